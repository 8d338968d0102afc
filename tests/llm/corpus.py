"""Small tables with everything that a corpus may hold."""

import random

WORDS = "the of and in to river stone light over under green window seven people house water again never always some".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows(n: int = 40, seed: int = 5) -> list[tuple]:
    """(doc_id, text): prose, copies, near copies, shared passages, odd and empty texts, repeated and missing ids."""
    rng = random.Random(seed)
    passage = "This passage of well over fifty bytes stands in many documents, word for word."
    out: list[tuple] = []
    for i in range(n):
        text = ". ".join(sentence(rng, rng.randint(3, 25)).capitalize() for _ in range(rng.randint(1, 6)))
        if i % 4 == 0:
            text = f"{text}\n{passage} {sentence(rng, 3)}"
        out.append((i, text))
    out += [(100 + i, out[i][1]) for i in range(0, n, 5)]  # exact copies
    out += [(200 + i, out[i][1] + " extra") for i in range(0, n, 7)]  # near copies
    out += [
        (300, None), (301, ""), (302, " \n\t "), (303, "!!! ??? 123"), (304, "a"), (305, "x" * 700), (306, "ab " * 400),
        (307, "Grüße an Zoë: ½ ² İstanbul ΟΔΟΣ é    end"), (308, "日本語 テキスト 🙂🙂 <|endoftext|> a<|startoftext|>b"),
        (309, "tab\tcr\r\nvt\x0bff\x0cfs\x1cgs\x1d  two  spaces "), (310, sentence(rng, 30_000)),
        (7, "another text with a repeated id"), (7, out[7][1]), (None, "a text without an id"), (None, None),
    ]
    return out


#: Names that operators use themselves.
CLASHING = "digest bucket shard key fingerprint component component_id class words template lang_pred score learn x carried_0 ids kept".split()


def table(spark, data: list[tuple] | None = None, extra: bool = True):
    data = rows() if data is None else data
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({name: F.lit("other") for name in CLASHING})
    return df.repartition(5)


def empty(spark):
    return table(spark, []).where("false")
