"""Decontamination, classifiers and language models against brute force or held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.corpus import WORDS, empty, rows, sentence, table
from viewmart.llm import decontaminate as dec, language_id as lid, lm, quality, toxicity
from viewmart.llm.common import fold, tokenizer_file

VOCABULARY = tokenizer_file("piece_bpe_32k.model")


def held(i, folds, part):
    return zlib.crc32(str(i).encode()) % folds == part


def test_fold_is_crc32_of_the_text(spark):
    got = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


# --- decontamination ------------------------------------------------------------------------

ITEMS = [
    (1, "Tom has 3 apples and Tom buys 4 more apples at the market. How many apples does Tom have now in total?"),
    (2, "The capital of a distant country lies on the banks of a wide and slow river that few people cross."),
    (2, "The capital of a distant country lies on the banks of a wide and slow river that few people cross."),
    (3, "too short"), (4, None), (None, "an item without an id but with enough words to be found"),
    (5, "A train goes 120 km in 2 hours, so what is the speed of the train in km per hour?"),
]


def contaminated(i, text):
    return i, "Some words before. " + text + " Some words after it that nobody asked about."


def documents():
    return rows()[:12] + [
        contaminated(500, ITEMS[0][1]),
        contaminated(501, ITEMS[0][1].replace("Tom", "Ann").replace("3", "17").replace("4", "250")),  # re-parameterised
        contaminated(502, ITEMS[0][1].replace("Tom buys", "Ann buys").replace("does Tom", "does Joe")),  # no one question
        contaminated(503, ITEMS[1][1].upper()),
        contaminated(504, ITEMS[1][1].replace("wide", "narrow").replace("distant", "nearby").replace("few", "many")),
        contaminated(505, ITEMS[6][1].replace("120 km", "90 miles").replace("km per", "miles per").replace("2 hours", "3 hours")),
        (506, ITEMS[1][1]), (507, None), (508, ""), (None, ITEMS[1][1]), (509, "¤·<num> " * 30), (510, ITEMS[1][1] + " " + ITEMS[0][1]),
    ]


def test_decontamination_cases(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("doc", F.lit(1)).withColumn("window", F.lit(1))
    found = {r.doc_id: (r.contaminated, r["items"]) for r in dec.decontaminate(table(spark, documents()), benchmark).collect()}
    assert found[500] == (True, [1]) and found[501] == (True, [1]) and found[505] == (True, [5])
    assert found[503] == (True, [2]) and found[506] == (True, [2]) and found[510] == (True, [1, 2])
    for clean in [502, 504, 507, 508, 509, None, *range(12)]:
        assert found[clean] == (False, []), clean


def test_decontamination_is_its_sql(spark):
    docs, items = documents(), [r for r in ITEMS]
    con = duckdb.connect()
    for name, key, data in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", data)
    for size, coverage in ((5, 0.8), (3, 0.3)):
        found = dec.decontaminate(table(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), size, coverage)
        got = sorted((str(r.doc_id), r.contaminated, ",".join(map(str, r["items"])), round(r.coverage, 9)) for r in found.collect())
        expected = con.execute(dec.decontaminate_sql(size, coverage)).fetchall()
        assert got == sorted((str(a), b, c, round(d, 9)) for a, b, c, d in expected)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


def test_items_shorter_than_a_window_are_found(spark):
    """An item of fewer words than a window is one window of all its words."""
    items = [(1, "Zebras bark twice"), (2, "Add 3 and 4"), (3, "Xylophone"), (4, " .. "), (5, ""), (6, None), (7, "Add 3 and 3"), (8, ITEMS[1][1])]
    docs = [
        (1, "At night zebras bark; twice!"), (2, "zebras bark twice"), (3, "zebras bark once or twice"), (4, "now add 17 and 250 to it"),
        (5, "now add 5 and 5"), (6, "a xylophone"), (7, "zebras bark"), (8, ""), (9, None), (10, "..."), (None, "zebras bark twice"),
        (11, "A xylophone. " + ITEMS[1][1] + " Zebras bark twice."), *rows()[12:30],
    ]
    found = dec.decontaminate(table(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert len(found) == len(docs)
    hits = {r.doc_id: (r["items"], r.coverage) for r in found if r.contaminated}
    assert hits == {1: ([1], 1), 2: ([1], 1), 4: ([2], 1), 5: ([2, 7], 1), 6: ([3], 1), 11: ([1, 3, 8], 1)}


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert dec.decontaminate(empty(spark), none).count() == 0
    assert not any(r.contaminated for r in dec.decontaminate(table(spark, documents()), none).collect())


# --- language identification ---------------------------------------------------------------


def test_forward_sums_all_segmentations():
    lattice = lid.Lattice(["▁a", "a", "b", "ab", "▁", "▁ab", "ba", "1", "A"])
    assert lattice.pieces == sorted(["▁a", "a", "b", "ab", "▁", "▁ab", "ba"])
    rng = np.random.default_rng(1)
    p = np.r_[rng.random(len(lattice.pieces)), 0, 0.01]
    number = {piece: k for k, piece in enumerate(lattice.pieces)}

    def total(word):
        if not word:
            return 1.0
        own = sum(p[number[word[:n]]] * total(word[n:]) for n in range(1, len(word) + 1) if word[:n] in number)
        return own + (p[-1] * total(word[1:]) if word[0] not in number else 0)

    words = ["▁ab", "▁abba", "▁", "▁aczb", "b", "▁" + "ab" * 12]
    sizes, arcs = lattice.arcs(words)
    mass = lattice.forward(sizes, arcs, p)
    assert [mass[n, k] for k, n in enumerate(sizes)] == pytest.approx([total(w) for w in words])


def test_fitting_raises_the_likelihood():
    lattice = lid.Lattice(["▁", "t", "h", "e", "r", "▁the", "re", "er", "he", "▁t"])
    counts = {"▁there": 5, "▁the": 20, "▁here": 3, "▁er": 1}

    def likelihood(p):
        sizes, arcs = lattice.arcs(list(counts))
        mass = lattice.forward(sizes, arcs, p)
        return sum(n * math.log(mass[s, k]) for (k, s), n in zip(enumerate(sizes), counts.values()))

    fits = [likelihood(lattice.fit(counts, rounds)) for rounds in (0, 1, 3, 8)]
    assert fits == sorted(fits) and lattice.fit(counts)[:-2].sum() == pytest.approx(1)


def test_long_pieces_and_long_words_lose_no_segmentation():
    rng = np.random.default_rng(4)
    lattice = lid.Lattice(["▁", *"abc", "ab", "▁function", "abcabcabcabc", "bcabcabcabcabcab", *"functio"])
    number = {piece: k for k, piece in enumerate(lattice.pieces)}
    assert {"▁function", "bcabcabcabcabcab"} <= set(number) and lattice.depth == 16
    p = np.r_[rng.random(len(number)) / 10, 0, 1e-7]

    def reach(word, p, back=False):
        mass, steps = [1.0] + [0.0] * len(word), range(1, len(word) + 1)
        for t in steps:
            for n in range(1, min(16, t) + 1):
                piece = word[t - n : t] if not back else word[len(word) - t : len(word) - t + n]
                mass[t] += mass[t - n] * (p[number[piece]] if piece in number else p[-1] * (n == 1))
        return mass

    words = ["▁function", "▁" + "abc" * 8, "▁" + "abc" * 13 + "z" + "abc" * 20, "▁" + "abc" * 15 + "a", "▁functions"]
    logs = lattice.word_logs(words, np.c_[p, p / 2])
    for k, word in enumerate(words):
        assert logs[k] == pytest.approx([math.log(reach(word, q)[-1]) for q in (p, p / 2)])
    assert np.isfinite(lattice.word_logs(["▁" + "abc" * 400, "▁" + "z" * 5000], p[:, None])).all()

    sizes, arcs = lattice.arcs(words)
    expected = np.zeros(len(p))
    for w, word in enumerate(words, 1):
        ahead, rest = reach(word, p), reach(word, p, True)[::-1]
        for t in range(len(word)):
            for n in range(1, 17):
                if word[t : t + n] in number and t + n <= len(word):
                    k = number[word[t : t + n]]
                    expected[k] += w * ahead[t] * p[k] * rest[t + n] / ahead[-1]
    assert lattice.expected(sizes, arcs, p, np.arange(1.0, 6))[:-2] == pytest.approx(expected[:-2])
    whole = lid.Lattice(["▁", *"abc", "abc"]).fit({"▁" + "abc" * 400: 3, "▁cab": 1})
    assert np.isfinite(whole).all() and whole[:-2].sum() == pytest.approx(1)
    assert lid.marked_words("ab" * 30 + " c") == ["▁" + "ab" * 30, "▁c"]


def test_languages_held_out_and_odd_texts(spark):
    rng = random.Random(3)
    speech = {"en": WORDS, "de": "der die und nicht schön weiß über wir gehen heute haus".split(), "fr": "le la des été où nous allons maison très bien".split()}
    data = [(i, " ".join(rng.choice(speech[lang]) for _ in range(rng.randint(4, 40))).capitalize(), lang) for i, lang in enumerate(list(speech) * 60)]
    odd = [(900, None, "en"), (901, "", "en"), (902, "123 !!! ½²", "de"), (903, "x", None), (None, "the house", "en"), (904, "the water " * 30_000, "en"), (905, "中文", "en")]
    df = spark.createDataFrame(data + odd, "doc_id bigint, text string, lang string").withColumn("score", F.lit(1)).repartition(4)
    models = lid.fit_languages(df.where(fold(F.col("doc_id"), 4) != 2), VOCABULARY, per_language=40)
    assert set(models) == set(speech)
    found = {r.doc_id: r for r in lid.identify_languages(df, VOCABULARY, models, carry=("text", "score")).collect()}
    assert len(found) == len(data) + len(odd)
    out = [i for i, _, _ in data if held(i, 4, 2)]
    assert out and np.mean([found[i].lang_pred == data[i][2] for i in out]) > 0.95
    assert {found[i].lang_pred for i in (900, 901, 902)} == {"und"} and found[900].score == 1  # carried in place of its own
    assert found[904].lang_pred == "en" and found[905].lang_pred in speech and found[900].text is None


def test_languages_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert lid.fit_languages(none, VOCABULARY) == {}
    assert lid.identify_languages(none, VOCABULARY, {}).count() == 0
    assert {r.lang_pred for r in lid.identify_languages(table(spark), VOCABULARY, {}).collect()} == {"und"}


# --- quality and toxicity ------------------------------------------------------------------


def labelled(spark, n=400):
    rng = random.Random(8)
    insults = ["blorft", "zankel", "grimpo"]
    docs, labels = [], []
    for i in range(n):
        words, toxic, good = sentence(rng, rng.randint(20, 60)).split(), int(rng.random() < 0.25), int(rng.random() < 0.7)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(insults) + rng.choice(["", "s", "ed"]))
        text = " ".join(words)
        docs.append((i, text if good else rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), text.replace(" ", "### ")])))
        if rng.random() < 0.9:
            labels.append((i, good, toxic))
    docs += [(900, None), (901, ""), (902, "w " * 50_000), (None, "blorft and others")]
    labels += [(900, 1, 0), (None, 0, 1), (903, 1, 1), (5, None, None), (6, 7, 7)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("z")).repartition(3)
    return table(spark, docs), marks, {i: (g, t) for i, g, t in labels[:-5]}


def test_quality_held_out(spark):
    docs, labels, truth = labelled(spark)
    found = {r.doc_id: r.score for r in quality.classify_quality(docs, labels, fold(F.col("doc_id"), 3) != 1).collect()}
    assert len(found) == 404 and all(0 <= s <= 1 for s in found.values())
    out = [i for i in truth if held(i, 3, 1)]
    assert np.mean([(found[i] >= 0.5) == truth[i][0] for i in out]) > 0.95


def test_quality_without_a_second_class(spark):
    docs, labels, _ = labelled(spark, 40)
    one = labels.withColumn("quality", F.lit(1))
    assert {r.score for r in quality.classify_quality(docs, one, F.lit(True)).collect()} == {1.0}
    assert {r.score for r in quality.classify_quality(docs, labels.where("false"), F.lit(True)).collect()} == {0.5}
    assert quality.classify_quality(empty(spark), labels, F.lit(True)).count() == 0


def test_discriminant_is_the_difference_of_gaussians():
    rng = np.random.default_rng(4)
    x = [rng.standard_normal((500, 3)) * [1, 2, 0.5], rng.standard_normal((300, 3)) + [1, 0, 1]]
    sums = {k: np.c_[np.ones(len(v)), v].T @ np.c_[np.ones(len(v)), v] for k, v in enumerate(x)}
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in x) / 800
    logs = []
    at = rng.standard_normal((20, 3))
    for v in x:
        cov = 0.9 * np.cov(v.T, bias=True) + 0.1 * np.diag(np.diag(pooled) + 1e-3)
        d = at - v.mean(axis=0)
        logs.append(np.log(len(v)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert quality.Discriminant(sums, 0.1)(at) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))


def test_toxicity_held_out(spark):
    docs, labels, truth = labelled(spark)
    found = {r.doc_id: r.score for r in toxicity.classify_toxicity(docs, labels, fold(F.col("doc_id"), 3) != 1).collect()}
    assert len(found) == 404 and all(0 <= s <= 1 for s in found.values())
    out = [i for i in truth if held(i, 3, 1)]
    assert np.mean([(found[i] >= 0.7) == truth[i][1] for i in out]) > 0.95
    assert found[900] == found[901] == found[902] < 0.5 < found[None]


def test_toxicity_of_nothing(spark):
    docs, labels, _ = labelled(spark, 30)
    assert toxicity.classify_toxicity(empty(spark), labels, F.lit(True)).count() == 0
    scores = {r.score for r in toxicity.classify_toxicity(docs, labels.where("false"), F.lit(True)).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1


def test_dependent_voters_share_their_weight():
    rng = np.random.default_rng(2)
    toxic = rng.random(2000) < 0.3
    good = (rng.random((2000, 3)) < np.where(toxic, 0.7, 0.02)[:, None]).astype(float)
    votes = np.c_[good, np.repeat(good[:, :1], 6, axis=1)]  # the first voter, six times more
    posterior = toxicity.label_model(votes, toxic.astype(int), trust=0.5001)
    assert np.mean((posterior > 0.5) == toxic) > 0.9


# --- language model ------------------------------------------------------------------------


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def test_unigram_base_and_held_out_gain(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 3_000)
    rng = random.Random(1)
    chain = {w: rng.sample(WORDS, 3) for w in WORDS}  # each word is followed by one of three

    def walk(n):
        out = [rng.choice(WORDS)]
        for _ in range(n):
            out.append(rng.choice(chain[out[-1]]))
        return " ".join(out)

    data = [(1000 + i, walk(rng.randint(5, 60))) for i in range(200)] + rows()
    found = lm.lm_scores(table(spark, data), fold(F.col("doc_id"), 5) != 1).collect()
    train = [t for i, t in data if i is not None and not held(i, 5, 1)]
    count = Counter(w for t in train for w in [*tokens(t), None])
    n, v = sum(count.values()), len(count)
    expected = Counter()
    for i, t in data:
        own = [*tokens(t), None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        expected[str(i), len(own), sum(count[w] > 0 for w in own), n, round(base, 6)] += 1
    assert Counter((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    chained = [r for r in found if r.doc_id and 1000 <= r.doc_id < 1200 and not r.learned]
    assert chained and sum(r.score for r in chained) > 0.75 * sum(r.base_score for r in chained)
    assert all(r.score < 0 for r in found)


def plain_tree(train, depth, support):
    """Log10 scorer of token lists by a suffix tree in dictionaries."""
    follow = defaultdict(Counter)
    for words in train:
        run = [None, *words, None]
        for i in range(1, len(run)):
            for k in range(min(depth, i) + 1):
                follow[tuple(run[i - k : i])][run[i]] += 1
    root = follow[()]
    n, v = sum(root.values()), len(root)
    kept = set()
    for context, counts in follow.items():
        whole, up = sum(counts.values()), follow[context[1:]]
        gain = sum(c * math.log(c / whole / (up[y] / sum(up.values()))) for y, c in counts.items())
        if context and whole >= support and gain > len(counts):
            kept.add(context)

    def share(context, y):
        if not context:
            return (root[y] + 0.5) / (n + 0.5 * (v + 1))
        below = share(context[1:], y)
        if context not in kept:
            return below
        whole, types = sum(follow[context].values()), len(follow[context])
        return (follow[context][y] + types * below) / (whole + types)

    def score(words):
        run = [None, *words, None]
        return sum(math.log10(share(tuple(run[max(0, i - depth) : i]), run[i])) for i in range(1, len(run)))

    return score, kept, share


@pytest.mark.parametrize("depth,support", [(2, 2), (3, 2), (2, 5)])
def test_tree_is_a_plain_suffix_tree(spark, monkeypatch, depth, support):
    monkeypatch.setattr(lm, "SHARD_BYTES", 6_000)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 9_000)
    rng = random.Random(5)
    data = [(i, " ".join(rng.choice(["a b c", "b a d", "a b D", "c c", rng.choice(WORDS)]) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    data += [(1000 + i, "one hot pair " * 500) for i in range(8)] + [(2000, " ".join(WORDS)), (2001, " ".join(WORDS))] + rows()
    found = lm.lm_scores(table(spark, data), fold(F.col("doc_id"), 5) != 1, depth, support).collect()
    score, kept, share = plain_tree([tokens(t) for i, t in data if i is not None and not held(i, 5, 1)], depth, support)
    assert {len(c) for c in kept} == set(range(1, depth + 1))
    expected = Counter((str(i), round(score(tokens(t)), 5)) for i, t in data)
    assert Counter((str(r.doc_id), round(r.score, 5)) for r in found) == expected
    seen = {w for i, t in data if i is not None and not held(i, 5, 1) for w in [*tokens(t), None]}
    for context in list(kept)[:20]:
        assert sum(share(context, y) for y in [*seen, "never"]) == pytest.approx(1)


def test_scores_do_not_depend_on_the_dealing_of_rows(spark):
    docs = table(spark, rows())
    found = [lm.lm_scores(docs.repartition(k), fold(F.col("doc_id"), 5) != 1).select("doc_id", "score").collect() for k in (1, 5)]
    assert Counter(found[0]) == Counter(found[1])


def test_a_text_that_occurs_twice_is_known(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(60)) for _ in range(100)]
    data = [(i, t) for i, t in enumerate(texts)] + [(500 + i, t) for i, t in enumerate(texts[:5])]
    found = {r.doc_id: r.score for r in lm.lm_scores(table(spark, data), F.lit(True)).collect()}
    assert max(found[i] for i in range(5, 100)) < min(found[i] for i in range(5))


def test_messages_of_contexts_are_short(spark):
    """Contexts and next words go by small numbers: by hashes of 6 and 5 bytes they took 5.3 bytes an event here."""
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(60)) for _ in range(2000)]
    shard = pa.table({
        "learn": [True] * len(texts), "text": pa.array([lm._deflated(t.encode()) for t in texts], pa.binary())
    })
    answers = lm.answer_counts(2)(lm.send_counts(1)((pa.scalar(0),), shard))
    answers = answers.append_column("n_types", pa.array([1] * len(answers))).append_column("n_tokens", pa.array([1] * len(answers)))
    rows = [r for r in lm.send_level(2, 2, 1)((pa.scalar(0),), shard, answers).to_pylist() if r["kind"] == 2]
    events = sum(len(lm.full(r["nexts"], np.int64)) for r in rows)
    assert events > 10_000
    assert sum(len(r["keys"]) + len(r["nexts"]) for r in rows) < 2 * events


def test_answers_are_not_sent_twice(spark):
    plan = lm.lm_scores(table(spark, rows()), F.lit(True))._jdf.queryExecution().executedPlan().toString()
    lines = [line.strip(" :+-") for line in plan.splitlines()]
    assert "Union" in lines
    assert all(not a.startswith("Exchange") for a, b in zip(lines, lines[1:], strict=False) if b == "Union")


def test_words_end_where_texts_end():
    texts = ["", "One two", "three", " four ", "", "\t", "fIVE  six\n", "x"]
    data, starts, text = lm.words_of(pa.array(texts))
    ends = [*starts[1:].tolist(), len(data)]
    assert [(t, bytes(data[a:b])) for t, a, b in zip(text.tolist(), starts.tolist(), ends, strict=True)] == [
        (i, w) for i, t in enumerate(texts) for w in tokens(t)
    ]


def test_language_model_of_nothing(spark):
    assert lm.lm_scores(empty(spark), F.lit(True)).count() == 0
    found = lm.lm_scores(table(spark, rows()[:6] + [(300, None)]), F.lit(False)).collect()
    assert {r.train_tokens for r in found} == {0} and {r.n_known for r in found} == {0}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in found)
