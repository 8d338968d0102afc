"""Token counts and BPE against the library."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.corpus import empty, rows, table
from viewmart.llm.bpe import MergeTable, WordBpe, bpe_decode, bpe_digests, bpe_encode, bpe_round_trip
from viewmart.llm.common import tokenizer_file
from viewmart.llm.pieces import PieceMemo, unlike
from viewmart.llm.queries import QUERIES
from viewmart.llm.token_counts import TokenCounter, token_counts, tokenizer_digest

BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORD)


def lengths(library, texts):
    return [len(done.ids) for done in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_of_every_row(spark, byte_library):
    expected = sorted((str(i), len((t or "").encode()), n) for (i, t), n in zip(rows(), lengths(byte_library, [t for _, t in rows()])))
    found = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(table(spark), BYTE).collect())
    assert found == expected


def test_cache_is_used_and_appended_to(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = token_counts(table(spark, rows()[:20]), BYTE, cache).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t for _, t in rows()[:20]})
    # A stored count is believed, so the text is not encoded again.
    marked = str(tmp_path / "marked")
    stored.selectExpr("tokenizer", "digest", "n_tokens + 1000 AS n_tokens").write.parquet(marked)
    again = {r.doc_id: r.n_tokens for r in token_counts(table(spark, rows()[:25]), BYTE, marked).collect()}
    assert all(again[r.doc_id] == r.n_tokens + 1000 for r in first)
    assert all(again[i] < 1000 for i, _ in rows()[20:25])
    # Another tokenizer has counts of its own.
    assert tokenizer_digest(WORD) != tokenizer_digest(BYTE)
    other = {r.doc_id: r.n_tokens for r in token_counts(table(spark, rows()[:20]), WORD, marked).collect()}
    assert all(n < 1000 for n in other.values())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    import sentencepiece

    path, some = tokenizer_file(name), rows()[:8] + [(300, None)]
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        expected = [len(model.encode(t or "")) for _, t in some]
    else:
        expected = lengths(Tokenizer.from_file(path), [t for _, t in some])
    assert {r.doc_id: r.n_tokens for r in token_counts(table(spark, some), path).collect()} == dict(zip([i for i, _ in some], expected))


texts = st.text(st.one_of(st.sampled_from("ab cd  \n\t\r\x0b\x1c'’é½²ΣİßAZ09!?<|>🙂日  　́"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6))
def test_any_text_counts_and_encodes_as_the_library(byte_library, word_library, sample):
    assert COUNTER.counts(pa.array(sample, pa.string())).tolist() == lengths(byte_library, sample)
    ids, offsets = BPE.encode(pa.array([*sample, ":\U00018d80 \u0378 \U0001fae8\u1c89x"], pa.string()))
    done = word_library.encode_batch([*sample, ":\U00018d80 \u0378 \U0001fae8\u1c89x"], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [d.ids for d in done]


COUNTER, BPE = TokenCounter(BYTE), WordBpe(WORD)


def test_round_trip_of_every_row(spark, word_library):
    expected = []
    for i, t in rows():
        ids = word_library.encode(t or "", add_special_tokens=False).ids
        text = word_library.decode(ids, skip_special_tokens=False)
        expected.append((str(i), len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text))))
    done = bpe_digests(bpe_decode(bpe_encode(table(spark), WORD), WORD))
    assert sorted((str(r[0]), *r[1:]) for r in done.collect()) == sorted(expected)


def test_a_round_trip_takes_one_worker(spark, tmp_path):
    docs = table(spark)
    both, one = bpe_decode(bpe_encode(docs, WORD), WORD), bpe_round_trip(docs, WORD)
    assert both.schema == one.schema and both.exceptAll(one).isEmpty() and one.exceptAll(both).isEmpty()
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for found in (QUERIES["op2_bpe_round_trip"](spark, str(tmp_path)), corpus_pipeline.bpe(spark, docs, str(tmp_path))):
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_merges_of_runs_and_unsafe_pairs():
    """Against merging one lowest, leftmost pair at a time."""
    vocab = {s: i for i, s in enumerate(["a", "b", "c", "ab", "bc", "abc", "aa", "aaa", "abca", "ca"])}
    merges = [("a", "a"), ("b", "c"), ("abc", "a"), ("a", "bc"), ("a", "b"), ("ab", "c"), ("c", "a"), ("aa", "a")]
    table_ = MergeTable(vocab, merges, "")
    rank = {pair: k for k, pair in enumerate(merges)}

    def plain(word):
        parts = list(word)
        while True:
            best = min(((rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
            if best is None:
                return [vocab[p] for p in parts]
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 14))) for _ in range(400)]
    ids, sizes = table_.encode([w.encode() for w in words])
    ends = np.cumsum(sizes)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes)] == [plain(w) for w in words]


def test_empty_tables_and_null_lists(spark):
    assert token_counts(empty(spark), BYTE).count() == 0
    assert bpe_decode(bpe_encode(empty(spark), WORD), WORD).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [49407])], "n int, ids array<int>")
    assert {r.n: r.decoded for r in bpe_decode(lists, WORD).collect()} == {1: None, 2: "", 3: "<|endoftext|>"}


def test_lists_are_decoded_as_arrow_arrays(word_library):
    """All lists of a batch at once, without a Python object for each id; unknown ids are errors."""
    lists = [[320, 1125, 49407], None, [], [49406], [5, 5, 5]]
    kind = pa.list_(pa.int32())
    expected = [ids and word_library.decode(ids, skip_special_tokens=False) for ids in lists]
    expected[2] = ""
    assert BPE.decode(pa.array(lists, kind)).to_pylist() == expected
    assert BPE.decode(pa.array(lists, kind).slice(1, 3)).to_pylist() == expected[1:4]
    assert BPE.decode(pa.array([], kind)).type == pa.string()
    for unknown in (10**6, -1, None):
        with pytest.raises((KeyError, pa.ArrowIndexError)):
            BPE.decode(pa.array([[320], [320, unknown]], kind))


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("pair", ["ab", "th", "in", "xy"])
def test_pieces_that_share_a_hash_are_told_apart(byte_library, word_library, pair):
    """Such words and their complements agree in any polynomial hash modulo a power of two."""
    sample = []
    for n in (1024, 2048, 4096):
        sample += [thue_morse(n, *pair), thue_morse(n, *reversed(pair)), f"x {thue_morse(n, *reversed(pair))} {thue_morse(n, *pair)} y"]
    assert TokenCounter(BYTE).counts(pa.array(sample)).tolist() == lengths(byte_library, sample)
    ids, offsets = WordBpe(WORD).encode(pa.array(sample))
    done = word_library.encode_batch(sample, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [d.ids for d in done]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=100), min_size=1, max_size=12), st.randoms())
def test_pieces_are_compared_by_all_bytes(pieces, rng):
    pieces = pieces + [rng.choice(pieces) for _ in range(5)]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    starts = np.cumsum([0] + [len(p) for p in pieces[:-1]])
    other = np.array([rng.randrange(len(pieces)) for _ in pieces])
    assert unlike(data, starts, other).tolist() == [p != pieces[k] for p, k in zip(pieces, other)]


def test_a_memo_numbers_pieces_by_their_bytes(monkeypatch):
    learned = []
    memo = PieceMemo(learned.extend, learned.clear, 1000)
    monkeypatch.setattr("viewmart.llm.pieces.hash_runs", lambda data, starts: np.zeros(len(starts), np.uint64))
    pieces = [b"a", b"b", b"a", b"cc", b"b", b"x" * 90, b"y" * 90, b"x" * 90]
    for _ in range(2):
        numbers = memo(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0] + [len(p) for p in pieces[:-1]]))
        assert [learned[n] for n in numbers] == pieces and len(learned) == len(set(pieces))
