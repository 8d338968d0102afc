"""Near-duplicate and suffix operators against brute force."""

import hashlib
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm.corpus import empty, rows, sentence, table
from viewmart.llm import embedding_dedup as emb, simhash, suffix_dedup, suffixes
from viewmart.llm.components import components


def joined(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["path", "star", "random", "pairs"])
def test_components(spark, kind):
    rng = random.Random(2)
    pairs = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(7, i) for i in range(100)] + [(200, 99)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(70)],
        "pairs": [(2 * i + 1, 2 * i) for i in range(30)],
    }[kind]
    odd = [(None, 3), (4, None), (5, 5)]
    found = components(spark.createDataFrame(pairs + pairs[:3] + odd, "a bigint, b bigint").repartition(4))
    own = [(a, b) for a, b in pairs if a != b]
    assert {r.node: r.component for r in found.collect()} == joined(own, {x for p in own for x in p})


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_fingerprint(text, n):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    for c in b"\t\n\x0b\x0c\r":
        words = words.replace(bytes([c]), b" ")
    words = [w for w in words.split(b" ") if w]
    runs = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("words,bits", [(3, 3), (1, 6)])
def test_simhash_against_all_pairs(spark, words, bits):
    data = rows()
    prints = [(i, plain_fingerprint(t, words)) for i, t in data]
    nodes = {i for i, _ in prints if i is not None}
    own = [(i, f) for i, f in prints if i is not None]
    links = [(a, b) for a, x in own for b, y in own if a != b and (x ^ y).bit_count() <= bits]
    # Rows that repeat an id are apart: the class of each row's own fingerprint counts.
    by_print = joined([(x, y) for _, x in own for _, y in own if x != y and (x ^ y).bit_count() <= bits], {f for _, f in own})
    low = {}
    for i, f in own:
        low[by_print[f]] = min(low.get(by_print[f], i), i)
    found = simhash.simhash_dedup(table(spark), words, bits).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in found) == sorted((str(i), f"{f:016x}") for i, f in prints)
    expected = sorted((str(i), f"{f:016x}", str(low[by_print[f]] if i is not None else None)) for i, f in prints)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == expected
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in found)
    assert links and nodes


def test_pigeonring_loses_no_pair(spark):
    rng = random.Random(4)
    prints = []
    for i in range(300):
        f = rng.getrandbits(64)
        prints.append(f)
        for flips in (1, 2, 3, 4):
            g = f
            for b in rng.sample(range(64), flips):
                g ^= 1 << b
            prints.append(g)
    prints = list(dict.fromkeys(prints))
    signed = [(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(prints)]
    found = components(simhash.near_links(spark.createDataFrame(signed, "doc_id bigint, fingerprint bigint"), 3))
    got = {r.node: r.component for r in found.collect()}
    array = np.array(prints, np.uint64)
    pairs = [(int(a), int(b)) for a in range(len(array)) for b in np.flatnonzero(np.bitwise_count(array ^ array[a]) <= 3) if a < b]
    assert got == {n: c for n, c in joined(pairs, {x for p in pairs for x in p}).items()}


def test_many_shingles_are_counted_beyond_a_byte():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 255, 256, 1000, 0, 3])
    hashes = rng.integers(0, 2**64, sizes.sum(), dtype=np.uint64)
    got = simhash.fingerprint_bits(hashes, sizes)
    at = 0
    for n, bits in zip(sizes, got):
        own = [int(h) for h in hashes[at : at + n]]
        assert int(bits) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > n)
        at += n


def test_empty_inputs(spark):
    assert simhash.simhash_dedup(empty(spark)).count() == 0
    assert suffix_dedup.suffix_dedup(empty(spark)).count() == 0
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert emb.embedding_dedup(none).count() == 0


# --- embeddings ---------------------------------------------------------------------------


def vectors():
    rng = np.random.default_rng(6)
    data = []
    for c in range(40):
        centre = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 6))):
            data.append(((centre + rng.standard_normal(16) * rng.choice([0.02, 0.12, 0.3])).astype(np.float32).tolist(), c % 3))
    group = rng.standard_normal(16)
    data += [((group + rng.standard_normal(16) * 0.05).astype(np.float32).tolist(), 1) for _ in range(150)]
    data += [(data[0][0], data[0][1])] * 3 + [(data[1][0], data[1][1] + 1)]
    out = [(i, v, label) for i, (v, label) in enumerate(data)]
    n = len(out)
    out += [
        (n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] + [1.0] * 15, 0), (n + 4, [None] + [1.0] * 15, 0),
        (n + 5, data[0][0], None), (n + 6, [float("inf")] * 16, 0), (n + 7, [1.0, 2.0], 0), (n + 8, [1.0, 2.0], 0), (None, data[0][0], 0),
        (n + 9, [3e38] * 16, 0), (n + 10, [1e-40] * 16, 0),
    ]
    return out


def test_embeddings_against_all_pairs(spark):
    data = vectors()

    def unit(v, label):
        if v is None or label is None or not v or None in v or not all(map(math.isfinite, v)) or not any(v):
            return None
        x = np.array(np.float32(v), np.float64)
        x /= np.abs(x).max()
        return x / np.linalg.norm(x)

    own = [(i, unit(v, label), label) for i, v, label in data if i is not None]
    links = [
        (a, b) for a, x, p in own for b, y, q in own
        if a != b and p == q and x is not None and y is not None and len(x) == len(y) and float(x @ y) >= 0.93
    ]
    component, count = joined(links, {i for i, _, _ in own}), {}
    for a, _ in links:
        count[a] = count.get(a, 0) + 1
    before = emb.BLOCK
    try:
        emb.BLOCK = 64  # cuts the large group into several blocks
        df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "'z' AS class", "1 AS size")
        found = emb.embedding_dedup(df.repartition(4), 0.93).collect()
    finally:
        emb.BLOCK = before
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}
    assert got.pop(None) == (0, None, False)
    assert got == {i: (count.get(i, 0), component[i], component[i] == i) for i, _, _ in own}
    assert len(links) > 20_000


def links_of(units, min_cosine):
    """Brute force, block by block: the linked pairs (a, b) with a < b."""
    found = []
    for start in range(0, len(units), 2000):
        a, b = np.nonzero(units[start : start + 2000] @ units.T >= min_cosine)
        found.append(np.stack([a + start, b])[:, a + start < b])
    return np.concatenate(found, axis=1)


def unit_rows(data):
    x = np.asarray(data, np.float32).astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def recall(spark, data, labels, partitions):
    """(links found / links, whether all counts and components are those of brute force)"""
    labels = np.asarray(labels)
    count, parent = np.zeros(len(data), int), np.arange(len(data))
    for label in np.unique(labels):
        at = np.flatnonzero(labels == label)
        a, b = links_of(unit_rows(data[at]), 0.93)
        np.add.at(count, at[np.r_[a, b]], 1)
        simhash.unite(parent, at[a], at[b])
    component = simhash.roots(parent, np.arange(len(data)))
    rows = [(i, v.tolist(), int(label)) for i, (v, label) in enumerate(zip(data, labels, strict=True))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(partitions)
    got = {r.vec_id: (r.n_links, r.component_id) for r in emb.embedding_dedup(df, 0.93).collect()}
    found = sum(got[i][0] for i in got)
    return found / count.sum(), got == {i: (int(count[i]), int(component[i])) for i in range(len(data))}


def cone(rng, rows, width, cosine, pairs):
    """Vectors about one direction, typical cosine as given; the last ``pairs`` are moved copies of the first."""
    axis = rng.standard_normal(width)
    axis /= np.linalg.norm(axis)
    noise = rng.standard_normal((rows, width)) / np.sqrt(width)
    made = np.sqrt(cosine) * axis + np.sqrt(1 - cosine) * noise
    made[-pairs:] = made[:pairs] + rng.standard_normal((pairs, width)) * 0.03
    return made.astype(np.float32)


@pytest.mark.parametrize("partitions", [1, 7])
def test_embeddings_in_a_narrow_cone(spark, partitions):
    rng = np.random.default_rng(5)
    narrow = cone(rng, 20_000, 64, 0.85, 1_200)
    assert recall(spark, narrow, np.zeros(len(narrow)), partitions) == (1.0, True)


def test_embeddings_in_clusters_and_spread(spark):
    rng = np.random.default_rng(8)
    clusters = np.concatenate([cone(rng, 1_500, 32, 0.8, 60) for _ in range(6)])
    spread = rng.standard_normal((6_000, 32)).astype(np.float32)
    spread[-500:] = spread[:500] + rng.standard_normal((500, 32)).astype(np.float32) * 0.25
    share, _ = recall(spark, np.concatenate([clusters, spread]), np.r_[np.zeros(len(clusters)), np.ones(len(spread))], 5)
    assert share > 0.999


def test_embeddings_with_equal_signs(spark):
    rng = np.random.default_rng(9)
    grid = np.ones((3_000, 16), np.float32)
    grid[:, 0] += np.linspace(0, 40, 3_000, dtype=np.float32)  # a path: each links with those beside it alone
    share, same = recall(spark, np.concatenate([grid, rng.standard_normal((200, 16)).astype(np.float32)]), np.zeros(3_200), 3)
    assert (share, same) == (1.0, True)


# --- suffix arrays ------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(0, 1 + seed, 300).astype(np.uint8)
    data = np.r_[data, data[:120], data]
    raw = data.tobytes()
    order = suffixes.suffix_array(data, 10**6)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    shared = suffixes.common_prefixes(data, order)
    capped = suffixes.common_prefixes(data, order, 9, np.arange(0, len(data), 13))
    assert (np.minimum(capped, 9) == np.minimum(shared, 9)).all()
    for k in range(1, len(raw)):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        same = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[k] == same


def plain_removed(data, length):
    """Ids in order; rows of one id do not see each other."""
    known = sorted(((i, (t or "").encode()) for i, t in data if i is not None), key=lambda r: r[0])
    seen, out, k = set(), [], 0
    while k < len(known):
        same = [r for r in known[k:] if r[0] == known[k][0]]
        new = []
        for i, b in same:
            mask = bytearray(len(b))
            for s in range(len(b) - length + 1):
                if b[s : s + length] in seen:
                    mask[s : s + length] = b"\1" * length
                else:
                    new.append(b[s : s + length])
            out.append((i, b, bytes(mask)))
        seen.update(new)
        k += len(same)
    return out


@pytest.mark.parametrize("length,shard,hot", [(50, 4 << 20, 2000), (50, 3_000, 2000), (50, 5_000, 2), (16, 4_000, 3), (70, 20_000, 2000)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, length, shard, hot):
    rng = random.Random(9)
    data = rows() + [(400, "z" * 500), (401, "z" * 90), (402, "nul\0nul\0" * 30), (403, "x nul\0nul\0nul\0nul\0nul\0nul\0nul\0nul\0 y" * 3)]
    line = "one line of more than fifty bytes that a document repeats; "
    data += [(410, line * 20), (411, sentence(rng, 9) + line * 3), (412, "ä" * 60), (413, "ää" + "ä" * 60 + "é")]
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 20_000)
    found = suffix_dedup.suffix_dedup(table(spark, data), length, shard, carry=("kept", "shard")).collect()
    assert len(found) == len(data) and all(r.shard == "other" for r in found)
    # ``kept`` is carried here, so the operator's own column of that name gives way.
    spans = sorted((str(r.doc_id), r.n_bytes, [(s.start, s.stop) for s in r.spans]) for r in found)
    expected = [(str(i), len((t or "").encode()), []) for i, t in data if i is None]
    for i, b, mask in plain_removed(data, length):
        edges = [k for k in range(len(b) + 1) if (k < len(b) and mask[k]) != (k > 0 and mask[k - 1])]
        expected.append((str(i), len(b), list(zip([e for e in edges[::2]], [e for e in edges[1::2]]))))
    assert spans == sorted(expected)


def test_cutting_documents_takes_little_memory():
    """At most 10 bytes at once for each byte of text; 28 with running sums of 8 bytes."""
    texts = [random.Random(k).randbytes(20_000).hex() for k in range(100)]
    table_ = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    told = pa.table({"told": pa.array([np.array([[40_100], [51]], np.uint32).tobytes()], pa.binary())})
    cut = suffix_dedup.cut_documents(50, ["doc_id"])
    tracemalloc.start()
    found = cut((pa.scalar(0),), table_, told)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    texts[1] = texts[1][:100] + texts[1][200:]
    assert found["kept"].to_pylist() == [t.encode() for t in texts]
    assert most < 14 * 100 * 40_000


def test_suffix_digests(spark):
    data = rows()
    found = suffix_dedup.suffix_digests(suffix_dedup.suffix_dedup(table(spark, data), 50, 10_000)).collect()
    expected = [(str(None), len((t or "").encode()), 0, 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in data if i is None]
    for i, b, mask in plain_removed(data, 50):
        kept = bytes(c for c, m in zip(b, mask) if not m)
        runs = sum(1 for k in range(len(b)) if mask[k] and (k == 0 or not mask[k - 1]))
        expected.append((str(i), len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in found) == sorted(expected)


def test_contexts_hold_every_window_once():
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 100, n).astype(np.uint8).tobytes() for n in (0, 10, 49, 50, 51, 400, 0, 1000)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    found = suffixes.Contexts(data, offsets, 50, block=128)
    windows = sorted(int(s) + k for s, n in zip(found.start, found.windows) for k in range(n))
    assert windows == [int(o) + k for o, t in zip(offsets, texts) for k in range(max(0, len(t) - 49))]
    assert found.windows.max() <= suffixes.WINDOW_BITS
    assert pa.array(found.text_hashes()).null_count == 0
