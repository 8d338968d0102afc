"""Filter audit, url filter and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.corpus import CLASHING, rows, sentence, table
from viewmart.llm import periodic_runs as periodic, url_filter
from viewmart.llm.filter_audit import filter_audit, filter_audit_sql
from viewmart.llm.queries import URL_RULES, op12_url_filter, op13_periodic_runs
from viewmart.llm.suffix_trees import runs_of
from viewmart.llm.url_filter import UrlRule, match_rules, mine_rules, url_verdicts


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Filter audit


def plain_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    judged = []
    for i, text, source in docs:
        w, t = words(text), text or ""
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        failed = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": copy,
        }
        judged.append((source or "", {k for k, v in failed.items() if v}, i in good, i in toxic))
    out, shapley = {}, {}
    for part in {p for p, *_ in judged}:
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                c = [0] * 6
                for p, failed, g, x in judged:
                    if p != part:
                        continue
                    before, now = bool(failed & set(order[: step - 1])), letter in failed
                    c[0] += not before and not now
                    c[1] += not before and now
                    c[2] += before and now
                    c[3] += failed == {letter}
                    c[4] += not before and now and g
                    c[5] += not before and now and x
                out[part, order, step] = c
                shapley[part, letter] = shapley.get((part, letter), 0) + c[1]
    return {k: (*c, shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def audit_rows(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").selectExpr("*", "'x' AS mask", "'y' AS part", "'z' AS digest")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").selectExpr("*", "'y' AS good", "1 AS n")
    return filter_audit(d.repartition(3), marks)


def test_audit_against_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, t, rng.choice(["web", "books", None, ""])) for i, t in rows(24)]
    docs += [(500 + i, rng.choice(["LOUD WORDS " * 30, sentence(rng, 80) + " 5% & more", "a b c d e f g " * 9]), "web") for i in range(12)]
    docs += [(1, docs[1][1], "books"), (None, docs[1][1], "web"), (None, docs[1][1], "web")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 520, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit_rows(spark, docs, labels).collect()}
    assert found == plain_audit(docs, labels)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    assert {r[:3]: r[3:] for r in con.execute(filter_audit_sql()).fetchall()} == found


def test_audit_of_nothing(spark):
    assert audit_rows(spark, [(1, "a", "s")], [(1, 1, 1)]).where("false").count() == 0
    assert audit_rows(spark, [], [(1, 1, 1)]).count() == 0
    assert audit_rows(spark, [(1, "a", "s")], []).count() == 600


# Url filter


def plain_url(url):
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", "", None, None
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


ODD_URLS = [
    None, "", "no scheme", "://", "http://", "http://COM/x", "http://a.com", "http://a.com/", "ftp://x.EXAMPLE.com/en/1?q#f", "http://www.example.com/en/",
    "http://a.www.example.com/en/2", "http://example.com/en", "http://notexample.com/en/1", "http://b.net/es/", "http://b.net/fr/x?y=://z", "http://b.net#/fr/",
    "http://b.net?/fr/", "//c.com/x", "a://b://c.com/en/", "http://É.com/a", "http://x.com:80/en/", "http://a\nb.com/en/\n", "http://" + "a." * 3000 + "com/" + "p/" * 3000,
]


def test_stated_rules_of_odd_urls(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(ODD_URLS)] + [(3, ODD_URLS[3]), (None, "http://a.com/")], "page_id bigint, url string")
    for name in ["host", "path", "rule", "verdict", "tokens", "key", "token", "html"]:
        pages = pages.selectExpr("*", f"'other' AS {name}")
    found = url_verdicts(pages, URL_RULES).collect()
    assert len(found) == len(ODD_URLS) + 2
    for r in found:
        url = "http://a.com/" if r.page_id is None else ODD_URLS[r.page_id]
        host, path, rule, verdict = plain_url(url)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_verdicts(pages.where("false"), URL_RULES).count() == 0
    # Without a labelled url nothing is mined.
    assert {r.verdict for r in url_verdicts(pages, [UrlRule("nowhere", "/", "block")]).collect()} == {"allow"}


def plain_rules(labelled, support, confidence):
    """Rules by counting every combination; for urls that bear no more tokens than the miner takes."""
    from itertools import combinations

    total = len(labelled)
    n = {}
    for tokens, _ in labelled:
        for t in tokens:
            n[t] = n.get(t, 0) + 1
    use = {t for t, c in n.items() if support <= c < total}
    sets, both = {(): total}, {}
    for tokens, verdict in labelled:
        own = sorted(set(tokens) & use)
        for size in range(len(own) + 1):
            for c in combinations(own, size):
                sets[c] = sets.get(c, 0) + (1 if c else 0)
                both[c, verdict] = both.get((c, verdict), 0) + 1
    rules = {(c, v): k / sets[c] for (c, v), k in both.items() if k >= support}
    out = {}
    for (c, v), conf in rules.items():
        fewer = [rules.get((tuple(t for t in c if t != x), v), 0) for x in c]
        if c and conf >= confidence and all(conf > f for f in fewer):
            out[c, v] = (round(conf, 9), both[c, v])
    return out, n


def test_rules_and_matches_against_all_combinations(spark):
    rng = random.Random(7)
    labelled = []
    for _ in range(300):
        tokens = sorted({rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))})
        bad = "a" in tokens and "b" in tokens or rng.random() < 0.1
        labelled.append((tokens, "block" if bad else "allow"))
    frame = spark.createDataFrame(labelled, "tokens array<string>, verdict string").repartition(4)
    mined = mine_rules(frame, 0.02, 5, 0.75).collect()
    rules, n = plain_rules(labelled, 6, 0.75)
    assert {(tuple(r.tokens), r.verdict): (round(r.confidence, 9), r.support) for r in mined} == rules and len(rules) > 3
    assert all(r.rarest == min(r.tokens, key=lambda t: (n[t], t)) for r in mined)
    asked = [sorted({rng.choice("abcdefghxy") for _ in range(rng.randint(1, 7))}) for _ in range(80)]
    sets = spark.createDataFrame([(list(t),) for t in {tuple(a) for a in asked}], "tokens array<string>")
    found = {tuple(r.tokens): r.verdict for r in match_rules(sets, mine_rules(frame, 0.02, 5, 0.75)).collect()}
    for tokens in map(tuple, asked):
        fits = [(conf, s, len(c), v) for (c, v), (conf, s) in rules.items() if set(c) <= set(tokens)]
        assert found.get(tokens) == (max(fits)[3] if fits else None)


def mined_sets(frame, max_items):
    mined = mine_rules(frame, 0.02, 5, 0.75, max_items).collect()
    found = {(tuple(r.tokens), r.verdict): (round(r.confidence, 9), r.support, r.rarest) for r in mined}
    assert len(found) == len(mined)
    return found


@pytest.mark.parametrize("max_items", [1, 3])
def test_urls_with_more_tokens_than_the_miner_takes(spark, max_items):
    """Rules are those of all combinations, also where a url has more telling tokens than FP-growth takes."""
    rng = random.Random(9)
    labelled = []
    for _ in range(300):
        tokens = {rng.choice("abcdefghi") for _ in range(rng.randint(1, 9))}
        tokens |= {"twin of a"} if "a" in tokens else set()
        bad = ("b" in tokens and "c" in tokens and "d" in tokens or "e" in tokens and "f" not in tokens) != (rng.random() < 0.1)
        labelled.append((sorted(tokens | ({"sure"} if bad and rng.random() < 0.3 else set())), "block" if bad else "allow"))
    rules, n = plain_rules(labelled, 6, 0.75)
    frame = spark.createDataFrame(labelled, "tokens array<string>, verdict string").repartition(4)
    expected = {key: (*rule, min(key[0], key=lambda t: (n[t], t))) for key, rule in rules.items()}
    assert mined_sets(frame, max_items) == expected and max(len(tokens) for tokens, _ in expected) > 2


def test_nested_tokens_do_not_multiply(spark):
    """Thirty tokens each of which holds the next: 2 ** 30 combinations, thirty sets of urls."""
    labelled = [([f"t{k:02d}" for k in range(i % 30 + 1)], "block" if i % 30 > 14 and i % 7 else "allow") for i in range(1500)]
    frame = spark.createDataFrame(labelled, "tokens array<string>, verdict string").repartition(4)
    held = {k: [v for tokens, v in labelled if len(tokens) > k] for k in range(30)}
    share = lambda k, v: held[k].count(v) / len(held[k])
    expected = {
        ((f"t{k:02d}",), v): (round(share(k, v), 9), held[k].count(v), f"t{k:02d}")
        for k in range(1, 30) for v in ("allow", "block")
        if held[k].count(v) >= 30 and share(k, v) >= 0.75 and share(k, v) > share(0, v)
    }
    assert mined_sets(frame, 10) == expected and len(expected) > 10


def test_url_query(spark):
    folder = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    found = op12_url_filter(spark, folder).collect()
    assert len(found) == len(urls) and {r.verdict for r in found} == {"allow", "block"} and any(r.mined for r in found)
    for r in found:
        host, path, rule, verdict = plain_url(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict) and (rule is None or not r.mined)


def test_a_long_hot_url_does_not_blow_up(spark):
    hot = "http://hot.com/" + "/".join(f"part{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(60))
    pages = spark.createDataFrame([(i, f"{hot}?k{i}=1") for i in range(200)] + [(1000 + i, f"http://b.net/es/{i}") for i in range(100)], "page_id bigint, url string")
    assert url_verdicts(pages, URL_RULES).where("rule is not null").count() == 300


# Periodic runs


def plain_runs(w, min_length=24, min_exponent=3):
    n, found = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            if i - a >= q:
                found.append((a, i - a + q, q))
    found = [r for r in found if not any(s[2] < r[2] and s[0] <= r[0] and s[0] + s[1] >= r[0] + r[1] for s in found)]
    return sorted(((a, n, q) for a, n, q in found if n >= max(min_length, min_exponent * q)), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    drop = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def planted(i, text):
    w, h = words(text), zlib.crc32(str(i).encode())
    if i is None or h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[j if j < a else a + (j - a) % p] for j in range(n)]


symbols = st.lists(st.integers(0, 2), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(symbols, st.builds(lambda s, k: (s * k)[:40], symbols, st.integers(2, 9))), max_size=3), st.sampled_from([(2, 2), (6, 3), (5, 2), (24, 3)]))
def test_runs_of_sequences(sequences, limits):
    expected = [(k, *r) for k, s in enumerate(sequences) for r in plain_runs(s, *limits)]
    arrays = [np.array(s, np.int64) for s in sequences]
    assert [tuple(r) for r in runs_of(arrays, *limits).tolist()] == expected if sequences else True
    flat, bounds = np.concatenate([np.zeros(0, np.int64), *arrays]), np.r_[0, np.cumsum([len(s) for s in sequences])].astype(np.int64)
    found = periodic.runs_in(flat, bounds, *limits)
    assert [tuple(r) for r in found.tolist()] == [(int(bounds[k]) + a, n, q) for k, a, n, q in expected]


def test_runs_of_fibonacci_words():
    a, b = "0", "01"
    while len(b) < 400:
        a, b = b, b + a
    s = [int(c) for c in b]
    assert [tuple(r)[1:] for r in runs_of([np.array(s)], 2, 2).tolist()] == plain_runs(s, 2, 2)


def test_documents_against_brute_force(spark):
    rng = random.Random(11)
    data = [(i, t) for i, t in rows(20) if i != 310]
    for i in range(30):
        cycle = sentence(rng, rng.randint(1, 12))
        data.append((400 + i, f"{sentence(rng, rng.randint(0, 9))}\t{' '.join([cycle] * rng.randint(1, 30))}\n{sentence(rng, rng.randint(0, 5))}"))
    data.append((500, " ".join(str(i % 700) for i in range(40_000))))  # one run over a long text
    found = periodic.periodic_runs(table(spark, data)).collect()
    expected = []
    for i, t in data:
        runs = [(0, 40_000, 700)] if i == 500 else plain_runs(words(t))
        expected.append((str(i), runs, collapsed(words(t), runs)))
    assert sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in found) == sorted(expected)
    assert sum(bool(e[1]) for e in expected) > 10
    assert periodic.periodic_runs(table(spark, data).where("false")).count() == 0


def test_run_query(spark):
    folder = "/root/testdata/sf0.001"
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = op13_periodic_runs(spark, folder).collect()
    assert len(found) == len(texts) and sum(r.n_runs > 0 for r in found) > 5
    for r in found:
        w = planted(r.doc_id, texts[r.doc_id])
        if len(w) > 2500:
            continue
        runs = plain_runs(w)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (
            len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == digest("".join("%d,%d,%d\n" % x for x in runs)) and r.collapsed_sha256 == digest(collapsed(w, runs))


def test_planted_tails_of_odd_rows(spark):
    data = [(i, t) for i, t in rows(30) + [(k, "a b  c\td e") for k in range(600, 700)] if i != 310]
    found = periodic.plant_periods(table(spark, data)).collect()
    assert sorted((str(r.doc_id), words(r.text)) for r in found) == sorted((str(i), planted(i, t)) for i, t in data)
    assert set(CLASHING).isdisjoint(found[0].asDict())


def test_limits_must_make_sense(spark):
    with pytest.raises(ValueError):
        periodic.periodic_runs(table(spark), 24, 1)
    with pytest.raises(ValueError):
        runs_of([np.zeros(3, np.int64)], 2, 1)
    assert url_filter.UrlRule("net", "/", "block").text == "net/"
