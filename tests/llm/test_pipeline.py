"""The pipeline over the smallest tables, stage by stage, and what is registered."""

import hashlib
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.corpus import CLASHING, rows, table
from tests.llm.test_duplicates import joined, plain_fingerprint, plain_removed
from viewmart.llm.common import tokenizer_file
from viewmart.llm.decontaminate import decontaminate_sql
from viewmart.session import settle

SMALL = "/root/testdata/sf0.001"


def plain(docs):
    """The stages by brute force, but for the language models, which keep every text with a letter."""
    docs = {i: t for i, t in docs.items() if re.search(r"[^\W\d_]", t or "")}
    prints = {i: plain_fingerprint(t, 3) for i, t in docs.items()}
    array, ids = np.array(list(prints.values()), np.uint64), list(prints)
    pairs = [(ids[a], ids[b]) for a in range(len(ids)) for b in np.flatnonzero(np.bitwise_count(array ^ array[a]) <= 3).tolist() if a < b]
    docs = {i: docs[i] for i, c in joined(pairs, ids).items() if i == c}
    cut = plain_removed(list(docs.items()), 50)
    docs = {i: bytes(c for c, m in zip(b, mask) if not m).decode("utf-8", "replace") for i, b, mask in cut}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SMALL}/benchmark.parquet'")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(docs.items()))
    dropped = {r[0] for r in con.execute(f"SELECT doc_id FROM ({decontaminate_sql()}) WHERE contaminated").fetchall()}
    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    return {i: library.encode(t, add_special_tokens=False).ids for i, t in docs.items() if i not in dropped}


def test_run_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    expected = plain(docs)
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id: list(r.ids) for r in found} == expected and len(found) == len(expected) < len(docs)
    for r in found[:20]:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()


def test_stages_take_odd_rows(spark):
    docs = table(spark, rows(), extra=False).selectExpr("doc_id", "text", "'en' AS lang", "CAST(NULL AS STRING) AS source", "CAST(NULL AS BIGINT) AS n_chars")
    others = {name: F.lit("other") for name in [*CLASHING, "has_letter", "doc", "item", "items", "contaminated", "decoded", "carried_1", "low", "node"]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs.withColumns(others), SMALL)
        assert kept.columns == corpus_pipeline.COLUMNS, name
        assert sorted(map(str, kept.collect())) == sorted(map(str, stage(spark, docs, SMALL).collect())), name
        docs = settle(kept, "stage")
        left = docs.count()
        assert left > 0
        assert stage(spark, docs.where("false"), SMALL).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs.withColumns(others), SMALL).count() == left and last(spark, docs.where("false"), SMALL).count() == 0


def test_languages_are_filled_in_and_corrected(spark):
    english = "the river runs over the stone and under the light of the house in the water again"
    german = "der fluss und das wasser sind nicht weit von dem haus und der stein ist noch immer da"
    data = [(i, english, "en") for i in range(30)] + [(100 + i, german, "de") for i in range(30)]
    odd = [(200, english, None), (201, german, None), (202, german, "en"), (204, "12 34", "en"), (205, None, None)]
    docs = spark.createDataFrame(data + odd, "doc_id bigint, text string, lang string").selectExpr("*", "'s' AS source", "1L AS n_chars")
    found = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, SMALL).collect()}
    assert found == {i: lang for i, _, lang in data} | {200: "en", 201: "de", 202: "de"}


def test_no_language_learned_keeps_texts_with_a_letter(spark):
    data = [(1, "a clean text"), (2, "123 !!!"), (3, None), (4, ""), (5, "Ω")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr(
        "doc_id", "text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "CAST(NULL AS BIGINT) AS n_chars"
    )
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SMALL).collect()} == {1, 5}
    wordless = docs.withColumn("lang", F.when(F.col("doc_id") == 2, "en"))  # the only labelled text holds no word
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, wordless, SMALL).collect()} == {1, 5}


def test_registered():
    import __spark_entry__ as driver

    names = list(driver.queries())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and "op5_decontaminate" in driver.oracle_sql()
