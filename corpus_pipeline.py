"""From raw documents to training tokens: five stages, each on all that the one before kept."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from viewmart.llm.bpe import bpe_digests, bpe_round_trip
from viewmart.llm.common import tokenizer_file
from viewmart.llm.decontaminate import decontaminate
from viewmart.llm.language_id import fit_languages, identify_languages
from viewmart.llm.simhash import simhash_dedup
from viewmart.llm.suffix_dedup import suffix_dedup
from viewmart.session import discard, new_folder, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: From this probability on a prediction counts against the language that a document is said to have.
SURE = 0.999


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter are rejected; the others get the language that the models find.

    A missing language is filled in with the prediction. One that was learned is corrected where a
    prediction of at least ``SURE`` contradicts it; a language that was not learned stays. Without a
    learned language nothing is filled in or corrected. NULL and empty texts hold no letter; repeated rows
    and NULL ids stay; an empty table stays empty; further columns are left out, whatever their names.
    """
    vocabulary = tokenizer_file("piece_bpe_32k.model")
    languages = fit_languages(docs, vocabulary)
    found = identify_languages(docs, vocabulary, languages, carry=("text", "lang", "source", "n_chars"))
    predicted = F.when(F.col("lang_pred") != "und", F.col("lang_pred"))
    wrong = F.col("lang").isin(list(languages)) & (F.col("score") >= SURE)
    lang = F.when(F.col("lang").isNull() | wrong, F.coalesce(predicted, "lang")).otherwise(F.col("lang"))
    return found.where("has_letter").withColumn("lang", lang).select(COLUMNS)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies stays.

    Documents with a NULL id stay. An id stays if one of the rows that repeat it does, and then with all
    its rows. NULL and empty texts are copies of each other. An empty table stays empty; further
    columns are left out, whatever their names.
    """
    rows = simhash_dedup(docs, shingle_words=3, max_bits=3).where("doc_id is not null")
    dropped = rows.groupBy("doc_id").agg(F.max("kept").alias("stays")).where("not stays").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(COLUMNS)


def suffix_arrays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 50 that an earlier document holds are cut out; every document stays.

    What is left of a character that was cut in two is shown by U+FFFD, and ``n_chars`` counts anew. NULL
    text becomes empty. Rows that repeat an id, or have none, all stay and are cut as the operator
    states. An empty table stays empty; further columns are left out, whatever their names.
    """
    found = suffix_dedup(docs, 50, carry=("lang", "source"))
    cut = found.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string")))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item are dropped, with all rows that repeat their id.

    NULL and empty texts and rows with a NULL id hold none and stay. An empty table, also of items,
    changes nothing; further columns are left out, whatever their names.
    """
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.where("contaminated").select("doc_id"), "doc_id", "left_anti").select(COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids themselves, for every row.

    NULL and empty texts have no ids and decode to the empty text. Repeated rows and NULL ids stay; an empty
    table stays empty; further columns are left out, whatever their names.
    """
    return bpe_digests(bpe_round_trip(docs, tokenizer_file("word_bpe_49k.json")), "ids")


STAGES = [
    ("language_id", language_id),
    ("simhash", simhash),
    ("suffix_arrays", suffix_arrays),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: No SQL can express the language models, fingerprint classes and merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again.

    What a stage has written for itself, and the result that it has read, are deleted when it is done.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
