"""The corpus queries by name, with production parameters, over whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from viewmart.llm import (
    bpe, decontaminate, embedding_dedup, filter_audit, language_id, lm, periodic_runs, quality, simhash, suffix_dedup,
    token_counts, toxicity, url_filter,
)
from viewmart.llm.common import fold, read_table, tokenizer_file

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, through a cache that starts empty."""
    counted = token_counts.token_counts(read_table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op2_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe.bpe_digests(bpe.bpe_round_trip(read_table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json")))


def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of vectors of one label that link at a cosine of 0.93."""
    return embedding_dedup.embedding_dedup(read_table(spark, folder, "embeddings"), 0.93)


def op4_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of documents whose fingerprints of three-word shingles link at 3 bits."""
    return simhash.simhash_dedup(read_table(spark, folder, "documents"), 3, 3).select("doc_id", "fingerprint", "component_id")


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's template windows; items as text."""
    documents, benchmark = read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark")
    found = decontaminate.decontaminate(documents, benchmark)
    return found.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from two thirds of the labelled ones."""
    held_out = fold(F.col("doc_id"), 3) == 1
    found = toxicity.classify_toxicity(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    documents = read_table(spark, folder, "documents")
    vocabulary = tokenizer_file("piece_bpe_32k.model")
    held_out = fold(F.col("doc_id"), 4) == 2
    languages = language_id.fit_languages(documents.where(~held_out), vocabulary)
    found = language_id.identify_languages(documents, vocabulary, languages)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Suffix-tree and unigram scores of every document, learned from four fifths of them."""
    held_out = fold(F.col("doc_id"), 5) == 1
    found = lm.lm_scores(read_table(spark, folder, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the strings of 50 bytes that an earlier one holds."""
    return suffix_dedup.suffix_digests(suffix_dedup.suffix_dedup(read_table(spark, folder, "documents"), 50))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from two thirds of the labelled ones."""
    held_out = fold(F.col("doc_id"), 3) == 1
    found = quality.classify_quality(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove, alone and after others, by source, in all 120 orders."""
    return filter_audit.filter_audit(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


#: The stated rules of the url query.
URL_RULES = [
    url_filter.UrlRule("com", "/", "allow"),
    url_filter.UrlRule("example.com", "/en/", "block"),
    url_filter.UrlRule("www.example.com", "/en/", "allow"),
    url_filter.UrlRule("net", "/es/", "block"),
    url_filter.UrlRule("net", "/fr/", "block"),
]


def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Stated rules and, elsewhere, rules mined from what these say, for the url of every page."""
    return url_filter.url_verdicts(read_table(spark, folder, "pages"), URL_RULES)


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of words of every document, one in ten of which has a planted one."""
    planted = periodic_runs.plant_periods(read_table(spark, folder, "documents"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(planted, 24, 3))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_lm_scores": op8_lm_scores,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality": op10_quality,
    "op11_filter_audit": op11_filter_audit,
    "op12_url_filter": op12_url_filter,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op5_decontaminate": decontaminate.decontaminate_sql(),
    "op11_filter_audit": filter_audit.filter_audit_sql(),
}
