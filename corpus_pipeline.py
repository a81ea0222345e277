"""The documents table made into packed training sequences, in five stages.

Each stage reads what the one before it wrote: language identification drops texts without a
recognisable language, the Jaccard join keeps the first document of each group of near-duplicates
(five-word shingles, similarity 0.8), decontamination drops documents that consist of benchmark
passages and cuts such passages out of others, the secret scan redacts secrets, and packing makes
sequences of at most 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, langid, packing, rowmap, secrets

#: A language with a calibrated probability below this counts as not recognised, and the document goes. With four
#: languages that is where the classifier all but guesses; 2 of 51 282 and 13 of 256 410 documents of the check tables go in this stage.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs in a language of the training rows; only text and non-null lang are learned from.

    Null and empty texts and texts without a letter go, and so do all rows if no row has text and lang.
    Every column stays as it is, whatever its name; repeated rows are judged alike; texts are read whole.
    """
    rowmap.text_batches(spark)
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    own, back = rowmap.set_aside(docs)
    return back(langid.predict(own, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least_score)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8), that of the smallest doc_id.

    Rows without doc_id stay, and so do null and empty texts, of which one of each doc_id is left.
    """
    return jaccard.keep_first(docs, k=5, percent=80)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without documents that are benchmark text for half of their words or more, and of others without those passages.

    Benchmark rows without text have no passages, those without item_id have. n_chars follows the text.
    Null and empty texts stay; texts are read whole; repeated rows are treated alike; an empty table, or
    one without benchmark rows, stays as it is, and so do all other columns.
    """
    kept = decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), nameless=True)
    return _recounted(kept, docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every secret of their texts replaced by a mark; no row goes. n_chars follows the text. For rows of every kind see `secrets.redact`."""
    return _recounted(secrets.redact(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of at most 2048 tokens; see `packing.pack` for null and empty texts and ids."""
    return packing.pack(docs)


def _recounted(docs: DataFrame, before: DataFrame) -> DataFrame:
    """n_chars of the text as it is now, where the table has that column."""
    if "n_chars" in before.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType))
    return docs.select(*before.columns)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_text),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: The classifier and the tokeniser are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of the documents table.

    Null and empty texts go in the first stage, and of rows with the same doc_id and text one stays in the
    second; rows without doc_id are near-duplicates of nothing; texts are read whole in every stage; an
    empty table gives no pieces; further columns of the table change nothing.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = rowmap.written(stage(spark, docs, sf_dir), name)
    return docs
