"""A stored index of texts that answers a ranked search from the blocks that can matter.

Documents, in order of their length, are dealt into sections of at most 128. A block holds the postings of
one token in one section, with `most`, the largest share of the score that any of them can add before the
weight of the token. The sum of these bounds over the words of a search bounds every document of a section,
so sections below the k-th score found so far are never read; and since documents of a section are about as
long as each other, their bounds are close to their scores.

Blocks are sorted by token over files, so a search reads the row groups of its words only, and of those
without the postings to find the bounds. An index is written whole, under a new name; a numbered file then
names it in one step, so readers see whole indexes only, and a job that failed or ran twice changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources import files

#: Documents in a section, and tokens of its documents (one longer document is a section of its own).
SECTION, TOKENS = 128, 1 << 20


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


@dataclass(frozen=True)
class TextIndex:
    """facts: name, total (documents), average (tokens of one), k1 and b."""

    spark: SparkSession
    path: str
    facts: dict

    def blocks(self) -> DataFrame:
        """(token, section, n, most, postings): postings are (row, doc_id, tf, len)."""
        return self.spark.read.parquet(f"{self.path}/indexes/{self.facts['name']}")


def _share(facts: dict, tf: Column, length: Column) -> Column:
    return tf * (facts["k1"] + 1) / (tf + facts["k1"] * (1 - facts["b"] + facts["b"] * length / F.lit(facts["average"])))


def write(docs: DataFrame, path: str, k1: float = 1.2, b: float = 0.75, section: int = SECTION) -> TextIndex:
    """An index of docs (doc_id, text, ...), read from then on by `load`.

    Every row counts as a document; null and empty texts have no tokens, but count in the average length.
    An empty table gives an index that finds nothing. Other columns change nothing.
    """
    spark, name = docs.sparkSession, uuid.uuid4().hex
    rows = docs.select("doc_id", tokens(F.col("text")).alias("t")).withColumn("len", F.size("t").cast("long"))
    ordered = rows.repartitionByRange("len", F.xxhash64("doc_id")).sortWithinPartitions("len", F.xxhash64("doc_id"))
    # long documents share a section with fewer others: `per` is the same for those of one length, and falls with it
    per = F.greatest(F.lit(1), F.least(F.lit(section), F.floor(TOKENS / F.greatest("len", F.lit(1))))).cast("long")
    placed = ordered.withColumns({"row": F.monotonically_increasing_id(), "per": per}).withColumn("section", F.xxhash64("per", F.expr("row div per")))
    where = f"{path}/documents/{name}"  # sections must not change if a task runs twice, so they are read from here
    placed.write.parquet(where)
    placed = spark.read.parquet(where)
    total, average = placed.agg(F.count("*"), F.avg("len")).first()
    facts = {"name": name, "total": total, "average": average or 1.0, "k1": k1, "b": b}
    counted = placed.where("len > 0").repartition("section").select("section", "row", "doc_id", "len", F.explode("t").alias("token")).groupBy("section", "token", "row", "doc_id", "len").agg(F.count("*").alias("tf"))
    blocks = counted.groupBy("section", "token").agg(F.count("*").alias("n"), F.max(_share(facts, F.col("tf"), F.col("len"))).alias("most"), F.collect_list(F.struct("row", "doc_id", "tf", "len")).alias("postings"))
    blocks.select("token", "section", "n", "most", "postings").repartitionByRange("token", "section").sortWithinPartitions("token", "section").write.option("parquet.block.size", 1 << 25).parquet(f"{path}/indexes/{name}")
    files.remove(spark, where)
    known = files.names(spark, f"{path}/snapshots")
    number = int(known[-1].partition(".")[0]) + 1 if known else 1
    files.put_new(spark, f"{path}/snapshots/{number:08d}.json", json.dumps(facts, sort_keys=True))
    return TextIndex(spark, path, facts)


def load(spark: SparkSession, path: str) -> TextIndex:
    """The index that was written last."""
    known = files.names(spark, f"{path}/snapshots")
    if not known:
        raise ValueError(f"{path} holds no index")
    return TextIndex(spark, path, json.loads(files.text(spark, f"{path}/snapshots/{known[-1]}")))


def _scores(blocks: DataFrame, facts: dict) -> DataFrame:
    """(row, doc_id, score) of all postings of blocks, which hold `weight`."""
    p = blocks.select("section", "weight", F.explode("postings").alias("p"))
    part = F.col("weight") * _share(facts, F.col("p.tf"), F.col("p.len"))
    return p.groupBy("section", F.col("p.row").alias("row"), F.col("p.doc_id").alias("doc_id")).agg(F.round(F.sum(part), 9).alias("score")).drop("section")


@dataclass(frozen=True)
class Answer:
    """rows: (doc_id, score, rnk). read and known: blocks whose postings were read, of those of the words."""

    rows: DataFrame
    read: int
    known: int


def search(index: TextIndex, words: list[str], k: int = 50) -> Answer:
    """The k best documents by BM25 of the words, as `usage.text_search` scores them, ties by doc_id; documents without any are left out.

    The k sections with the largest bounds hold k documents or more; the k-th score among theirs is one that
    no document outside the sections with at least that bound can reach. A word given twice counts once.
    """
    spark, facts = index.spark, index.facts
    own = index.blocks().where(F.col("token").isin(sorted(set(words))))
    found = own.groupBy("token").agg(F.sum("n").alias("df"), F.count("*").alias("blocks")).collect()  # a row a word
    total = facts["total"]
    weights = spark.createDataFrame([(r["token"], r["df"]) for r in found], "token string, df long").select("token", F.ln((total - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("weight"))
    weighted = own.join(F.broadcast(weights), "token")
    bounds = weighted.groupBy("section").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"), F.count("*").alias("blocks"))
    first = bounds.orderBy(F.desc("bound"), "section").limit(k).select("section").collect()  # k numbers
    best = _scores(weighted.where(F.col("section").isin([r["section"] for r in first])), facts).orderBy(F.desc("score"), "doc_id").limit(k).collect()
    least = best[-1]["score"] if len(best) == k else 0.0
    open_ = bounds.where(F.col("bound") >= least - 1e-6).select("section", "blocks")
    rows = _scores(weighted.join(open_.select("section"), "section", "left_semi"), facts).orderBy(F.desc("score"), "doc_id").limit(k)
    ranked = rows.select("doc_id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rnk"))  # k rows
    return Answer(ranked, open_.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0], sum(r["blocks"] for r in found))
