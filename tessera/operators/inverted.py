"""The inverted file as tables: postings by word, weights, votes, bursts, weak geometry, ranking.

A query is one plan: query points meet postings on their word, the Hamming distance is a residual
predicate of that join, votes are weighted, damped where they come in bursts, summed into angle and
scale histograms, smoothed, and normalised. Everything carries query_id, so a batch of queries is one
plan too. Word, distance and prior tables have a fixed size (words are bounded by the codebook; 65
distances; 127 bins), and so Spark may broadcast them; postings are never.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb, exp, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as v

ANGLES, SCALES = 64, 63


@dataclass(frozen=True)
class SearchParams:
    """Defaults of the search; wgc_window of 0 switches the histograms off."""

    shortlist: int = 20
    hamming: int = 22
    scale_weight: float = 0.06
    he_weight: int = 1
    tfidf: int = 1
    burst_intra: int | None = 0
    burst_inter: bool = True
    cancel_multiple: bool = False
    wgc_window: int = 5
    wgc_class: int = 0x40
    norm: int = 2


def with_geometry(points: DataFrame) -> DataFrame:
    return points.withColumn("qscale", v.quantized_scale(F.col("scale"))).withColumn("qangle", v.quantized_angle(F.col("angle")))


def word_weights(postings: DataFrame, codebook: DataFrame, tfidf: int = 1) -> DataFrame:
    """(vw, n, w): w = ln(N / n) over N postings, ln N for a word without any; 1 without tf-idf."""
    return weights_of_counts(postings.groupBy("vw").agg(F.count("*").alias("n")), codebook, tfidf)


def weights_of_counts(counts: DataFrame, codebook: DataFrame, tfidf: int = 1) -> DataFrame:
    """`word_weights` out of the number of postings of each word (vw, n)."""
    every = codebook.select("vw").join(counts, "vw", "left").select("vw", F.coalesce("n", F.lit(0)).alias("n"))
    if not tfidf:
        return every.withColumn("w", F.lit(1.0))
    total = counts.agg(F.sum("n").cast("double").alias("total"))
    return every.crossJoin(F.broadcast(total)).select("vw", "n", F.ln(F.col("total") / F.greatest(F.col("n"), F.lit(1))).alias("w"))  # one row


def image_norms(postings: DataFrame) -> DataFrame:
    """(image_id, l1, l2, l3): the number of points, the root of the sum of squared word counts, the root of the number."""
    return norms_of_counts(postings.groupBy("image_id", "vw").agg(F.count("*").alias("n")))


def norms_of_counts(counts: DataFrame) -> DataFrame:
    """`image_norms` out of word counts by image (image_id, vw, n)."""
    return counts.groupBy("image_id").agg(F.sum("n").cast("double").alias("l1"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("l2"), F.sqrt(F.sum("n")).alias("l3"))


def he_weight(distance: int, kind: int = 1) -> float:
    """Weight of a Hamming distance: 0 flat, 1 the bits of surprise of so near a pair, 2 a Gaussian."""
    if kind == 0:
        return 1.0
    if kind == 1:
        return 64 - log2(sum(comb(64, j) for j in range(distance + 1)))
    return 64 * exp(-distance * distance / 256)


def he_weights(spark: SparkSession, kind: int = 1) -> DataFrame:
    return spark.createDataFrame([(i, he_weight(i, kind)) for i in range(65)], "hd int, hw double")


def _prior(angle: int, scale: int, kind: int) -> float:
    near, half, quarter = 4.0, 0.4 if kind not in (0x60, 0xC0) else 0.0, 0.2 if kind != 0xC0 else 0.0
    peak = lambda x, width: exp(-x * x / width)
    return 1 + near * (peak(angle, 5) + peak(angle - 64, 5)) + half * peak(angle - 32, 5) + quarter * (peak(angle - 16, 5) + peak(angle - 48, 5)) + peak(scale - 31, 40)


def wgc_weights(spark: SparkSession, kind: int = 0x40) -> DataFrame:
    """(dim, bin, wt): the prior of differences of angle and of scale, each summed over the other."""
    rows = [("angle", a, sum(_prior(a, s, kind) for s in range(SCALES))) for a in range(ANGLES)]
    rows += [("scale", s, sum(_prior(a, s, kind) for a in range(ANGLES))) for s in range(SCALES)]
    return spark.createDataFrame(rows, "dim string, bin int, wt double")


def probe(queries: DataFrame, postings: DataFrame, hamming: int, on: str = "vw") -> DataFrame:
    """(query_id, dqid, image_id, pt, vw, hd, da, ds, ms) of pairs on the same word within the distance.

    on: the column to join on, where both have one that only points of one word share.
    """
    q = queries.select("query_id", F.col("pt").alias("dqid"), on, F.col("binsign").alias("qsign"), F.col("qangle").alias("qa"), F.col("qscale").alias("qs"))
    p = postings.select("image_id", "pt", *dict.fromkeys(("vw", on)), "binsign", "qangle", "qscale")
    hd = v.hamming(F.col("qsign"), F.col("binsign"))
    pairs = p.join(q, on).where(hd <= hamming)
    return pairs.select("query_id", "dqid", "image_id", "pt", "vw", hd.cast("int").alias("hd"), F.pmod(F.col("qangle") - F.col("qa"), F.lit(ANGLES)).alias("da"), (F.col("qscale") - F.col("qs") + 31).alias("ds"), F.least("qscale", "qs").alias("ms"))


def votes(pairs: DataFrame, words: DataFrame, params: SearchParams) -> DataFrame:
    spark = pairs.sparkSession
    joined = pairs.join(words.select("vw", "w"), "vw").join(he_weights(spark, params.he_weight), "hd")
    return joined.withColumn("score", F.col("w") * F.col("w") * F.exp(F.col("ms") * params.scale_weight) * F.col("hw")).drop("w", "hw")


def _burst_factor(kind: int, score: Column, total: Column, most: Column, n: Column) -> Column:
    return {0: F.sqrt(score / total), 1: F.sqrt(score / most), 2: F.ln(1 + score / total), 3: F.ln(1 + score / most), 4: F.sqrt(1 / n), 5: 1 / n}[kind]


def damp_within_images(votes_: DataFrame, kind: int = 0, cancel_multiple: bool = False) -> DataFrame:
    """Votes of one image and word are damped if there are several; the factor is of the votes before any cancelling.

    cancel_multiple keeps, of a query point's votes for an image and word, only the best (the first point among equals).
    """
    g = Window.partitionBy("query_id", "image_id", "vw")
    s = F.col("score")
    factor = F.when(F.count("*").over(g) >= 2, _burst_factor(kind, s, F.sum(s).over(g), F.max(s).over(g), F.count("*").over(g))).otherwise(1.0)
    out = votes_.withColumn("_f", factor)
    if cancel_multiple:
        one = Window.partitionBy("query_id", "image_id", "vw", "dqid").orderBy(F.desc("score"), "pt")
        out = out.withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r")
    return out.withColumn("score", s * F.col("_f")).drop("_f")


def damp_between_images(votes_: DataFrame) -> DataFrame:
    """Each vote times the root of its share of all votes of its query point."""
    g = Window.partitionBy("query_id", "dqid")
    return votes_.withColumn("score", F.col("score") * F.sqrt(F.col("score") / F.sum("score").over(g)))


def histograms(votes_: DataFrame) -> DataFrame:
    """(query_id, image_id, dim, bin, s): votes summed by difference of angle and by difference of scale."""
    bins = F.explode(F.array(F.struct(F.lit("angle").alias("dim"), F.col("da").cast("int").alias("bin")), F.struct(F.lit("scale").alias("dim"), F.col("ds").cast("int").alias("bin"))))
    return votes_.select("query_id", "image_id", "score", bins.alias("b")).groupBy("query_id", "image_id", "b.dim", "b.bin").agg(F.sum("score").alias("s"))


def geometric_scores(bins: DataFrame, weights: DataFrame, window: int) -> DataFrame:
    """(query_id, image_id, score): the lesser of the two histograms' peaks, weighted and smoothed over whole windows.

    A bin adds to the windows that end at it or up to window - 1 bins after; windows do not wrap.
    """
    end = F.explode(F.sequence(F.col("bin"), F.col("bin") + window - 1)).alias("end")
    size = F.when(F.col("dim") == "angle", ANGLES).otherwise(SCALES)
    spread = bins.join(weights, ["dim", "bin"]).select("query_id", "image_id", "dim", (F.col("s") * F.col("wt")).alias("s"), end)
    summed = spread.where((F.col("end") >= window - 1) & (F.col("end") < size)).groupBy("query_id", "image_id", "dim", "end").agg(F.sum("s").alias("s"))
    peaks = summed.groupBy("query_id", "image_id", "dim").agg(F.max("s").alias("m"))
    return peaks.groupBy("query_id", "image_id").agg(F.min("m").alias("score"))


def voted_scores(pairs: DataFrame, words: DataFrame, norms: DataFrame, query_norms: DataFrame, params: SearchParams) -> DataFrame:
    """(query_id, image_id, score) of the images with votes for a query; pairs: as of `probe`."""
    found = votes(pairs, words, params)
    if params.burst_intra is not None:
        found = damp_within_images(found, params.burst_intra, params.cancel_multiple)
    if params.burst_inter:
        found = damp_between_images(found)
    if params.wgc_window:
        scored = geometric_scores(histograms(found), wgc_weights(pairs.sparkSession, params.wgc_class), params.wgc_window)
    else:
        scored = found.groupBy("query_id", "image_id").agg(F.sum("score").alias("score"))
    column = f"l{params.norm}"
    scored = scored.join(norms.select("image_id", F.col(column).alias("n")), "image_id").join(query_norms.select("query_id", F.col(column).alias("qn")), "query_id")
    return scored.select("query_id", "image_id", (F.col("score") / (F.col("n") * F.col("qn"))).alias("score"))


def score_images(queries: DataFrame, postings: DataFrame, words: DataFrame, norms: DataFrame, query_norms: DataFrame, params: SearchParams) -> DataFrame:
    """(query_id, image_id, score) of every image for every query, as many rows as that is: images without votes score 0."""
    scored = voted_scores(probe(queries, postings, params.hamming), words, norms, query_norms, params)
    every = norms.select("image_id").crossJoin(F.broadcast(query_norms.select("query_id")))  # a batch of queries
    return every.join(scored, ["query_id", "image_id"], "left").select("query_id", "image_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best images of each query; ties by image."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "image_id")
    return scores.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)


def search(queries: DataFrame, postings: DataFrame, codebook: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """The best images of each query (query_id, image_id, score, rnk); images without votes score 0 and fill up by number."""
    return ranked(queries, probe(queries, postings, params.hamming), word_weights(postings, codebook, params.tfidf), image_norms(postings), params)


def ranked(queries: DataFrame, pairs: DataFrame, words: DataFrame, norms: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """`search` out of the pairs of queries and postings.

    Only images with votes are scored. A query with fewer than k of them is filled from the 2 k smallest
    image numbers, among which the first k without votes must be.
    """
    k = params.shortlist
    query_norms = image_norms(queries.withColumn("image_id", F.col("query_id"))).withColumnRenamed("image_id", "query_id")
    return filled(voted_scores(pairs, words, norms, query_norms, params).where("score > 0"), query_norms.select("query_id"), norms.select("image_id"), k)


def filled(scores: DataFrame, queries: DataFrame, images: DataFrame, k: int, score: float = 0.0) -> DataFrame:
    """The k best images of each query, those without a score among them, which have `score`, less than all others; ties by image."""
    voted = top(scores, k)
    have = queries.join(voted.groupBy("query_id").agg(F.count("*").alias("have")), "query_id", "left").where(F.coalesce("have", F.lit(0)) < k)
    smallest = images.orderBy("image_id").limit(2 * k)
    none = have.select("query_id").crossJoin(F.broadcast(smallest)).join(voted.select("query_id", "image_id"), ["query_id", "image_id"], "left_anti")  # 2 k rows for a query
    rest = none.select("query_id", "image_id", F.lit(score).alias("score"))
    return top(voted.select("query_id", "image_id", "score").unionByName(rest), k)


def merge(first: DataFrame, second: DataFrame, offset: int) -> DataFrame:
    """Two shards as one, the second's images moved by an offset."""
    return first.unionByName(second.withColumn("image_id", F.col("image_id") + offset))


def first_of_word(postings: DataFrame) -> DataFrame:
    """One posting of each image and word: its first point."""
    w = Window.partitionBy("image_id", "vw").orderBy("pt")
    return postings.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def run_lengths(postings: DataFrame, most: int) -> DataFrame:
    """(length, n): how many (word, image) pairs have so many postings; longer ones count as `most`."""
    runs = postings.groupBy("vw", "image_id").agg(F.count("*").alias("m"))
    return runs.groupBy(F.least(F.col("m"), F.lit(most)).alias("length")).agg(F.count("*").alias("n"))


def gap_lengths(postings: DataFrame) -> DataFrame:
    """(gap, n): differences of consecutive image ids within a word's list, the first against -1."""
    w = Window.partitionBy("vw").orderBy("image_id", "pt")
    gaps = postings.select((F.col("image_id") - F.coalesce(F.lag("image_id").over(w), F.lit(-1))).alias("gap"))
    return gaps.groupBy("gap").agg(F.count("*").alias("n"))


def without_zero_votes(votes: DataFrame) -> DataFrame:
    """The votes that still count after damping and cancelling."""
    return votes.where(F.col("score") > 0)
