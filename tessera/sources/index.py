"""The inverted file on disk: segments of postings laid out for the join of a search, and snapshots that say which count.

A segment holds postings, bucketed and sorted by `cell`, word counts by image, and norms. A cell is a word,
or, of a word with more than `slice_rows` postings, one of several slices by image; a search that joins on
the cell needs no exchange of the postings, and no task holds a frequent word whole. A snapshot is a small
file that lists segments, the totals by word and the settings. It is put under the next number in one step,
and never changed: readers see whole snapshots only, two writers cannot both have one number, and what a
writer left behind that failed is named by none.

An addition writes one more segment: its postings, the totals with its own counts added, and the norms of
the images that it touches, so that weights and norms of a search are always those of its snapshot.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import inverted
from tessera.sources import files

#: Slices of a word are this far apart in `cell`; words are smaller.
_SLICE = 1 << 40


@dataclass(frozen=True)
class Layout:
    """buckets: of a segment's postings, a file each. slice_rows: postings of a word in one cell, about."""

    buckets: int = 64
    slice_rows: int = 1 << 20


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _table(spark: SparkSession, path: str, segment: str, buckets: int) -> DataFrame:
    """The bucketed postings of a segment; the session learns of the table when it first reads it."""
    name, where = f"tessera_segment_{segment}", f"{path}/segments/{segment}/postings"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(where).schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (cell) SORTED BY (cell, image_id) INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(name)


def _write_segment(postings: DataFrame, path: str, layout: Layout, earlier: list[DataFrame]) -> tuple[dict, DataFrame]:
    """What a snapshot says of the new segment, and its counts by word. earlier: word counts by image of the other segments."""
    spark, segment = postings.sparkSession, uuid.uuid4().hex
    where = f"{path}/segments/{segment}"
    postings = postings.drop("cell")
    counts = postings.groupBy("vw").agg(F.count("*").alias("n"))
    counts.write.parquet(f"{where}/counts")
    counts = spark.read.parquet(f"{where}/counts")
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # fewer than a million words can be so frequent, and those are broadcast
    slices = counts.where(F.col("n") > max(layout.slice_rows, rows // 1_000_000)).select("vw", F.ceil(F.col("n") / layout.slice_rows).cast("long").alias("slices"))
    slices.write.parquet(f"{where}/slices")
    slices = spark.read.schema(slices.schema).parquet(f"{where}/slices")
    slice_ = F.pmod(F.xxhash64("image_id"), F.coalesce("slices", F.lit(1).cast("long")))
    celled = postings.join(F.broadcast(slices), "vw", "left").withColumn("cell", F.col("vw") + slice_ * _SLICE).drop("slices")
    # the exchange deals rows as the buckets do, so that a bucket is one file
    celled.repartition(layout.buckets, "cell").write.bucketBy(layout.buckets, "cell").sortBy("cell", "image_id").option("path", f"{where}/postings").format("parquet").saveAsTable(f"tessera_segment_{segment}")
    bags = postings.groupBy("image_id", "vw").agg(F.count("*").alias("n"))
    bags.repartitionByRange("image_id").sortWithinPartitions("image_id").write.parquet(f"{where}/bags")
    bags = spark.read.schema(bags.schema).parquet(f"{where}/bags")
    low, high = bags.agg(F.min("image_id"), F.max("image_id")).first()
    again = 0
    if earlier and low is not None:
        # of images that have points already; row groups outside the range are not read
        known = _union(earlier).where(F.col("image_id").between(low, high)).join(bags.select("image_id").distinct(), "image_id", "left_semi")
        again = known.select("image_id").distinct().count()
        if again:
            bags = bags.unionByName(known).groupBy("image_id", "vw").agg(F.sum("n").alias("n"))
    inverted.norms_of_counts(bags).write.parquet(f"{where}/norms")
    return {"id": segment, "rows": rows, "images_again": again}, counts


@dataclass(frozen=True)
class Snapshot:
    spark: SparkSession
    path: str
    number: int
    facts: dict

    @property
    def layout(self) -> Layout:
        return Layout(**self.facts["layout"])

    def _read(self, table: str) -> list[DataFrame]:
        return [self.spark.read.parquet(f"{self.path}/segments/{s['id']}/{table}") for s in self.facts["segments"]]

    def segments(self) -> list[tuple[DataFrame, DataFrame]]:
        """Of each segment its postings, and the slices of its frequent words."""
        own = [_table(self.spark, self.path, s["id"], self.layout.buckets) for s in self.facts["segments"]]
        return list(zip(own, self._read("slices"), strict=True))

    def postings(self) -> DataFrame:
        return _union([p for p, _ in self.segments()]).drop("cell")

    def codebook(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/codebooks/{self.facts['codebook']}")

    def totals(self) -> DataFrame:
        """(vw, n): postings of each word."""
        return self.spark.read.parquet(f"{self.path}/totals/{self.facts['totals']}")

    def words(self, tfidf: int = 1) -> DataFrame:
        return inverted.weights_of_counts(self.totals(), self.codebook(), tfidf)

    def norms(self) -> DataFrame:
        """(image_id, l1, l2, l3); of an image in several segments those of the last, which count all of it."""
        own = self._read("norms")
        if not any(s["images_again"] for s in self.facts["segments"]):
            return _union(own)
        every = _union([n.withColumn("_at", F.lit(i)) for i, n in enumerate(own)])
        last = every.groupBy("image_id").agg(F.max_by(F.struct("l1", "l2", "l3"), "_at").alias("n"))
        return last.select("image_id", "n.l1", "n.l2", "n.l3")

    def pairs(self, queries: DataFrame, hamming: int) -> DataFrame:
        """The pairs of `inverted.probe`, segment by segment: query points go to the buckets, postings stay where they are."""
        found = []
        for postings, slices in self.segments():
            asked = queries.join(F.broadcast(slices), "vw", "left")
            asked = asked.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("slices", F.lit(1).cast("long")) - 1)))
            asked = asked.withColumn("cell", F.col("vw") + F.col("_slice") * _SLICE).drop("_slice", "slices")
            found.append(inverted.probe(asked, postings, hamming, "cell"))
        return _union(found)


def _number(name: str) -> int:
    return int(name.partition(".")[0])


def _publish(spark: SparkSession, path: str, number: int, facts: dict) -> Snapshot:
    files.put_new(spark, f"{path}/snapshots/{number:08d}.json", json.dumps(facts, sort_keys=True))
    return Snapshot(spark, path, number, facts)


def _put_table(rows: DataFrame, path: str, kind: str) -> str:
    name = uuid.uuid4().hex
    rows.write.parquet(f"{path}/{kind}/{name}")
    return name


def latest(spark: SparkSession, path: str) -> Snapshot | None:
    found = files.names(spark, f"{path}/snapshots")
    return load(spark, path, _number(found[-1])) if found else None


def load(spark: SparkSession, path: str, number: int | None = None) -> Snapshot:
    """The snapshot of a number, or the last one."""
    if number is None:
        found = latest(spark, path)
        if found is None:
            raise ValueError(f"{path} holds no index")
        return found
    return Snapshot(spark, path, number, json.loads(files.text(spark, f"{path}/snapshots/{number:08d}.json")))


def store(postings: DataFrame, codebook: DataFrame, path: str, layout: Layout = Layout(), **settings) -> Snapshot:
    """A snapshot of these postings alone, whatever the folder held before; settings are kept with it.

    postings: vw, image_id, pt and what a search reads. Storing the same again gives the same index.
    """
    spark = postings.sparkSession
    before = latest(spark, path)
    segment, counts = _write_segment(postings, path, layout, [])
    facts = {
        "layout": asdict(layout), "settings": settings, "segments": [segment], "streams": {}, "codebook": _put_table(codebook.select("vw", "centroid"), path, "codebooks"), "totals": _put_table(counts, path, "totals"),
    }
    return _publish(spark, path, before.number + 1 if before else 1, facts)


def add(postings: DataFrame, path: str, stream: str | None = None, batch: int | None = None) -> Snapshot:
    """A snapshot with one more segment. A batch of a stream that is in the index already changes nothing.

    Images may have points in the index; a point that comes again is a point more.
    """
    spark = postings.sparkSession
    before = load(spark, path)
    if stream is not None and before.facts["streams"].get(stream, -1) >= batch:
        return before
    segment, counts = _write_segment(postings, path, before.layout, before._read("bags"))
    totals = before.totals().unionByName(counts).groupBy("vw").agg(F.sum("n").alias("n"))
    facts = before.facts | {"segments": [*before.facts["segments"], segment], "totals": _put_table(totals, path, "totals")}
    if stream is not None:
        facts["streams"] = facts["streams"] | {stream: batch}
    return _publish(spark, path, before.number + 1, facts)


def compact(spark: SparkSession, path: str) -> Snapshot:
    """A snapshot of the same postings in one segment."""
    before = load(spark, path)
    segment, _ = _write_segment(before.postings(), path, before.layout, [])
    return _publish(spark, path, before.number + 1, before.facts | {"segments": [segment]})


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Removes all snapshots but the last `keep`, and what only they name; the number of folders removed. No search may read those then."""
    numbers = [_number(n) for n in files.names(spark, f"{path}/snapshots")]
    kept = [load(spark, path, n).facts for n in numbers[-keep:]]
    used = {"segments": {s["id"] for f in kept for s in f["segments"]}, "totals": {f["totals"] for f in kept}, "codebooks": {f["codebook"] for f in kept}}
    for n in numbers[:-keep]:
        files.remove(spark, f"{path}/snapshots/{n:08d}.json")
    gone = [f"{path}/{kind}/{name}" for kind, names in used.items() for name in files.names(spark, f"{path}/{kind}") if name not in names]
    for folder in gone:
        files.remove(spark, folder)
    return len(gone)


def search(queries: DataFrame, snapshot: Snapshot, params: inverted.SearchParams = inverted.SearchParams()) -> DataFrame:
    """`inverted.search` on a stored index, with the weights and norms of its snapshot."""
    return inverted.ranked(queries, snapshot.pairs(queries, params.hamming), snapshot.words(params.tfidf), snapshot.norms(), params)
