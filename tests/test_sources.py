import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import binary
from tessera.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("layout", sorted(binary.LAYOUTS))
def test_points_round_trip(spark, tmp_path, layout):
    binary.register(spark)
    kind = binary.point_type(layout, 4)
    out = np.zeros(50, kind)
    for name in kind.names:
        if name == "desc":
            out[name] = np.arange(200).reshape(50, 4)
        elif name == "d":
            out[name] = 4
        else:
            out[name] = np.arange(50)
    (tmp_path / f"a.{layout}").write_bytes(out.tobytes())
    df = spark.read.format("points").option("layout", layout).load(str(tmp_path / f"*.{layout}"))
    assert df.count() == 50
    assert [r["x"] for r in df.orderBy("pt").select("x").collect()] == list(range(50))
    df.write.format("points").option("layout", layout).mode("append").save(str(tmp_path / "copy"))
    again = spark.read.format("points").option("layout", layout).load(str(tmp_path / "copy"))
    assert again.drop("file").exceptAll(df.drop("file")).count() == 0 and again.count() == 50


def test_broken_file_is_refused(tmp_path):
    with pytest.raises(ValueError):
        binary.decode_points(b"\0" * 41, "vwgeo")


def test_vectors_round_trip(spark, tmp_path):
    binary.register(spark)
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.lit("").alias("file"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    e.repartition(2).write.format("fvecs").mode("append").save(str(tmp_path / "v"))
    back = spark.read.format("fvecs").load(str(tmp_path / "v"))
    assert back.select("vec").exceptAll(e.select("vec")).count() == 0 and back.count() == e.count()


def test_windowed_counts(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert ingest.windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()
