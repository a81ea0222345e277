"""Learned models as Parquet folders: quantisers, codebooks (flat, in levels, with edges), bases with medians, atoms.

A model is a few small tables with a manifest that names its kind and shape; reading checks the kind.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.operators.quantization import ProductQuantizer


def write_tables(spark: SparkSession, kind: str, tables: dict[str, DataFrame], path: str, **facts) -> None:
    """Writes a model; the manifest comes last, so that a folder with one is whole."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
    facts = {"kind": kind, **facts}
    spark.createDataFrame([(k, str(v)) for k, v in facts.items()], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str, kind: str | None = None) -> dict[str, str]:
    found = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/manifest").collect()}
    if kind is not None and found.get("kind") != kind:
        raise ValueError(f"{path} holds {found.get('kind')}, not {kind}")
    return found


def read_tables(spark: SparkSession, kind: str, names: list[str], path: str) -> dict[str, DataFrame]:
    manifest(spark, path, kind)
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def write_quantizer(spark: SparkSession, model: ProductQuantizer, path: str) -> None:
    subspaces, cells, size = model.centroids.shape
    error = lambda q, c: None if model.errors is None else float(model.errors[q, c])
    rows = [(q, c, model.centroids[q, c].tolist(), error(q, c)) for q in range(subspaces) for c in range(cells)]
    table = spark.createDataFrame(rows, "q int, c int, centroid array<double>, error double")
    write_tables(spark, "quantizer", {"cells": table}, path, subspaces=subspaces, cells=cells, size=size)


def read_quantizer(spark: SparkSession, path: str) -> ProductQuantizer:
    said = manifest(spark, path, "quantizer")
    shape = tuple(int(said[k]) for k in ("subspaces", "cells", "size"))
    rows = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: (r["q"], r["c"]))
    errors = None if any(r["error"] is None for r in rows) else np.array([r["error"] for r in rows]).reshape(shape[:2])
    return ProductQuantizer(np.array([r["centroid"] for r in rows]).reshape(shape), errors)


def write_binarizer(spark: SparkSession, basis: np.ndarray, medians: DataFrame, path: str) -> None:
    rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(basis)], "i int, row array<double>")
    write_tables(spark, "binarizer", {"basis": rows, "medians": medians}, path, bits=len(basis))


def read_binarizer(spark: SparkSession, path: str) -> tuple[np.ndarray, DataFrame]:
    found = read_tables(spark, "binarizer", ["basis", "medians"], path)
    rows = sorted(found["basis"].collect(), key=lambda r: r["i"])
    return np.array([r["row"] for r in rows]), found["medians"]


def write_tree(spark: SparkSession, levels: DataFrame, path: str) -> None:
    """levels: (level, parent, child, centroid, ...) of `clustering.hierarchical_kmeans`, with factors where it has them."""
    write_tables(spark, "tree", {"levels": levels}, path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return read_tables(spark, "tree", ["levels"], path)["levels"]


def write_two_level(spark: SparkSession, coarse: DataFrame, edges: DataFrame, leaves: DataFrame, path: str) -> None:
    write_tables(spark, "two_level", {"coarse": coarse, "edges": edges, "leaves": leaves}, path)


def read_two_level(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = read_tables(spark, "two_level", ["coarse", "edges", "leaves"], path)
    return found["coarse"], found["edges"], found["leaves"]


def write_lists(spark: SparkSession, lists: DataFrame, codebook: DataFrame, model: ProductQuantizer, path: str) -> None:
    """Inverted lists of codes, sorted by word, with what made them."""
    write_quantizer(spark, model, f"{path}/quantizer")
    write_tables(spark, "lists", {"codebook": codebook, "lists": lists.sortWithinPartitions("vw", "vec_id")}, path)


def read_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, ProductQuantizer]:
    found = read_tables(spark, "lists", ["codebook", "lists"], path)
    return found["lists"], found["codebook"], read_quantizer(spark, f"{path}/quantizer")


def write_atoms(spark: SparkSession, atoms: DataFrame, path: str) -> None:
    write_tables(spark, "atoms", {"atoms": atoms}, path)


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    return read_tables(spark, "atoms", ["atoms"], path)["atoms"]
