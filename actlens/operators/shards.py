"""Shard manifests: agreement, contiguity, merging; manifest checks and lineage.

A manifest table has one row per shard or dataset (thousands at most), whatever
the size of the data it describes.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from actlens.functions.binding import let
from actlens.session import materialize
from actlens.sources.manifest import rule_problems

_AGREED = ("base_model", "layer_index", "d_model", "norm", "corpus", "positions_per_doc")


def shard_agreement(manifests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shards whose stage or extraction settings differ from those of the first shard."""
    settings = F.struct("stage", *[F.col(f"extraction.{c}").alias(c) for c in _AGREED])
    start = F.col("extraction.corpus_slice.start")
    first = W.partitionBy(*(by or [F.lit(0)])).orderBy(start, "path")
    marked = manifests.withColumn("_s", settings).withColumn("_ref", F.first("_s").over(first))
    names = ["stage", *_AGREED]
    differing = F.array_compact(
        F.array(
            *[F.when(~F.col(f"_s.{c}").eqNullSafe(F.col(f"_ref.{c}")), F.lit(c)) for c in names]
        )
    )
    return (
        marked.select(*by, "path", F.array_join(differing, ",").alias("differs_in"))
        .where(F.col("differs_in") != "")
    )


def shard_contiguity(manifests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Places where the next shard does not start where this one ends."""
    start = F.col("extraction.corpus_slice.start")
    end = start + F.col("extraction.corpus_slice.length")
    order = W.partitionBy(*(by or [F.lit(0)])).orderBy(start, "path")
    return (
        manifests.select(
            *by,
            "path",
            end.alias("ends_at"),
            F.lead(start).over(order).alias("next_start"),
        )
        .where(F.col("next_start") != F.col("ends_at"))
        .withColumn(
            "problem", F.when(F.col("next_start") > F.col("ends_at"), "gap").otherwise("overlap")
        )
    )


def rowcount_check(merged: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row: rows found, rows declared by the manifests, and whether they agree."""
    declared = manifests.agg(F.coalesce(F.sum("row_count"), F.lit(0))).scalar()
    return merged.agg(F.count(F.lit(1)).alias("found")).select(
        "found", declared.alias("declared"), (F.col("found") == declared).alias("agrees")
    )


def merged_slice(manifests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Corpus slice, row count and parents of the merged dataset."""
    slice_start = F.col("extraction.corpus_slice.start")
    return manifests.groupBy(*by).agg(
        F.min(slice_start).alias("start"),
        F.sum("extraction.corpus_slice.length").alias("length"),
        F.sum("row_count").alias("row_count"),
        F.transform(
            F.sort_array(F.collect_list(F.struct(slice_start.alias("s"), "dataset_id"))),
            lambda x: x["dataset_id"],
        ).alias("parent_datasets"),
    )


def shard_problems(manifests: DataFrame) -> DataFrame:
    """``path``, ``problem`` of every shard that must not be merged with the others.

    Shards must be of stage ``base``, agree in their settings and lie end to end.
    """
    return (
        shard_agreement(manifests)
        .select("path", F.concat(F.lit("differs in "), "differs_in").alias("problem"))
        .unionByName(shard_contiguity(manifests).select("path", "problem"))
        .unionByName(
            manifests.where(F.col("stage") != "base").select(
                "path", F.concat(F.lit("stage is "), "stage").alias("problem")
            )
        )
    )


def scan_shards(spark: SparkSession, root: str, schema: StructType | None = None) -> DataFrame:
    """All rows of the shard folders under ``root`` in one scan, with ``path``: the folder below ``root``.

    The folder comes from the scan's own file metadata.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    rows = (reader.schema(schema) if schema is not None else reader).parquet(root)
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    base = re.sub(r"^\w+:/*", "", root.rstrip("/")).strip("/")
    return rows.withColumn("path", F.substring_index(folder, f"{base}/", -1))


def count_problems(rows: DataFrame, manifests: DataFrame) -> DataFrame:
    """``path``, ``problem`` of every shard whose rows are not those that its manifest declares.

    One plan over all shards: rows are counted by folder in the map tasks.
    """
    found = rows.groupBy("path").agg(F.count(F.lit(1)).alias("found"))
    declared = manifests.select("path", F.col("row_count").alias("declared"))
    problem = (
        F.when(F.col("declared").isNull(), "no manifest")
        .when(F.coalesce("found", F.lit(0)) != F.col("declared"), F.format_string("%d rows, declared %d", F.coalesce("found", F.lit(0)), "declared"))
    )
    joined = found.join(declared, "path", "full_outer")
    return joined.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def merge_shards(rows: DataFrame, manifests: DataFrame) -> DataFrame:
    """The rows of all shards (``path`` tells them apart) as one table, without ``path``.

    Raises where :func:`shard_problems` or :func:`count_problems` have rows.
    """
    problems = shard_problems(manifests).unionByName(count_problems(rows, manifests))
    least = problems.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "problem")).alias("of")).first()
    if least.n:
        message = f"{least.of.path}: {least.of.problem} ({least.n} problems"
        raise ValueError(f"{message}; shard_problems and count_problems list them)")
    return rows.drop("path")


def manifest_validate(manifests: DataFrame) -> DataFrame:
    """One row per (manifest, broken rule); empty for a valid table."""
    return rule_problems(manifests)


def lineage(manifests: DataFrame) -> DataFrame:
    """(dataset_id, ancestor, depth): parents, their parents and so on, to the end.

    Each step keeps only pairs that no shorter way has found, so the walk ends where
    nothing new appears. A dataset that is its own ancestor is an error. Manifests are
    few; a step is a join of small stored tables.
    """
    edges = materialize(manifests.select("dataset_id", F.explode("parent_datasets").alias("ancestor")).distinct(), "lineage")
    parents = edges.select(F.col("dataset_id").alias("ancestor"), F.col("ancestor").alias("_up"))
    found = step = edges.withColumn("depth", F.lit(1))
    depth = 1
    while not step.isEmpty():
        if not step.where("dataset_id = ancestor").isEmpty():
            raise ValueError("a dataset is its own ancestor")
        depth += 1
        further = (
            step.join(parents, "ancestor")
            .select("dataset_id", F.col("_up").alias("ancestor"), F.lit(depth).alias("depth"))
            .distinct()
        )
        step = materialize(further.join(found, ["dataset_id", "ancestor"], "left_anti"), "lineage")
        found = found.unionByName(step)
    return found


# Declared datasets whose markers are broadcast, a few dozen bytes each; beyond, rows are joined by shuffles.
MOST_DECLARED = 100_000
# Parts that one dataset's rows are dealt to where they are shuffled.
SALTS = 64


def _with_markers(df: DataFrame, declared: DataFrame, most: int) -> DataFrame:
    """Rows of ``df`` with the declared markers of their dataset; others are dropped.

    The lookup holds only datasets that ``df`` has, and its size is checked. If it may be broadcast, no
    row is moved; if not, the rows of a dataset are salted.
    """
    used = declared.join(df.select("dataset_id").distinct(), "dataset_id", "left_semi")
    found = used.limit(most + 1).collect()
    if len(found) <= most:
        return df.join(F.broadcast(df.sparkSession.createDataFrame(found, used.schema)), "dataset_id")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    copies = declared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["dataset_id", "_salt"]).drop("_salt")


def drift_check(df: DataFrame, manifests: DataFrame, ids: str = "ids", most: int = MOST_DECLARED) -> DataFrame:
    """Rows whose marker neighbours differ from those their manifest declares.

    ``df`` has ``dataset_id`` and token ids; each marker occurrence inside the
    sequence is compared with the declared neighbours. Token ids stay where they are as long as the
    declared datasets are at most ``most``.
    """
    declared = manifests.select(
        "dataset_id",
        F.col("tokens.injection_token_id").alias("_inj"),
        F.col("tokens.injection_left_neighbor_id").alias("_left"),
        F.col("tokens.injection_right_neighbor_id").alias("_right"),
    )
    joined = _with_markers(df, declared, most)

    def neighbours(a: Column) -> Column:
        return F.array_compact(
            F.transform(
                a,
                lambda x, i: F.when(
                    x == F.col("_inj"),
                    F.struct(F.get(a, i - 1).alias("left"), F.get(a, i + 1).alias("right")),
                ),
            )
        )

    fits = F.size(
        F.filter(
            F.col("_spots"),
            lambda s: s["left"].eqNullSafe(F.col("_left")) & s["right"].eqNullSafe(F.col("_right")),
        )
    )
    return (
        joined.withColumn("_spots", let(F.col(ids), neighbours))
        .withColumn("markers", F.size("_spots"))
        .withColumn("good_markers", fits)
        .where(F.col("good_markers") != 1)
        .drop("_inj", "_left", "_right", "_spots")
    )
