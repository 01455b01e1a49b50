"""Merging the shards of a base dataset: one checked scan, one written table, one manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from actlens.operators.shards import merge_shards, merged_slice, scan_shards
from actlens.schemas import MANIFEST
from actlens.sources.manifest import Manifest, as_object, base_dataset_id, derive_manifest
from actlens.sources.sinks import write_dataset


def merge_job(
    spark: SparkSession, root: str, manifests: DataFrame, dst: str, schema: StructType | None = None
) -> Manifest:
    """Write the shards under ``root`` as one dataset at ``dst`` and return its manifest.

    ``manifests`` has one row per shard, whose ``path`` is the shard's folder below ``root``. All
    problems are found before anything is written. The merged manifest is that of a
    serial run over the whole slice: same id, the shards in order as its parents.
    """
    rows = scan_shards(spark, root, schema)
    table = merge_shards(rows, manifests)
    whole = merged_slice(manifests).first()
    start = F.col("extraction.corpus_slice.start")
    known = [c for c in MANIFEST.fieldNames() if c in manifests.columns]
    first = as_object(manifests.orderBy(start).select(*known).first())  # checked when it is stored
    e = first.extraction
    e.corpus_slice = {"start": whole.start, "length": whole.length}
    merged = derive_manifest(
        first,
        dataset_id=base_dataset_id(e.base_model, e.layer_index, e.corpus, whole.start, whole.length),
        parent_datasets=list(whole.parent_datasets),
        row_count=whole.row_count,
        created_by="merge",
    )
    stored = write_dataset(table, dst, schema or table.schema, merged)
    if stored.row_count != whole.row_count:
        raise ValueError(f"merged rows {stored.row_count} != declared rows {whole.row_count}")
    return stored
