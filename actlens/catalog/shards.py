"""Shard manifests, merging, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from actlens.catalog.registry import query
from actlens.catalog.views import LAYER, MODEL
from actlens.operators import joins, shards
from actlens.plans.merge import merge_job
from actlens.session import scratch_path
from actlens.sources import manifest as mf


@query("dataset_id", "SELECT path, dataset_id FROM shards")
def dataset_id(v):
    return v.shards().select("path", "dataset_id")


@query(
    "shard_agreement",
    """SELECT run, path, 'layer_index' AS differs_in FROM (
         SELECT *, first_value(layer) OVER (PARTITION BY run ORDER BY start, path) AS ref FROM shards) WHERE layer <> ref""",
)
def shard_agreement(v):
    return shards.shard_agreement(v.shards(), ["run"])


_NEXT = """
  SELECT run, path, start + length AS ends_at, lead(start) OVER (PARTITION BY run ORDER BY start, path) AS next_start FROM shards"""


@query(
    "shard_contiguity",
    f"""SELECT *, CASE WHEN next_start > ends_at THEN 'gap' ELSE 'overlap' END AS problem FROM ({_NEXT}) WHERE next_start <> ends_at""",
)
def shard_contiguity(v):
    return shards.shard_contiguity(v.shards(), ["run"])


@query(
    "rowcount_check",
    "SELECT count(*) AS found, (SELECT sum(row_count)::BIGINT FROM shards WHERE run = 'whole') AS declared, true AS agrees FROM documents",
)
def rowcount_check(v):
    return shards.rowcount_check(v.table("documents"), v.shards().where(F.col("run") == "whole"))


@query(
    "merge_shards",
    """SELECT lang, count(*) AS row_count, sum(length(text))::BIGINT AS chars,
         (SELECT dataset_id FROM (SELECT 'base_tiny-model_L20_' || substr(sha256('acme/tiny-model|20|documents|{''start'': '
            || min(start) || ', ''length'': ' || sum(length) || '}'), 1, 8) AS dataset_id FROM shards WHERE run = 'whole')) AS dataset_id
       FROM documents GROUP BY 1""",
)
def merge_shards(v):
    """Shards of 100 documents in folders of their own, merged by a job; the id is that of a serial run."""
    root, dst = scratch_path(v.spark, "shards"), scratch_path(v.spark, "merged")
    docs = v.table("documents").withColumn("whole", F.concat(F.lit("shard-"), F.floor(F.col("doc_id") / 100)))
    docs.repartition("whole").write.partitionBy("whole").parquet(root)
    manifests = v.shards().where(F.col("run") == "whole").drop("run")
    manifests = manifests.withColumn("path", F.concat(F.lit("whole="), F.substring_index("path", "/", -1)))
    merged = merge_job(v.spark, root, manifests, dst, v.table("documents").schema)
    return (
        v.spark.read.parquet(dst)
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.length("text")).alias("chars"))
        .withColumn("dataset_id", F.lit(merged.dataset_id))
    )


@query(
    "merged_slice",
    """SELECT run, min(start) AS start, sum(length)::BIGINT AS length, sum(row_count)::BIGINT AS row_count,
         string_agg(dataset_id, ',' ORDER BY start) AS parents FROM shards GROUP BY 1""",
)
def merged_slice(v):
    return shards.merged_slice(v.shards(), ["run"]).select(
        "run", "start", "length", "row_count", F.array_join("parent_datasets", ",").alias("parents")
    )


@query("complete_shards", "SELECT path, row_count FROM shards WHERE run = 'whole'")
def complete_shards(v):
    """Shards found in the data that a manifest with the same row count declares."""
    shard = F.floor(F.col("doc_id") / 100).cast("string")
    found = v.table("documents").groupBy(F.concat(F.lit("whole/shard-"), shard).alias("path")).agg(
        F.count(F.lit(1)).alias("row_count")
    )
    return joins.complete_shards(found, v.shards())


@query(
    "manifest_write",
    "SELECT dataset_id, stage, row_count, start, length, layer FROM (SELECT *, 'base' AS stage FROM shards)",
)
def manifest_write(v):
    """Manifests of all shards stored as JSON and read with the fixed schema."""
    path = scratch_path(v.spark, "manifests")
    mf.write_manifests(v.shards(), path)
    extraction = F.col("extraction")
    return mf.read_manifests(v.spark, path).select(
        "dataset_id",
        "stage",
        "row_count",
        extraction["corpus_slice"]["start"].alias("start"),
        extraction["corpus_slice"]["length"].alias("length"),
        extraction["layer_index"].alias("layer"),
    )


@query(
    "manifest_read",
    "SELECT dataset_id, 64::BIGINT AS d_model, row_count, CAST(NULL AS VARCHAR) AS created_by FROM shards",
)
def manifest_read(v):
    """Manifests parsed from JSON text; the unknown key ``run`` is dropped."""
    lines = v.shards().select(F.to_json(F.struct("*")).alias("value"))
    return mf.parse_manifests(lines).select(
        "dataset_id", F.col("extraction.d_model").alias("d_model"), "row_count", "created_by"
    )


_DERIVED = ", ".join(["('av_sft')", "('ar_sft')", "('rl')"])


@query(
    "derive_manifest",
    f"""SELECT dataset_id || '__' || b || '_raw' AS dataset_id, b || '_' || replace(dataset_id, 'base_', '') || '__' || b || '_raw__shuf42' AS final_id,
          dataset_id AS parent FROM shards, (VALUES {_DERIVED}) t(b) WHERE run = 'whole'""",
)
def derive_manifest(v):
    """Ids along the chain split, build, shuffle for every shard of the whole run."""
    rows = v.shards().where(F.col("run") == "whole")
    for_stage = rows.withColumn("bucket", F.explode(F.array(*map(F.lit, mf.TRAINING_STAGES))))
    split = mf.derive_manifests(for_stage, F.concat("dataset_id", F.lit("__"), "bucket", F.lit("_raw")))
    name = F.concat("bucket", F.lit("_"), F.regexp_replace("dataset_id", "^base_", ""))
    built = mf.derive_manifests(split, name, stage=F.col("bucket"))
    shuffled = mf.derive_manifests(built, F.concat("dataset_id", F.lit("__shuf42")))
    # Up the chain by the parents that the manifests name.
    up = [
        m.select(F.col("dataset_id").alias(f"id{i}"), F.get("parent_datasets", F.lit(0)).alias(f"id{i + 1}"))
        for i, m in enumerate((shuffled, built, split))
    ]
    return up[0].join(up[1], "id1").join(up[2], "id2").select(
        F.col("id2").alias("dataset_id"), F.col("id0").alias("final_id"), F.col("id3").alias("parent")
    )


@query(
    "manifest_validate",
    """SELECT dataset_id, unnest(list_filter([
         CASE WHEN kind <> 'activation_dataset' THEN 'kind' END,
         CASE WHEN schema_version <> 1 THEN 'schema_version' END,
         CASE WHEN trained AND NOT has_tokens THEN 'tokens' END,
         CASE WHEN trained AND NOT has_templates THEN 'actor_template' END,
         CASE WHEN stage = 'ar_sft' AND NOT (has_tokens AND has_suffix) THEN 'critic_suffix' END,
         CASE WHEN stage = 'ar_sft' AND NOT has_templates THEN 'critic_template' END], lambda p: p IS NOT NULL)) AS problem FROM catalog""",
)
def manifest_validate(v):
    return shards.manifest_validate(v.catalog())


@query(
    "lineage",
    """WITH RECURSIVE up AS (
         SELECT dataset_id, parent AS ancestor, 1 AS depth FROM catalog
         UNION ALL SELECT up.dataset_id, c.parent, up.depth + 1 FROM up JOIN catalog c ON up.ancestor = c.dataset_id)
       SELECT dataset_id, ancestor, min(depth) AS depth FROM up GROUP BY 1, 2""",
)
def lineage(v):
    return shards.lineage(v.catalog())


@query(
    "drift_check",
    """SELECT doc_id, count(*) FILTER (id = 9) AS markers, count(*) FILTER (id = 9 AND l = 5 AND r = 6) AS good_markers FROM (
         SELECT doc_id, id, lag(id) OVER w AS l, lead(id) OVER w AS r FROM (
           SELECT doc_id, unnest(list_transform(tokens, lambda t: length(t))) AS id, unnest(range(len(tokens))) AS i
           FROM tokens WHERE source <> 'src5') WINDOW w AS (PARTITION BY doc_id ORDER BY i))
       GROUP BY 1 HAVING good_markers <> 1""",
)
def drift_check(v):
    """Word lengths as token ids against the neighbours that the source's manifest declares."""
    ids = F.transform("tokens", lambda t: F.length(t))
    rows = v.tokens().select("doc_id", F.concat(F.lit("rl_"), "source").alias("dataset_id"), ids.alias("ids"))
    declared = v.catalog().where(F.col("tokens").isNotNull())
    return shards.drift_check(rows, declared).select(
        "doc_id",
        F.col("markers").cast("bigint").alias("markers"),
        F.col("good_markers").cast("bigint").alias("good_markers"),
    )
