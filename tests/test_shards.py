"""Manifests, shards, lineage."""

import contextlib
import io
import os
import re

import pytest
from pyspark.sql import functions as F

from actlens.operators import shards
from actlens.plans import build
from actlens.plans.merge import merge_job
from actlens.session import scratch_path
from actlens.sources import manifest as mf
from actlens.sources import sinks
from actlens.sources.corpus import read_batched


def make(stage="base", **changes):
    values = dict(
        dataset_id="base_m_L2_x",
        stage=stage,
        row_count=3,
        extraction=mf.Extraction("org/m", 4, 2, "none", "corp", {"start": 0, "length": 5}, 10),
    )
    return mf.Manifest(**(values | changes))


TOKENS = mf.TokenInfo("x", 9, 5, 6, [1, 2])


def test_round_trip(spark):
    path = scratch_path(spark, "m") + "/data"
    full = make("ar_sft", tokens=TOKENS, prompt_templates={"actor": "a", "critic": "c"}, parent_datasets=["p"])
    mf.manifest_write(spark, full, path)
    back = mf.manifest_read(spark, path)
    assert back.created_at.endswith("+00:00") and back.code_version
    assert mf.derive_manifest(back) == mf.derive_manifest(full, parent_datasets=[full.dataset_id])


@pytest.mark.parametrize(
    "bad",
    [
        dict(kind="other"),
        dict(schema_version=2),
        dict(stage="rl"),
        dict(stage="rl", tokens=TOKENS),
        dict(stage="rl", tokens=mf.TokenInfo("x", -1, -1, -1), prompt_templates={"actor": "a"}),
        dict(stage="ar_sft", tokens=TOKENS, prompt_templates={"actor": "a"}),
        dict(stage="ar_sft", tokens=mf.TokenInfo("x", 1, 2, 3), prompt_templates={"actor": "a", "critic": "c"}),
    ],
)
def test_invalid_manifests(spark, bad):
    with pytest.raises(ValueError):
        mf.checked(mf.manifest_frame(spark, [make(**bad)]))


def test_ids_agree(spark):
    args = ("org/model", 3, "corp", 100, 250)
    column = spark.range(1).select(mf.dataset_id(*[F.lit(a) for a in args]).alias("i")).first().i
    assert column == mf.base_dataset_id(*args)
    assert column.startswith("base_model_L3_")
    with pytest.raises(ValueError):
        mf.pick_manifest(None, None, "")
    assert mf.pick_manifest(None, None, "x@[0:5]") == "x"


def shard_table(spark, slices, layers=None, rows=None):
    out = []
    for i, (start, length) in enumerate(slices):
        layer = (layers or [2] * 9)[i]
        n = (rows or [b for _, b in slices])[i]
        out.append((f"s{i}", f"ds{i}", "base", n, ("m", 4, layer, "none", "c", (start, length), 10)))
    schema = (
        "path string, dataset_id string, stage string, row_count long, extraction struct<base_model string,"
        "d_model long, layer_index long, norm string, corpus string,"
        "corpus_slice struct<start long, length long>, positions_per_doc long>"
    )
    return spark.createDataFrame(out, schema)


def labelled(spark, slices):
    """Rows of shards s0, s1, …, told apart by ``path``."""
    rows = [(i, f"s{k}") for k, (a, n) in enumerate(slices) for i in range(a, a + n)]
    return spark.createDataFrame(rows, "id long, path string")


def test_merge(spark):
    slices = [(50, 20), (0, 50), (70, 5)]
    merged = shards.merge_shards(labelled(spark, slices), shard_table(spark, slices))
    assert merged.columns == ["id"]
    assert sorted(r.id for r in merged.collect()) == list(range(75))
    whole = shards.merged_slice(shard_table(spark, slices)).first()
    assert (whole.start, whole.length, whole.parent_datasets) == (0, 75, ["ds1", "ds0", "ds2"])


@pytest.mark.parametrize(
    ("slices", "layers", "rows", "message"),
    [
        ([(0, 10), (15, 5)], None, None, "gap"),
        ([(0, 10), (5, 5)], None, None, "overlap"),
        ([(0, 10), (10, 5)], [2, 3], None, "differs in layer_index"),
        ([(0, 10), (10, 5)], None, [10, 6], "s1: 5 rows, declared 6"),
    ],
)
def test_bad_merges(spark, slices, layers, rows, message):
    with pytest.raises(ValueError, match=message):
        shards.merge_shards(labelled(spark, slices), shard_table(spark, slices, layers, rows))


def test_counts_by_shard(spark):
    """Rows are compared shard by shard: a surplus in one does not make up for another."""
    declared = shard_table(spark, [(0, 10), (10, 5), (15, 3)])
    rows = labelled(spark, [(0, 11), (11, 4)]).unionByName(spark.createDataFrame([(9, "s9")], "id long, path string"))
    found = {r.path: r.problem for r in shards.count_problems(rows, declared).collect()}
    assert found == {"s0": "11 rows, declared 10", "s1": "4 rows, declared 5", "s2": "0 rows, declared 3", "s9": "no manifest"}
    with pytest.raises(ValueError, match="4 problems"):
        shards.merge_shards(rows, declared)


def test_merge_job(spark):
    """One scan of all shard folders; nothing is written where a shard is wrong."""
    slices = [(50, 20), (0, 50), (70, 5)]
    root, dst = scratch_path(spark, "shards"), scratch_path(spark, "merged")
    labelled(spark, slices).withColumn("part", F.col("path")).write.partitionBy("part").parquet(root)
    manifests = shard_table(spark, slices).withColumn("path", F.concat(F.lit("part="), "path"))
    scan = shards.scan_shards(spark, root).drop("path")
    assert {r.path for r in shards.scan_shards(spark, root).select("path").distinct().collect()} == {f"part=s{i}" for i in range(3)}
    assert scan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    with pytest.raises(ValueError, match="part=s2: 5 rows, declared 4"):
        merge_job(spark, root, shard_table(spark, slices, rows=[20, 50, 4]).withColumn("path", F.concat(F.lit("part="), "path")), dst)
    assert not os.path.exists(dst.removeprefix("file:"))
    schema = spark.createDataFrame([], "id long").schema
    merged = merge_job(spark, root, manifests, dst, schema)
    assert (merged.row_count, merged.parent_datasets) == (75, ["ds1", "ds0", "ds2"])
    assert merged.dataset_id == mf.base_dataset_id("m", 2, "c", 0, 75) and mf.manifest_read(spark, dst).row_count == 75
    assert sorted(r.id for r in spark.read.parquet(dst).collect()) == list(range(75))


def test_row_groups_are_bounded(spark):
    """The writer's limit shows in the footers; a table written without it is refused."""
    path, other = scratch_path(spark, "bounded"), scratch_path(spark, "free")
    rows = spark.range(0, 2000, 1, 1).select("id")
    stored = sinks.write_dataset(rows, path, rows.schema, make(), max_rows_per_file=900, row_group_rows=128)
    assert stored.row_count == 2000
    sizes = sinks.row_groups(spark, path)
    assert sizes.agg(F.sum("row_count"), F.max("row_count")).first()[:] == (2000, 128)
    assert sizes.select("file").distinct().count() == 3
    assert sinks.checked_row_groups(spark, path, 128) == 128
    rows.write.parquet(other)
    with pytest.raises(ValueError, match="row group of 2000 rows"):
        sinks.checked_row_groups(spark, other, 128)


def test_split_size_is_the_readers_own(spark):
    path = scratch_path(spark, "batched")
    spark.range(0, 20_000, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("t")).write.option(
        "parquet.block.row.count.limit", 1000
    ).parquet(path)
    before = dict(spark.conf.getAll)
    many, few = read_batched(spark, path, 64 << 10), read_batched(spark, path, 1 << 30)
    assert dict(spark.conf.getAll) == before

    def splits(df):
        return df.select(F.spark_partition_id().alias("p")).distinct().count()

    assert splits(many) > 5 * splits(few) and many.count() == few.count() == 20_000
    joined = spark.range(1).select(F.sha2(F.lit("7"), 256).alias("t")).join(many, "t")
    assert joined.count() == 1


def test_lineage(spark):
    edges = [("c", ["b"]), ("b", ["a"]), ("a", ["root1", "root2"]), ("d", ["b", "a"])]
    df = spark.createDataFrame(edges, "dataset_id string, parent_datasets array<string>")
    got = {(r.dataset_id, r.ancestor): r.depth for r in shards.lineage(df).collect()}
    assert got[("c", "a")] == 2 and got[("c", "root1")] == 3
    assert got[("d", "a")] == 1 and got[("d", "root2")] == 2
    assert len(got) == 1 * 4 + 3 + 2 + 4


def test_lineage_has_no_depth_limit(spark):
    schema = "dataset_id string, parent_datasets array<string>"
    chain = [(f"d{i}", [f"d{i + 1}"]) for i in range(10)]
    rows = shards.lineage(spark.createDataFrame(chain, schema)).collect()
    assert len(rows) == 55 and max(r.depth for r in rows) == 10
    with pytest.raises(ValueError):
        shards.lineage(spark.createDataFrame([("a", ["b"]), ("b", ["a"])], schema))


def test_guards(spark):
    df = spark.range(1).withColumn("api_explanation", F.lit("e"))
    build.stage_guards(make(), df, "av_sft")
    with pytest.raises(ValueError, match="expected a base dataset"):
        build.stage_guards(make("rl"), df, "rl")
    normed = make()
    normed.extraction.norm = "unit"
    with pytest.raises(ValueError, match="raw vectors"):
        build.stage_guards(normed, df, "rl")
    with pytest.raises(ValueError, match="api_explanation"):
        build.stage_guards(make(), spark.range(1), "ar_sft")
    with pytest.raises(ValueError, match="empty"):
        build.stage_guards(make(), spark.range(0), "rl")


def test_drift(spark):
    declared = spark.createDataFrame([("d", (9, 5, 6))], "dataset_id string, tokens struct<injection_token_id long, injection_left_neighbor_id long, injection_right_neighbor_id long>")
    rows = [(0, "d", [5, 9, 6]), (1, "d", [4, 9, 6]), (2, "d", [9, 6]), (3, "d", [5, 9, 6, 5, 9, 6]), (4, "d", [1])]
    df = spark.createDataFrame(rows, "id long, dataset_id string, ids array<long>")
    for most, moved in ((10, False), (0, True)):
        found = shards.drift_check(df, declared, most=most)
        assert {r.id: (r.markers, r.good_markers) for r in found.collect()} == {1: (1, 0), 2: (1, 0), 3: (2, 2), 4: (0, 0)}
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            found.explain("formatted")
        # Few declared datasets are broadcast and no token ids move; many are joined by salted keys.
        exchanges = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", out.getvalue())
        assert any("ids#" in e and "_salt#" in e for e in exchanges) == moved
        assert moved or not exchanges


def test_shard_problems_are_all_listed(spark):
    slices = [(10 * i + i, 10) for i in range(30)]
    found = shards.shard_problems(shard_table(spark, slices, layers=[2] * 30))
    assert found.count() == 29 and {r.problem.split()[0] for r in found.collect()} == {"gap"}
    with pytest.raises(ValueError, match="29 problems"):
        shards.merge_shards(labelled(spark, slices), shard_table(spark, slices, layers=[2] * 30))
