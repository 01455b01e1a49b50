"""What the physical plans must look like."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from actlens.functions.text import tokenize
from actlens.operators import batching, ranking, sampling
from actlens.session import scratch_path
from actlens.sources.corpus import corpus_slice, read_projected


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def stored(spark):
    path = scratch_path(spark, "stored")
    spark.range(1000).select(
        F.concat(F.lit("d"), F.col("id") % 50).alias("doc_id"),
        F.col("id").alias("n_raw_tokens"),
        F.col("id").alias("doc_idx"),
        F.repeat(F.lit("w "), 80).alias("text"),
        F.array(F.lit(1.0).cast("float")).alias("activation_vector"),
    ).write.parquet(path)
    return path


def wide_exchanges(text: str, column: str) -> int:
    """Exchanges whose input holds ``column``."""
    blocks = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)
    return sum(column in b for b in blocks)


def test_slice_is_pushed_down(spark, stored):
    text = plan(corpus_slice(spark.read.parquet(stored), 10, 20).select("doc_id"))
    assert "GreaterThanOrEqual(doc_idx,10)" in text and "LessThanOrEqual(doc_idx,29)" in text
    assert "text" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_only_named_columns_are_read(spark, stored):
    text = plan(read_projected(spark, stored, ["doc_id"]))
    assert "ReadSchema: struct<doc_id:string>" in text


def test_sampling_never_shuffles(spark, stored):
    docs = spark.read.parquet(stored).select("doc_id", tokenize(F.col("text")).alias("tokens"))
    text = plan(sampling.position_sample(docs, 10, 1))
    assert "Exchange" not in text and "Python" not in text


def test_split_moves_no_row(spark, stored):
    rows = spark.read.parquet(stored)
    text = plan(sampling.doc_split(rows, {"a": 0.5, "b": 0.5}, 1))
    main = text.split("===== Subqueries =====")[0]
    assert "Exchange" not in main and "Join" not in main
    assert wide_exchanges(text, "activation_vector") == 0


def test_row_shuffle_moves_wide_rows_once(spark, stored):
    text = plan(batching.row_shuffle(spark.read.parquet(stored), batching.KEYS, 1, "x"))
    assert wide_exchanges(text, "activation_vector") == 1


def test_vectors_meet_samples_without_moving_prefixes(spark, tmp_path):
    """The prefixes are cut after the last exchange; repeated and NULL ids and repeated vectors keep their rows."""
    words = " ".join(f"w{i}" for i in range(70))
    docs = [("a", words), ("a", words), ("a", words + " x"), (None, words[::-1]), ("b", "short")]
    docs = spark.createDataFrame(docs, "doc_id string, text string")
    docs = docs.select("doc_id", F.split("text", " ").alias("tokens"))
    vectors = spark.createDataFrame([(0, "p"), (1, "q"), (1, "r"), (None, "s")], "vec_id long, v string")

    def attach(keys):
        return keys.withColumn("vec_id", F.col("n_raw_tokens") % 2).join(vectors, "vec_id")

    got = sampling.position_sample_with(docs, 10, 1, attach)
    want = attach(sampling.position_sample(docs, 10, 1)).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 40
    text = plan(got)
    for block in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text):
        assert not ("_doc" in block and "n_raw_tokens" in block) and "detokenized" not in block


def test_vector_shuffle_moves_wide_rows_once(spark, stored):
    rows = spark.read.parquet(stored)
    text = plan(batching.vector_shuffle(rows, batching.KEYS, 1, "x"))
    assert wide_exchanges(text, "_v#") == 1 and "Join" not in text
    assert len(re.findall(r"\(\d+\) Exchange", text)) == 1 and "SinglePartition" not in text


def test_slices_of_the_order_are_filters(spark, stored):
    text = plan(ranking.rank_between(spark.read.parquet(stored), batching.KEYS, 1, 5, 50))
    main = text.split("===== Subqueries =====")[0]
    assert "Exchange" not in main


def test_single_partition_only_for_count_tables(spark, stored):
    text = plan(ranking.global_rank(spark.read.parquet(stored).select("doc_id", "n_raw_tokens"), batching.KEYS, 1))
    for block in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: SinglePartition", text):
        assert "doc_id" not in block and "n_raw_tokens" not in block


def test_catalyst_only_operators(spark):
    import __spark_entry__ as entry

    python_free = (
        "tokenize position_sample doc_split row_shuffle vector_shuffle batches cache_join cache_source "
        "prior_run_join build_av build_ar rollout_summary best_mid_worst group_advantage mismatch_metrics "
        "length_reward_corr shard_contiguity lineage marker_sites clean_features"
    ).split()
    queries = entry.queries()
    for name in python_free:
        text = plan(queries[name](spark, "/root/testdata/sf0.001"))
        assert "EvalPython" not in text and "InPandas" not in text and "InArrow" not in text, name
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
