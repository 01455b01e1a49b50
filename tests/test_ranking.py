"""Ranks, orders, batches and shards against plain Python."""

import contextlib
import hashlib
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlens.operators import batching, ranking, rollouts, selection


def h60(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(2000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), "id")


@pytest.mark.parametrize("digits", [0, 1, 3, 5])
def test_global_rank(keys, digits):
    want = {k: i for i, k in enumerate(sorted((f"k{i}" for i in range(2000)), key=lambda k: (h60(7, "s", k), k)))}
    got = ranking.global_rank(keys.repartition(7), ["k"], 7, "s", digits)
    assert {r.k: r["rank"] for r in got.collect()} == want


def test_rank_between_is_a_slice(keys):
    order = sorted((f"k{i}" for i in range(2000)), key=lambda k: (h60(1, "", k), k))
    for a, b in ((0, 10), (995, 1207), (1990, 5000), (5, 5)):
        got = {r.k for r in ranking.rank_between(keys, ["k"], 1, a, b).collect()}
        assert got == set(order[a:b])
    with pytest.raises(ValueError):
        ranking.rank_between(keys, ["k"], 1, 5, 4)


@pytest.fixture(scope="module")
def rewards(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        # Group 0 holds most rows; a third of all rewards share one value.
        group = 0 if i % 10 else 1 + i % 7
        value = -2.0 if i % 3 == 0 else round(rng.uniform(-4, 0), 3)
        rows.append((group, i, value if i % 100 else None, rng.randint(5, 20)))
    schema = "rollout_id long, sample_id long, reward double, response_length int"
    return spark.createDataFrame(rows, schema).repartition(6), rows


def by_group(rows):
    groups = {}
    for g, i, v, n in rows:
        if v is not None:
            groups.setdefault(g, []).append((i, v, n))
    return groups


@pytest.mark.parametrize("small", [1, 5, 100, selection.SMALL])
def test_exact_percentiles(rewards, monkeypatch, small):
    """Whatever is small enough to be put in order, and with few bits a round."""
    monkeypatch.setattr(selection, "BITS", 12 if small > 5 else 3)
    df, rows = rewards
    points = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = selection.exact_percentiles(df, ["rollout_id"], "reward", points, small)
    for r in got.collect():
        values = [v for _, v, _ in by_group(rows)[r.rollout_id]]
        want = np.percentile(values, [q * 100 for q in points.values()])
        assert np.allclose([r[p] for p in points], want)


def test_ordered_bits(spark):
    values = [float("-inf"), -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    bits = selection.ordered_bits(F.col("v")).alias("b")
    found = [r.b for r in df.select(bits).collect()]
    assert found == sorted(found) and len(set(found)) == len(values) - 1
    back = df.select(bits).select(selection.from_ordered_bits(F.col("b")).alias("v")).collect()
    assert [str(r.v + 0.0) for r in back] == [str(v + 0.0) for v in values]


def picks(sample, top, mid, bottom):
    order = [i for i, _ in sorted(((i, v) for i, v, _ in sample), key=lambda x: (-x[1], x[0]))]
    n = len(order)
    lo = max(0, n // 2 - mid // 2)
    lists = order[:top] + order[lo : lo + mid] + (order[-bottom:] if bottom else [])
    return list(dict.fromkeys(lists))


@pytest.mark.parametrize("sizes", [(6, 8, 6), (3, 0, 0), (0, 5, 2), (40, 40, 40), (1, 1, 0)])
def test_best_mid_worst(rewards, sizes):
    df, rows = rewards
    top, mid, bottom = sizes
    got = {}
    for r in rollouts.best_mid_worst(df, top, mid, bottom).orderBy("rollout_id", "pick").collect():
        got.setdefault(r.rollout_id, []).append(r.sample_id)
    assert got == {g: picks(s, *sizes) for g, s in by_group(rows).items()}


def asked(n):
    return F.array(
        F.struct(F.lit(0).alias("tag"), (n / 2).cast("bigint").alias("lo"), n.alias("hi")),
        F.struct(F.lit(1).alias("tag"), F.lit(-3).cast("bigint").alias("lo"), F.lit(4).cast("bigint").alias("hi")),
        F.struct(F.lit(2).alias("tag"), n.alias("lo"), (n + 5).alias("hi")),
    )


@pytest.mark.parametrize("small,most", [(1, 50_000), (7, 50_000), (400, 50_000), (50, 2), (1 << 15, 2)])
def test_rows_at_ranks(rewards, monkeypatch, small, most):
    """Buckets broadcast or stored, cut by value and then by tie; repeated rows take places of their own."""
    monkeypatch.setattr(selection, "MOST", most)
    monkeypatch.setattr(selection, "BITS", 4 if small < 50 else 12)
    df, rows = rewards
    twice = df.unionByName(df.where("sample_id % 50 = 0"))
    found = selection.rows_at_ranks(twice, ["rollout_id"], F.col("reward"), "sample_id", asked, small).collect()
    got = sorted((r.rollout_id, r.tag, r["rank"], r.sample_id, r.group_rows) for r in found)
    want = []
    for g, sample in by_group(rows + [r for r in rows if r[1] % 50 == 0]).items():
        order = [i for i, _ in sorted(((i, v) for i, v, _ in sample), key=lambda x: (x[1], x[0]))]
        n = len(order)
        want += [(g, 0, k, order[k], n) for k in range(n // 2, n)] + [(g, 1, k, order[k], n) for k in range(4)]
    assert got == sorted(want)


def test_ranks_exchange_counts_only(rewards):
    """A round moves one count per bucket, digit and map task, and no row of the table."""
    df, _ = rewards
    keyed = selection._keyed(df, ["rollout_id"], F.col("reward"), F.col("sample_id"))
    schema = "rollout_id long, _k_lo long, _k_hi long, _t_lo long, _t_hi long, _off long, _n long, _rows long, _ranks array<long>"
    row = (0, -(1 << 62), 1 << 62, 0, 5000, 0, 2700, 2700, [10, 1350])
    buckets = selection._local([row], spark_frame(df, schema))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        selection.refined(keyed, buckets, ["rollout_id"]).explain("formatted")
    moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", out.getvalue())
    assert moved and all("_digit" in columns for columns in moved[-1:])
    assert all(re.search(r"\b_k#|\b_t#", columns) is None for columns in moved)
    assert "SortMergeJoin" not in out.getvalue()


def spark_frame(df, schema):
    return df.sparkSession.createDataFrame([], schema)


def test_correlations(rewards):
    df, rows = rewards
    for r in rollouts.length_reward_corr(df).collect():
        sample = by_group(rows)[r.rollout_id]  # rows without a reward take no part, nor a rank
        lengths, values = [n for _, _, n in sample], [v for _, v, _ in sample]
        rank = lambda x: np.array([np.mean(np.flatnonzero(np.sort(x) == y)) for y in x])
        assert np.isclose(r.pearson, np.corrcoef(lengths, values)[0, 1])
        assert np.isclose(r.spearman, np.corrcoef(rank(np.array(lengths)), rank(np.array(values)))[0, 1])


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1, i, 5, 1.0 * i) for i in range(4)], "rollout_id int, sample_id int, response_length int, reward double")
    assert rollouts.length_reward_corr(df).collect()[0][1:] == (None, None)


def test_correlations_join_no_rows(rewards):
    df, _ = rewards
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        rollouts.length_reward_corr(df).explain("formatted")
    assert "sample_id" not in out.getvalue() and "response_length" not in out.getvalue()


@pytest.mark.parametrize("bits", [8, 16, 30])
def test_running_sum(spark, bits):
    """Dense and sparse integers, negative ones too, in hot and small groups."""
    rng = random.Random(1)
    sparse = {rng.randrange(-(1 << 62), 1 << 62) for _ in range(500)}
    rows = [(0 if i < 700 else i % 5, i, rng.randint(0, 9)) for i in range(1000)]
    rows += [(9, i, rng.randint(0, 9)) for i in sorted(sparse)]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(5)
    got = {r.i: r.s for r in ranking.running_sum(df, ["g"], "i", F.col("v"), "s", bits).collect()}
    sums = {}
    for g, i, v in rows:
        assert got[i] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v


def test_running_sum_orders_no_more_than_a_chunk(spark):
    """One group of 10^6 sparse integers: no task of any exchange gets more than a few chunks."""
    df = spark.range(1_000_000).select((F.col("id") * 1_000_003).alias("i"))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        last = ranking.running_sum(df, [], "i", F.lit(1), "s", bits=10)
        sizes = last.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 200_000
        assert last.where(F.col("s") != F.col("i") / 1_000_003).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_advantage(rewards):
    df, rows = rewards
    out = rollouts.group_advantage(df.where("reward is not null"), ["rollout_id"])
    for r in out.where("rollout_id = 2").collect():
        values = np.array([v for _, v, _ in by_group(rows)[2]])
        assert np.isclose(r.advantage, (r.reward - values.mean()) / (values.std() + 1e-6))


# --- batches ------------------------------------------------------------------------


def test_batches_cover_each_epoch_once(spark):
    df = spark.range(37).withColumnRenamed("id", "k")
    drawn = batching.batches(df, ["k"], 10, 12, seed=5).collect()
    assert len(drawn) == 120
    assert sorted(r.draw_index for r in drawn) == list(range(120))
    for epoch in range(3):
        assert sorted(r.k for r in drawn if r.epoch == epoch) == list(range(37))
    assert all(r.batch_id == r.draw_index // 10 for r in drawn)
    orders = [[r.k for r in sorted(drawn, key=lambda r: r.draw_index) if r.epoch == e] for e in range(3)]
    assert orders[0] != orders[1] != orders[2]
    epoch1 = batching.epoch_shuffle(df, ["k"], 5, 1).orderBy("epoch_rank").collect()
    assert [r.k for r in epoch1] == orders[1]


def test_batches_resume(spark):
    df = spark.range(23).withColumnRenamed("id", "k")
    whole = {r.draw_index: r.k for r in batching.batches(df, ["k"], 4, 10, seed=1).collect()}
    rest = {r.draw_index: r.k for r in batching.batches(df, ["k"], 4, 5, seed=1, start=20).collect()}
    assert rest == {i: whole[i + 20] for i in range(20)}
    assert batching.resume_offset(20, handed_back=3) == 17
    assert batching.resume_offset(2, handed_back=5) == 0
    assert batching.resume_offset(None) == 0
    with pytest.raises(ValueError):
        batching.resume_offset(None, step=3)


def test_batches_in_key_order_and_larger_than_the_table(spark):
    df = spark.range(7).withColumnRenamed("id", "k")
    drawn = batching.batches(df, ["k"], 20, 1).collect()
    assert [r.k for r in sorted(drawn, key=lambda r: r.draw_index)] == [i % 7 for i in range(20)]


def test_sample_groups(spark):
    df = spark.range(5).withColumnRenamed("id", "k")
    rows = batching.sample_groups(batching.batches(df, ["k"], 5, 1, seed=0), 3).collect()
    assert sorted(r.sample_index for r in rows) == list(range(15))
    assert all(r.group_index == r.sample_index // 3 for r in rows)


@pytest.mark.parametrize("rows", [1, 2, 9, 1000])
def test_vector_shuffle(spark, rows):
    """Each row takes its successor's vector in one ring, whatever the number of rows or ranges."""
    keys = [(f"d{i % 50}", i) for i in range(rows)]
    order = sorted(keys, key=lambda k: (h60(9, "ds", "activ", *k), k))
    want = {k: float(order[(i + 1) % rows][1]) for i, k in enumerate(order)}
    table = [(d, i, [float(i)] * 4) for d, i in keys]
    df = spark.createDataFrame(table, "doc_id string, n_raw_tokens long, activation_vector array<float>")
    for given, partitions in ((3, 1), (8, 7), (2, 600)):
        out = batching.vector_shuffle(df.repartition(given), batching.KEYS, 9, "ds", partitions=partitions).collect()
        assert {(r.doc_id, r.n_raw_tokens): r.activation_vector[0] for r in out} == want and len(out) == rows


def test_vector_shuffle_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id string, n_raw_tokens long, activation_vector array<float>")
    assert batching.vector_shuffle(df, batching.KEYS, 9, "ds").collect() == []


def test_vector_shuffle_keeps_null_vectors(spark):
    rows = [("d", i, None if i == 3 else [float(i)]) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id string, n_raw_tokens long, activation_vector array<float>")
    out = batching.vector_shuffle(df, batching.KEYS, 1, "ds").collect()
    assert sum(r.activation_vector is None for r in out) == 1


def test_permute_join_moves_every_value(spark):
    df = spark.range(200).select("id", (F.col("id") * 10).alias("v"))
    rows = batching.permute_join(df, ["id"], 4, "ds", "v").collect()
    assert sorted(r.v for r in rows) == [i * 10 for i in range(200)]
    assert all(r.v == r.source_id * 10 for r in rows)
    assert sum(r.id == r.source_id for r in rows) < 10


def test_row_shuffle(spark):
    rows = [(f"d{i % 7}", i, str(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id string, n_raw_tokens long, t string")
    a = {r.shuffle_rank: r.t for r in batching.row_shuffle(df, batching.KEYS, 1, "x").collect()}
    b = {r.shuffle_rank: r.t for r in batching.row_shuffle(df, batching.KEYS, 1, "y").collect()}
    assert sorted(a) == list(range(500)) and sorted(a.values()) == sorted(b.values()) and a != b


# --- shards ---------------------------------------------------------------------------


def test_even_slices(spark):
    df = spark.range(10, 33).withColumnRenamed("id", "doc_idx")
    rows = batching.even_slices(df, 10, 20, 3).collect()
    assert {r.doc_idx: r.worker for r in rows} == {i: min((i - 10) // 6, 2) for i in range(10, 30)}
    with pytest.raises(ValueError):
        batching.even_slices(df, 0, 2, 3)


def test_equal_shards(spark):
    rows = [(0, i) for i in range(30)] + [(1, i) for i in range(11)]
    df = spark.createDataFrame(rows, "s long, i long")
    kept = batching.equal_shards(df, "s", "i", 4).collect()
    assert sorted((r.s, r.i) for r in kept) == [(s, i) for s in (0, 1) for i in range(8)]
    with pytest.raises(Exception, match="no whole micro-batch"):
        batching.equal_shards(df, "s", "i", 12).collect()


def test_packed_offsets(spark):
    df = spark.createDataFrame([(0, 0, 4), (0, 1, 2), (0, 2, 5), (1, 0, 3)], "b long, i long, n long")
    rows = batching.packed_offsets(df, "n", "b", "i").orderBy("b", "i").collect()
    assert [(r.start_offset, r.last_index) for r in rows] == [(0, 3), (4, 5), (6, 10), (0, 2)]


# --- policies -------------------------------------------------------------------------


def test_mismatch_of_unequal_arrays_is_an_error(spark):
    schema = "rollout_id long, train_log_probs array<double>, rollout_log_probs array<double>"
    good = [(1, [-1.0, -2.0], [-1.0, -2.0]), (1, None, [-1.0]), (1, None, None), (1, [], [])]
    row = rollouts.mismatch_metrics(spark.createDataFrame(good, schema)).first()
    assert (row.tokens, row.tis, row.tis_abs, row.tis_k3) == (2, 1.0, 0.0, 0.0)
    bad = spark.createDataFrame([*good, (1, [-1.0], [-1.0, -2.0])], schema)
    with pytest.raises(Exception, match="unequal length: 1 and 2"):
        rollouts.mismatch_metrics(bad).collect()
