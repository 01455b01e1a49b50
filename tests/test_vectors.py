"""Vector functions and aggregates against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlens.functions import vectors
from actlens.functions.vectors import list_offsets
from actlens.operators import aggregates, filters, joins
from actlens.plans.evaluate import round_trip, score_rollouts
from actlens.slots import SignReconstructor, SignVerbalizer

D = 16


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(0)
    pred, gold = rng.normal(size=(300, D)) * 5, rng.normal(size=(300, D)) * 90 + 20
    # Two thirds of the rows are in one group.
    rows = [(i, min(i % 6, 2), p.tolist(), g.tolist()) for i, (p, g) in enumerate(zip(pred, gold))]
    df = spark.createDataFrame(rows, "id long, grp int, pred array<float>, gold array<float>")
    return df.repartition(5), pred.astype(np.float32).astype(float), gold.astype(np.float32).astype(float)


def unit(x, s):
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12) * s


def test_pair_scores(pairs):
    df, pred, gold = pairs
    for scale in (None, 3.0, vectors.SQRT_D):
        s = {None: None, 3.0: 3.0, vectors.SQRT_D: math.sqrt(D)}[scale]
        p, g = (pred, gold) if s is None else (unit(pred, s), unit(gold, s))
        want = ((p - g) ** 2).mean(axis=1)
        got = df.select("id", vectors.direction_mse(F.col("pred"), F.col("gold"), scale).alias("m"))
        by_id = {r.id: r.m for r in got.collect()}
        assert np.allclose([by_id[i] for i in range(300)], want)


def test_mse_is_two_minus_two_cosine(pairs):
    df, _, _ = pairs
    s = vectors.pair_scores(F.col("pred"), F.col("gold"))
    row = df.select(F.max(F.abs(s["mse"] - 2 * (1 - s["cosine"]))).alias("d")).first()
    assert row.d < 1e-9


def test_rescale(spark):
    rows = [(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, [0.0, 1e-3])]
    df = spark.createDataFrame(rows, "id long, v array<float>").orderBy("id")
    got = df.select(vectors.rescale(F.col("v"), 10.0).alias("r")).collect()
    assert np.allclose(got[0].r, [6, 8])
    assert got[1].r == [0, 0] and got[2].r is None and np.allclose(got[3].r, [0, 10])
    twice = df.select(vectors.rescale(vectors.rescale(F.col("v"), 10.0), 10.0).alias("r")).collect()
    assert np.allclose(twice[0].r, got[0].r)
    assert df.select(vectors.rescale(F.col("v"), None).alias("r")).collect()[0].r == [3, 4]


def test_norms_of_ragged_rows(spark):
    rows = [(0, [3.0, 4.0]), (1, []), (2, None), (3, [1.0]), (4, [2.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>").orderBy("id")
    got = [r.n for r in df.select(vectors.l2_norm(F.col("v")).alias("n")).collect()]
    assert got == [5.0, 0.0, None, 1.0, 3.0]


def test_checks(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    assert {r.id for r in filters.finite_vectors(df, "v").collect()} == {0, 3}
    assert {r.id for r in filters.non_finite_vectors(df, "v").collect()} == {1, 2}
    assert [(r.id, r.width) for r in filters.width_check(df, "v", 2).collect()] == [(3, 1)]
    with pytest.raises(Exception, match="NaN or infinite"):
        filters.finite_vectors(df, "v", strict=True).collect()
    with pytest.raises(Exception, match="differ in width"):
        df.select(vectors.cosine(F.col("v"), F.slice("v", 1, 1))).collect()


def test_reward(spark):
    df = spark.createDataFrame([(0.5, True), (0.0, True), (None, False)], "mse double, ok boolean")
    plain = [r.r for r in df.select(vectors.reward(F.col("mse"), F.col("ok")).alias("r")).collect()]
    assert plain == [-0.5, 0.0, -2.0]
    logged = df.select(vectors.reward(F.col("mse"), F.col("ok"), True).alias("r")).collect()
    assert np.allclose([r.r for r in logged], [-math.log(0.5), -math.log(1e-8), -math.log(2)])


def test_resolve_scale():
    assert vectors.resolve_scale(None, 4) is None
    assert vectors.resolve_scale("raw", 4) is None
    assert vectors.resolve_scale("none", 4) is None
    assert vectors.resolve_scale("sqrt_d_model", 4) == 2.0
    assert vectors.resolve_scale("2.5", 4) == 2.5
    with pytest.raises(ValueError):
        vectors.resolve_scale("big", 4)


@pytest.mark.parametrize("scale", [None, 7.0, vectors.SQRT_D])
def test_baselines_and_fve(pairs, scale):
    df, pred, gold = pairs
    s = math.sqrt(D) if scale == vectors.SQRT_D else scale
    g = gold if s is None else unit(gold, s)
    p = pred if s is None else unit(pred, s)
    mu = g.mean(axis=0)
    mu_norm = mu if s is None else unit(mu, s)
    row = aggregates.fve_baselines(df, "gold", scale).first()
    assert row.n == 300
    assert np.isclose(row.rawvar, ((g - mu) ** 2).mean())
    assert np.isclose(row.meannorm, ((g - mu_norm) ** 2).mean())
    fve = aggregates.fve(df, "pred", "gold", scale).first().fve
    assert np.isclose(fve, 1 - ((p - g) ** 2).mean() / ((g - mu) ** 2).mean())


def test_grouped_fve_does_not_depend_on_batches(spark, pairs):
    df, pred, gold = pairs
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = aggregates.fve(df.repartition(3), "pred", "gold", by=["grp"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    groups = np.array([min(i % 6, 2) for i in range(300)])
    for r in rows:
        p, g = unit(pred[groups == r.grp], 4.0), unit(gold[groups == r.grp], 4.0)
        want = 1 - ((p - g) ** 2).mean() / ((g - g.mean(axis=0)) ** 2).mean()
        assert np.isclose(r.fve, want) and r.n == (groups == r.grp).sum()


def test_groups_with_null_keys(spark):
    rows = [("a", 1, [1.0]), (None, 1, [2.0]), (None, None, [4.0]), ("a", None, [8.0]), (None, 1, [16.0])]
    df = spark.createDataFrame(rows, "g string, h int, v array<float>").coalesce(1)
    got = {(r.g, r.h): (r["mean"], r.n) for r in aggregates.mean_vector(df, "v", ["g", "h"]).collect()}
    assert got == {("a", 1): (1, 1), (None, 1): (9, 2), (None, None): (4, 1), ("a", None): (8, 1)}
    one = {r.g: r["mean"] for r in aggregates.mean_vector(df, "v", ["g"]).collect()}
    assert one == {"a": 4.5, None: 22 / 3}


def test_null_vectors_are_left_out(spark):
    df = spark.createDataFrame([([1.0, 3.0],), (None,), ([3.0, 5.0],)], "v array<float>")
    rows = aggregates.mean_vector(df, "v").orderBy("pos").collect()
    assert [(r["mean"], r.n) for r in rows] == [(2, 2), (4, 2)]


def test_baselines_with_zero_vectors(spark):
    vectors_ = [[0.0, 0.0], [3.0, 0.0], [0.0, 5.0], [-1.0, 0.0]]
    df = spark.createDataFrame([(v,) for v in vectors_], "v array<float>")
    g = unit(np.array(vectors_), 2.0)
    mu = g.mean(axis=0)
    row = aggregates.fve_baselines(df, "v", 2.0).first()
    assert np.isclose(row.rawvar, ((g - mu) ** 2).mean())
    assert np.isclose(row.meannorm, ((g - unit(mu, 2.0)) ** 2).mean())
    zeros = aggregates.fve_baselines(df.limit(1).where("v[0] = 0"), "v", 2.0).first()
    assert zeros.rawvar == 0 and zeros.meannorm == 0


def test_mean_vector(pairs):
    df, _, gold = pairs
    rows = aggregates.mean_vector(df, "gold").orderBy("pos").collect()
    assert np.allclose([r["mean"] for r in rows], gold.mean(axis=0))


def test_norm_stats(pairs):
    df, _, gold = pairs
    row = aggregates.norm_stats(df, "gold").first()
    norms = np.linalg.norm(gold, axis=1)
    assert row.n == 300
    assert np.isclose(row["mean"], norms.mean()) and np.isclose(row["max"], norms.max())
    want = np.percentile(norms, [10, 25, 50, 75, 90])
    assert np.allclose([row.p10, row.p25, row.p50, row.p75, row.p90], want)
    assert row.suggested_scale >= norms.mean()


def test_critic_metrics(pairs):
    df, pred, gold = pairs
    rows = aggregates.critic_metrics(df, "pred", "gold", 4.0, 0.5, ["grp"]).collect()
    groups = np.array([min(i % 6, 2) for i in range(300)])
    for r in rows:
        p, g = pred[groups == r.grp], gold[groups == r.grp]
        mse = ((unit(p, 4.0) - unit(g, 4.0)) ** 2).mean(axis=1)
        assert np.isclose(r.loss, mse.sum()) and np.isclose(r.fve_nrm, (1 - mse.mean() / 0.5) * len(p))
        assert np.isclose(r.gold_norm_raw, np.linalg.norm(g, axis=1).sum())
        assert r.mse_scale == 4.0 * len(p)
    raw = aggregates.critic_metrics(df, "pred", "gold", None, None, ["grp"]).first()
    assert raw.mse_scale == -raw.n and "fve_nrm" not in raw


def test_paired_agreement(spark):
    a = spark.createDataFrame([(i, 1.0 + i) for i in range(5)], "id long, mse double")
    b = a.withColumn("mse", F.col("mse") * F.when(F.col("id") == 4, 1.5).otherwise(1.0))
    assert joins.paired_agreement(a, a).first().agrees
    bad = joins.paired_agreement(a, b, tol=0.1).first()
    assert not bad.agrees and np.isclose(bad.max_dev, 1 / 3)
    few, none = (joins.paired_agreement(a.limit(n), a).first() for n in (3, 0))
    assert few.agrees and few.n == 3
    assert none.agrees is None and none.n == 0


def test_round_trip_and_scoring(spark):
    rows = [(0, [1.0, -2.0, 0.1, 0.0]), (1, [0.0, 0.0, 0.0, 5.0])]
    df = spark.createDataFrame(rows, "id long, activation_vector array<float>").orderBy("id")
    out = round_trip(df, SignVerbalizer(2), SignReconstructor(4)).collect()
    assert out[0].explanation == "+0 -1"
    want = 3 / (math.sqrt(2) * math.sqrt(5.01))
    assert np.isclose(out[0].cosine, want) and np.isclose(out[0].mse, 2 * (1 - want), atol=1e-6)
    samples = spark.createDataFrame(
        [
            (0, "COMPLETED", "<explanation>+0 -1</explanation>"),
            (1, "COMPLETED", "no tag"),
            (2, "TRUNCATED", "<explanation>+0</explanation>"),
        ],
        "id long, status string, response string",
    ).withColumn("activation_vector", F.array(*[F.lit(x).cast("float") for x in (1, -1, 0, 0)]))
    scored = {r.id: r for r in score_rollouts(samples, SignReconstructor(4)).collect()}
    assert np.isclose(scored[0].reward, 0.0) and scored[0].status == "COMPLETED"
    assert scored[1].reward == scored[2].reward == -2.0
    assert scored[1].status == scored[2].status == "FAILED"


def test_offsets_do_not_wrap():
    assert list_offsets([2, 0, 3]).to_pylist() == [0, 2, 2, 5]
    with pytest.raises(OverflowError):
        list_offsets([2**30, 2**30, 1])


def test_sums_are_shuffled_once_per_task(spark, monkeypatch):
    """Sums carried over the batches of a task: tasks x groups x width rows before the shuffle, flushed or not."""
    rng = np.random.default_rng(3)
    table = [(int(g), rng.normal(size=5).tolist()) for g in rng.integers(0, 3, 2000)]
    rows = [(None if g == 2 else f"g{g}", v) for g, v in table]
    df = spark.createDataFrame(rows, "g string, v array<double>").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        want = {g: sum(1 for x, _ in rows if x == g) for g in (None, "g0", "g1")}
        for bound in (aggregates.HELD_BYTES, 1):
            monkeypatch.setattr(aggregates, "HELD_BYTES", bound)
            found = {(r.g, r.pos): (r.n, r.total) for r in aggregates.vector_sums(df, "v", ["g"]).collect()}
            assert len(found) == 15
            for (g, pos), (n, total) in found.items():
                assert n == want[g] and np.isclose(total, sum(v[pos] for x, v in rows if x == g))
        monkeypatch.undo()
        assert aggregates.partial_sums(df, "v", ["g"]).count() <= 4 * 3
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
