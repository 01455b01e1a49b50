"""Vector functions and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from actlens.catalog.registry import query
from actlens.functions import vectors
from actlens.operators import aggregates, filters, joins
from actlens.plans.evaluate import round_trip
from actlens.slots import SignReconstructor, SignVerbalizer

SQRT_D = vectors.SQRT_D


@query("l2_norm", "SELECT vec_id, round(norm, 5) AS norm FROM norms")
def l2_norm(v):
    return v.vectors().select("vec_id", F.round(vectors.l2_norm(F.col("v")), 5).alias("norm"))


@query(
    "rescale",
    """SELECT vec_id, 8.0::DOUBLE AS norm, round(sum(x), 3) AS element_sum, round(max(x), 3) AS greatest
       FROM unit GROUP BY 1""",
)
def rescale(v):
    """Vectors brought to norm 8, the square root of their width."""
    rows = v.vectors().select("vec_id", vectors.rescale(F.col("v"), SQRT_D).alias("r"))
    total = F.aggregate("r", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select(
        "vec_id",
        F.round(vectors.l2_norm(F.col("r")), 4).alias("norm"),
        F.round(total, 3).alias("element_sum"),
        F.round(F.array_max("r").cast("double"), 3).alias("greatest"),
    )


@query("direction_mse", "SELECT id, round(mse, 6) AS mse FROM scored")
def direction_mse(v):
    mse = vectors.direction_mse(F.col("pred"), F.col("gold"))
    return v.pairs().select("id", F.round(mse, 6).alias("mse"))


@query(
    "raw_mse",
    """SELECT id, round(list_sum(list_transform(list_zip(pred, gold), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 64, 8) AS mse
       FROM pairs""",
)
def raw_mse(v):
    """No scale: the vectors are compared as they are."""
    mse = vectors.direction_mse(F.col("pred"), F.col("gold"), None)
    return v.pairs().select("id", F.round(mse, 8).alias("mse"))


@query("cosine", "SELECT id, round(cos, 6) AS cosine FROM scored")
def cosine(v):
    return v.pairs().select(
        "id", F.round(vectors.cosine(F.col("pred"), F.col("gold")), 6).alias("cosine")
    )


@query(
    "reward",
    """SELECT id, round(CASE WHEN label <> 3 THEN -mse ELSE -2.0 END, 6) AS reward,
         round(CASE WHEN label <> 3 THEN -ln(greatest(mse, 1e-8)) ELSE -ln(2.0::DOUBLE) END, 6) AS log_reward FROM scored""",
)
def reward(v):
    """Label 3 plays the failed samples."""
    mse = vectors.direction_mse(F.col("pred"), F.col("gold"))
    rows = v.pairs().select("id", mse.alias("mse"), (F.col("label") != 3).alias("ok"))
    return rows.select(
        "id",
        F.round(vectors.reward(F.col("mse"), F.col("ok")), 6).alias("reward"),
        F.round(vectors.reward(F.col("mse"), F.col("ok"), True), 6).alias("log_reward"),
    )


def _damaged(v):
    """Vectors of label 3 start with NaN, those of label 5 lack their last element."""
    nan = F.lit(float("nan")).cast("float")
    spoiled = F.transform("v", lambda x, i: F.when((F.col("label") == 3) & (i == 0), nan).otherwise(x))
    kept = F.when(F.col("label") == 5, F.size("v") - 1).otherwise(F.size("v"))
    return v.vectors().select("vec_id", "label", F.slice(spoiled, F.lit(1), kept).alias("v"))


@query("finite_vectors", "SELECT vec_id FROM vectors WHERE label <> 3")
def finite_vectors(v):
    return filters.finite_vectors(_damaged(v), "v").select("vec_id")


@query("width_check", "SELECT vec_id, 63::BIGINT AS width FROM vectors WHERE label = 5")
def width_check(v):
    return filters.width_check(_damaged(v), "v", 64).select(
        "vec_id", F.col("width").cast("bigint").alias("width")
    )


@query(
    "noise_filter",
    """SELECT doc_id, n_raw_tokens FROM base_vectors
       WHERE n_raw_tokens > 100 AND sqrt(list_inner_product(activation_vector::DOUBLE[], activation_vector::DOUBLE[])) <= 120.5""",
)
def noise_filter(v):
    return filters.noise_filter(v.base_vectors(), 100, 120.5).select("doc_id", "n_raw_tokens")


# --- aggregates -----------------------------------------------------------------------


@query(
    "mean_vector",
    """SELECT label, pos, round(avg(x), 5) AS mean, count(*) AS n FROM (
         SELECT label, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM vectors) GROUP BY 1, 2""",
)
def mean_vector(v):
    means = aggregates.mean_vector(v.vectors(), "v", ["label"])
    return means.select(
        "label", F.col("pos").cast("bigint").alias("pos"), F.round("mean", 5).alias("mean"), "n"
    )


_MU = "SELECT pos, avg(x) AS mu FROM unit GROUP BY 1"
_BASELINES = f"""
  SELECT count(DISTINCT vec_id) AS n, avg((x - mu * s) * (x - mu * s)) AS meannorm, avg((x - mu) * (x - mu)) AS rawvar
  FROM unit JOIN ({_MU}) USING (pos), (SELECT 8 / sqrt(sum(mu * mu)) AS s FROM ({_MU}))"""


@query(
    "fve_baselines",
    f"SELECT n, round(meannorm, 6) AS meannorm, round(rawvar, 6) AS rawvar FROM ({_BASELINES})",
)
def fve_baselines(v):
    return _rounded(aggregates.fve_baselines(v.vectors(), "v"))


@query(
    "fve_baselines_raw",
    """SELECT count(DISTINCT vec_id) AS n, round(avg((x - mu) * (x - mu)), 4) AS meannorm, round(avg((x - mu) * (x - mu)), 4) AS rawvar
       FROM (SELECT vec_id, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM vectors)
       JOIN (SELECT pos, avg(x) AS mu FROM (SELECT unnest(range(0, 64)) AS pos, unnest(v) AS x FROM vectors) GROUP BY 1) USING (pos)""",
)
def fve_baselines_raw(v):
    return _rounded(aggregates.fve_baselines(v.vectors(), "v", None), 4)


def _rounded(df, digits: int = 6):
    return df.select(
        "n",
        F.round("meannorm", digits).alias("meannorm"),
        F.round("rawvar", digits).alias("rawvar"),
    )


_GOLD_UNIT = """
  SELECT id, label, pos, x, avg(x) OVER (PARTITION BY label, pos) AS mu FROM (
    SELECT p.id, p.label, unnest(range(64)) AS pos, unnest(list_transform(p.gold, lambda y: y / s.gn * 8)) AS x
    FROM pairs p JOIN scored s USING (id))"""


@query(
    "fve",
    f"""SELECT label, n, round(mse, 6) AS mse, round(rawvar, 6) AS rawvar, round(1 - mse / rawvar, 5) AS fve
        FROM (SELECT label, count(*) AS n, avg(mse) AS mse FROM scored GROUP BY 1)
        JOIN (SELECT label, avg((x - mu) * (x - mu)) AS rawvar FROM ({_GOLD_UNIT}) GROUP BY 1) USING (label)""",
)
def fve(v):
    return aggregates.fve(v.pairs(), "pred", "gold", SQRT_D, ["label"]).select(
        "label",
        "n",
        F.round("mse", 6).alias("mse"),
        F.round("rawvar", 6).alias("rawvar"),
        F.round("fve", 5).alias("fve"),
    )


_CRITIC = f"""
  SELECT batch_id, count(*) AS n, round(sum(mse), 5) AS loss, round(sum(pn), 5) AS pred_norm_raw,
    round(sum(gn), 5) AS gold_norm_raw, round(count(*) * 8.0::DOUBLE, 5) AS mse_scale,
    round((1 - avg(mse) / (SELECT rawvar FROM ({_BASELINES}))) * count(*), 4) AS fve_nrm
  FROM scored GROUP BY 1"""


@query("critic_metrics", _CRITIC)
def critic_metrics(v):
    baseline = aggregates.fve_baselines(v.vectors(), "v").select("rawvar").scalar()
    out = aggregates.critic_metrics(v.pairs(), "pred", "gold", math.sqrt(64), baseline)
    names = ["loss", "pred_norm_raw", "gold_norm_raw", "mse_scale"]
    return out.select(
        "batch_id",
        "n",
        *[F.round(c, 5).alias(c) for c in names],
        F.round("fve_nrm", 4).alias("fve_nrm"),
    )


@query(
    "baseline_broadcast",
    f"""SELECT batch_id, n, round(loss, 5) AS loss, round(rawvar, 6) AS rawvar
        FROM (SELECT batch_id, count(*) AS n, sum(mse) AS loss FROM scored GROUP BY 1), (SELECT rawvar FROM ({_BASELINES}))""",
)
def baseline_broadcast(v):
    batch = aggregates.critic_metrics(v.pairs(), "pred", "gold", math.sqrt(64))
    joined = aggregates.baseline_broadcast(batch, aggregates.fve_baselines(v.vectors(), "v"))
    return joined.select(
        "batch_id", "n", F.round("loss", 5).alias("loss"), F.round("rawvar", 6).alias("rawvar")
    )


_PERCENTILES = ", ".join(
    f"round(quantile_cont({{col}}, {q}), {{digits}}) AS {name}"
    for name, q in aggregates.PERCENTILES.items()
)


@query(
    "norm_stats",
    f"""SELECT label, count(*) AS n, round(avg(norm), 4) AS mean, round(min(norm), 4) AS min, round(max(norm), 4) AS max,
          ceil(avg(norm) / (pow(10, floor(log10(avg(norm)))) / 2)) * (pow(10, floor(log10(avg(norm)))) / 2) AS suggested_scale,
          {_PERCENTILES.format(col="norm", digits=4)} FROM norms GROUP BY 1""",
)
def norm_stats(v):
    stats = aggregates.norm_stats(v.vectors(), "v", ["label"])
    names = ["mean", "min", "max", *aggregates.PERCENTILES]
    return stats.select(
        "label", "n", "suggested_scale", *[F.round(c, 4).alias(c) for c in names]
    )


@query(
    "pred_scale_check",
    "SELECT round(avg(pn / 8), 6) AS pred_per_dim, avg(pn / 8) < 0.1 AS untrained FROM scored",
)
def pred_scale_check(v):
    return filters_round(aggregates.pred_scale_check(v.pairs(), "pred"))


def filters_round(df):
    return df.withColumn("pred_per_dim", F.round("pred_per_dim", 6))


@query(
    "paired_agreement",
    "SELECT count(*) AS n, 1.0::DOUBLE AS mean_ratio, true AS agrees FROM pairs",
)
def paired_agreement(v):
    """One path compares directions, the other rescales both vectors first."""
    pairs = v.pairs()
    a = pairs.select("id", vectors.direction_mse(F.col("pred"), F.col("gold")).alias("mse"))
    scaled = pairs.select(
        "id",
        vectors.rescale(F.col("pred"), 8.0).alias("p"),
        vectors.rescale(F.col("gold"), 8.0).alias("g"),
    )
    b = scaled.select("id", vectors.direction_mse(F.col("p"), F.col("g"), None).alias("mse"))
    return joins.paired_agreement(a, b).select(
        "n", F.round("mean_ratio", 4).alias("mean_ratio"), "agrees"
    )


@query(
    "round_trip",
    """SELECT vec_id, round(2 * (1 - c), 5) AS mse, round(c, 5) AS cosine FROM (
         SELECT vec_id, list_sum(list_reverse_sort(list_transform(v, lambda x: abs(x)))[1:8]) / (sqrt(8) * norm) AS c
         FROM vectors JOIN norms USING (vec_id, label))""",
)
def round_trip_query(v):
    """Vector to text to vector with the sign-naming stand-ins."""
    rows = v.vectors().withColumnRenamed("v", "activation_vector")
    told = round_trip(rows, SignVerbalizer(8), SignReconstructor(64))
    return told.select(
        "vec_id", F.round("mse", 5).alias("mse"), F.round("cosine", 5).alias("cosine")
    )
