"""Scored samples."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from actlens.catalog.registry import query
from actlens.catalog.vectors import _PERCENTILES
from actlens.functions import text
from actlens.operators import aggregates, filters, rollouts
from actlens.session import scratch_path
from actlens.slots import SignReconstructor
from actlens.streaming.jobs import reward_batches, reward_stream

_DONE = r"regexp_matches(response, '(?s)<explanation>.*?</explanation>')"
# Tokens of the filled critic template: the response words, plus five around them.
_CRITIC_TOKENS = r"len(regexp_extract_all('Summary of the following text: <text>' || trim(regexp_extract(response, '(?s)<explanation>(.*?)</explanation>', 1), chr(10) || ' ') || '</text> <summary>', '\S+'))"


@query("completed_only", "SELECT sample_id FROM rollouts WHERE status = 'COMPLETED'")
def completed_only(v):
    return filters.completed_only(v.rollouts()).select("sample_id")


@query(
    "rollout_status",
    f"""SELECT sample_id, CASE WHEN NOT {_DONE} OR status = 'TRUNCATED' OR {_CRITIC_TOKENS} > 8 THEN 'FAILED' ELSE status END AS status
        FROM rollouts""",
)
def rollout_status(v):
    """A context of eight tokens is enough for every response, so only the rules decide."""
    return filters.rollout_status(v.rollouts(), 8).select("sample_id", "status")


@query(
    "logprob_overrun",
    """SELECT rollout_id, count(*) AS n, count(*) FILTER (len(rollout_log_probs) > 5) AS overrun,
         round(avg((len(rollout_log_probs) > 5)::INT), 6) AS overrun_rate FROM rollouts GROUP BY 1""",
)
def logprob_overrun(v):
    return filters.logprob_overrun(v.rollouts(), 5).withColumn(
        "overrun_rate", F.round("overrun_rate", 6)
    )


@query(
    "critic_view",
    f"SELECT sample_id, {_CRITIC_TOKENS} AS total_length, 0::BIGINT AS response_length FROM rollouts WHERE {_DONE}",
)
def critic_view(v):
    prompt = text.fill_template(
        text.fv.CRITIC_TEMPLATE, explanation=text.extract_explanation(F.col("response"))
    )
    rows = v.rollouts().withColumn("critic_tokens", text.tokenize(prompt))
    return filters.critic_view(rows).select(
        "sample_id",
        F.col("total_length").cast("bigint").alias("total_length"),
        F.col("response_length").cast("bigint").alias("response_length"),
    )


@query(
    "group_advantage",
    """SELECT sample_id, round((reward - avg(reward) OVER g) / (stddev_pop(reward) OVER g + 1e-6), 5) AS advantage
       FROM rollouts WINDOW g AS (PARTITION BY rollout_id, group_index)""",
)
def group_advantage(v):
    return rollouts.group_advantage(v.rollouts()).select(
        "sample_id", F.round("advantage", 5).alias("advantage")
    )


_PICKS = """
  SELECT rollout_id, sample_id, r AS rank, CASE WHEN r < 6 THEN 0
    WHEN r >= greatest(0, n // 2 - 4) AND r < greatest(0, n // 2 - 4) + 8 THEN 1 WHEN r >= n - 6 THEN 2 END AS tag
  FROM (SELECT *, row_number() OVER (PARTITION BY rollout_id ORDER BY reward DESC, sample_id) - 1 AS r,
          count(*) OVER (PARTITION BY rollout_id) AS n FROM rollouts)"""
_PICKED = f"""
  SELECT rollout_id, sample_id, rank, row_number() OVER (PARTITION BY rollout_id ORDER BY tag, rank) AS pick
  FROM ({_PICKS}) WHERE tag IS NOT NULL"""


@query("best_mid_worst", _PICKED)
def best_mid_worst(v):
    picked = rollouts.best_mid_worst(v.rollouts())
    return picked.select("rollout_id", "sample_id", "rank", F.col("pick").cast("bigint").alias("pick"))


@query("picks_union", f"SELECT rollout_id, count(*) AS picks, min(rank) AS best, max(rank) AS worst FROM ({_PICKED}) GROUP BY 1")
def picks_union(v):
    """Size and range of the union of the three lists."""
    picked = rollouts.best_mid_worst(v.rollouts())
    return picked.groupBy("rollout_id").agg(
        F.count(F.lit(1)).alias("picks"), F.min("rank").alias("best"), F.max("rank").alias("worst")
    )


@query(
    "rollout_report",
    f"""SELECT p.rollout_id, p.sample_id, pick, round(reward, 6) AS reward,
          CASE event_id % 3 WHEN 0 THEN 'WildChat' WHEN 1 THEN 'UFW' ELSE 'other' END AS label,
          CASE WHEN event_type = 'view' AND value > 100 THEN '<explanation>' || chr(10) ELSE '' END || event_type || ' ' || props AS explanation
        FROM ({_PICKED}) p JOIN rollouts r USING (rollout_id, sample_id) JOIN (SELECT event_id, value FROM events) e ON e.event_id = p.sample_id""",
)
def rollout_report(v):
    report = rollouts.rollout_report(v.rollouts())
    return report.select(
        "rollout_id",
        "sample_id",
        F.col("pick").cast("bigint").alias("pick"),
        F.round("reward", 6).alias("reward"),
        "label",
        "explanation",
    )


@query(
    "rollout_summary",
    f"""SELECT rollout_id, count(*) AS n, count(DISTINCT group_index) AS groups, count(*) // count(DISTINCT group_index) AS per_group,
          round(avg(reward), 7) AS mean, round(stddev_pop(reward), 7) AS std, round(min(reward), 7) AS min, round(max(reward), 7) AS max,
          {_PERCENTILES.format(col="reward", digits=7)} FROM rollouts GROUP BY 1""",
)
def rollout_summary(v):
    names = ["mean", "std", "min", "max", *aggregates.PERCENTILES]
    return rollouts.rollout_summary(v.rollouts()).select(
        "rollout_id", "n", "groups", "per_group", *[F.round(c, 7).alias(c) for c in names]
    )


@query(
    "source_split",
    """SELECT rollout_id, CASE WHEN contains(doc_id, 'WildChat') THEN 'WildChat' WHEN contains(doc_id, 'Ultra-FineWeb') THEN 'UFW'
         ELSE 'other' END AS source, count(*) AS row_count FROM rollouts GROUP BY 1, 2""",
)
def source_split(v):
    return aggregates.source_split(v.rollouts(), ["rollout_id"])


@query(
    "mismatch_metrics",
    """SELECT rollout_id, count(*) AS tokens, round(avg(exp(d)), 7) AS tis, round(avg(abs(exp(d) - 1)), 7) AS tis_abs,
         round(avg(exp(d) - 1 - d), 7) AS tis_k3
       FROM (SELECT rollout_id, unnest(train_log_probs) - unnest(rollout_log_probs) AS d FROM rollouts) GROUP BY 1""",
)
def mismatch_metrics(v):
    out = rollouts.mismatch_metrics(v.rollouts())
    names = ["tis", "tis_abs", "tis_k3"]
    return out.select("rollout_id", "tokens", *[F.round(c, 7).alias(c) for c in names])


@query(
    "extraction_rate",
    f"""SELECT rollout_id, count(*) AS n, count(*) FILTER ({_DONE}) AS extracted,
          round(avg(({_DONE})::INT), 6) AS extraction_rate, count(*) FILTER ({_DONE}) = 0 AS none_extracted FROM rollouts GROUP BY 1""",
)
def extraction_rate(v):
    return rollouts.extraction_rate(v.rollouts()).withColumn(
        "extraction_rate", F.round("extraction_rate", 6)
    )


@query(
    "length_reward_corr",
    """SELECT rollout_id, round(corr(response_length, reward), 6) AS pearson, round(corr(rl, rr), 6) AS spearman
       FROM (SELECT *, rank() OVER l + (count(*) OVER (PARTITION BY rollout_id, response_length) - 1) / 2 AS rl,
               rank() OVER w + (count(*) OVER (PARTITION BY rollout_id, reward) - 1) / 2 AS rr
             FROM rollouts WHERE response_length IS NOT NULL AND reward IS NOT NULL
             WINDOW l AS (PARTITION BY rollout_id ORDER BY response_length), w AS (PARTITION BY rollout_id ORDER BY reward)) GROUP BY 1""",
)
def length_reward_corr(v):
    return rollouts.length_reward_corr(v.rollouts()).select(
        "rollout_id",
        F.round("pearson", 6).alias("pearson"),
        F.round("spearman", 6).alias("spearman"),
    )


# The stand-in's vector of a text without signs: the bytes of its digest, twice.
_REWARDS = f"""
  WITH e AS (SELECT vec_id, embedding, (SELECT count(*) FROM embeddings) AS n FROM embeddings),
  r AS (SELECT *, regexp_extract(response, '(?s)<explanation>(.*?)</explanation>', 1) AS body FROM rollouts),
  p AS (SELECT rollout_id, sample_id, status, list_transform(embedding, lambda x: x::DOUBLE) AS gold, list_transform(range(0, 64),
          lambda i: ('0x' || substr(sha256(trim(body, chr(10) || ' ')), 1 + 2 * (i % 32), 2))::INT - 127.5::DOUBLE) AS pred
        FROM r JOIN e ON e.vec_id = sample_id % n),
  s AS (SELECT rollout_id, sample_id, status, CASE WHEN status = 'COMPLETED' THEN 2 * list_cosine_similarity(pred, gold) - 2 ELSE -2.0 END AS reward FROM p)
  SELECT rollout_id, count(*) AS n, count(*) FILTER (status = 'COMPLETED') AS scored,
    count(*) FILTER (status <> 'COMPLETED') AS penalised, round(avg(reward), 4) AS mean_reward,
    round(max(reward) FILTER (status = 'COMPLETED'), 4) AS best_reward FROM s GROUP BY 1"""


def _incoming(v):
    """Samples without rewards as a folder of files; vectors come from the embeddings by sample id."""
    embeddings = v.table("embeddings")
    n = embeddings.agg(F.count(F.lit(1))).scalar()
    src = scratch_path(v.spark, "incoming")
    samples = v.rollouts().withColumn("vec_id", F.col("sample_id") % n)
    vectors = embeddings.select("vec_id", F.col("embedding").alias("activation_vector"))
    samples.join(vectors, "vec_id").drop("reward", "vec_id").repartition("sample_id").write.parquet(src)
    return src, v.spark.read.parquet(src).schema


def _scored(rows):
    done = F.col("mse").isNotNull()
    return rows.groupBy("rollout_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("mse").alias("scored"),
        F.count_if(~done & (F.col("reward") == -2.0)).alias("penalised"),
        F.round(F.avg("reward"), 4).alias("mean_reward"),
        F.round(F.max(F.when(done, F.col("reward"))), 4).alias("best_reward"),
    )


@query("reward_stream", _REWARDS)
def reward_stream_query(v):
    """Samples scored from a file stream."""
    src, schema = _incoming(v)
    dst, checkpoint = scratch_path(v.spark, "rewards"), scratch_path(v.spark, "stream")
    reconstructor = SignReconstructor(64)
    stream = reward_stream(v.spark, src, dst, checkpoint, schema, reconstructor, seconds=None, max_files=2)
    stream.awaitTermination()
    return _scored(v.spark.read.parquet(dst))


def _written(spark, path, counted) -> int:
    """Rows of all finished micro-batches under ``path``; ``counted`` keeps the rows of each, so none is read twice."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.listStatus(folder) if store.exists(folder) else ():
        name = status.getPath().getName()
        if name not in counted and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
            counted[name] = spark.read.schema("sample_id long").parquet(f"{path}/{name}").count()
    return sum(counted.values())


@query("reward_batches", _REWARDS)
def reward_batches_query(v):
    """The same with samples gathered into batches, of 512 or of what a second brought."""
    src, schema = _incoming(v)
    dst, checkpoint = scratch_path(v.spark, "rewards"), scratch_path(v.spark, "stream")
    n = v.spark.read.parquet(src).count()
    stream = reward_batches(v.spark, src, dst, checkpoint, schema, SignReconstructor(64), 512, 1.0, lanes=4)
    done, grown, counted = 0, time.monotonic(), {}
    try:
        while stream.isActive and done < n:  # the last batch of each lane waits for its timer
            time.sleep(0.2)
            before, done = done, _written(v.spark, dst, counted)
            grown = time.monotonic() if done > before else grown
            if time.monotonic() - grown > 120:
                raise TimeoutError(f"{done} of {n} samples scored, none for two minutes")
    finally:
        stream.stop()
    if stream.exception() is not None:
        raise stream.exception()
    return _scored(v.spark.read.parquet(dst))
