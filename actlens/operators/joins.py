"""Joins: explanation caches, prior runs, resumption and comparisons of datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from actlens import fixed_values as fv
from actlens.functions import text as tx
from actlens.functions.hashing import text_hash
from actlens.session import materialize

TEXT = "detokenized_text_truncated"
EXPLANATION = "api_explanation"
KEYS = ("doc_id", "n_raw_tokens")


def cache_union(caches: Sequence[DataFrame]) -> DataFrame:
    """Caches on top of each other, with ``source_no`` (position in the list).

    A cache may bring a ``row_no`` of its own; without one its rows are told
    apart by the explanation text, so that the winner stays the same on every run.
    """
    parts = []
    for number, cache in enumerate(caches):
        row_no = F.col("row_no").cast("bigint") if "row_no" in cache.columns else F.lit(0).cast("bigint")
        parts.append(
            cache.select(TEXT, EXPLANATION, F.lit(number).alias("source_no"), row_no.alias("row_no"))
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cache_source(caches: Sequence[DataFrame]) -> DataFrame:
    """One explanation per text hash: the last row of the last source wins."""
    return (
        cache_union(caches)
        .select(text_hash(F.col(TEXT)).alias("text_sha"), EXPLANATION, "source_no", "row_no")
        .groupBy("text_sha")
        .agg(
            F.max_by(EXPLANATION, F.struct("source_no", "row_no", EXPLANATION)).alias(EXPLANATION)
        )
    )


def cache_join(df: DataFrame, cache: DataFrame, text: str = TEXT) -> DataFrame:
    """Attach the cached explanation of each text; NULL on a miss.

    The cache has one row per hash, so copies of one text only meet one row;
    a hot text is split by the adaptive skew join.
    """
    return df.withColumn("text_sha", text_hash(F.col(text))).join(cache, "text_sha", "left")


def cache_miss(df: DataFrame, cache: DataFrame, text: str = TEXT) -> DataFrame:
    """Rows whose text is not in the cache."""
    return df.withColumn("text_sha", text_hash(F.col(text))).join(cache, "text_sha", "left_anti")


def cache_stats(df: DataFrame, caches: Sequence[DataFrame], text: str = TEXT) -> DataFrame:
    """One row per cache source: its rows, its texts, and the rows of ``df`` it could serve."""
    sha = text_hash(F.col(text))
    wanted = df.groupBy(sha.alias("text_sha")).agg(F.count(F.lit(1)).alias("_n"))
    texts = (
        cache_union(caches)
        .groupBy("source_no", text_hash(F.col(TEXT)).alias("text_sha"))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    return (
        texts.join(wanted, "text_sha", "left")
        .groupBy("source_no")
        .agg(
            F.sum("_rows").alias("row_count"),
            F.count(F.lit(1)).alias("unique_texts"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("hits"),
        )
        .withColumn("hit_rate", F.col("hits") / total)
    )


def prior_explanations(prior: DataFrame, template: str = fv.CRITIC_TEMPLATE) -> DataFrame:
    """(doc_id, n_raw_tokens) → explanation of an earlier training table.

    A ``response`` column holds tagged explanations, otherwise the filled
    template in ``prompt`` is undone. For a repeated key the last row wins,
    taken as the greatest text since a table has no row order.
    """
    if "response" in prior.columns:
        unwrapped = tx.extract_explanation(F.col("response"))
        failed = F.raise_error(
            F.concat(F.lit("no explanation in response: "), F.col("response"))
        ).cast("string")
        unwrapped = F.coalesce(unwrapped, failed)
    else:
        unwrapped = tx.unwrap_template(F.col("prompt"), template)
    order = F.struct("row_no", EXPLANATION) if "row_no" in prior.columns else F.col(EXPLANATION)
    return (
        prior.withColumn(EXPLANATION, unwrapped)
        .groupBy(*KEYS)
        .agg(F.max_by(EXPLANATION, order).alias(EXPLANATION))
    )


def match_rate(raw: DataFrame, prior: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows, matched rows and their share, for an exact-key reuse."""
    known = prior.select(*keys).distinct().withColumn("_hit", F.lit(1))
    joined = raw.select(*keys).join(known, list(keys), "left")
    return joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("_hit").alias("matched"),
        (F.count("_hit") / F.count(F.lit(1))).alias("match_rate"),
    )


def prior_run_join(
    raw: DataFrame,
    prior: DataFrame,
    template: str = fv.CRITIC_TEMPLATE,
    min_match: float = fv.MIN_MATCH_RATE,
) -> DataFrame:
    """Rows with the explanation an earlier run has for the same key; misses are dropped.

    A match rate below ``min_match`` is an error: the earlier run then has another corpus, seed
    or tokenizer. Both tables are read once: the rate is observed in the join while
    its hits are stored, so nothing is returned before it is known.
    """
    known = prior_explanations(prior, template).withColumn("_hit", F.lit(True))
    seen = Observation()
    joined = raw.join(known, list(KEYS), "left").observe(
        seen, F.count(F.lit(1)).alias("n"), F.count("_hit").alias("matched")
    )
    hits = materialize(joined.where("_hit").drop("_hit"), "prior-hits")
    figures = seen.get
    if figures["n"] and figures["matched"] < min_match * figures["n"]:
        raise ValueError(f"match rate too low: {figures['matched']} of {figures['n']}")
    return hits


def recover_cache(prior: DataFrame, template: str | None = None) -> DataFrame:
    """Cache table (text, explanation) from a training table that kept its source text."""
    if "response" in prior.columns:
        body = tx.extract_explanation(F.col("response"))
    else:
        body = tx.unwrap_template(F.col("prompt"), template or fv.CRITIC_TEMPLATE)
    empty = F.raise_error(F.lit("row without an explanation")).cast("string")
    checked = F.when(F.length(body) > 0, body).otherwise(empty)
    return prior.select(TEXT, checked.alias(EXPLANATION))


def bucket_join(df: DataFrame, buckets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Give every row its document's bucket from a table of documents."""
    return df.join(buckets.select(key, "bucket"), key)


def paired_agreement(
    a: DataFrame, b: DataFrame, key: str = "id", tol: float = 1e-3
) -> DataFrame:
    """Compare the errors two scoring paths give the same rows.

    One row: ``n``, mean ratio, greatest |ratio - 1| and the verdict ``agrees``
    (NULL without rows); whether ``n`` is enough to judge by is the reader's choice.
    """
    pairs = a.select(key, F.col("mse").alias("_a")).join(
        b.select(key, F.col("mse").alias("_b")), key
    )
    ratio = F.col("_a") / F.col("_b")
    return pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(ratio).alias("mean_ratio"),
        F.max(F.abs(ratio - 1)).alias("max_dev"),
    ).withColumn("agrees", F.col("max_dev") <= tol)


def resume_anti_join(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not among those already written."""
    return df.join(done.select(*keys), list(keys), "left_anti")


def complete_shards(shards: DataFrame, manifests: DataFrame, key: str = "path") -> DataFrame:
    """Shards that have both data and a manifest with the same row count."""
    return shards.join(
        manifests.select(key, F.col("row_count").alias("_declared")), key
    ).where(F.col("row_count") == F.col("_declared")).drop("_declared")


def dataset_overlap(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str] = KEYS,
    text: str = TEXT,
    doc: str = "doc_id",
) -> DataFrame:
    """One row: keys shared and on one side only, text differences on shared keys, shared documents.

    Texts are compared by hash, so only keys and hashes are shuffled.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, text_hash(F.col(text)).alias(name))

    joined = side(a, "_a").join(side(b, "_b"), list(keys), "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    documents = joined.groupBy(doc).agg(
        F.count_if(both).alias("_both"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNull()).alias("_left"),
        F.count_if(F.col("_a").isNull() & F.col("_b").isNotNull()).alias("_right"),
        F.count_if(both & (F.col("_a") != F.col("_b"))).alias("_diff"),
    )
    in_a = F.col("_both") + F.col("_left") > 0
    in_b = F.col("_both") + F.col("_right") > 0

    def total(col: str) -> Column:
        return F.coalesce(F.sum(col), F.lit(0))

    return documents.agg(
        F.count_if(in_a & in_b).alias("shared_docs"),
        total("_both").alias("shared_keys"),
        total("_diff").alias("text_mismatches"),
        total("_left").alias("only_left"),
        total("_right").alias("only_right"),
    )
