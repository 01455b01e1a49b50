"""Projections, predicates and row checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens import fixed_values as fv
from actlens.functions import prompts, text, vectors


def carry_columns(df: DataFrame, keep_debug: bool = True) -> DataFrame:
    """The vector and provenance; the source text only where ``keep_debug`` asks for it."""
    columns = ["activation_vector", "n_raw_tokens", "activation_layer", "doc_id"]
    return df.select(*columns, *(["detokenized_text_truncated"] if keep_debug else []))


def min_feature_filter(
    df: DataFrame, col: str = "api_explanation", n: int = fv.MIN_FEATURES
) -> DataFrame:
    """Rows whose explanation has at least ``n`` paragraphs."""
    return df.where(text.feature_count(F.col(col)) >= n)


def checked_completion(df: DataFrame, col: str = "raw") -> DataFrame:
    """Fail on an empty-string completion: a completer must return text or NULL."""
    empty = F.raise_error(F.lit("the completer returned an empty completion")).cast("string")
    return df.withColumn(col, F.when(F.col(col) == "", empty).otherwise(F.col(col)))


def drop_failed_completion(df: DataFrame, col: str = "raw", pattern: str = fv.RESPONSE_PATTERN) -> DataFrame:
    """Rows with a completion that holds the tagged body; an empty completion is an error."""
    raw = F.col(col)
    return checked_completion(df.where(raw.rlike(f"(?s){pattern}") | (raw == "")), col)


def completed_only(df: DataFrame) -> DataFrame:
    """Samples that may be scored."""
    return df.where(F.col("status") == "COMPLETED")


def critic_token_count(response: str = "response", template: str = fv.CRITIC_TEMPLATE):
    """Number of tokens of the critic prompt built from a response."""
    explanation = text.extract_explanation(F.col(response))
    return F.size(text.tokenize(text.fill_template(template, explanation=explanation)))


def rollout_status(
    df: DataFrame, max_ctx: int = fv.MAX_CRITIC_TOKENS, template: str = fv.CRITIC_TEMPLATE
) -> DataFrame:
    """Status after scoring rules: no explanation, truncated or too long means FAILED."""
    missing = text.extract_explanation(F.col("response")).isNull()
    failed = (
        missing
        | (F.col("status") == "TRUNCATED")
        | (critic_token_count("response", template) > max_ctx)
    )
    return df.withColumn("status", F.when(failed, F.lit("FAILED")).otherwise(F.col("status")))


def finite_vectors(df: DataFrame, col: str, strict: bool = False) -> DataFrame:
    """Rows with finite vectors; ``strict`` fails on the first other row instead."""
    ok = vectors.finite(F.col(col))
    if strict:
        ok = F.when(ok, F.lit(True)).otherwise(
            F.raise_error(F.lit("vector with a NaN or infinite element")).cast("boolean")
        )
    return df.where(ok)


def non_finite_vectors(df: DataFrame, col: str) -> DataFrame:
    """The quarantine side of :func:`finite_vectors`."""
    return df.where(~vectors.finite(F.col(col)))


def width_check(df: DataFrame, col: str, d: int) -> DataFrame:
    """Rows whose vector does not have ``d`` elements (empty for a good table)."""
    return df.where(F.size(col) != d).withColumn("width", F.size(col))


def noise_filter(
    df: DataFrame, min_tokens: int = 10, max_norm: float | None = None, col: str = "activation_vector"
) -> DataFrame:
    """Drop early positions and, given a cap, rare high-norm vectors."""
    kept = df.where(F.col("n_raw_tokens") > min_tokens)
    return kept if max_norm is None else kept.where(vectors.l2_norm(F.col(col)) <= max_norm)


def placeholder_check(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Rows whose messages lack the injection placeholder."""
    return df.where(~prompts.has_placeholder(F.col(prompt)))


def pad_leak_check(df: DataFrame, pad, eos, tokens: str = "tokens") -> DataFrame:
    """Rows whose tokens hold the pad token, with the count; nothing to check if pad is eos."""
    if pad is None or pad == eos:
        return df.where(F.lit(False)).withColumn("pad_tokens", F.lit(0))
    leaked = df.where(F.array_contains(tokens, pad))
    return leaked.withColumn("pad_tokens", F.size(F.filter(tokens, lambda t: t == pad)))


def logprob_overrun(
    df: DataFrame, max_new: int, by: Sequence[str] = ("rollout_id",), col: str = "rollout_log_probs"
) -> DataFrame:
    """Share of rows whose log-prob array is longer than ``max_new``; rows are kept."""
    over = F.size(col) > max_new
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(over).alias("overrun"),
        F.avg(over.cast("double")).alias("overrun_rate"),
    )


def leak_scan(
    df: DataFrame, col: str, patterns: Sequence[str] = fv.LEAK_PATTERNS
) -> DataFrame:
    """One row per (row, forbidden substring found), letter case ignored."""
    found = text.matched_patterns(F.col(col), list(patterns))
    return (
        df.withColumn("pattern", F.explode_outer(found))
        .where(F.col("pattern").isNotNull())
        .drop(col)
    )


def cjk_flag(df: DataFrame, col: str) -> DataFrame:
    """Add ``cjk``: the smell of a failed injection when *all* outputs carry it."""
    return df.withColumn("cjk", text.has_cjk(F.col(col)))


def critic_view(df: DataFrame, tokens: str = "critic_tokens") -> DataFrame:
    """Samples with critic tokens, in the shape the critic trains on."""
    return (
        df.where(F.col(tokens).isNotNull())
        .withColumn("total_length", F.size(tokens))
        .withColumn("response_length", F.lit(0))
    )
