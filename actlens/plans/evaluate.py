"""Scoring: rollouts to rewards, vectors through text and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.functions import text, vectors
from actlens.operators.filters import rollout_status
from actlens.slots import Reconstructor, Verbalizer, reconstruct_with, verbalize_with


def score_rollouts(
    df: DataFrame,
    reconstructor: Reconstructor,
    scale: float | str | None = vectors.SQRT_D,
    log_mode: bool = False,
    col: str = "activation_vector",
    lenient: bool = False,
) -> DataFrame:
    """Add ``mse`` and ``reward``. Samples that are not completed get the fixed penalty
    and never reach the model; with ``lenient`` so do samples that the model fails on."""
    checked = rollout_status(df)
    explanation = F.when(
        F.col("status") == "COMPLETED", text.extract_explanation(F.col("response"))
    )
    scored = (
        checked.withColumn("_pred", reconstruct_with(reconstructor, lenient)(explanation))
        .withColumn("mse", vectors.pair_scores(F.col("_pred"), F.col(col), scale)["mse"])
        .drop("_pred")
    )
    return scored.withColumn(
        "reward", vectors.reward(F.col("mse"), F.col("mse").isNotNull(), log_mode)
    )


def round_trip(
    df: DataFrame,
    verbalizer: Verbalizer,
    reconstructor: Reconstructor,
    scale: float | str | None = vectors.SQRT_D,
    col: str = "activation_vector",
) -> DataFrame:
    """Vector to text to vector: adds ``text``, ``explanation``, ``mse`` and ``cosine``.

    Text without tags counts as the explanation itself.
    """
    told = df.withColumn("text", verbalize_with(verbalizer)(F.col(col))).withColumn(
        "explanation", F.coalesce(text.extract_explanation(F.col("text")), F.col("text"))
    )
    back = told.withColumn("_pred", reconstruct_with(reconstructor)(F.col("explanation")))
    scores = back.withColumn("_s", vectors.pair_scores(F.col("_pred"), F.col(col), scale))
    return scores.withColumns({"mse": F.col("_s.mse"), "cosine": F.col("_s.cosine")}).drop(
        "_pred", "_s"
    )
