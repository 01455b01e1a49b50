"""Aggregates over vectors, scores and datasets.

Vector sums are carried over all Arrow batches of a task, so that what is shuffled is
one sum per task, group and element at most, and finished per (group, element), so that
no task merges whole vectors of all partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from actlens import fixed_values as fv
from actlens.functions import text, vectors
from actlens.operators.selection import exact_percentiles
from actlens.session import materialize

# Bytes of sums that a task holds; beyond, they are passed on and begun anew.
HELD_BYTES = 64 << 20

PERCENTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


# --- vectors ----------------------------------------------------------------------


def partial_sums(
    df: DataFrame,
    gold: str,
    by: Sequence[str] = (),
    scale: float | str | None = None,
    pred: str | None = None,
) -> DataFrame:
    """One row per task and group: ``by…, _n, _sq, _err, _total`` (see :func:`vector_sums`).

    More rows come from a task only where its sums outgrow HELD_BYTES.
    """
    by = list(by)
    columns = by + [gold] + ([pred] if pred else [])
    source = df.select(*columns).where(F.col(gold).isNotNull())
    key_schema = T.StructType([source.schema[c] for c in by])
    schema = T.StructType(
        key_schema.fields
        + [
            T.StructField("_n", T.LongType()),
            T.StructField("_sq", T.DoubleType()),
            T.StructField("_err", T.DoubleType()),
            T.StructField("_total", T.ArrayType(T.DoubleType())),
        ]
    )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            for key, n, sq, err, total in _batch_sums(batch, by, gold, pred, scale):
                mine = held.get(key)
                if mine is None:
                    held[key] = [n, sq, err, total]
                    size += total.nbytes + 200
                elif len(mine[3]) != len(total):
                    raise ValueError(f"vectors in {gold} differ in width")
                else:
                    held[key] = [mine[0] + n, mine[1] + sq, mine[2] + err, mine[3] + total]
            if size > HELD_BYTES:
                yield _sum_rows(held, key_schema)
                held, size = {}, 0
        if held:
            yield _sum_rows(held, key_schema)

    return source.mapInArrow(partial, schema)


def vector_sums(
    df: DataFrame,
    gold: str,
    by: Sequence[str] = (),
    scale: float | str | None = None,
    pred: str | None = None,
) -> DataFrame:
    """Long table ``by…, pos, n, total, sq, err``.

    ``total`` is the sum of element ``pos`` of the rescaled vectors, ``n`` the
    rows, ``sq`` the sum of their squared norms, ``err`` the sum of the rows'
    mean squared differences to ``pred`` (0 without one).
    """
    partials = partial_sums(df, gold, by, scale, pred)
    return (
        partials.select(*by, "_n", "_sq", "_err", F.posexplode("_total").alias("pos", "_x"))
        .groupBy(*by, "pos")
        .agg(
            F.sum("_n").alias("n"),
            F.sum("_x").alias("total"),
            F.sum("_sq").alias("sq"),
            F.sum("_err").alias("err"),
        )
    )


def _matrix(batch: pa.RecordBatch, col: str, scale: float | str | None) -> np.ndarray:
    flat, lengths, _ = vectors._rows(batch.column(col))
    if not (lengths == lengths[0]).all():
        raise ValueError(f"vectors in {col} differ in width")
    return vectors._scaled(flat, lengths, scale).reshape(batch.num_rows, -1)


def _batch_sums(batch, by: list[str], gold: str, pred: str | None, scale) -> Iterator[tuple]:
    """(key, rows, sum of squared norms, sum of errors, sum of vectors) of each group in a batch."""
    matrix = _matrix(batch, gold, scale)
    squares = (matrix * matrix).sum(axis=1)
    errors = np.zeros(len(matrix))
    if pred:
        errors = ((_matrix(batch, pred, scale) - matrix) ** 2).mean(axis=1)
    codes = np.zeros(batch.num_rows, dtype=np.int64)
    keys = batch.select(by)
    for column in keys.columns:  # 0 stands for a NULL key
        index = column.dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64) + 1
        codes = np.unique(codes * (index.max() + 1) + index, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    sums = np.add.reduceat(matrix[order], starts, axis=0)
    figures = [np.diff(np.append(starts, len(order))).tolist()]
    figures += [np.add.reduceat(x[order], starts).tolist() for x in (squares, errors)]
    heads = [keys.column(i).take(pa.array(order[starts])).to_pylist() for i in range(len(by))]
    names = list(zip(*heads)) if by else [()]
    yield from zip(names, *figures, sums)


def _sum_rows(held: dict[tuple, list], keys: T.StructType) -> pa.RecordBatch:
    columns = list(zip(*held)) if keys else []
    kinds = [to_arrow_type(field.dataType) for field in keys]
    n, sq, err, total = zip(*held.values())
    arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
    arrays += [pa.array(n, pa.int64()), pa.array(sq, pa.float64()), pa.array(err, pa.float64())]
    arrays.append(pa.array([t.tolist() for t in total], pa.list_(pa.float64())))
    return pa.RecordBatch.from_arrays(arrays, names=[*keys.fieldNames(), "_n", "_sq", "_err", "_total"])


def mean_vector(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Element-wise mean in long form: ``by…, pos, mean, n``."""
    return vector_sums(df, col, by).select(
        *by, "pos", (F.col("total") / F.col("n")).alias("mean"), "n"
    )


def _moments(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: rows, width, squared norm of the mean, mean squared norm, mean error."""
    return (
        sums.groupBy(*by)
        .agg(
            F.max("n").alias("n"),
            F.count(F.lit(1)).alias("d"),
            F.sum(F.pow(F.col("total") / F.col("n"), 2)).alias("mu2"),
            F.max("sq").alias("sq"),
            F.max("err").alias("err"),
        )
        .withColumn("q", F.col("sq") / F.col("n"))
    )


def _target(scale: float | str) -> Column:
    return F.sqrt(F.col("d").cast("double")) if scale == vectors.SQRT_D else F.lit(float(scale))


def fve_baselines(
    df: DataFrame, col: str, scale: float | str | None = vectors.SQRT_D, by: Sequence[str] = ()
) -> DataFrame:
    """Errors of two constant predictions over rescaled vectors, in one pass.

    ``rawvar``: distance to the mean vector; ``meannorm``: distance to the mean
    brought to the same norm. Closed forms in the mean and the mean squared norm.
    """
    moments = _moments(vector_sums(df, col, by, scale), by)
    rawvar = (F.col("q") - F.col("mu2")) / F.col("d")
    if scale is None:
        meannorm = rawvar
    else:
        s = _target(scale)
        to_sphere = (F.col("q") + s * s - 2 * s * F.sqrt("mu2")) / F.col("d")
        meannorm = F.when(F.sqrt("mu2") > fv.NORM_FLOOR, to_sphere).otherwise(
            F.col("q") / F.col("d")
        )
    return moments.select(*by, "n", meannorm.alias("meannorm"), rawvar.alias("rawvar"))


def fve(
    df: DataFrame,
    pred: str,
    gold: str,
    scale: float | str | None = vectors.SQRT_D,
    by: Sequence[str] = (),
) -> DataFrame:
    """Fraction of variance explained per group; the mean in the denominator is not rescaled."""
    moments = _moments(vector_sums(df.where(F.col(pred).isNotNull()), gold, by, scale, pred), by)
    mse = F.col("err") / F.col("n")
    rawvar = (F.col("q") - F.col("mu2")) / F.col("d")
    return moments.select(
        *by, "n", mse.alias("mse"), rawvar.alias("rawvar"), (1 - mse / rawvar).alias("fve")
    )


def critic_metrics(
    df: DataFrame,
    pred: str,
    gold: str,
    scale: float | None,
    b_rv: Column | float | None = None,
    by: Sequence[str] = ("batch_id",),
) -> DataFrame:
    """Per-batch sums that a trainer logs: error, raw norms, scale and explained variance."""
    scored = df.withColumn("_s", vectors.pair_scores(F.col(pred), F.col(gold), scale))
    rows = F.count(F.lit(1))
    columns = [
        rows.alias("n"),
        F.sum("_s.mse").alias("loss"),
        F.sum("_s.pred_norm").alias("pred_norm_raw"),
        F.sum("_s.gold_norm").alias("gold_norm_raw"),
        (rows * F.lit(-1.0 if scale is None else float(scale))).alias("mse_scale"),
    ]
    out = scored.groupBy(*by).agg(*columns)
    if b_rv is not None:
        base = b_rv if isinstance(b_rv, Column) else F.lit(b_rv)
        explained = (1 - (F.col("loss") / F.col("n")) / base) * F.col("n")
        out = out.withColumn("fve_nrm", F.when(base > 0, explained))
    return out


def baseline_broadcast(batch: DataFrame, baseline: DataFrame, col: str = "rawvar") -> DataFrame:
    """Attach a one-row dataset constant to every row, as a scalar subquery."""
    return batch.withColumn(col, baseline.select(col).scalar())


def norm_stats(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Norm count, mean, range and exact percentiles, with a suggested injection scale.

    The norms are written once to the shared folder: the vectors are read once, the
    percentiles work on the narrow table, and count bits instead of moving rows.
    """
    keys = list(by) or ["_all"]
    norm = vectors.l2_norm(F.col(col)).alias("norm")
    norms = df.select(*by, norm) if by else df.select(F.lit(0).alias("_all"), norm)
    norms = materialize(norms, "vector-norms")
    mean = F.avg("norm")
    step = F.pow(F.lit(10.0), F.floor(F.log10(mean))) / 2
    plain = norms.groupBy(*keys).agg(
        F.count("norm").alias("n"),
        mean.alias("mean"),
        F.min("norm").alias("min"),
        F.max("norm").alias("max"),
        (F.ceil(mean / step) * step).alias("suggested_scale"),
    )
    out = plain.join(exact_percentiles(norms, keys, "norm", PERCENTILES), keys)
    return out if by else out.drop("_all")


def pred_scale_check(df: DataFrame, pred: str, floor: float = 0.1) -> DataFrame:
    """Mean prediction norm per square-root width; below ``floor`` the predictor is untrained."""
    ratio = F.avg(vectors.l2_norm(F.col(pred)) / F.sqrt(F.size(pred).cast("double")))
    return df.agg(ratio.alias("pred_per_dim")).withColumn(
        "untrained", F.col("pred_per_dim") < floor
    )


# --- datasets -----------------------------------------------------------------------


def bucket_counts(df: DataFrame, key: str = "doc_id", bucket: str = "bucket") -> DataFrame:
    """Documents and rows per bucket, rows pre-counted per document."""
    return (
        df.groupBy(bucket, key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(bucket)
        .agg(F.count(F.lit(1)).alias("docs"), F.sum("_n").alias("row_count"))
    )


def distinct_docs(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct document ids."""
    return df.select(key).distinct()


def last_wins(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Per key the value that comes last in ``order``."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def drop_breakdown(df: DataFrame, raw: str = "raw", n: int = fv.MIN_FEATURES) -> DataFrame:
    """Rows by outcome of the completion: none, no_tag, too_few or kept."""
    body = text.extract_tagged(F.col(raw))
    outcome = (
        F.when(F.col(raw).isNull(), "none")
        .when(body.isNull(), "no_tag")
        .when(text.feature_count(text.clean_features(body)) < n, "too_few")
        .otherwise("kept")
    )
    return df.groupBy(outcome.alias("reason")).agg(F.count(F.lit(1)).alias("row_count"))


def source_split(df: DataFrame, by: Sequence[str] = (), doc_id: str = "doc_id") -> DataFrame:
    """Rows per source label."""
    return df.groupBy(*by, text.source_label(F.col(doc_id)).alias("source")).agg(
        F.count(F.lit(1)).alias("row_count")
    )
