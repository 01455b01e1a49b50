"""Importance resampling of documents towards a target text distribution.

Features are hashed runs of words, counted in buckets over all documents and over
all target texts. A bucket's gain is the logarithm of the ratio of its two shares;
a document's weight is the sum of the gains of its features. Gumbel noise on the
weights makes the largest scores a draw without replacement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens.llm.common import ordered_index
from actlens.llm.crc_words import Payloads, run_buckets
from actlens.session import materialize

BUCKETS = 10_000
LONGEST = 3
_worker: list[Payloads] = []


def _payloads() -> Payloads:
    """The dictionary of this Python worker, kept from task to task."""
    if not _worker:
        _worker.append(Payloads())
    return _worker[0]


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``bucket``, ``n``: features of all texts by bucket; buckets without any are absent.

    A task counts into one array, so it sends ``buckets`` rows at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in run_buckets(_bytes(batch.column(0)), _payloads(), buckets, longest)[1]:
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    counted = texts.select(F.col(text).cast("binary")).mapInArrow(count, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(counts: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in thousandths, from two tables of counts of ``buckets`` rows at most."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for table, into in ((counts, s), (target, t)):
        for row in table.collect():
            into[row.bucket] = row.n
    source, wanted = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array(
        [math.floor(1000 * math.log((b + 1.0) * source / ((a + 1.0) * wanted))) for a, b in zip(s.tolist(), t.tolist())],
        np.int64,
    )


def document_weights(
    docs: DataFrame, gains: np.ndarray, text: str = "text", carry: Sequence[str] = ("doc_id",), longest: int = LONGEST
) -> DataFrame:
    """The columns ``carry`` of every row, with ``n_words``, ``n_features`` and ``weight``."""
    carry = list(carry)
    carried = F.struct(*[F.col(c) for c in carry]).alias("row")
    source = docs.select(F.col(text).cast("binary").alias("text"), carried)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, runs = run_buckets(_bytes(batch.column("text")), _payloads(), len(gains), longest)
            weight = np.zeros(len(words), np.int64)
            features = np.zeros(len(words), np.int64)
            for owner, found in runs:
                # The owners ascend, so sums over them are differences of one running sum.
                sums = np.concatenate([[0], np.cumsum(gains[found])])
                cuts = np.searchsorted(owner, np.arange(len(words) + 1))
                weight += np.diff(sums[cuts])
                features += np.diff(cuts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(weight, pa.int64())],
                ["row", "n_words", "n_features", "weight"],
            )

    schema = f"row {source.schema['row'].dataType.simpleString()}, n_words long, n_features long, weight long"
    return source.mapInArrow(weigh, schema)


def gumbel(seed: int, key: Column) -> Column:
    """Noise of a row in thousandths: floor(-1000 ln(-ln u)), u from a keyed digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    target_text: str = "text",
    per_cent: int = 5,
    min_words: int = 20,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    seed: int = 42,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Every row of ``docs`` with its weight, score and place in the draw.

    Columns: ``row`` (struct of ``id`` and the columns ``carry``), ``n_words``, ``n_features``,
    ``weight``, ``score``, ``rank`` (from 1; null where the row is not drawn).

    Words are runs of ASCII letters and digits and all other characters, lower-cased A-Z.
    Features are runs of 1 to ``longest`` words, repeats counted, dealt to buckets by the CRC-32
    of their UTF-8 bytes. Of the N rows with at least ``min_words`` words, floor(N * per_cent / 100)
    with the highest scores are drawn, ties to the smaller id.

    * A null or empty text has no words, no features and weight 0.
    * Noise is keyed by the id: rows with equal ids and texts tie and are ranked one after the other.
      A null id counts as the empty one and comes last among ties.
    * An empty table gives an empty result; an empty target gives each bucket its smoothed gain.
    * Very long texts are scanned in parts. Other columns are not read.

    The rank comes from one sort of the narrow scores over all partitions; the number of
    buckets bounds all that reaches the driver.
    """
    counts = bucket_counts(docs, text, buckets, longest)
    gains = bucket_gains(counts, bucket_counts(target, target_text, buckets, longest), buckets)
    columns = [id, *[c for c in carry if c != id]]
    weighed = document_weights(docs, gains, text, columns, longest)
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel(seed, F.col(f"row.{id}"))), "scores")
    enough = F.col("n_words") >= min_words
    drawn = scored.agg(F.floor(F.count_if(enough) * per_cent / 100).alias("drawn")).scalar()
    keyed = scored.select(
        "*",
        F.when(enough, 0).otherwise(1).alias("_late"),
        (-F.col("score")).alias("_low"),
        F.col(f"row.{id}").isNull().alias("_no_id"),
        F.col(f"row.{id}").alias("_id"),
    )
    # The counts tell rows with equal ids apart, so that reruns agree.
    order = ["_late", "_low", "_no_id", "_id", "n_features", "weight"]
    placed = ordered_index(keyed, order, "draw")
    rank = F.when(enough & (F.col("index") < drawn), F.col("index") + 1).cast("long")
    return placed.select("row", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` in the order of the draw, all columns."""
    placed = resample(docs, target, carry=docs.columns, **options)
    return placed.where(F.col("rank").isNotNull()).orderBy("rank").select("row.*")
