"""Batches of a stream by number or by time, whichever comes first."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from actlens.operators.packs import pack_table, unpack_table

_MARKS = [
    T.StructField("lane", T.IntegerType()),
    T.StructField("batch_no", T.LongType()),
    T.StructField("batch_size", T.IntegerType()),
    T.StructField("cause", T.StringType()),
]
_CHUNKS = "lane int, rows binary"
_OUT = T.StructType([*_MARKS, T.StructField("rows", T.BinaryType())])

# Rows of a lane that travel as one value, and the bytes of batches that leave the state as one frame.
CHUNK_ROWS = 1024
FRAME_BYTES = 16 << 20


def _packed(rows: pa.Table) -> bytes:
    return pack_table(rows, "lz4")


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows behind their lane to one value per lane and ``CHUNK_ROWS`` rows."""
    for batch in batches:
        lane = batch.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(lane, kind="stable")
        rows = pa.table(batch.columns[1:], schema=pa.schema(list(batch.schema)[1:])).take(pa.array(order))
        numbers, starts = np.unique(lane[order], return_index=True)
        lanes, chunks = [], []
        for number, lo, hi in zip(numbers.tolist(), starts.tolist(), [*starts.tolist()[1:], len(lane)]):
            for at in range(lo, hi, CHUNK_ROWS):
                lanes.append(number)
                chunks.append(_packed(rows.slice(at, min(CHUNK_ROWS, hi - at))))
        yield pa.RecordBatch.from_arrays([pa.array(lanes, pa.int32()), pa.array(chunks, pa.binary())], ["lane", "rows"])


def _spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches back to rows, each with its batch's lane, number, size and cause."""
    for batch in batches:
        *marks, chunks = batch.columns
        for i, chunk in enumerate(chunks):
            for rows in unpack_table(chunk.as_buffer()).combine_chunks().to_batches():
                same = [pa.repeat(mark[i], rows.num_rows) for mark in marks]
                fields = [*rows.schema, *list(batch.schema)[: len(marks)]]
                yield pa.RecordBatch.from_arrays([*rows.columns, *same], schema=pa.schema(fields))


class Gather(StatefulProcessor):
    """Holds the rows of a lane until there are ``size`` of them or the oldest has waited ``seconds``.

    State of a lane: fewer than ``size`` rows, the number of its next batch, and when its timer
    is due. A row that arrives after its batch went out starts the next one. Rows come, wait and leave
    packed; a batch leaves as one value.
    """

    def __init__(self, size: int, seconds: float):
        self.size = size
        self.wait = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "rows binary")
        self.next = handle.getValueState("next", "batch_no long, due long")

    def _state(self) -> tuple[list[pa.Table], int, int]:
        number, due = self.next.get() if self.next.exists() else (0, 0)
        return [unpack_table(r[0]) for r in self.rows.get()] if self.rows.exists() else [], number, due

    def _frame(self, lane: int, number: int, batches: list[pa.Table], cause: str) -> pd.DataFrame:
        """Batches from ``number`` on, a row each."""
        numbers, sizes = range(number, number + len(batches)), [b.num_rows for b in batches]
        rows = [_packed(b) for b in batches]
        return pd.DataFrame({"lane": lane, "batch_no": numbers, "batch_size": sizes, "cause": cause, "rows": rows})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, number, due = self._state()
        waited, n = bool(held), sum(t.num_rows for t in held)
        full: list[pa.Table] = []
        for frame in rows:
            for chunk in frame["rows"]:
                held.append(unpack_table(chunk))
                n += held[-1].num_rows
                if n < self.size:
                    continue
                together, cut = pa.concat_tables(held), n - n % self.size
                full += [together.slice(at, self.size) for at in range(0, cut, self.size)]
                held, n, waited = [together.slice(cut)] if n > cut else [], n - cut, False
                if sum(t.nbytes for t in full) >= FRAME_BYTES:
                    yield self._frame(key[0], number, full, "size")
                    number, full = number + len(full), []
        if full:
            yield self._frame(key[0], number, full, "size")
            number += len(full)
        if due and not waited:
            self.handle.deleteTimer(due)
            due = 0
        if held and not waited:
            due = timerValues.getCurrentProcessingTimeInMs() + self.wait
            self.handle.registerTimer(due)
        self._keep(held, number, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, number, _ = self._state()
        if held:
            yield self._frame(key[0], number, [pa.concat_tables(held)], "time")
            number += 1
        self._keep([], number, 0)

    def _keep(self, rows: list[pa.Table], number: int, due: int) -> None:
        if rows:
            self.rows.put([(_packed(pa.concat_tables(rows)),)])
        elif self.rows.exists():
            self.rows.clear()
        self.next.update((number, due))


def lane_partitions(spark: SparkSession, lanes: int) -> int:
    """Partitions for the state of ``lanes``: between as many and twice as many, where the fullest holds fewest lanes.

    Every partition is a task and a store of its own in every micro-batch, with rows or without.
    """
    places = [r[0] for r in spark.range(lanes).select(F.hash(F.col("id").cast("int"))).collect()]
    return min(range(lanes, 2 * lanes + 1), key=lambda n: (max(Counter(p % n for p in places).values()), n))


def gathered(source: DataFrame, size: int, seconds: float, lanes: int, key: str) -> DataFrame:
    """Rows of the stream ``source`` in batches: its columns and ``lane``, ``batch_no``, ``batch_size``, ``cause``.

    Rows are dealt to ``lanes`` by a hash of ``key``; each lane gathers batches of its own, so the
    work of a wide stream is spread. ``cause`` is ``size`` or ``time``. Rows travel and wait as packed Arrow
    chunks, and whole batches are dealt to all cores before they are unpacked.
    """
    lane = F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int").alias("lane")
    cores = source.sparkSession.sparkContext.defaultParallelism
    batches = (
        source.select(lane, "*")
        .mapInArrow(_deal, _CHUNKS)
        .groupBy("lane")
        .transformWithStateInPandas(Gather(size, seconds), _OUT, "append", "processingTime")
    )
    whole = T.StructType([*source.schema.fields, *_MARKS])
    return (batches.repartition(cores) if lanes < cores else batches).mapInArrow(_spread_out, whole)
