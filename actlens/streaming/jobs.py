"""Streams over a folder of files; each micro-batch writes its own folder.

The folder is named after the batch id, so a batch that runs again after a
failure replaces what it wrote before. Only :func:`reward_batches` keeps state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from actlens.plans.evaluate import score_rollouts
from actlens.plans.explain import explain
from actlens.slots import Completer, Reconstructor
from actlens.streaming.gather import gathered, lane_partitions


def _by_batch(
    source: DataFrame, work: Callable[[DataFrame], DataFrame], dst: str, checkpoint: str
):
    def write(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{dst}/batch={batch_id}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def explain_stream(
    spark: SparkSession,
    src: str,
    dst: str,
    checkpoint: str,
    schema: T.StructType,
    completer: Completer,
    cache: DataFrame | None = None,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    max_files: int = 16,
    glob: str = "*.parquet",
    **explain_args,
) -> StreamingQuery:
    """Explain the files under ``src`` chunk by chunk, then stop.

    Finished chunks survive a crash and none is explained twice; start it again
    to take up new files. ``prepare`` shapes a raw chunk before it is explained.
    """
    source = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", glob)
        .parquet(src)
    )

    def work(batch: DataFrame) -> DataFrame:
        return explain(prepare(batch), cache, completer, **explain_args)

    return _by_batch(source, work, dst, checkpoint).trigger(availableNow=True).start()


def reward_stream(
    spark: SparkSession,
    src: str,
    dst: str,
    checkpoint: str,
    schema: T.StructType,
    reconstructor: Reconstructor,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    seconds: int | None = 5,
    max_files: int = 1,
    glob: str = "*.parquet",
    **score_args,
) -> StreamingQuery:
    """Score rollout files as they arrive: at most ``max_files`` at a time, every ``seconds``.

    ``seconds=None`` scores what is there and stops. Where that is fewer files than cores, the rows are
    dealt to all cores before they are scored.
    """
    cores = spark.sparkContext.defaultParallelism
    source = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", glob)
        .parquet(src)
    )

    def work(batch: DataFrame) -> DataFrame:
        rows = batch.repartition(cores) if max_files < cores else batch
        return score_rollouts(prepare(rows), reconstructor, **score_args)

    writer = _by_batch(source, work, dst, checkpoint)
    if seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{seconds} seconds").start()


# Stored bytes of new files that a micro-batch takes for each lane.
LANE_BYTES = 16 << 20
# Lists and timers of a key are kept by this store; other stores have no timers.
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_AS_CALLER = ("spark.sql.session.timeZone", "spark.sql.execution.arrow.maxRecordsPerBatch")


def reward_batches(
    spark: SparkSession,
    src: str,
    dst: str,
    checkpoint: str,
    schema: T.StructType,
    reconstructor: Reconstructor,
    size: int,
    seconds: float = 5.0,
    lanes: int = 1,
    key: str = "sample_id",
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    every: float = 0.5,
    max_files: int | None = None,
    glob: str = "*.parquet",
    **score_args,
) -> StreamingQuery:
    """Score samples in batches of ``size``, or fewer once the oldest has waited ``seconds``.

    Samples are gathered over files and micro-batches, in ``lanes`` side by side. A batch is scored
    as one; where the reconstructor fails, its samples get the fixed reward, like samples
    that are not completed. The rows keep ``lane``, ``batch_no``, ``batch_size`` and ``cause``.
    A micro-batch takes new files of up to 16 MB for each lane, one at least (or ``max_files``), so what a
    lane's task reads does not grow with what has come in. Runs until it is stopped. Settings of the state hold in a
    session of its own, which has one to two shuffle partitions a lane, since every partition costs a micro-batch a task and a store.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    own.conf.set("spark.sql.shuffle.partitions", str(lane_partitions(spark, lanes)))
    for setting in _AS_CALLER:
        own.conf.set(setting, spark.conf.get(setting))
    bound = ("maxBytesPerTrigger", lanes * LANE_BYTES) if max_files is None else ("maxFilesPerTrigger", max_files)
    source = own.readStream.schema(schema).option(*bound).option("pathGlobFilter", glob).parquet(src)

    def work(batch: DataFrame) -> DataFrame:
        return score_rollouts(prepare(batch), reconstructor, lenient=True, **score_args)

    writer = _by_batch(gathered(source, size, seconds, lanes, key), work, dst, checkpoint)
    return writer.trigger(processingTime=f"{int(every * 1000)} milliseconds").start()
