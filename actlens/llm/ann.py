"""Approximate nearest neighbours: one small-world graph per shard, results merged.

Vectors are dealt into shards of bounded size by a hash. A shard's graph is stored as
flat neighbour arrays; blocks of queries visit every shard, and the best of all
shards are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from actlens.llm.common import packed
from actlens.llm.hnsw import Graph, build
from actlens.session import materialize

SHARD = 16_384
BLOCK = 1024
BEAM = 192

_INDEX = "width int, shard int, entry int, vectors binary, ids array<long>, counts array<int>, layers array<binary>"
_FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """False for null, empty and zero vectors and for null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _stored(vectors: DataFrame) -> str:
    """How the index stores components: as they are given, anything but float as double."""
    return "float32" if vectors.schema["vector"].dataType.elementType == FloatType() else "float64"


def _scaled(raw: np.ndarray) -> np.ndarray:
    """Rows in double, each times the power of two that brings its largest component below one.

    Cosines stay what they are, and no square overflows or vanishes.
    """
    exact = raw.astype(np.float64)
    return np.ldexp(exact, -np.frexp(np.abs(exact).max(1))[1][:, None])


def build_index(vectors: DataFrame, nearest: int, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """One row per shard with its graph, and (``width``, ``shards``), from ``vec_id`` and ``vector``.

    Equal vectors are one node, which keeps its ``nearest + 1`` smallest ids: no other
    of its ids can be among the nearest of any query. Vectors of different width do
    not meet. Components are stored as they are given: single precision or double.
    """
    kind = _stored(vectors)
    smallest = W.partitionBy("vector").orderBy("vec_id")
    nodes = materialize(
        vectors.distinct()
        .withColumn("nth", F.row_number().over(smallest))
        .where(F.col("nth") <= nearest + 1)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("width", F.size("vector")),
        "ann-nodes",
    )
    shards = nodes.groupBy("width").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    placed = nodes.join(F.broadcast(shards), "width").withColumn(
        "shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int")
    )

    def graph_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(head=rows["ids"].str[0]).sort_values("head", kind="stable")
        raw = np.stack(rows["vector"].to_numpy()).astype(kind)
        graph = build(_scaled(raw))
        return pd.DataFrame({
            "width": [key[0]],
            "shard": [key[1]],
            "entry": [graph.entry],
            "vectors": [raw.tobytes()],
            "ids": [np.concatenate(rows["ids"].to_numpy())],
            "counts": [rows["ids"].map(len).to_numpy(np.int32)],
            "layers": [[layer.astype(np.int32).tobytes() for layer in graph.layers]],
        })

    return materialize(placed.groupBy("width", "shard").applyInPandas(graph_of, _INDEX), "ann-index"), shards


def _cosines(vectors: np.ndarray, lengths: np.ndarray, query: np.ndarray, query_length: float) -> np.ndarray:
    """Cosines in double precision; a vector's does not depend on which others are scored with it."""
    return (vectors * query).sum(1) / (lengths * query_length)


def _slack(width: int) -> float:
    """How far two similarities may be apart and still be in either order in single precision."""
    return 4 * (width + 4) * 2.0**-24


def _settled(scores: np.ndarray, full: int, nearest: int, slack: float) -> bool:
    """Whether no vector outside a beam of ``full`` places can be as near as the last one wanted.

    One more than ``nearest``, as the query itself may be among them.
    """
    if len(scores) < full or full <= nearest:
        return False
    return scores.min() + slack < np.partition(scores, -nearest - 1)[-nearest - 1]


def _search(nearest: int, beam: int, kind: str):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                raw = np.frombuffer(row.vectors, kind).reshape(-1, row.width)
                exact = _scaled(raw)
                length = np.sqrt((exact * exact).sum(1))
                unit = (exact / length[:, None]).astype(np.float32)
                layers = [np.frombuffer(b, np.int32).reshape(len(raw), -1) for b in row.layers]
                graph = Graph(unit, layers, row.entry)
                asked = _scaled(np.stack([np.asarray(q["vector"], np.float64) for q in row.queries]))
                names = np.array([q["vec_id"] for q in row.queries])
                asked_length = np.sqrt((asked * asked).sum(1))
                ids, _ = graph.search((asked / asked_length[:, None]).astype(np.float32), beam)
                starts = np.cumsum([0, *row.counts])
                members = np.asarray(row.ids)
                full = min(beam, len(raw))
                out: list[tuple[int, int, float]] = []
                for i, found in enumerate(ids):
                    found = found[found >= 0]
                    scores = _cosines(exact[found], length[found], asked[i], asked_length[i])
                    if len(found) < len(raw) and not _settled(scores, full, nearest, _slack(row.width)):
                        # Vectors that single precision cannot tell apart fill the beam, or links are missing.
                        found = np.arange(len(raw))
                        scores = _cosines(exact, length, asked[i], asked_length[i])
                    best = [
                        (-score, int(v))
                        for f, score in zip(found, scores)
                        for v in members[starts[f] : starts[f + 1]]
                        if v != names[i]
                    ]
                    out += [(int(names[i]), v, -score) for score, v in sorted(best)[:nearest]]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return search


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    id: str = "vec_id",
    vector: str = "embedding",
    nearest: int = 5,
    shard: int = SHARD,
    block: int = BLOCK,
    beam: int = BEAM,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (cosine, double precision).

    Queries are the rows where ``is_query`` holds (a column over ``vec_id``); candidates are
    all rows but the query's own; ties go to the smaller id.

    * Unusable vectors (see :func:`usable`) and null ids neither ask nor are found.
    * Equal vectors are all candidates; repeated rows count once.
    * A beam is scored whole in double precision. Where its last vector is within single
      precision of the nearest, the query is compared with the whole shard instead.
    * Scores are those of the given components, float or double, however large or small.
    * With fewer candidates than ``nearest`` all are returned; an empty table gives no rows.
    * Other columns are not read.
    """
    rows = (
        packed(vectors)
        .select(F.col(f"row.{id}").cast("long").alias("vec_id"), F.col(f"row.{vector}").alias("vector"))
        .where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    )
    index, shards = build_index(rows, nearest, shard)
    queries = rows.where(is_query).distinct().withColumn("width", F.size("vector"))
    blocks = queries.agg(F.ceil(F.count(F.lit(1)) / block).alias("n")).scalar()
    asked = (
        queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.greatest(blocks, F.lit(1))))
        .groupBy("width", "block")
        .agg(F.collect_list(F.struct("vec_id", "vector")).alias("queries"))  # about `block` of them
        .join(F.broadcast(shards), "width")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .select("width", "shard", "queries")
    )
    # A stated set of queries, in blocks, against every shard.
    found = asked.join(index, ["width", "shard"]).mapInPandas(_search(nearest, beam, _stored(rows)), _FOUND)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")
