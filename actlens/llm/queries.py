"""The operators as registered queries on the given tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.llm import (
    ann,
    bilinear,
    chat,
    content_sort,
    curriculum,
    packing,
    parity_join,
    relative_factors,
    resampling,
    rule_ensemble,
    sharding,
    simplex_clusters,
    suffix_windows,
)
from actlens.llm.common import session, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(session(spark), sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DRAW = "('0x' || substr(sha256('42|mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT"
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


@query(
    "op3_curriculum_mix",
    f"""WITH d AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size, {_DRAW} AS draw FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
            WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
    o AS (SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS full_at FROM w),
    l AS (SELECT *, ((SELECT sum(source_size) * 1.5::DOUBLE FROM o) - coalesce(sum(most) OVER below, 0)) / sum(weight) OVER above AS level
          FROM o WINDOW below AS (ORDER BY full_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP),
                        above AS (ORDER BY full_at RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    t AS (SELECT source, source_size, least(most, weight * (SELECT arg_min(level, full_at) FROM l WHERE level <= full_at)) AS target FROM l),
    r AS (SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER
            (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS middle
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
      size * (CASE WHEN middle < target THEN 1 ELSE 0 END + CASE WHEN middle + source_size < target THEN 1 ELSE 0 END) AS taken
    FROM r""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, in training order."""
    mixed = curriculum.curriculum(table(spark, sf_dir, "documents"))
    ordered = mixed.orderBy(F.get("times", F.lit(0)).asc_nulls_last(), "id")
    return ordered.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken")
    )


@query("op4_balanced_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of near equal bytes."""
    placed = sharding.balanced_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    "op5_content_sort",
    f"""WITH d AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
    g AS (SELECT *, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the row that stays of its equal texts."""
    rows = content_sort.content_sort(table(spark, sf_dir, "documents"))
    return rows.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op7_rule_ensemble")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text by a sparse rule ensemble."""
    scored = rule_ensemble.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


@query("op8_swap_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in a sequence of 2048 tokens."""
    return packing.packed_pieces(table(spark, sf_dir, "documents"))


SAID = "</s>[INST] ok [/INST]"


@query("op9_chat_masks")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted conversations and their loss masks give back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)], given.schema)
    return chat.chat_digest(chat.chat_examples(given.unionByName(more)))


@query("op10_bilinear_scores")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and log-bilinear log10 probabilities of every text."""
    return bilinear.score_texts(table(spark, sf_dir, "documents"))


@query("op1_parity_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    found = parity_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query("op2_suffix_windows")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without repeated 200-byte strings."""
    found = suffix_windows.repeated_bytes(table(spark, sf_dir, "documents"))
    return suffix_windows.kept_texts(found).drop("kept")


@query("op6_sharded_graphs")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query(
    "op11_relative_factors",
    r"""WITH d AS (SELECT doc_id, row_number() OVER () AS no, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, no, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
    h AS (SELECT doc_id, no, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM s),
    f AS (SELECT no, i, doc_id > min(doc_id) OVER (PARTITION BY g) AS found FROM h),
    r AS (SELECT DISTINCT no, i + k AS i FROM f, range(13) t(k) WHERE found),
    k AS (SELECT no, len(w) AS n_words, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
    l AS (SELECT no, count(*) AS n_left, string_agg(word, ' ' ORDER BY i) AS kept FROM k ANTI JOIN r USING (no, i) GROUP BY no)
    SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n_left, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN l USING (no)""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without passages of smaller documents."""
    found = relative_factors.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


_NEAREST = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT"


def _round(r: int) -> str:
    """Assignment to the centroids c{r}, and the centroids after it."""
    return f"""a{r} AS (SELECT vec_id, no, v, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
              FROM (SELECT vec_id, no, v, cluster, {_NEAREST} AS distance FROM kept, c{r}) GROUP BY vec_id, no, v),
    m{r} AS (SELECT cluster, list(floor(total / n)::BIGINT ORDER BY i) AS c FROM
              (SELECT cluster, i, sum(v[i]) AS total, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY cluster, i) GROUP BY cluster),
    c{r + 1} AS (SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))"""


@query(
    "op12_simplex_clusters",
    f"""WITH kept AS (SELECT vec_id, row_number() OVER () AS no, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
              FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
    c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, v AS c
              FROM kept ORDER BY sha256('1:' || vec_id) LIMIT 16),
    {_round(0)}, {_round(1)}, {_round(2)}, {_round(3)}
    SELECT vec_id, cluster::INT AS cluster, distance,
      CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
      CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.c, ',')) AS centroid_sha256
    FROM a3 JOIN c3 USING (cluster)""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact k-means of all vectors, comparisons filtered by n-simplex bounds."""
    found = simplex_clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


@query("op13_aho_resampling")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and draw of all documents towards the benchmark texts."""
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("row.doc_id", "n_features", "weight", "score", "rank")
