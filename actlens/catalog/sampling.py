"""Sources, sampling, splits, shuffles and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from actlens import schemas
from actlens.catalog.registry import query
from actlens.catalog.views import LAYER, MODEL, POSITIONS, SEED, sql_hash
from actlens.functions.text import doc_key, prefix_text, tokenize
from actlens.operators import aggregates, batching, filters, joins, ranking, sampling
from actlens.session import scratch_path, spread
from actlens.sources import corpus as src
from actlens.sources import manifest as mf
from actlens.sources import sinks

SPLIT = {"av_sft": 0.3, "ar_sft": 0.3, "rl": 0.4}


def _rank(salt: str, keys: str, seed: str = str(SEED)) -> str:
    """SQL of the 0-based rank in hashed order of ``keys`` (comma separated)."""
    joined = " || '|' || ".join(k.strip() for k in keys.split(","))
    hashed = sql_hash(f"'{seed}|{salt}|' || {joined}")
    return f"row_number() OVER (ORDER BY {hashed}, {keys}) - 1"


_SPLIT_SQL = f"""
  SELECT doc_id, CASE WHEN r < trunc(n * 0.3::DOUBLE) THEN 'av_sft'
    WHEN r < trunc(n * 0.3::DOUBLE) + trunc(n * 0.3::DOUBLE) THEN 'ar_sft' ELSE 'rl' END AS bucket
  FROM (SELECT doc_id, {_rank('', 'doc_id')} AS r, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM base))"""


# --- sources ---------------------------------------------------------------------


@query(
    "corpus_slice",
    """SELECT doc_id, doc_idx, length(text) AS chars FROM corpus
       WHERE doc_idx >= (SELECT count(*) // 4 FROM documents)
         AND doc_idx < (SELECT count(*) // 4 + count(*) // 2 FROM documents)""",
)
def corpus_slice(v):
    """The middle half of the corpus, cut out by index."""
    docs = v.corpus()
    n = docs.count()
    return src.corpus_slice(docs, n // 4, n // 2).select(
        "doc_id", "doc_idx", F.length("text").alias("chars")
    )


@query("read_projected", "SELECT doc_id, lang, n_chars FROM documents")
def read_projected(v):
    return src.read_projected(v.spark, f"{v.sf_dir}/documents.parquet", ["doc_id", "lang", "n_chars"])


@query(
    "read_batched",
    "SELECT source, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1",
)
def read_batched(v):
    docs = src.read_batched(v.spark, f"{v.sf_dir}/documents.parquet", 1 << 18)
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars")
    )


def _manifest(stage: str = "base") -> mf.Manifest:
    return mf.Manifest(
        dataset_id=mf.base_dataset_id(MODEL, LAYER, "documents", 0, 1),
        stage=stage,
        row_count=0,
        extraction=mf.Extraction(
            MODEL, 64, LAYER, "none", "documents", {"start": 0, "length": 1}, POSITIONS
        ),
    )


@query(
    "write_dataset",
    """SELECT doc_id, n_raw_tokens, activation_layer, len(activation_vector) AS width,
         length(detokenized_text_truncated) AS chars,
         (SELECT count(*) FROM base) AS declared_rows FROM base_vectors""",
)
def write_dataset(v):
    """Base table through the sink and back, with the row count its manifest declares."""
    path = scratch_path(v.spark, "dataset") + "/base"
    sinks.write_dataset(v.base_vectors().drop("vec_id"), path, schemas.BASE, _manifest())
    stored = mf.manifest_read(v.spark, path)
    return v.spark.read.parquet(path).select(
        "doc_id",
        "n_raw_tokens",
        "activation_layer",
        F.size("activation_vector").alias("width"),
        F.length("detokenized_text_truncated").alias("chars"),
        F.lit(stored.row_count).alias("declared_rows"),
    )


@query(
    "split_write",
    f"""SELECT bucket, count(DISTINCT doc_id) AS docs, count(*) AS row_count
        FROM base JOIN ({_SPLIT_SQL}) USING (doc_id) GROUP BY 1""",
)
def split_write(v):
    """Three splits written in one pass, counted from their folders."""
    path = scratch_path(v.spark, "splits")
    rows = v.base().select("doc_id", "n_raw_tokens")
    sinks.split_write(sampling.doc_split(rows, SPLIT, SEED), path)
    parts = [
        v.spark.read.parquet(f"{path}/bucket={b}").withColumn("bucket", F.lit(b)) for b in SPLIT
    ]
    return aggregates.bucket_counts(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(
    "sample_head",
    "SELECT doc_id, n_raw_tokens FROM base ORDER BY doc_id, n_raw_tokens LIMIT 20",
)
def sample_head(v):
    return src.sample_head(v.base().select("doc_id", "n_raw_tokens"), 20, ["doc_id", "n_raw_tokens"])


@query(
    "row_range",
    f"""SELECT doc_id, n_raw_tokens FROM (
          SELECT *, {_rank('', 'doc_id, n_raw_tokens')} AS r FROM base) WHERE r >= 100 AND r < 1100""",
)
def row_range(v):
    rows = v.base().select("doc_id", "n_raw_tokens")
    return src.row_range(rows, 100, 1100, batching.KEYS, SEED)


@query(
    "rollout_source",
    "SELECT rollout_id, sample_id, group_index, status, response_length, round(reward, 6) AS reward FROM rollouts",
)
def rollout_source(v):
    """Rollouts stored as Parquet and read with the declared schema."""
    path = scratch_path(v.spark, "rollouts")
    v.rollouts().write.parquet(path)
    return src.rollout_source(v.spark, path).select(
        "rollout_id",
        "sample_id",
        "group_index",
        "status",
        F.col("response_length").cast("bigint").alias("response_length"),
        F.round("reward", 6).alias("reward"),
    )


@query("chunk_union", "SELECT chunk_id, count(*) AS row_count FROM (SELECT doc_idx // 100 AS chunk_id FROM corpus) GROUP BY 1")
def chunk_union(v):
    """Chunks written to folders of their own, read as one table."""
    path = scratch_path(v.spark, "chunks")
    docs = v.corpus().select("doc_id", F.floor(F.col("doc_idx") / 100).alias("chunk_id"))
    parted = docs.withColumn("part", F.col("chunk_id")).repartition("part")  # one file per chunk
    parted.write.partitionBy("part").parquet(path)
    return (
        src.chunk_union(v.spark, path).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("row_count"))
    )


# --- tokens and positions -----------------------------------------------------------


@query("doc_key", "SELECT doc_id, doc_idx FROM corpus")
def doc_key_query(v):
    return v.table("documents").select(
        doc_key("documents", "train", F.col("doc_id")).alias("doc_id"),
        F.col("doc_id").alias("doc_idx"),
    )


@query(
    "tokenize",
    """SELECT doc_id, len(tokens) AS n_tokens, tokens[1] AS first_token, tokens[-1] AS last_token,
         sha256(array_to_string(tokens, ' ')) AS digest FROM tokens""",
)
def tokenize_query(v):
    tokens = tokenize(F.col("text"))
    return (
        spread(v.corpus(), "doc_id")
        .withColumn("tokens", tokens)
        .select(
            "doc_id",
            F.size("tokens").cast("bigint").alias("n_tokens"),
            F.get("tokens", F.lit(0)).alias("first_token"),
            F.try_element_at("tokens", F.lit(-1)).alias("last_token"),
            F.sha2(F.array_join("tokens", " "), 256).alias("digest"),
        )
    )


@query(
    "prefix_text",
    "SELECT doc_id, n_raw_tokens, sha256(detokenized_text_truncated) AS digest FROM base",
)
def prefix_text_query(v):
    rows = v.positions().withColumn("position", F.explode_outer("positions"))
    n = F.col("position") + 1
    return rows.where(F.col("position").isNotNull()).select(
        "doc_id",
        n.alias("n_raw_tokens"),
        F.sha2(prefix_text(F.col("tokens"), n), 256).alias("digest"),
    )


@query(
    "candidate_positions",
    """SELECT doc_id, count(*) AS candidates, min(i) AS first_position, max(i) AS last_position,
         sum(i)::BIGINT AS position_sum
       FROM (SELECT doc_id, unnest(tokens) AS t, unnest(range(len(tokens))) AS i FROM tokens)
       WHERE i >= 50 AND t NOT IN ('the', 'la', 'de') GROUP BY 1""",
)
def candidate_positions(v):
    """Candidates past position 50, three words taken as special tokens."""
    spots = sampling.candidate_positions(v.tokens(), special=["the", "la", "de"])
    c = F.col("candidates")
    return spots.where(F.size(c) > 0).select(
        "doc_id",
        F.size(c).cast("bigint").alias("candidates"),
        F.array_min(c).cast("bigint").alias("first_position"),
        F.array_max(c).cast("bigint").alias("last_position"),
        F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("position_sum"),
    )


@query(
    "position_sample",
    "SELECT doc_id, n_raw_tokens, length(detokenized_text_truncated) AS chars FROM base",
)
def position_sample(v):
    return sampling.position_sample(v.tokens(), POSITIONS, SEED).select(
        "doc_id",
        "n_raw_tokens",
        F.length("detokenized_text_truncated").cast("bigint").alias("chars"),
    )


@query(
    "drop_unsampled_docs",
    "SELECT doc_id, len(offsets) AS sampled FROM positions WHERE len(offsets) > 0",
)
def drop_unsampled_docs(v):
    return sampling.drop_unsampled_docs(v.positions()).select(
        "doc_id", F.size("positions").cast("bigint").alias("sampled")
    )


@query(
    "extraction_stats",
    """SELECT count(*) AS docs, sum(len(offsets))::BIGINT AS row_count,
         count(*) FILTER (len(offsets) = 0) AS docs_skipped,
         count(*) FILTER (len(offsets) BETWEEN 1 AND 9) AS docs_short_sampled FROM positions""",
)
def extraction_stats(v):
    return sampling.extraction_stats(v.positions(), POSITIONS)


@query(
    "windowed_text_sample",
    f"""SELECT doc_id, start, array_to_string(tokens[start + 1 : start + 64], ' ') AS text
        FROM (SELECT *, {sql_hash("'7|start|' || doc_id")} % w AS start,
                -ln(({sql_hash("'7|race|' || doc_id")} + 1)::DOUBLE / 1152921504606846976::DOUBLE) / w AS race
              FROM (SELECT *, len(tokens) - 63 AS w FROM tokens) WHERE w > 0)
        ORDER BY race, doc_id LIMIT 128""",
)
def windowed_text_sample(v):
    """128 windows of 64 tokens; the limit is the sample size."""
    return sampling.windowed_text_sample(v.tokens(), 128, 64, 7).select(
        "doc_id", "start", F.array_join("window", " ").alias("text")
    )


@query(
    "pad_leak_check",
    """SELECT doc_id, count(*) FILTER (t = 'the') AS pad_tokens
       FROM (SELECT doc_id, unnest(tokens) AS t FROM tokens) GROUP BY 1 HAVING pad_tokens > 0""",
)
def pad_leak_check(v):
    """The word "the" taken as the pad token."""
    return filters.pad_leak_check(v.tokens(), "the", "<eos>").select(
        "doc_id", F.col("pad_tokens").cast("bigint").alias("pad_tokens")
    )


# --- splits ---------------------------------------------------------------------------


@query("doc_split", f"SELECT doc_id, n_raw_tokens, bucket FROM base JOIN ({_SPLIT_SQL}) USING (doc_id)")
def doc_split(v):
    documents = sampling.sampleable_docs(v.tokens())
    return sampling.doc_split(v.base().select("doc_id", "n_raw_tokens"), SPLIT, SEED, documents=documents)


@query(
    "doc_split_hash",
    f"""SELECT doc_id, CASE WHEN u < 0.3::DOUBLE THEN 'av_sft' WHEN u < 0.6::DOUBLE THEN 'ar_sft' ELSE 'rl' END AS bucket
        FROM (SELECT doc_id, {sql_hash(f"'{SEED}||' || doc_id")}::DOUBLE / 1152921504606846976::DOUBLE AS u FROM corpus)""",
)
def doc_split_hash(v):
    return sampling.doc_split_hash(v.corpus().select("doc_id"), SPLIT, SEED)


@query(
    "bucket_counts",
    f"""SELECT bucket, count(DISTINCT doc_id) AS docs, count(*) AS row_count
        FROM base JOIN ({_SPLIT_SQL}) USING (doc_id) GROUP BY 1""",
)
def bucket_counts(v):
    rows = v.base().select("doc_id", "n_raw_tokens")
    return aggregates.bucket_counts(sampling.doc_split(rows, SPLIT, SEED))


@query("bucket_join", f"SELECT doc_id, n_raw_tokens, bucket FROM base JOIN ({_SPLIT_SQL}) USING (doc_id)")
def bucket_join(v):
    rows = v.base().select("doc_id", "n_raw_tokens")
    buckets = sampling.doc_split(rows.select("doc_id").distinct(), SPLIT, SEED)
    return joins.bucket_join(rows, buckets)


@query("distinct_docs", "SELECT DISTINCT doc_id FROM base")
def distinct_docs(v):
    return aggregates.distinct_docs(v.base())


@query(
    "split_disjointness",
    f"""SELECT count(*) AS docs, 0::BIGINT AS leaked_docs, sum(n)::BIGINT AS row_count
        FROM (SELECT doc_id, count(*) AS n FROM base JOIN ({_SPLIT_SQL}) USING (doc_id) GROUP BY 1)""",
)
def split_disjointness(v):
    """Documents and rows over all buckets, and the documents found in two of them."""
    marked = sampling.doc_split(v.base().select("doc_id", "n_raw_tokens"), SPLIT, SEED)
    leaked = sampling.split_disjointness(marked).agg(F.count(F.lit(1))).scalar()
    return aggregates.bucket_counts(marked).agg(
        F.sum("docs").alias("docs"), F.sum("row_count").alias("row_count")
    ).withColumn("leaked_docs", leaked)


# --- ranks, shuffles, batches -----------------------------------------------------------


@query("global_rank", f"SELECT doc_id, {_rank('', 'doc_id')} AS rank FROM corpus")
def global_rank(v):
    return ranking.global_rank(v.corpus().select("doc_id"), ["doc_id"], SEED)


@query(
    "row_shuffle",
    f"""SELECT doc_id, n_raw_tokens, vec_id, {_rank('ds', 'doc_id, n_raw_tokens')} AS shuffle_rank,
          sha256(detokenized_text_truncated) AS digest FROM base_vectors""",
)
def row_shuffle(v):
    mixed = batching.row_shuffle(v.base_vectors(), batching.KEYS, SEED, "ds")
    return mixed.select(
        "doc_id",
        "n_raw_tokens",
        "vec_id",
        "shuffle_rank",
        F.sha2("detokenized_text_truncated", 256).alias("digest"),
    )


_RING = sql_hash(f"'{SEED}|ds|activ|' || doc_id || '|' || n_raw_tokens")


@query(
    "vector_shuffle",
    f"""SELECT doc_id, n_raw_tokens, round(list_sum(list_transform(next, lambda x: x::DOUBLE)), 3) AS element_sum
        FROM (SELECT *, coalesce(lead(activation_vector) OVER ring, first_value(activation_vector) OVER ring) AS next
              FROM (SELECT *, {_RING} AS h FROM base_vectors)
              WINDOW ring AS (ORDER BY h, doc_id, n_raw_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""",
)
def vector_shuffle(v):
    moved = batching.vector_shuffle(v.base_vectors(), batching.KEYS, SEED, "ds")
    total = F.aggregate("activation_vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return moved.select("doc_id", "n_raw_tokens", F.round(total, 3).alias("element_sum"))


@query(
    "permute_join",
    f"""SELECT t.doc_id, t.n_raw_tokens, s.doc_id AS source_doc_id, s.n_raw_tokens AS source_n_raw_tokens, s.vec_id
        FROM (SELECT doc_id, n_raw_tokens, {_rank('ds|activ|to', 'doc_id, n_raw_tokens')} AS slot FROM base) t
        JOIN (SELECT doc_id, n_raw_tokens, vec_id, {_rank('ds|activ|from', 'doc_id, n_raw_tokens')} AS slot FROM base_vectors) s
        USING (slot)""",
)
def permute_join(v):
    rows = v.base_vectors().select("doc_id", "n_raw_tokens", "vec_id")
    return batching.permute_join(rows, batching.KEYS, SEED, "ds", "vec_id")


def _epoch_rank(epoch: str) -> str:
    hashed = sql_hash(f"'{SEED}|epoch|' || {epoch} || '|' || doc_id")
    return f"row_number() OVER (PARTITION BY {epoch} ORDER BY {hashed}, doc_id) - 1"


@query("epoch_shuffle", f"SELECT doc_id, epoch, {_epoch_rank('epoch')} AS epoch_rank FROM (SELECT doc_id, 3::BIGINT AS epoch FROM corpus)")
def epoch_shuffle(v):
    return batching.epoch_shuffle(v.corpus().select("doc_id"), ["doc_id"], SEED, 3)


# Two and a half epochs from half an epoch on, whatever the corpus size: batch
# size and start are shares of it.
_DRAW = f"""
  SELECT doc_id, epoch, epoch * n + r - n // 2 AS draw_index, (epoch * n + r - n // 2) // (n // 8) AS batch_id
  FROM (SELECT doc_id, epoch, n, {_epoch_rank('epoch')} AS r
        FROM (SELECT doc_id, unnest([0, 1, 2, 3]) AS epoch, (SELECT count(*) FROM documents) AS n FROM corpus))
  WHERE epoch * n + r >= n // 2 AND epoch * n + r < n // 2 + 20 * (n // 8)"""


def _draw(v):
    docs = v.corpus().select("doc_id")
    n = docs.count()
    return batching.batches(docs, ["doc_id"], n // 8, 20, SEED, start=n // 2)


@query("batches", f"SELECT doc_id, epoch, draw_index, batch_id FROM ({_DRAW})")
def batches(v):
    return _draw(v)


@query(
    "group_index",
    f"SELECT doc_id, epoch, draw_index AS group_index, draw_index * 4 AS first_sample_index FROM ({_DRAW})",
)
def group_index(v):
    return batching.group_index(_draw(v), 4).drop("draw_index", "batch_id")


@query(
    "sample_groups",
    f"""SELECT doc_id, batch_id, draw_index AS group_index, draw_index * 4 + c AS sample_index
        FROM ({_DRAW}), (SELECT unnest([0, 1, 2, 3]) AS c)""",
)
def sample_groups(v):
    return batching.sample_groups(_draw(v), 4).drop("draw_index", "epoch")


@query(
    "chunk_ids",
    f"SELECT doc_id, ({_rank('chunk', 'doc_id')}) // 128 AS chunk_id FROM corpus",
)
def chunk_ids(v):
    return batching.chunk_ids(v.corpus().select("doc_id"), ["doc_id"], 128, SEED)


@query(
    "even_slices",
    """SELECT doc_id, least(doc_idx // ((SELECT count(*) FROM documents) // 7), 6) AS worker FROM corpus""",
)
def even_slices(v):
    docs = v.corpus().select("doc_id", "doc_idx")
    return batching.even_slices(docs, 0, docs.count(), 7).drop("doc_idx")


@query("reshard", "SELECT sample_id, group_index % 6 AS worker FROM rollouts")
def reshard(v):
    rows = v.rollouts().select("sample_id", "group_index")
    return batching.reshard(rows, "group_index", 6).drop("group_index")


@query(
    "shard_min",
    """SELECT min(n) AS min_rows, count(*) AS shards
       FROM (SELECT rollout_id, count(*) AS n FROM rollouts WHERE status = 'COMPLETED' GROUP BY 1)""",
)
def shard_min(v):
    return batching.shard_min(filters.completed_only(v.rollouts()), "rollout_id")


@query(
    "equal_shards",
    """SELECT rollout_id, sample_id FROM (
         SELECT *, row_number() OVER (PARTITION BY rollout_id ORDER BY sample_id) AS r,
           (SELECT min(c) // 8 * 8 FROM (SELECT count(*) AS c FROM rollouts WHERE status = 'COMPLETED' GROUP BY rollout_id)) AS keep
         FROM rollouts WHERE status = 'COMPLETED') WHERE r <= keep""",
)
def equal_shards(v):
    rows = filters.completed_only(v.rollouts()).select("rollout_id", "sample_id")
    return batching.equal_shards(rows, "rollout_id", "sample_id", 8)


@query(
    "packed_offsets",
    """SELECT rollout_id, sample_id, e - response_length AS start_offset, e - 1 AS last_index
       FROM (SELECT *, sum(response_length) OVER (PARTITION BY rollout_id ORDER BY sample_id)::BIGINT AS e FROM rollouts)""",
)
def packed_offsets(v):
    rows = v.rollouts().select("rollout_id", "sample_id", "response_length")
    return batching.packed_offsets(rows, "response_length", "rollout_id", "sample_id").drop(
        "response_length"
    )
