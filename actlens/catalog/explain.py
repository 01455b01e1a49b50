"""Explanation caches, prior runs and the explain plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from actlens.catalog.registry import query
from actlens.catalog.views import SEED
from actlens.functions import text
from actlens.operators import aggregates, filters, joins
from actlens.operators.sampling import position_sample
from actlens.plans.explain import explain
from actlens.session import materialize, scratch_path
from actlens.sources.answers import AnswerStore
from actlens.slots import StubCompleter
from actlens.streaming.jobs import explain_stream

_EXPLAINED = """
  SELECT doc_idx, e AS api_explanation FROM (
    SELECT d.doc_id AS doc_idx, CASE WHEN c.text_sha IS NOT NULL THEN c.api_explanation ELSE x.explanation END AS e
    FROM documents d LEFT JOIN cache c ON sha256(d.text) = c.text_sha JOIN cleaned x ON x.doc_idx = d.doc_id)
  WHERE len(string_split(e, chr(10) || chr(10))) >= 2"""


@query(
    "min_feature_filter",
    "SELECT doc_idx, explanation FROM cleaned WHERE len(string_split(explanation, chr(10) || chr(10))) >= 2",
)
def min_feature_filter(v):
    cleaned = text.clean_features(text.extract_tagged(F.col("raw")))
    rows = v.completions().select("doc_idx", cleaned.alias("explanation"))
    return filters.min_feature_filter(rows, "explanation")


@query("drop_failed_completion", "SELECT doc_idx, raw FROM cleaned WHERE body IS NOT NULL")
def drop_failed_completion(v):
    return filters.drop_failed_completion(v.completions()).select("doc_idx", "raw")


@query(
    "drop_breakdown",
    """SELECT CASE WHEN raw IS NULL THEN 'none' WHEN body IS NULL THEN 'no_tag'
         WHEN len(string_split(explanation, chr(10) || chr(10))) < 2 THEN 'too_few' ELSE 'kept' END AS reason,
         count(*) AS row_count FROM cleaned GROUP BY 1""",
)
def drop_breakdown(v):
    return aggregates.drop_breakdown(v.completions())


@query(
    "cache_union",
    "SELECT sha256(text) AS text_sha, api_explanation, source_no, row_no FROM cache_rows",
)
def cache_union(v):
    rows = joins.cache_union(v.caches())
    return rows.select(
        F.sha2("detokenized_text_truncated", 256).alias("text_sha"),
        "api_explanation",
        "source_no",
        "row_no",
    )


@query("cache_source", "SELECT text_sha, api_explanation FROM cache")
def cache_source(v):
    return joins.cache_source(v.caches())


@query(
    "last_wins",
    "SELECT source, arg_max(lang, doc_id) AS lang FROM documents GROUP BY 1",
)
def last_wins(v):
    """Language of the last document of each source."""
    return aggregates.last_wins(v.table("documents"), ["source"], "lang", ["doc_id"])


@query(
    "cache_join",
    """SELECT d.doc_id AS doc_idx, sha256(d.text) AS text_sha, c.api_explanation
       FROM documents d LEFT JOIN cache c ON sha256(d.text) = c.text_sha""",
)
def cache_join(v):
    joined = joins.cache_join(v.texts(), joins.cache_source(v.caches()))
    return joined.select("doc_idx", "text_sha", "api_explanation")


@query(
    "cache_miss",
    "SELECT doc_id AS doc_idx FROM documents WHERE sha256(text) NOT IN (SELECT text_sha FROM cache)",
)
def cache_miss(v):
    return joins.cache_miss(v.texts(), joins.cache_source(v.caches())).select("doc_idx")


@query(
    "cache_stats",
    """SELECT source_no, sum(r)::BIGINT AS row_count, count(*) AS unique_texts, coalesce(sum(w), 0)::BIGINT AS hits,
         round(coalesce(sum(w), 0) / (SELECT count(*) FROM documents), 6) AS hit_rate
       FROM (SELECT source_no, sha256(text) AS text_sha, count(*) AS r FROM cache_rows GROUP BY 1, 2)
       LEFT JOIN (SELECT sha256(text) AS text_sha, count(*) AS w FROM documents GROUP BY 1) USING (text_sha) GROUP BY 1""",
)
def cache_stats(v):
    return joins.cache_stats(v.texts(), v.caches()).withColumn("hit_rate", F.round("hit_rate", 6))


@query("explain", _EXPLAINED)
def explain_query(v):
    done = explain(v.texts(), joins.cache_source(v.caches()), StubCompleter())
    return done.select("doc_idx", "api_explanation")


@query("explain_resumed", _EXPLAINED)
def explain_resumed(v):
    """The same through a store that already holds the answers for a part of the texts."""
    cache = joins.cache_source(v.caches())
    store = AnswerStore(v.spark, scratch_path(v.spark, "answers"))
    explain(v.texts().where(F.col("doc_idx") % 3 == 0), cache, StubCompleter(), store=store)
    done = explain(v.texts(), cache, StubCompleter(), store=store)
    return done.select("doc_idx", "api_explanation")


@query(
    "explain_drops",
    """SELECT reason, count(DISTINCT text_sha) AS texts, count(*) AS row_count FROM (
         SELECT sha256(d.text) AS text_sha, CASE WHEN c.text_sha IS NULL AND raw IS NULL THEN 'gave_up'
             WHEN c.text_sha IS NULL AND body IS NULL THEN 'no_tag'
             WHEN len(string_split(coalesce(c.api_explanation, x.explanation), chr(10) || chr(10))) < 2 THEN 'too_few' END AS reason
         FROM documents d LEFT JOIN cache c ON sha256(d.text) = c.text_sha JOIN cleaned x ON x.doc_idx = d.doc_id)
       WHERE reason IS NOT NULL GROUP BY 1""",
)
def explain_drops(v):
    """Texts and rows without an explanation, by reason, as a build leaves them behind."""
    store = AnswerStore(v.spark, scratch_path(v.spark, "answers"))
    explain(v.texts(), joins.cache_source(v.caches()), StubCompleter(), store=store)
    drops = v.spark.read.parquet(f"{store.path}/drops")
    return drops.groupBy("reason").agg(F.count(F.lit(1)).alias("texts"), F.sum("row_count").alias("row_count"))


@query("explain_stream", _EXPLAINED)
def explain_stream_query(v):
    """The same rows from a file stream in micro-batches."""
    dst, checkpoint = scratch_path(v.spark, "explained"), scratch_path(v.spark, "stream")
    documents = v.table("documents")
    stream = explain_stream(
        v.spark,
        f"{v.sf_dir}/[d]ocuments.parquet",  # a stream takes one file, or a folder of files, by a pattern only
        dst,
        checkpoint,
        documents.schema,
        StubCompleter(),
        cache=materialize(joins.cache_source(v.caches()), "cache"),  # every micro-batch reads it
        prepare=lambda df: df.select(
            F.col("doc_id").alias("doc_idx"), F.col("text").alias("detokenized_text_truncated")
        ),
        glob="*",
    )
    stream.awaitTermination()
    return v.spark.read.parquet(dst).select("doc_idx", "api_explanation")


@query(
    "prior_run_join",
    "SELECT doc_id, n_raw_tokens, explanation AS api_explanation FROM prior",
)
def prior_run_join(v):
    rows = v.base().select("doc_id", "n_raw_tokens")
    return joins.prior_run_join(rows, v.prior("av"))


@query(
    "prior_run_join_template",
    "SELECT doc_id, n_raw_tokens, explanation AS api_explanation FROM prior",
)
def prior_run_join_template(v):
    """The same from filled templates instead of tagged responses."""
    rows = v.base().select("doc_id", "n_raw_tokens")
    return joins.prior_run_join(rows, v.prior("ar"))


@query(
    "match_rate",
    """SELECT (SELECT count(*) FROM base) AS n, (SELECT count(*) FROM prior) AS matched,
         round((SELECT count(*) FROM prior) / (SELECT count(*) FROM base), 6) AS match_rate""",
)
def match_rate(v):
    return joins.match_rate(v.base(), v.prior("av")).withColumn(
        "match_rate", F.round("match_rate", 6)
    )


@query(
    "recover_cache",
    """SELECT sha256(detokenized_text_truncated) AS text_sha, explanation AS api_explanation FROM prior
       UNION ALL SELECT sha256(detokenized_text_truncated), explanation FROM prior""",
)
def recover_cache(v):
    """Caches recovered from both kinds of training table."""
    both = joins.recover_cache(v.prior("av")).unionByName(joins.recover_cache(v.prior("ar")))
    return both.select(
        F.sha2("detokenized_text_truncated", 256).alias("text_sha"), "api_explanation"
    )


@query("resume_anti_join", "SELECT doc_id, doc_idx FROM corpus WHERE lang <> 'en'")
def resume_anti_join(v):
    """English documents were written before; the rest is left to do."""
    path = scratch_path(v.spark, "done")
    docs = v.corpus().select("doc_id", "doc_idx", "lang")
    docs.where(F.col("lang") == "en").select("doc_id").write.parquet(path)
    done = v.spark.read.schema("doc_id string").parquet(path)
    return joins.resume_anti_join(docs.drop("lang"), done, ["doc_id"])


@query(
    "dataset_overlap",
    f"""WITH other AS (
          SELECT doc_id, unnest(list_distinct(list_concat(offsets, []::BIGINT[]))) + 51 AS n_raw_tokens, lang FROM positions WHERE lang <> 'de')
        SELECT count(DISTINCT a.doc_id) FILTER (a.lang <> 'de') AS shared_docs,
          count(*) FILTER (o.doc_id IS NOT NULL) AS shared_keys,
          count(*) FILTER (o.lang = 'fr') AS text_mismatches,
          count(*) FILTER (o.doc_id IS NULL) AS only_left, 0::BIGINT AS only_right
        FROM base a LEFT JOIN other o USING (doc_id, n_raw_tokens)""",
)
def dataset_overlap(v):
    """A second dataset without German documents and with changed French texts."""
    base = position_sample(v.tokens(), 10, SEED)
    changed = F.when(
        F.col("lang") == "fr", F.concat("detokenized_text_truncated", F.lit("."))
    ).otherwise(F.col("detokenized_text_truncated"))
    other = base.where(F.col("lang") != "de").withColumn("detokenized_text_truncated", changed)
    return joins.dataset_overlap(base, other)
