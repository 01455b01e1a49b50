"""Derived views over the given tables, in Spark and in SQL.

The given tables hold no activations or explanations, so the views shape them
into such data: documents become a corpus, embeddings the vectors, events the
rollouts. Each view grows with its table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.functions import text as tx
from actlens.functions.binding import let
from actlens.functions.hashing import int_hash
from actlens.operators.sampling import position_sample, position_sample_with, sampled_positions
from actlens.session import spread
from actlens.sources.manifest import dataset_id

POSITIONS = 10
SEED = 42
MODEL = "acme/tiny-model"
LAYER = 20


def sql_hash(expr: str) -> str:
    """SQL of the 60-bit hash."""
    return f"(('0x' || substr(sha256({expr}), 1, 15))::BIGINT)"


class Views:
    """Spark side of the views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def corpus(self) -> DataFrame:
        return self.table("documents").select(
            tx.doc_key("documents", "train", F.col("doc_id")).alias("doc_id"),
            F.col("doc_id").alias("doc_idx"),
            "text",
            "lang",
            "source",
        )

    def tokens(self) -> DataFrame:
        return spread(self.corpus(), "doc_id").select(
            "doc_id", "doc_idx", "lang", "source", tx.tokenize(F.col("text")).alias("tokens")
        )

    def positions(self) -> DataFrame:
        return sampled_positions(self.tokens(), POSITIONS, SEED)

    def base(self) -> DataFrame:
        """Sampled positions with text, without vectors."""
        return position_sample(self.tokens(), POSITIONS, SEED).withColumn(
            "activation_layer", F.lit(LAYER).cast("bigint")
        )

    def base_vectors(self) -> DataFrame:
        """Base table: a vector for each sampled position, norms between 50 and 149; a document's text moves once."""
        vectors = self.table("embeddings")
        n = vectors.agg(F.count(F.lit(1))).scalar()
        key = F.concat_ws("|", "doc_id", F.col("n_raw_tokens").cast("string"))
        factor = (F.lit(50) + F.col("vec_id") % 100).cast("float")
        scaled = vectors.select(
            "vec_id", F.transform("embedding", lambda x: x * factor).alias("activation_vector")
        )

        def attach(keys: DataFrame) -> DataFrame:
            return keys.withColumn("vec_id", int_hash(key) % n).join(scaled, "vec_id")

        return position_sample_with(self.tokens(), POSITIONS, SEED, attach).select(
            "n_raw_tokens",
            "detokenized_text_truncated",
            "activation_vector",
            F.lit(LAYER).cast("bigint").alias("activation_layer"),
            "doc_id",
            "vec_id",
        )

    def explained(self) -> DataFrame:
        """Base table with a two-paragraph explanation per row."""
        words = F.split("detokenized_text_truncated", " ")
        return self.base_vectors().withColumn(
            "api_explanation",
            F.concat(
                F.lit("starts with "), F.get(words, 0), F.lit("\n\nends with "), F.element_at(words, -1)
            ),
        )

    def completions(self) -> DataFrame:
        """Raw completer output per document."""
        length = F.length("text")
        kind = length % 10

        def answer(words: Column) -> Column:
            first = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
            last = F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))
            return (
                F.when(kind == 0, F.lit(None).cast("string"))
                .when(kind == 1, F.lit("<analysis>\n1. cut off"))
                .when(kind == 2, F.lit("<analysis>\nonly one feature\n</analysis>"))
                .when(
                    kind == 3,
                    F.concat(
                        F.lit("<analysis>\n1. **Topic:** "),
                        first,
                        F.lit(" text\n2) ends with "),
                        last,
                        F.lit("\n</analysis>"),
                    ),
                )
                .otherwise(
                    F.concat(
                        F.lit("Sure.\n<analysis>\n- starts with "),
                        first,
                        F.lit("\n* has "),
                        F.greatest(F.size(words), F.lit(1)).cast("string"),
                        F.lit(" words\n(c) length "),
                        length.cast("string"),
                        F.lit("_\n</analysis>"),
                    )
                )
            )

        raw = let(tx.tokenize(F.col("text")), answer)
        return spread(self.table("documents"), "doc_id").select(
            F.col("doc_id").alias("doc_idx"), "lang", raw.alias("raw")
        )

    def texts(self) -> DataFrame:
        """Documents as rows to explain."""
        return self.table("documents").select(
            F.col("doc_id").alias("doc_idx"), F.col("text").alias("detokenized_text_truncated")
        )

    def caches(self) -> list[DataFrame]:
        """Explanations of labelled documents; the second source is the later one."""
        labelled = self.table("documents").join(self.table("labels"), "doc_id")

        def cache(rows: DataFrame, explanation: Column) -> DataFrame:
            return rows.select(
                F.col("text").alias("detokenized_text_truncated"),
                explanation.alias("api_explanation"),
                F.col("doc_id").alias("row_no"),
            )

        judged = labelled.where((F.col("quality") == 1) | (F.col("toxic") == 1))
        later = F.when(F.col("toxic") == 1, F.lit("B only")).otherwise(F.lit("B one\n\nB two"))
        return [cache(labelled, F.lit("A one\n\nA two")), cache(judged, later)]

    def prior(self, kind: str) -> DataFrame:
        """Training rows of an earlier run that left out documents with a mail address."""
        mail_free = self.corpus().where(~F.col("text").contains("@"))
        tokens = spread(mail_free, "doc_id").select("doc_id", tx.tokenize(F.col("text")).alias("tokens"))
        rows = position_sample(tokens, POSITIONS, SEED)
        told = F.concat(F.lit("seen "), F.col("n_raw_tokens").cast("string"))
        keys = rows.select("doc_id", "n_raw_tokens", "detokenized_text_truncated", told.alias("_e"))
        if kind == "av":
            return keys.withColumn("response", tx.wrap_explanation(F.col("_e"))).drop("_e")
        filled = tx.fill_template(tx.fv.CRITIC_TEMPLATE, explanation=F.col("_e"))
        return keys.withColumn("prompt", filled).drop("_e")

    def pairs(self) -> DataFrame:
        """Predictions and targets: each vector against its neighbour."""
        e = self.table("embeddings")
        return e.select(
            F.col("vec_id").alias("id"),
            F.floor(F.col("vec_id") / 64).alias("batch_id"),
            F.col("label").cast("bigint").alias("label"),
            F.col("embedding").alias("pred"),
        ).join(
            e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("gold")), "id"
        )

    def vectors(self) -> DataFrame:
        """Vectors with norms that vary."""
        factor = (F.lit(50) + F.col("vec_id") % 100).cast("float")
        return self.table("embeddings").select(
            "vec_id",
            F.col("label").cast("bigint").alias("label"),
            F.transform("embedding", lambda x: x * factor).alias("v"),
        )

    def rollouts(self) -> DataFrame:
        e = F.col("event_id")
        status = (
            F.when(F.col("event_type") == "error", "FAILED")
            .when((F.col("event_type") == "view") & (F.col("value") > 100), "TRUNCATED")
            .otherwise("COMPLETED")
        )
        doc = (
            F.when(e % 3 == 0, F.lit("allenai/WildChat-1M:train:"))
            .when(e % 3 == 1, F.lit("openbmb/Ultra-FineWeb:en:"))
            .otherwise(F.lit("other:train:"))
        )
        body = F.concat(F.lit("<explanation>\n"), F.col("event_type"), F.lit(" "), F.col("props"))
        close = F.when(status == "TRUNCATED", F.lit("")).otherwise(F.lit("\n</explanation>"))
        steps = F.sequence(F.lit(0), (e % 8).cast("int"))
        return self.table("events").select(
            (e % 4).alias("rollout_id"),
            e.alias("sample_id"),
            F.col("user_id").alias("group_index"),
            (-F.col("value") / 250.0).alias("reward"),
            status.alias("status"),
            F.concat(doc, e.cast("string")).alias("doc_id"),
            F.concat(body, close).alias("response"),
            (F.lit(5) + e % 146).cast("int").alias("response_length"),
            F.transform(steps, lambda i: -(i + 1) / F.lit(10.0)).alias("train_log_probs"),
            F.transform(steps, lambda i: -(i + 1) / F.lit(10.0) - i * F.lit(0.01)).alias(
                "rollout_log_probs"
            ),
        )

    def messages(self) -> DataFrame:
        """Conversation turns as message lists, one message per line; "ou" marks the place."""
        lines = F.split(F.replace(F.col("text"), F.lit("ou"), F.lit("<INJECT>")), "\n")
        return self.table("conversations").select(
            "conv_id",
            "turn",
            F.transform(
                lines, lambda x: F.struct(F.col("role").alias("role"), x.alias("content"))
            ).alias("prompt"),
        )

    def shards(self) -> DataFrame:
        """Manifests of corpus shards of 100 documents, in runs that fit and runs that do not."""
        docs = self.table("documents").select(
            "doc_id", "lang", F.floor(F.col("doc_id") / 100).alias("shard")
        )
        whole = docs.withColumn("run", F.lit("whole"))
        runs = (
            whole.unionByName(docs.withColumn("run", F.concat(F.lit("lang-"), "lang")))
            .unionByName(docs.withColumn("run", F.lit("padded")))
            .unionByName(docs.withColumn("run", F.lit("mixed")))
        )
        rows = runs.groupBy("run", "shard").agg(
            F.min("doc_id").alias("start"), F.count(F.lit(1)).alias("row_count")
        )
        length = F.when(F.col("run") == "padded", F.col("row_count") + 10).otherwise(
            F.col("row_count")
        )
        layer = F.when(F.col("run") == "mixed", F.lit(LAYER) + F.col("shard") % 2).otherwise(
            F.lit(LAYER)
        )
        return rows.select(
            "run",
            F.concat("run", F.lit("/shard-"), F.col("shard").cast("string")).alias("path"),
            dataset_id(F.lit(MODEL), layer, F.lit("documents"), F.col("start"), length).alias(
                "dataset_id"
            ),
            F.lit("base").alias("stage"),
            "row_count",
            F.struct(
                F.lit(MODEL).alias("base_model"),
                F.lit(64).cast("bigint").alias("d_model"),
                layer.cast("bigint").alias("layer_index"),
                F.lit("none").alias("norm"),
                F.lit("documents").alias("corpus"),
                F.struct(F.col("start"), length.alias("length")).alias("corpus_slice"),
                F.lit(POSITIONS).cast("bigint").alias("positions_per_doc"),
            ).alias("extraction"),
        )

    def catalog(self) -> DataFrame:
        """Manifests of one dataset chain per source, with a few broken rules."""
        sources = self.table("documents").groupBy("source").agg(
            F.count(F.lit(1)).alias("row_count"), F.max("lang").alias("lang")
        )
        chain = F.array(
            *[
                F.struct(F.lit(s).alias("stage"), F.lit(i).alias("no"))
                for i, s in enumerate(("base", "av_sft", "ar_sft", "rl"))
            ]
        )
        rows = sources.withColumn("c", F.explode(chain))
        name = F.concat_ws("_", F.col("c.stage"), "source")
        parent = F.concat_ws("_", F.lit("base"), "source")
        trained = F.col("c.no") > 0
        no_suffix = F.col("lang") == "fr"
        return rows.select(
            name.alias("dataset_id"),
            F.col("c.stage").alias("stage"),
            "row_count",
            F.when(F.col("source") == "src7", "other_kind").otherwise("activation_dataset").alias("kind"),
            F.when(F.col("source") == "src3", 2).otherwise(1).cast("bigint").alias("schema_version"),
            F.when(
                trained & (F.col("source") != "src5"),
                F.struct(
                    F.lit("x").alias("injection_char"),
                    F.lit(9).cast("bigint").alias("injection_token_id"),
                    F.lit(5).cast("bigint").alias("injection_left_neighbor_id"),
                    F.lit(6).cast("bigint").alias("injection_right_neighbor_id"),
                    F.when(~no_suffix, F.array(F.lit(1).cast("bigint"))).alias("critic_suffix_ids"),
                ),
            ).alias("tokens"),
            F.when(
                trained & (F.col("source") != "src9"),
                F.create_map(F.lit("actor"), F.lit("a"), F.lit("critic"), F.lit("c")),
            )
            .otherwise(F.create_map().cast("map<string,string>"))
            .alias("prompt_templates"),
            F.when(trained, F.array(parent))
            .otherwise(F.array(F.concat_ws("_", F.lit("corpus"), "lang")))
            .alias("parent_datasets"),
        )


_LEN10 = "length(text) % 10"
_FIRST = "coalesce(regexp_extract_all(text, '\\S+')[1], '')"
_LAST = "coalesce(regexp_extract_all(text, '\\S+')[-1], '')"

# SQL side; each view names the views it needs by using them.
SQL = {
    "corpus": "SELECT 'documents:train:' || doc_id AS doc_id, doc_id AS doc_idx, text, lang, source FROM documents",
    "tokens": "SELECT doc_id, doc_idx, lang, source, regexp_extract_all(text, '\\S+') AS tokens FROM corpus",
    "positions": f"""
        SELECT *, list_reduce(range(greatest(n - {POSITIONS}, 0), n),
          lambda acc, j: list_append(acc, CASE WHEN list_contains(acc, {sql_hash(f"'{SEED}|' || doc_id || '|' || j")} % (j + 1))
            THEN j ELSE {sql_hash(f"'{SEED}|' || doc_id || '|' || j")} % (j + 1) END), []::BIGINT[]) AS offsets
        FROM (SELECT *, greatest(len(tokens) - 50, 0) AS n FROM tokens)""",
    "base": f"""
        SELECT doc_id, doc_idx, lang, source, n_raw_tokens, {LAYER}::BIGINT AS activation_layer,
          array_to_string(tokens[1:n_raw_tokens], ' ') AS detokenized_text_truncated
        FROM (SELECT *, unnest(offsets) + 51 AS n_raw_tokens FROM positions)""",
    "base_vectors": f"""
        SELECT b.*, e.vec_id, list_transform(e.embedding, lambda x: (x * (50 + e.vec_id % 100))::FLOAT) AS activation_vector
        FROM (SELECT *, {sql_hash("doc_id || '|' || n_raw_tokens")} % (SELECT count(*) FROM embeddings) AS want FROM base) b
        JOIN embeddings e ON e.vec_id = b.want""",
    "explained": """
        SELECT *, 'starts with ' || string_split(detokenized_text_truncated, ' ')[1] || chr(10) || chr(10) || 'ends with '
          || string_split(detokenized_text_truncated, ' ')[-1] AS api_explanation FROM base_vectors""",
    "completions": f"""
        SELECT doc_id AS doc_idx, lang, CASE {_LEN10} WHEN 0 THEN NULL
          WHEN 1 THEN '<analysis>' || chr(10) || '1. cut off'
          WHEN 2 THEN '<analysis>' || chr(10) || 'only one feature' || chr(10) || '</analysis>'
          WHEN 3 THEN '<analysis>' || chr(10) || '1. **Topic:** ' || {_FIRST} || ' text' || chr(10) || '2) ends with ' || {_LAST} || chr(10) || '</analysis>'
          ELSE 'Sure.' || chr(10) || '<analysis>' || chr(10) || '- starts with ' || {_FIRST} || chr(10) || '* has '
            || greatest(len(regexp_extract_all(text, '\\S+')), 1) || ' words' || chr(10) || '(c) length ' || length(text) || '_' || chr(10) || '</analysis>' END AS raw
        FROM documents""",
    "cleaned": """
        SELECT doc_idx, lang, raw, body, CASE WHEN body IS NOT NULL THEN array_to_string(list_filter(list_transform(string_split(body, chr(10)),
          lambda x: regexp_replace(trim(regexp_replace(regexp_replace(x,
            '^\\s*(?:[-*•+–—]|\\d+[.)]|\\(\\d+\\)|[a-zA-Z][.)]|\\([a-zA-Z]\\)|[ivxIVX]+[.)])\\s+', ''),
            '^\\*\\*(.+?)\\*\\*\\s*', '\\1 ')), '^[*_]+|[*_]+$', '', 'g')),
          lambda x: x <> ''), chr(10) || chr(10)) END AS explanation
        FROM (SELECT *, CASE WHEN regexp_matches(raw, '(?s)<analysis>\\s*(.*?)\\s*</analysis>')
          THEN regexp_extract(raw, '(?s)<analysis>\\s*(.*?)\\s*</analysis>', 1) END AS body FROM completions)""",
    "cache_rows": """
        SELECT text, 'A one' || chr(10) || chr(10) || 'A two' AS api_explanation, 0 AS source_no, d.doc_id AS row_no
          FROM documents d JOIN labels l ON d.doc_id = l.doc_id
        UNION ALL
        SELECT text, CASE WHEN toxic = 1 THEN 'B only' ELSE 'B one' || chr(10) || chr(10) || 'B two' END, 1, d.doc_id
          FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1 OR toxic = 1""",
    "cache": """
        SELECT sha256(text) AS text_sha, arg_max(api_explanation, (source_no, row_no)) AS api_explanation
        FROM cache_rows GROUP BY 1""",
    "prior": """
        SELECT b.doc_id, n_raw_tokens, detokenized_text_truncated, 'seen ' || n_raw_tokens AS explanation
        FROM base b JOIN documents d ON b.doc_idx = d.doc_id WHERE NOT contains(d.text, '@')""",
    "pairs": """
        SELECT a.vec_id AS id, a.vec_id // 64 AS batch_id, a.label::BIGINT AS label,
          a.embedding::DOUBLE[] AS pred, b.embedding::DOUBLE[] AS gold
        FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id - 1""",
    "scored": """
        SELECT id, batch_id, label, 2 * (1 - list_cosine_similarity(pred, gold)) AS mse,
          list_cosine_similarity(pred, gold) AS cos,
          sqrt(list_inner_product(pred, pred)) AS pn, sqrt(list_inner_product(gold, gold)) AS gn FROM pairs""",
    "vectors": """
        SELECT vec_id, label::BIGINT AS label,
          list_transform(embedding, lambda x: (x * (50 + vec_id % 100))::FLOAT)::DOUBLE[] AS v FROM embeddings""",
    "norms": "SELECT vec_id, label, sqrt(list_inner_product(v, v)) AS norm FROM vectors",
    "unit": """
        SELECT vec_id, label, unnest(range(1, 65)) AS pos, unnest(list_transform(v, lambda x: x / norm * 8)) AS x
        FROM vectors JOIN norms USING (vec_id, label)""",
    "rollouts": """
        SELECT event_id % 4 AS rollout_id, event_id AS sample_id, user_id AS group_index, -value / 250.0 AS reward,
          CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'view' AND value > 100 THEN 'TRUNCATED' ELSE 'COMPLETED' END AS status,
          CASE event_id % 3 WHEN 0 THEN 'allenai/WildChat-1M:train:' WHEN 1 THEN 'openbmb/Ultra-FineWeb:en:' ELSE 'other:train:' END || event_id AS doc_id,
          '<explanation>' || chr(10) || event_type || ' ' || props ||
            CASE WHEN event_type = 'view' AND value > 100 THEN '' ELSE chr(10) || '</explanation>' END AS response,
          5 + event_id % 146 AS response_length,
          list_transform(range(0, 1 + event_id % 8), lambda i: -(i + 1) / 10.0::DOUBLE) AS train_log_probs,
          list_transform(range(0, 1 + event_id % 8), lambda i: -(i + 1) / 10.0::DOUBLE - i * 0.01::DOUBLE) AS rollout_log_probs,
          event_type, props
        FROM events""",
    "messages": """
        SELECT conv_id, turn, role, string_split(replace(text, 'ou', '<INJECT>'), chr(10)) AS contents FROM conversations""",
    "shards": f"""
        SELECT run, run || '/shard-' || shard AS path, shard, start, row_count, length, layer,
          'base_tiny-model_L' || layer || '_' || substr(sha256('{MODEL}|' || layer || '|documents|{{''start'': ' || start
            || ', ''length'': ' || length || '}}'), 1, 8) AS dataset_id
        FROM (SELECT run, shard, min(doc_id) AS start, count(*) AS row_count,
            count(*) + CASE WHEN run = 'padded' THEN 10 ELSE 0 END AS length,
            {LAYER} + CASE WHEN run = 'mixed' THEN shard % 2 ELSE 0 END AS layer
          FROM (SELECT unnest(['whole', 'lang-' || lang, 'padded', 'mixed']) AS run, doc_id // 100 AS shard, doc_id FROM documents)
          GROUP BY 1, 2)""",
    "catalog": """
        SELECT stage || '_' || source AS dataset_id, stage, row_count, source, lang,
          CASE WHEN source = 'src7' THEN 'other_kind' ELSE 'activation_dataset' END AS kind,
          CASE WHEN source = 'src3' THEN 2 ELSE 1 END AS schema_version,
          stage <> 'base' AS trained, source <> 'src5' AS has_tokens, source <> 'src9' AS has_templates, lang <> 'fr' AS has_suffix,
          CASE WHEN stage = 'base' THEN 'corpus_' || lang ELSE 'base_' || source END AS parent
        FROM (SELECT source, count(*) AS row_count, max(lang) AS lang FROM documents GROUP BY 1),
          (SELECT unnest(['base', 'av_sft', 'ar_sft', 'rl']) AS stage)""",
}


def _uses(sql: str) -> set[str]:
    return {name for name in SQL if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql)}


def with_views(sql: str) -> str:
    """Put the views that ``sql`` reads, directly or not, in front of it."""
    needed: set[str] = set()
    queue = [sql]
    while queue:
        for name in _uses(queue.pop()) - needed:
            needed.add(name)
            queue.append(SQL[name])
    head = ",\n".join(f"{name} AS ({SQL[name].strip()})" for name in SQL if name in needed)
    if not needed:
        return sql
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{sql.lstrip()[len('WITH RECURSIVE'):]}"
    if sql.lstrip().upper().startswith("WITH"):
        return f"WITH {head},\n{sql.lstrip()[len('WITH'):]}"
    return f"WITH {head}\n{sql}"
