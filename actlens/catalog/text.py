"""Text functions, prompts and text checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from actlens import fixed_values as fv
from actlens.catalog.registry import query
from actlens.functions import prompts, text
from actlens.functions.hashing import text_hash
from actlens.operators import filters

_TAG = r"(?s)<explanation>(.*?)</explanation>"
_EXPL = f"CASE WHEN regexp_matches(response, '{_TAG}') THEN regexp_replace(regexp_extract(response, '{_TAG}', 1), '^\\s+|\\s+$', '', 'g') END"


def _sql_text(value: str) -> str:
    quoted = value.replace("'", "''")
    return "'" + "' || chr(10) || '".join(quoted.split("\n")) + "'"


@query("text_hash", "SELECT doc_id, sha256(text) AS text_sha FROM documents")
def text_hash_query(v):
    return v.table("documents").select("doc_id", text_hash(F.col("text")).alias("text_sha"))


@query(
    "fill_template",
    "SELECT doc_id, sha256('{' || 'Lang ' || lang || ': <begin_text>' || text || '<end_text>}') AS digest FROM documents",
)
def fill_template(v):
    filled = text.fill_template(
        "{{Lang {lang}: <begin_text>{text}<end_text>}}", text=F.col("text"), lang=F.col("lang")
    )
    return v.table("documents").select("doc_id", F.sha2(filled, 256).alias("digest"))


@query(
    "unwrap_template",
    "SELECT doc_id, sha256(text) AS digest, true AS same FROM documents",
)
def unwrap_template(v):
    """Filling and undoing the template gives every text back."""
    filled = text.fill_template(fv.CRITIC_TEMPLATE, explanation=F.col("text"))
    back = v.table("documents").withColumn("_back", text.unwrap_template(filled, fv.CRITIC_TEMPLATE))
    return back.select(
        "doc_id", F.sha2("_back", 256).alias("digest"), (F.col("_back") == F.col("text")).alias("same")
    )


@query("extract_tagged", "SELECT doc_idx, body FROM cleaned")
def extract_tagged(v):
    return v.completions().select("doc_idx", text.extract_tagged(F.col("raw")).alias("body"))


@query("clean_features", "SELECT doc_idx, explanation FROM cleaned")
def clean_features(v):
    body = text.extract_tagged(F.col("raw"))
    return v.completions().select("doc_idx", text.clean_features(body).alias("explanation"))


@query(
    "clean_features_documents",
    r"""SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)),
          lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(x,
            '^\s*(?:[-*•+–—]|\d+[.)]|\(\d+\)|[a-zA-Z][.)]|\([a-zA-Z]\)|[ivxIVX]+[.)])\s+', ''),
            '^\*\*(.+?)\*\*\s*', '\1 '), '^\s+|\s+$', '', 'g'), '^[*_]+|[*_]+$', '', 'g')),
          lambda x: x <> ''), chr(10) || chr(10))) AS digest FROM documents""",
)
def clean_features_documents(v):
    """The clean-up on whole documents: lists, headings and plain lines."""
    return v.table("documents").select(
        "doc_id", F.sha2(text.clean_features(F.col("text")), 256).alias("digest")
    )


@query(
    "wrap_explanation",
    "SELECT doc_idx, '<explanation>' || chr(10) || explanation || chr(10) || '</explanation>' AS response FROM cleaned",
)
def wrap_explanation(v):
    cleaned = text.clean_features(text.extract_tagged(F.col("raw")))
    return v.completions().select("doc_idx", text.wrap_explanation(cleaned).alias("response"))


@query("extract_explanation", f"SELECT sample_id, {_EXPL} AS explanation FROM rollouts")
def extract_explanation(v):
    return v.rollouts().select(
        "sample_id", text.extract_explanation(F.col("response")).alias("explanation")
    )


@query(
    "explanation_body",
    f"""SELECT sample_id, CASE WHEN contains(response, '</explanation>') THEN {_EXPL}
          ELSE regexp_replace(response, '^\\s+|\\s+$', '', 'g') END AS body FROM rollouts""",
)
def explanation_body(v):
    return v.rollouts().select("sample_id", text.explanation_body(F.col("response")).alias("body"))


@query(
    "source_label",
    """SELECT sample_id, CASE WHEN contains(doc_id, 'WildChat') THEN 'WildChat'
         WHEN contains(doc_id, 'Ultra-FineWeb') THEN 'UFW' ELSE 'other' END AS label FROM rollouts""",
)
def source_label(v):
    return v.rollouts().select("sample_id", text.source_label(F.col("doc_id")).alias("label"))


@query(
    "clip_note",
    """SELECT doc_id, CASE WHEN length(text) > 1800 THEN substr(text, 1, 1800) || chr(10) || chr(10)
         || '[... TRUNCATED: ' || (length(text) - 1800) || ' more chars ...]' ELSE text END AS shown FROM documents""",
)
def clip_note(v):
    """Display form of every document; the cut is the feature."""
    return v.table("documents").select("doc_id", text.clip_note(F.col("text"), 1800).alias("shown"))


# --- prompts --------------------------------------------------------------------------


@query(
    "user_prompt",
    f"""SELECT doc_id, 1::BIGINT AS messages, 'user' AS role,
          {_sql_text(fv.ACTOR_TEMPLATE.replace("{injection_char}", fv.INJECT_PLACEHOLDER))} AS content FROM documents""",
)
def user_prompt(v):
    rows = v.table("documents").select("doc_id", prompts.user_prompt().alias("p"))
    return rows.select(
        "doc_id",
        F.size("p").cast("bigint").alias("messages"),
        F.col("p")[0]["role"].alias("role"),
        F.col("p")[0]["content"].alias("content"),
    )


@query(
    "swap_placeholder",
    "SELECT conv_id, turn, replace(array_to_string(contents, '|'), '<INJECT>', '㈎') AS content FROM messages",
)
def swap_placeholder(v):
    swapped = prompts.swap_placeholder(F.col("prompt"), "㈎")
    joined = F.array_join(F.transform(swapped, lambda m: m["content"]), "|")
    return v.messages().select("conv_id", "turn", joined.alias("content"))


@query(
    "placeholder_check",
    "SELECT conv_id, turn FROM messages WHERE NOT contains(array_to_string(contents, '|'), '<INJECT>')",
)
def placeholder_check(v):
    return filters.placeholder_check(v.messages()).select("conv_id", "turn")


@query(
    "append_turn",
    """SELECT conv_id, turn, len(contents) + 1 AS messages, role AS first_role, 'assistant' AS last_role,
         'turn ' || turn AS last_content FROM messages""",
)
def append_turn(v):
    told = prompts.append_turn(
        F.col("prompt"), "assistant", F.concat(F.lit("turn "), F.col("turn").cast("string"))
    )
    rows = v.messages().select("conv_id", "turn", told.alias("p"))
    return rows.select(
        "conv_id",
        "turn",
        F.size("p").cast("bigint").alias("messages"),
        F.col("p")[0]["role"].alias("first_role"),
        F.element_at("p", -1)["role"].alias("last_role"),
        F.element_at("p", -1)["content"].alias("last_content"),
    )


@query(
    "loss_mask",
    """SELECT conv_id, turn, repeat('0', len(regexp_extract_all(text, '\\S+'))::INT) || repeat('1', (turn + 1)::INT) AS mask
       FROM conversations""",
)
def loss_mask(v):
    """Every token of a turn masked, turn + 1 response tokens after it."""
    mask = prompts.loss_mask(
        F.size(text.tokenize(F.col("text"))), (F.col("turn") + 1).cast("int")
    )
    return v.table("conversations").select(
        "conv_id", "turn", F.array_join(F.transform(mask, lambda m: m.cast("string")), "").alias("mask")
    )


@query(
    "marker_sites",
    """SELECT doc_id, string_agg(i, ',' ORDER BY i) AS sites, count(*) AS n_sites FROM (
         SELECT doc_id, i, id, lag(id) OVER w AS l, lead(id) OVER w AS r FROM (
           SELECT doc_id, unnest(list_transform(tokens, lambda t: length(t))) AS id,
             unnest(range(len(tokens))) AS i FROM tokens) WINDOW w AS (PARTITION BY doc_id ORDER BY i))
       WHERE id = 9 AND l = 5 AND r = 6 GROUP BY 1""",
)
def marker_sites(v):
    """Word lengths as token ids: a 9 between a 5 and a 6."""
    ids = F.transform("tokens", lambda t: F.length(t))
    rows = v.tokens().select("doc_id", ids.alias("ids"))
    sites = rows.select("doc_id", prompts.marker_sites(F.col("ids"), 9, 5, 6).alias("s"))
    return sites.where(F.size("s") > 0).select(
        "doc_id",
        F.array_join(F.transform("s", lambda i: i.cast("string")), ",").alias("sites"),
        F.size("s").cast("bigint").alias("n_sites"),
    )


@query(
    "suffix_check",
    """SELECT doc_idx, coalesce(regexp_extract_all('Summary of the following text: <text>' || explanation || '</text> <summary>', '\\S+')[-1]
         = '<summary>', false) AS good,
         coalesce(regexp_extract_all(explanation, '\\S+')[-2:] = ['ends', 'with'], false) AS bad FROM cleaned WHERE explanation IS NOT NULL""",
)
def suffix_check(v):
    cleaned = text.clean_features(text.extract_tagged(F.col("raw")))
    rows = v.completions().select("doc_idx", cleaned.alias("e")).where(F.col("e").isNotNull())
    prompt = text.fill_template(fv.CRITIC_TEMPLATE, explanation=F.col("e"))
    return rows.select(
        "doc_idx",
        prompts.suffix_check(text.tokenize(prompt), ["<summary>"]).alias("good"),
        prompts.suffix_check(text.tokenize(F.col("e")), ["ends", "with"]).alias("bad"),
    )


@query(
    "last_real_token",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN n + 3 ELSE n - 1 END AS last_index
       FROM (SELECT *, len(regexp_extract_all(text, '\\S+')) AS n FROM conversations)""",
)
def last_real_token(v):
    """Masks padded by four on the left for users and on the right for others."""
    ones = F.array_repeat(F.lit(1), F.size(text.tokenize(F.col("text"))))
    pad = F.array_repeat(F.lit(0), 4)
    mask = F.when(F.col("role") == "user", F.concat(pad, ones)).otherwise(F.concat(ones, pad))
    return v.table("conversations").select(
        "conv_id", "turn", prompts.last_real_token(mask).cast("bigint").alias("last_index")
    )


# --- checks on text ---------------------------------------------------------------------


_LEAKS = [*fv.LEAK_PATTERNS, "@", "icense", "secret"]


@query(
    "leak_scan",
    "SELECT doc_id, pattern FROM documents, (SELECT unnest(["
    + ", ".join(f"'{p}'" for p in _LEAKS)
    + "]) AS pattern) WHERE contains(lower(text), pattern)",
)
def leak_scan(v):
    docs = v.table("documents").select("doc_id", "text")
    return filters.leak_scan(docs, "text", _LEAKS)


@query(
    "cjk_flag",
    """SELECT role, count(*) AS turns, count(*) FILTER (regexp_matches(shown, '[\\x{3200}-\\x{33FF}\\x{4E00}-\\x{9FFF}]')) AS cjk_turns
       FROM (SELECT role, replace(array_to_string(contents, '|'), '<INJECT>', '㈎') AS shown FROM messages) GROUP BY 1""",
)
def cjk_flag(v):
    """Turns whose text shows the marker character after the swap."""
    swapped = prompts.swap_placeholder(F.col("prompt"), "㈎")
    shown = F.array_join(F.transform(swapped, lambda m: m["content"]), "|")
    rows = v.messages().select(F.col("prompt")[0]["role"].alias("role"), shown.alias("shown"))
    return filters.cjk_flag(rows, "shown").groupBy("role").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if("cjk").alias("cjk_turns")
    )
