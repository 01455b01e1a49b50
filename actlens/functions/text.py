"""Text functions: tokens, templates, tags and feature clean-up."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from actlens import fixed_values as fv

# Whitespace as Python sees it, in Java regex terms.
_WS = r"[\s\x1c-\x1f]"


def tokenize(text: Column, max_length: int | None = None) -> Column:
    """Whitespace tokens of the whole text; ``max_length`` truncates on the right."""
    tokens = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    return tokens if max_length is None else F.slice(tokens, 1, max_length)


def prefix_text(tokens: Column, n: Column, special: list[str] | None = None) -> Column:
    """Text of the first ``n`` tokens, special tokens left out."""
    head = F.slice(tokens, F.lit(1), n.cast("int"))
    if special:
        head = F.filter(head, lambda t: ~t.isin(special))
    return F.array_join(head, " ")


def first_words(joined: Column, n: Column) -> Column:
    """First ``n`` tokens of a text whose tokens are joined by single spaces.

    The same text as :func:`prefix_text`, found by scanning to the n-th space: a
    document is joined once, not once for each of its sampled positions.
    """
    return F.call_function("substring_index", joined, F.lit(" "), n.cast("int"))


def doc_key(corpus: str, split: str, idx: Column) -> Column:
    """Document id ``corpus:split:idx``."""
    return F.concat_ws(":", F.lit(corpus), F.lit(split), idx.cast("string"))


def strip(text: Column) -> Column:
    """Trim Unicode whitespace on both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(text, rf"(?U)^{_WS}+|{_WS}+\z", "")


def template_parts(template: str, fields: set[str]) -> list[tuple[str, str | None]]:
    """Split a ``{field}`` template into (literal, field) pairs, checking its fields."""
    parts: list[tuple[str, str | None]] = []
    pending = ""  # an escaped brace ends a literal early
    for literal, field, spec, conversion in string.Formatter().parse(template):
        if field is not None and (field not in fields or spec or conversion):
            raise ValueError(f"template has an unknown placeholder {{{field}}}")
        pending += literal
        if field is not None:
            parts.append((pending, field))
            pending = ""
    if pending:
        parts.append((pending, None))
    missing = fields - {f for _, f in parts if f}
    if missing:
        raise ValueError(f"template lacks placeholder(s) {sorted(missing)}")
    return parts


def fill_template(template: str, **cols: Column) -> Column:
    """Substitute columns for the placeholders of ``template``."""
    pieces: list[Column] = []
    for literal, field in template_parts(template, set(cols)):
        if literal:
            pieces.append(F.lit(literal))
        if field:
            pieces.append(cols[field])
    return F.concat(*pieces)


def unwrap_template(prompt: Column, template: str, field: str = "explanation") -> Column:
    """Inverse of :func:`fill_template` for one placeholder; a mismatch is an error."""
    (prefix, first), *rest = template_parts(template, {field})
    if first != field or len(rest) > 1 or (rest and rest[0][1]):
        raise ValueError("template must hold its placeholder exactly once")
    suffix = rest[0][0] if rest else ""
    fits = (
        prompt.startswith(prefix)
        & prompt.endswith(suffix)
        & (F.length(prompt) >= len(prefix) + len(suffix))
    )
    body = F.substring(
        prompt, F.lit(len(prefix) + 1), F.length(prompt) - F.lit(len(prefix) + len(suffix))
    )
    return F.when(fits, body).when(
        prompt.isNotNull(),
        F.raise_error(F.concat(F.lit("prompt does not fit the template: "), prompt)).cast("string"),
    )


def extract_tagged(raw: Column, pattern: str = fv.RESPONSE_PATTERN) -> Column:
    """First match of a one-group pattern, dot matching newlines; NULL on miss."""
    return F.get(F.regexp_extract_all(raw, F.lit(f"(?s){pattern}"), F.lit(1)), F.lit(0))


def clean_features(body: Column) -> Column:
    """Plain paragraphs from a list: markers, emphasis and empty lines removed."""

    def clean(line: Column) -> Column:
        line = F.regexp_replace(line, "(?U)" + fv.LIST_MARKER, "")
        line = F.regexp_replace(line, "(?U)(?s)" + fv.LEADING_BOLD, "$1 ")
        return F.regexp_replace(strip(line), r"^[*_]+|[*_]+\z", "")

    lines = F.transform(F.split(body, "\n"), clean)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n\n")


def feature_count(text: Column) -> Column:
    """Number of blank-line separated paragraphs."""
    return F.size(F.split(text, "\n\n"))


def wrap_explanation(text: Column) -> Column:
    """Put ``text`` between the explanation tags."""
    return F.concat(F.lit(fv.EXPLANATION_OPEN + "\n"), text, F.lit("\n" + fv.EXPLANATION_CLOSE))


def _tag_span(response: Column, close_from: Column) -> tuple[Column, Column]:
    start = F.locate(fv.EXPLANATION_OPEN, response) + F.lit(len(fv.EXPLANATION_OPEN))
    return start, F.call_function("locate", F.lit(fv.EXPLANATION_CLOSE), response, close_from)


def extract_explanation(response: Column) -> Column:
    """First tagged payload, trimmed; NULL unless an open tag is followed by a close tag."""
    has_open = F.locate(fv.EXPLANATION_OPEN, response) > 0
    start, end = _tag_span(response, F.locate(fv.EXPLANATION_OPEN, response) + F.lit(len(fv.EXPLANATION_OPEN)))
    return F.when(has_open & (end > 0), strip(F.substring(response, start, end - start)))


def explanation_body(response: Column) -> Column:
    """Text between the first open and first close tag, else the whole text; trimmed."""
    start, end = _tag_span(response, F.lit(1))
    tagged = (F.locate(fv.EXPLANATION_OPEN, response) > 0) & (end >= start)
    return strip(F.when(tagged, F.substring(response, start, end - start)).otherwise(response))


def source_label(doc_id: Column) -> Column:
    """Corpus family a document id belongs to."""
    label = F.lit(fv.OTHER_SOURCE)
    for needle, name in reversed(fv.SOURCE_LABELS):
        label = F.when(doc_id.contains(needle), F.lit(name)).otherwise(label)
    return label


def clip_note(text: Column, m: int) -> Column:
    """Text for display: cut after ``m`` characters with a note of what is left out."""
    note = F.concat(
        F.lit("\n\n[... TRUNCATED: "),
        (F.length(text) - F.lit(m)).cast("string"),
        F.lit(" more chars ...]"),
    )
    return F.when(F.length(text) > m, F.concat(F.substring(text, 1, m), note)).otherwise(text)


def has_cjk(text: Column) -> Column:
    """True where text holds enclosed CJK letters or ideographs."""
    return text.rlike(r"[\u3200-\u33FF\u4E00-\u9FFF]")


def matched_patterns(text: Column, patterns: list[str]) -> Column:
    """Array of the patterns that occur in ``text``, letter case ignored."""
    low = F.lower(text)
    hits = [F.when(low.contains(p.lower()), F.lit(p)) for p in patterns]
    return F.array_compact(F.array(*hits))
