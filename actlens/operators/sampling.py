"""Token positions, sampled rows and document splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens import fixed_values as fv
from actlens.functions.binding import let
from actlens.functions.hashing import key_hash, unit_hash
from actlens.functions.text import first_words, prefix_text
from actlens.operators.ranking import before_cut, hash_order_key, rank_cuts
from actlens.session import materialize


def candidate_positions(
    df: DataFrame,
    min_pos: int = fv.MIN_POSITION,
    special: Sequence[str] = (),
    tokens: str = "tokens",
) -> DataFrame:
    """Add ``candidates``: 0-based token positions from ``min_pos`` on that are not special.

    Stays inside the row: a document is never exploded to its tokens.
    """
    return df.withColumn("candidates", _candidates(F.col(tokens), min_pos, special))


def _candidates(tokens: Column, min_pos: int, special: Sequence[str]) -> Column:
    if special:
        return F.array_compact(
            F.transform(
                tokens, lambda t, i: F.when((i >= min_pos) & ~t.isin(list(special)), i)
            )
        )
    last = F.size(tokens) - 1
    return F.when(last >= min_pos, F.sequence(F.lit(min_pos), last)).otherwise(
        F.array().cast("array<int>")
    )


def draw_without_replacement(n: Column, k: int, seed: int, key: Column) -> Column:
    """``min(n, k)`` distinct numbers from [0, n), a uniform set keyed by (seed, key).

    Floyd's method: k hashes per row, whatever n is.
    """
    none = F.array().cast("array<bigint>")

    def step(chosen: Column, j: Column) -> Column:
        drawn = key_hash(seed, key, j) % (j + 1)
        return F.concat(
            chosen, F.array(F.when(F.array_contains(chosen, drawn), j).otherwise(drawn))
        )

    def draw(size: Column) -> Column:
        first = F.greatest(size - k, F.lit(0).cast("bigint"))
        steps = F.when(size > 0, F.sequence(first, size - 1)).otherwise(none)
        return F.aggregate(steps, none, step)

    return let(n.cast("bigint"), draw)


def sampled_positions(
    df: DataFrame,
    k: int,
    seed: int,
    min_pos: int = fv.MIN_POSITION,
    special: Sequence[str] = (),
    key: str = "doc_id",
    tokens: str = "tokens",
) -> DataFrame:
    """Add ``positions``: up to ``k`` candidate positions of the row's document.

    Keyed by (seed, document) alone, so slicing or reordering the corpus does
    not change a document's sample. No shuffle.
    """
    if special:

        def draw(spots: Column) -> Column:
            drawn = draw_without_replacement(F.size(spots), k, seed, F.col(key))
            return F.transform(drawn, lambda i: F.get(spots, i.cast("int")).cast("bigint"))

        return df.withColumn("positions", let(_candidates(F.col(tokens), min_pos, special), draw))
    n = F.greatest(F.size(tokens) - min_pos, F.lit(0))
    return df.withColumn("positions", _drawn(n, k, seed, key, min_pos))


def _drawn(n: Column, k: int, seed: int, key: str, min_pos: int) -> Column:
    """Up to ``k`` of the ``n`` positions from ``min_pos`` on."""
    return F.transform(draw_without_replacement(n, k, seed, F.col(key)), lambda i: i + min_pos)


def position_sample(df: DataFrame, k: int, seed: int, **options) -> DataFrame:
    """One row per sampled position, with ``n_raw_tokens`` (1-based) and the text up to it."""
    special = list(options.get("special", ()))
    tokens = options.get("tokens", "tokens")
    drawn = sampled_positions(df, k, seed, **options)
    # What the text is cut from: the joined document, or its tokens where special
    # ones have to be left out of each prefix.
    drawn = drawn.withColumn("_doc", F.col(tokens) if special else F.array_join(tokens, " ")).drop(tokens)
    n = F.col("position") + 1
    # The outer form keeps the planner from evaluating the positions twice, once
    # more in an inferred "array is not empty" filter.
    exploded = drawn.withColumn("position", F.explode_outer("positions")).where(
        F.col("position").isNotNull()
    )
    text = prefix_text(F.col("_doc"), n, special) if special else first_words(F.col("_doc"), n)
    return (
        exploded.withColumn("n_raw_tokens", n)
        .withColumn("detokenized_text_truncated", text)
        .drop("position", "positions", "_doc")
    )


def position_sample_with(
    df: DataFrame,
    k: int,
    seed: int,
    attach: Callable[[DataFrame], DataFrame],
    min_pos: int = fv.MIN_POSITION,
    key: str = "doc_id",
    tokens: str = "tokens",
) -> DataFrame:
    """:func:`position_sample` of ``df`` joined with what ``attach`` adds to its keys, without moving prefixes.

    ``attach`` gets ``key`` and ``n_raw_tokens``, and returns its input's columns and more; it may drop or repeat rows.
    Texts are cut to tokens once and stored. A document then meets its rows by key and number of tokens,
    on which its positions depend: its text crosses the network once, not once for each position.
    Keys may repeat or be NULL. Columns: ``key``, ``n_raw_tokens``, the attached ones, ``detokenized_text_truncated``.
    """
    sized = df.select(key, F.size(tokens).alias("_n"), F.array_join(tokens, " ").alias("_doc"))
    docs = materialize(sized.where(F.col("_n") > min_pos), "sampled-texts")
    drawn = _drawn(F.col("_n") - min_pos, k, seed, key, min_pos)
    keys = docs.select(key, "_n", drawn.alias("_at")).distinct()
    # The outer form, as above; every stored document has a position.
    keys = keys.withColumn("_at", F.explode_outer("_at"))
    rows = attach(keys.select(key, "_n", (F.col("_at") + 1).alias("n_raw_tokens")))
    docs = docs.select(F.col(key).alias("_key"), F.col("_n").alias("_size"), "_doc")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_n") == F.col("_size"))
    text = first_words(F.col("_doc"), F.col("n_raw_tokens"))
    return rows.join(docs, same).withColumn("detokenized_text_truncated", text).drop("_key", "_size", "_doc", "_n")


def sampleable_docs(
    df: DataFrame,
    min_pos: int = fv.MIN_POSITION,
    special: Sequence[str] = (),
    key: str = "doc_id",
    tokens: str = "tokens",
) -> DataFrame:
    """Ids of the documents that have a candidate position, and so get a sample; nothing is drawn."""
    spots = F.size(_candidates(F.col(tokens), min_pos, special)) if special else F.size(tokens) - min_pos
    return df.where(spots > 0).select(key)


def drop_unsampled_docs(docs: DataFrame, positions: str = "positions") -> DataFrame:
    """Documents with at least one sampled position."""
    return docs.where(F.size(positions) > 0)


def extraction_stats(docs: DataFrame, k: int, positions: str = "positions") -> DataFrame:
    """Rows written, documents skipped and documents with fewer than ``k`` samples."""
    drawn = F.size(positions)
    return docs.agg(
        F.count(F.lit(1)).alias("docs"),
        F.coalesce(F.sum(drawn), F.lit(0)).cast("bigint").alias("row_count"),
        F.count_if(drawn == 0).alias("docs_skipped"),
        F.count_if((drawn > 0) & (drawn < k)).alias("docs_short_sampled"),
    )


def check_fractions(fracs: dict[str, float]) -> None:
    """Fractions must be non-negative and sum to one."""
    if any(f < 0 for f in fracs.values()):
        raise ValueError(f"fractions must be non-negative, got {fracs}")
    if abs(sum(fracs.values()) - 1.0) >= 1e-6:
        raise ValueError(f"fractions must sum to 1.0, got {sum(fracs.values())}")


def doc_split(
    df: DataFrame,
    fracs: dict[str, float],
    seed: int,
    key: str = "doc_id",
    out: str = "bucket",
    documents: DataFrame | None = None,
) -> DataFrame:
    """Exact split by document: ``int(n * f)`` documents per bucket, the rest in the last.

    The cut points of the hashed document order come from the distinct ids, which are
    stored once; each row then finds its bucket by comparing its own hash with
    them. Wide rows are neither shuffled nor joined. ``documents`` may give the ids of all documents
    with rows, once each, where they are known before the rows are made.
    """
    check_fractions(fracs)
    names, shares = list(fracs), list(fracs.values())

    def boundary(upto: int):
        return lambda n: sum(
            (F.floor(n.cast("double") * F.lit(f)) for f in shares[: upto + 1]), F.lit(0)
        )

    ids = df.select(key).distinct() if documents is None else documents.select(key)
    ids = materialize(ids, "document-ids")
    cuts = rank_cuts(ids, [key], seed, [boundary(i) for i in range(len(names) - 1)])
    cut = cuts.select(F.struct(*[f"cut_{i}" for i in range(len(names) - 1)])).scalar()
    row_key = hash_order_key(df, [key], seed)
    bucket = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        bucket = F.when(before_cut(row_key, cut[f"cut_{i}"]), F.lit(names[i])).otherwise(bucket)
    return df.withColumn(out, bucket)


def doc_split_hash(
    df: DataFrame, fracs: dict[str, float], seed: int, key: str = "doc_id", out: str = "bucket"
) -> DataFrame:
    """Split by hash thresholds: one narrow pass, sizes exact in expectation only."""
    check_fractions(fracs)
    names, shares = list(fracs), list(fracs.values())
    u = unit_hash(key_hash(seed, "", F.col(key)))
    bucket = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        bucket = F.when(u < sum(shares[: i + 1]), F.lit(names[i])).otherwise(bucket)
    return df.withColumn(out, bucket)


def split_disjointness(df: DataFrame, key: str = "doc_id", bucket: str = "bucket") -> DataFrame:
    """Documents found in more than one bucket: empty for a leak-free split."""
    return (
        df.groupBy(key)
        .agg(F.min(bucket).alias("first_bucket"), F.max(bucket).alias("last_bucket"))
        .where(F.col("first_bucket") != F.col("last_bucket"))
    )


def windowed_text_sample(
    df: DataFrame, n: int, width: int, seed: int, key: str = "doc_id", tokens: str = "tokens"
) -> DataFrame:
    """``n`` random windows of ``width`` tokens, each inside one document.

    A document is drawn with weight equal to its number of window starts
    (smallest ``-ln(u) / weight`` first), then a start is drawn in it. One pass
    and a top-n; no running sum over the corpus.
    """
    starts = (F.size(tokens) - width + 1).cast("bigint")
    drawn = (
        df.where(starts > 0)
        .withColumn("_w", starts)
        .withColumn(
            "_race",
            -F.log((key_hash(seed, "race", F.col(key)) + 1).cast("double") / float(1 << 60))
            / F.col("_w"),
        )
        .withColumn("start", key_hash(seed, "start", F.col(key)) % F.col("_w"))
        .withColumn("window", F.slice(F.col(tokens), (F.col("start") + 1).cast("int"), F.lit(width)))
    )
    return drawn.select(key, "start", "window", "_race").orderBy("_race", key).limit(n).drop("_race")
