"""Sampling and splits."""

import hashlib

import pytest
from pyspark.sql import functions as F

from actlens.functions.text import tokenize
from actlens.operators import aggregates, sampling
from actlens.sources.corpus import corpus_slice

LENGTHS = [0, 49, 50, 51, 55, 60, 61, 200, 1000] + [70 + i for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"c:train:{i}", " ".join(f"w{j}" for j in range(n))) for i, n in enumerate(LENGTHS)]
    df = spark.createDataFrame(rows, "doc_idx long, doc_id string, text string")
    return df.withColumn("tokens", tokenize(F.col("text"))).drop("text")


def drawn(n, k, seed, key):
    """Floyd's method in plain Python."""
    chosen = []
    for j in range(max(n - k, 0), n):
        digest = hashlib.sha256(f"{seed}|{key}|{j}".encode()).hexdigest()
        t = int(digest[:15], 16) % (j + 1)
        chosen.append(j if t in chosen else t)
    return chosen


def test_positions(docs):
    rows = sampling.sampled_positions(docs, 10, 42).collect()
    for r in rows:
        n = max(LENGTHS[r.doc_idx] - 50, 0)
        assert r.positions == [p + 50 for p in drawn(n, 10, 42, r.doc_id)]
        assert len(set(r.positions)) == len(r.positions) == min(n, 10)


def test_positions_do_not_depend_on_slices(docs):
    whole = {(r.doc_id, r.n_raw_tokens) for r in sampling.position_sample(docs, 5, 1).collect()}
    parts = set()
    for lo, hi in ((0, 4), (4, 30), (30, 999)):
        part = docs.where(F.col("doc_idx").between(lo, hi - 1)).repartition(3)
        parts |= {(r.doc_id, r.n_raw_tokens) for r in sampling.position_sample(part, 5, 1).collect()}
    assert parts == whole


def test_draw_is_uniform(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    picks = df.select(F.explode(sampling.draw_without_replacement(F.lit(8), 3, 0, F.col("k"))).alias("p"))
    counts = {r.p: r["count"] for r in picks.groupBy("p").count().collect()}
    assert sorted(counts) == list(range(8))
    assert all(abs(c - 1500) < 150 for c in counts.values())


def test_special_tokens(spark):
    words = ["x" if i % 2 else "<s>" for i in range(80)]
    df = spark.createDataFrame([("d", words)], "doc_id string, tokens array<string>")
    spots = sampling.candidate_positions(df, special=["<s>"]).first().candidates
    assert spots == [i for i in range(50, 80) if i % 2]
    rows = sampling.position_sample(df, 100, 1, special=["<s>"]).collect()
    assert sorted(r.n_raw_tokens - 1 for r in rows) == spots
    for r in rows:
        assert r.detokenized_text_truncated == " ".join(t for t in words[: r.n_raw_tokens] if t == "x")


def test_text_and_stats(docs):
    rows = sampling.position_sample(docs, 10, 42).collect()
    for r in rows:
        assert r.detokenized_text_truncated == " ".join(f"w{j}" for j in range(r.n_raw_tokens))
    stats = sampling.extraction_stats(sampling.sampled_positions(docs, 10, 42), 10).first()
    sizes = [min(max(n - 50, 0), 10) for n in LENGTHS]
    assert stats.row_count == sum(sizes) == len(rows)
    assert stats.docs_skipped == sizes.count(0)
    assert stats.docs_short_sampled == sum(0 < s < 10 for s in sizes)


@pytest.mark.parametrize("fracs", [(0.3, 0.3, 0.4), (0.25, 0.25, 0.5), (0.0, 1.0, 0.0), (1.0, 0.0, 0.0)])
def test_split(spark, fracs):
    # One document holds a third of the rows.
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("d0")).otherwise(F.concat(F.lit("d"), F.col("id") % 97)).alias("doc_id"),
        "id",
    )
    names = dict(zip(("av_sft", "ar_sft", "rl"), fracs))
    split = sampling.doc_split(rows, names, 42)
    counts = {r.bucket: r.docs for r in aggregates.bucket_counts(split).collect()}
    n = rows.select("doc_id").distinct().count()
    want = {"av_sft": int(n * fracs[0]), "ar_sft": int(n * fracs[1])}
    want["rl"] = n - sum(want.values())
    assert counts == {k: v for k, v in want.items() if v}
    assert sampling.split_disjointness(split).isEmpty()
    again = sampling.doc_split(rows.repartition(9, "id"), names, 42)
    assert again.exceptAll(split).isEmpty() and split.exceptAll(again).isEmpty()


def test_hash_split_agrees_with_its_thresholds(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("doc_id"))
    counts = sampling.doc_split_hash(rows, {"a": 0.2, "b": 0.8}, 1).groupBy("bucket").count().collect()
    share = {r.bucket: r["count"] / 5000 for r in counts}
    assert abs(share["a"] - 0.2) < 0.02


@pytest.mark.parametrize("fracs", [{"a": 0.5, "b": 0.4}, {"a": -0.1, "b": 1.1}])
def test_bad_fractions(spark, fracs):
    with pytest.raises(ValueError):
        sampling.doc_split(spark.range(1).withColumnRenamed("id", "doc_id"), fracs, 1)


def test_corpus_slice(docs):
    assert {r.doc_idx for r in corpus_slice(docs, 3, 4).collect()} == {3, 4, 5, 6}
    with pytest.raises(IndexError):
        corpus_slice(docs, 60, 100)


def test_windows_stay_inside_documents(docs):
    rows = sampling.windowed_text_sample(docs, 20, 30, 5).collect()
    assert len(rows) == 20
    for r in rows:
        assert r.window == [f"w{j}" for j in range(r.start, r.start + 30)]
        assert r.start + 30 <= LENGTHS[int(r.doc_id.split(":")[-1])]


@pytest.mark.parametrize("special", [(), ("<s>", "w3")])
def test_sampleable_docs(spark, special):
    """The documents that get a sample are known without drawing one."""
    rows = [(f"d{i}", (["<s>"] * (i % 3) + [f"w{k}" for k in range(i)])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id string, tokens array<string>")
    drawn = sampling.drop_unsampled_docs(sampling.sampled_positions(docs, 2, 7, 4, special))
    found = sampling.sampleable_docs(docs, 4, special)
    assert {r.doc_id for r in found.collect()} == {r.doc_id for r in drawn.collect()} != set()
