"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from actlens.llm import ann, bilinear, chat, content_sort, curriculum, packing, parity_join, rule_ensemble, sharding
from actlens.llm import suffix_windows
from actlens.llm.common import session
from actlens.session import materialize

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row string, size long, keep_id long, kept boolean, score double, node long, digest string, salt int"
)
LONG = " ".join(f"word{i % 977} x{i}" for i in range(40_000))
TEXTS = [
    (1, "Same text here, twice over."), (2, "same TEXT here, twice over."), (3, "É accent Stays"), (4, "é accent stays"),
    (5, None), (6, ""), (7, "   \n\t"), (8, "one"), (9, "one"), (9, "one"), (None, "no id"), (None, None), (10, LONG),
]


@pytest.fixture(scope="module")
def sp(spark):
    return session(spark)


@pytest.fixture(scope="module")
def docs(sp):
    sources = ["a", None, "", "b"]
    rows = [(i, t, "en", sources[k % 4], 1, "r", 5, 7, True, 0.1, 3, "d", 1) for k, (i, t) in enumerate(TEXTS)]
    return sp.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(sp):
    return sp.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_content_sort(docs, none):
    rows = content_sort.content_sort(docs).collect()
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(lower(t), []).append(i)
    assert len(rows) == len(TEXTS)
    for r in rows:
        mine = groups[lower(r.row.text)]
        assert r.group_size == len(mine)
        assert r.keep_id == max((i for i in mine if i is not None), default=None)
        assert r.text_sha256 == hashlib.sha256(lower(r.row.text).encode()).hexdigest()
    assert sum(r.kept for r in rows) == len(groups)
    assert content_sort.content_sort(none).count() == 0
    assert content_sort.distinct_texts(docs).columns == docs.columns


def test_content_sort_splits_a_hot_group(sp):
    rows = [(i, "hot" if i % 3 else f"cold {i}") for i in range(3000)]
    out = content_sort.content_sort(sp.createDataFrame(rows, "doc_id long, text string")).collect()
    hot = [r for r in out if r.row.text == "hot"]
    assert {(r.keep_id, r.group_size) for r in hot} == {(2999, 2000)}
    assert [r.row.doc_id for r in hot if r.kept] == [2999]
    assert all(r.kept and r.group_size == 1 for r in out if r.row.text != "hot")


def test_curriculum(docs, none):
    rows = curriculum.curriculum(docs).collect()
    assert len(rows) == len(TEXTS)
    assert all(r.passes <= 2 and len(r.times) == r.passes and all(0 <= t <= 1 for t in r.times) for r in rows)
    assert all(r.passes == 0 for r in rows if r.size == 0)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    assert set(by) == {"a", None, "", "b"}
    for mine in by.values():
        taken = sum(r.size * r.passes for r in mine)
        assert abs(taken - mine[0].target) <= max(r.size for r in mine)
        assert mine[0].source_size == sum(r.size for r in mine)
    total = sum(mine[0].source_size for mine in by.values())
    assert math.isclose(sum(mine[0].target for mine in by.values()), 1.5 * total)
    assert curriculum.curriculum(none).count() == 0
    assert curriculum.mixed_documents(docs).columns == docs.columns
    times = [r.time for r in curriculum.training_order(curriculum.curriculum(docs)).collect()]
    assert times == sorted(times)


def test_curriculum_follows_its_schedule(sp):
    docs = sp.createDataFrame([(i, "w " * 10, "s") for i in range(2000)], "doc_id long, text string, source string")
    late = (((0.0, 0.0), (1.0, 2.0)),)
    rows = curriculum.curriculum(docs, share=1.0, schedules=late).collect()
    times = np.array([t for r in rows for t in r.times])
    # Density 2t: a quarter of the words before half of the time.
    assert abs((times < 0.5).mean() - 0.25) < 0.01


def test_shards(docs, none, sp):
    rows = sharding.balanced_shards(docs, 4).collect()
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 8 for _, t in TEXTS)
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.balanced_shards(none, 4).count() == 0
    assert {r.shard for r in sharding.balanced_shards(docs, 1).collect()} == {0}
    many = sp.createDataFrame([(i, "same" if i % 3 == 0 else "t" * (i % 90)) for i in range(6000)], "doc_id long, text string")
    rows = sharding.balanced_shards(many, 24).collect()
    total, most = sum(r.size for r in rows), 98
    for s in range(24):
        mine = sum(r.size for r in rows if r.shard == s)
        assert abs(mine - total / 24) <= most + total / 24 / 64 + 1


def test_near_duplicates(docs, none):
    rows = parity_join.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert got[1] == [(2, 1)] and got[2] == [(2, 1)]
    assert got[8] == [(1, 8)] and got[9] == [(1, 8), (1, 8)]
    assert got[5] == [(0, 5)] and got[6] == [(0, 6)] and got[7] == [(0, 7)]
    assert got[3] == [(1, 3)] and got[4] == [(1, 4)]  # other letters keep their case
    assert sorted(n for n, _ in got[None]) == [0, 1]
    assert parity_join.near_duplicates(none).count() == 0
    kept = parity_join.representatives(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 7, 8, 10, None}


def test_suffix_windows(docs, none, sp):
    rows = suffix_windows.kept_texts(suffix_windows.repeated_bytes(docs, window=16, gram=6)).collect()
    assert len(rows) == len(TEXTS)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    # " text here, twice over." differs in case only before its start.
    assert [bytes(r.kept) for r in got[2]] == [b"same TEXT"]
    assert got[5][0].n_bytes == 0 and got[9][0].n_removed == 0
    assert got[10][0].n_bytes == len(LONG)
    assert suffix_windows.repeated_bytes(none).count() == 0


def test_packing(docs, none):
    rows = packing.packed_pieces(docs, size=64).collect()
    assert {r.length for r in rows if r.doc_id == 5} == {1}
    assert len([r for r in rows if r.doc_id == 9]) == 2
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.packed_pieces(none).count() == 0


def test_quality(docs, none, labels):
    rows = rule_ensemble.score_quality(docs, labels).collect()
    assert len(rows) == len(TEXTS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in rows)
    assert rule_ensemble.score_quality(none, labels).count() == 0
    assert {r.score for r in rule_ensemble.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert rule_ensemble.with_quality(docs, labels).select("row.*").columns == docs.columns


def test_language_model(docs, none):
    rows = bilinear.score_texts(docs).collect()
    assert len(rows) == len(TEXTS)
    assert all(np.isfinite([r.base_score, r.score]).all() for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (5, 6, 7)} == {1}
    assert bilinear.score_texts(none).count() == 0
    one = docs.where("doc_id = 10")
    held = bilinear.is_held_out(F.col("doc_id"))
    assert bilinear.score_texts(docs.where(held)).where("n_known > 0").count() == 0
    assert bilinear.score_texts(one, outcomes=50, dictionary=100).count() == 1


def test_neighbours(sp):
    ok = [(i, [float(i % 7 + 1), float(i % 5), 1.0], "x", 0) for i in range(60)]
    odd = [(100, None, "x", 0), (101, [0.0, 0.0, 0.0], "x", 0), (102, [1.0, None, 1.0], "x", 0), (None, [1.0, 1.0, 1.0], "x", 0),
           (103, [float("nan"), 1.0, 1.0], "x", 0), (104, [], "x", 0), (105, [1.0, 2.0], "x", 0), (3, ok[3][1], "x", 0)]
    table = sp.createDataFrame(ok + odd, "vec_id long, embedding array<float>, row string, shard int")
    rows = ann.nearest_neighbours(table, F.col("vec_id") % 20 == 0, shard=16).collect()
    assert {r.query_id for r in rows} == {0, 20, 40}  # 105 stands alone in its width
    x = {i: np.array(v) for i, v, *_ in ok}
    for q in (0, 20, 40):
        cos = {i: float(x[q] @ v / np.linalg.norm(x[q]) / np.linalg.norm(v)) for i, v in x.items() if i != q}
        want = sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:5]
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert np.allclose([r.score for r in mine], [cos[i] for i in want], atol=1e-12)
    assert ann.nearest_neighbours(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    two = table.where("vec_id in (0, 1)")
    assert ann.nearest_neighbours(two, F.col("vec_id") % 20 == 0).count() == 1


def test_chat(sp):
    said = "</s>[INST] ok [/INST]"
    turns = [
        (1, 0, "user", "a <|endoftext|> \\ b"), (1, 1, "assistant", "x <|endoftext|> \\<| é\n"), (1, 2, "assistant", " y "),
        (2, None, None, None), (2, 1, "assistant", None), (None, 0, "assistant", "z"), (3, 0, "assistant", "t"), (3, 0, "assistant", "t"),
        (4, 0, "user", said), (4, 1, "assistant", said), (5, 0, "user", "\\<"), (5, 1, "assistant", "<"), (5, 2, "assistant", "|endoftext|>"),
    ]
    table = sp.createDataFrame([(*t, "c") for t in turns], "conv_id long, turn long, role string, text string, block string")
    for block in (1 << 20, 1):
        rows = {r.conv_id: r for r in chat.chat_digest(chat.chat_examples(table, block=block)).collect()}
        assert len(rows) == 6
        for conv, r in rows.items():
            mine = [(role or "", text or "") for c, _, role, text in turns if c == conv]
            loss = "".join(t for role, t in mine if role == "assistant")
            assert r.n_turns == len(mine)
            assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
            assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_digest(chat.chat_examples(table.limit(0))).count() == 0


def test_pipeline_stages(sp, docs, labels, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    for table in (docs, docs.limit(0)):
        left = table
        for name, stage in corpus_pipeline.STAGES:
            left = materialize(stage(sp, left, folder), name)
            if name != "pack":
                assert left.columns == docs.columns
        assert left.count() == 0 or table is docs
