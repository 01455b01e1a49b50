"""Relative factors, n-simplex clusters and importance resampling against plain versions."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlens.llm import crc_words, relative_factors, resampling, simplex, simplex_clusters
from actlens.llm.common import session

SCHEMA = "doc_id long, text string, row string, id long, tie long, phrase long, block long, weight double, rank int"
REST = ("r", 1, 2, 3, 4, 0.5, 6)


@pytest.fixture(scope="module")
def sp(spark):
    return session(spark)


def documents(sp, rows):
    return sp.createDataFrame([(i, t, *REST) for i, t in rows], SCHEMA)


# --- relative factors ---------------------------------------------------------------


def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def plain_passages(rows, window=13):
    """(id, words, kept words) per row, in the order of ``rows``."""

    def order(i):
        return (i is None, i or 0)

    least = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, order(i)), order(i))
    out = []
    for i, t in rows:
        w = split(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < order(i):
                gone |= set(range(k, k + window))
        out.append((i, len(w), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def passage_rows(seed, n=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["é", "W1", "a b"]
    shared = [[vocabulary[k] for k in rng.integers(0, 43, size)] for size in (12, 13, 14, 20, 40, 90)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.integers(0, 5)):
            parts += [vocabulary[k] for k in rng.integers(0, 43, rng.integers(0, 25))]
            passage = shared[rng.integers(0, 6)]
            a = rng.integers(0, len(passage))
            parts += passage if rng.random() < 0.5 else passage[a : a + rng.integers(0, 40)]
        rows.append((int(rng.integers(0, n)), (" " if i % 3 else "\t\n ").join(parts)))
    return rows


ODD = [
    (7, None), (8, ""), (9, " \t\n"), (None, "x " * 30), (None, "x " * 30), (None, "y " * 40), (3, "short text"),
    (5, "y " * 40), (5, "y " * 40), (5, "x " * 12), (2, " ".join(f"w{k % 17}" for k in range(60_000))),
    (4, " ".join(f"w{k % 17}" for k in range(100, 30_000))),
]


@pytest.mark.parametrize("seed,held", [(1, 1 << 16), (2, 8), (3, 200)])
def test_passages(sp, seed, held):
    """Whatever a task holds at a time, and with phrases that reach over partitions."""
    rows = passage_rows(seed) + ODD
    found = relative_factors.repeated_passages(documents(sp, rows), held=held).collect()
    got = collections.Counter((r.id, r.n_words, bytes(r.kept)) for r in found)
    assert got == collections.Counter(plain_passages(rows))
    for r in found:
        assert r.kept_sha256 == hashlib.sha256(r.kept).hexdigest()
        assert r.n_removed == r.n_words - len(r.kept.split()) == sum(f.length for f in r.factors)


def test_factors_are_copies(sp):
    """Each factor's words stand in its source, at its place there; the kept words are the literals."""
    rows = list({i: (i, t) for i, t in passage_rows(5, 80)}.values())
    words = {i: split(t) for i, t in rows}
    several = 0
    for r in relative_factors.repeated_passages(documents(sp, rows)).collect():
        end, literals = 0, []
        for f in r.factors:
            assert f.start >= end and f.source < r.id
            assert words[r.id][f.start : f.start + f.length] == words[f.source][f.source_start : f.source_start + f.length]
            literals += words[r.id][end : f.start]
            end = f.start + f.length
        assert b" ".join(literals + words[r.id][end:]) == r.kept
        several += len({f.source for f in r.factors}) > 1
    assert several


def test_copies_of_a_third(sp):
    """One text and one passage in many documents, over several index partitions."""
    text = " ".join(f"c{k}" for k in range(50))
    rows = [(i, text) for i in range(0, 300, 3)] + [(i, f"{i} own {text[:120]} end {i}") for i in range(1, 300, 3)]
    found = relative_factors.repeated_passages(documents(sp, rows).repartition(5), held=32).collect()
    assert {(r.id, r.n_words, bytes(r.kept)) for r in found} == set(plain_passages(rows))


def test_parse_is_greedy():
    # (start, end, source, line): the run that reaches farthest from each word is taken.
    runs = [(0, 13, 1, 5), (0, 20, 2, 0), (10, 30, 3, 1), (15, 28, 4, 0), (40, 60, 1, 2)]
    assert relative_factors.parse(runs) == [(0, 20, 2, 0), (20, 30, 3, 1), (40, 60, 1, 2)]
    assert relative_factors.parse([]) == []


def test_passages_of_an_empty_table(sp):
    assert relative_factors.repeated_passages(documents(sp, ODD).limit(0)).collect() == []


# --- n-simplex clusters ---------------------------------------------------------------


def plain_clusters(rows, k, rounds, width, scale=64):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return collections.Counter()
    table = np.floor(scale * np.array([v for _, v in kept], float)).astype(np.int64)
    digest = [hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest() for i, _ in kept]
    first = sorted(range(len(kept)), key=lambda j: (digest[j], kept[j][1]))[:k]
    centroids = table[first].copy()
    for step in range(rounds + 1):
        distances = ((table[:, None, :] - centroids[None]) ** 2).sum(2)
        cluster = distances.argmin(1)
        if step < rounds:
            for c in set(cluster.tolist()):
                centroids[c] = table[cluster == c].sum(0) // (cluster == c).sum()
    best = distances.min(1)
    return collections.Counter(
        (i, int(c), int(d), int(best[cluster == c].sum()), int(best.sum()),
         hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for (i, _), c, d in zip(kept, cluster, best)
    )


def vectors(sp, rows, kind="float"):
    table = [(i, v, 1, 2, 3) for i, v in rows]
    return sp.createDataFrame(table, f"vec_id long, embedding array<{kind}>, id long, distance int, v int")


def clustered(sp, rows, kind="float", **options):
    return collections.Counter(tuple(r) for r in simplex_clusters.cluster_vectors(vectors(sp, rows, kind), **options).collect())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters(sp, kind):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(5, 8))
    rows = [(i, (centers[i % 5] + rng.normal(size=8) * 0.2).astype(np.float32).tolist()) for i in range(700)]
    rows += [(i + 1000, rows[i % 40][1]) for i in range(300)]  # equal vectors, ties
    rows += [(None, rows[0][1]), (3, rows[9][1]), (3, rows[9][1]), (2000, None), (2001, []), (2002, [1.0] * 7),
             (2003, [1.0] * 7 + [None]), (2004, [math.nan] * 8), (2005, [math.inf] * 8), (2006, [0.0] * 8), (2007, [-1.5] * 8)]
    want = plain_clusters(rows, 16, 3, 8)
    assert clustered(sp, rows, kind, width=8) == want


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_few_vectors(sp, rounds):
    rows = [(i, [float(i % 3), 0.5, -0.25]) for i in range(9)]
    assert clustered(sp, rows, width=3, rounds=rounds) == plain_clusters(rows, 16, rounds, 3)
    assert clustered(sp, rows[:1], width=3, rounds=rounds) == plain_clusters(rows[:1], 16, rounds, 3)


def test_clusters_of_an_empty_table(sp):
    assert not clustered(sp, [(1, None)], width=3)


def test_vectors_too_large(sp):
    with pytest.raises(Exception, match="below"):
        clustered(sp, [(1, [1e30, 0.0])], width=2)


def test_simplex_bounds():
    """Bounds hold, reject most centroids of clustered vectors, and flat pivots are left out."""
    rng = np.random.default_rng(2)
    centers = rng.integers(-2000, 2000, (12, 64))
    table = centers[rng.integers(0, 12, 900)] + rng.integers(-40, 40, (900, 64))
    pivots = np.vstack([centers, centers[:3], (centers[0] + centers[1]) // 2])
    base = simplex.Simplex(pivots)
    assert 12 <= len(base.pivots) <= 13
    others = centers + rng.integers(-30, 30, centers.shape)
    a, b = base.apexes(base.distances(table)), base.apexes(base.distances(others))
    true = np.sqrt(((table[:, None] - others[None]) ** 2).sum(2))
    flat = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(2)
    assert (np.sqrt(flat + (a[:, -1:] - b[:, -1]) ** 2) <= true * (1 + 1e-6) + 1e-3).all()
    assert (np.sqrt(flat + (a[:, -1:] + b[:, -1]) ** 2) >= true * (1 - 1e-6) - 1e-3).all()
    cluster, distance, compared = simplex.nearest(table, a, others, b)
    assert (cluster == true.argmin(1)).all() and (distance == (true**2).round().min(1)).all()
    assert compared < 0.2 * true.size


# --- importance resampling ------------------------------------------------------------


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_draw(rows, target):
    found = [(i, *features(t)) for i, t in rows]
    s = collections.Counter(b for _, _, f in found for b in f)
    t = collections.Counter(b for x in target for b in features(x)[1])
    size, wanted = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * size / ((s[b] + 1) * wanted))) for b in range(10_000)]
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + noise, None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for place, r in enumerate(able[: 5 * len(able) // 100]):
        r[5] = place + 1
    return collections.Counter(map(tuple, out))


def drawn(sp, rows, target):
    texts = sp.createDataFrame([(1, t) for t in target], "item_id int, text string")
    found = resampling.resample(documents(sp, rows), texts).collect()
    return collections.Counter((r.row.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in found)


def draw_rows():
    rng = np.random.default_rng(8)
    words = ["the", "The", "of", "Straße", "naïve", "x1", "ÉTÉ", "日本", "a" * 70, "b" * 200, "2024"]
    marks = [" ", "  ", ", ", "\n", "-", "\x00", ". ", "_", "\x7f", " "]
    rows = []
    for i in range(120):
        size = int(rng.integers(0, 60))
        rows.append((i, "".join(words[rng.integers(0, 11)] + marks[rng.integers(0, 10)] for _ in range(size))))
    return rows + [(200, None), (201, ""), (202, "--"), (None, rows[5][1]), (None, None), (7, rows[7][1]), (7, rows[7][1]),
                   (203, "Long text " * 30_000)]


def test_draw(sp):
    target = ["the naïve x1 of 2024", "Straße, the STRASSE", None, ""]
    assert drawn(sp, draw_rows(), target) == plain_draw(draw_rows(), target)


def test_draw_without_target_or_rows(sp):
    assert drawn(sp, draw_rows(), []) == plain_draw(draw_rows(), [])
    assert not drawn(sp, [], ["a b c"])


def test_drawn_documents(sp):
    docs = documents(sp, draw_rows())
    target = sp.createDataFrame([("the of",)], "text string")
    ids = [r.doc_id for r in resampling.drawn_documents(docs, target, min_words=5).collect()]
    ranked = resampling.resample(docs, target, min_words=5).where("rank IS NOT NULL").orderBy("rank").collect()
    assert ids == [r.row.doc_id for r in ranked] and ids


@pytest.mark.parametrize("size", [0, 1, 40, 1 << 16])
def test_dictionary_size_changes_nothing(size, monkeypatch):
    """Words inside and outside the automaton, texts in parts, runs over part borders."""
    monkeypatch.setattr(crc_words, "CHUNK", 97)
    payloads = crc_words.Payloads(size)
    payloads.once, texts = set(), [(t or "").encode() for _, t in draw_rows()[:-1]]
    texts.append(b"Q w. " * 3000)
    for _ in range(3):
        counts, runs = crc_words.run_buckets(texts, payloads, 10_000)
        for i, t in enumerate(texts):
            n, want = features(t.decode())
            assert counts[i] == n
            assert sorted(want) == sorted(np.concatenate([b[o == i] for o, b in runs]).tolist())
    assert len(payloads.words) <= size


def test_automaton_is_learned():
    payloads = crc_words.Payloads()
    text = " ".join(f"word{k}" for k in range(3000)).encode()
    for _ in range(3):
        crc_words.run_buckets([text], payloads, 10)
    assert len(payloads.words) == 3000 and payloads.automaton is not None
    a, b = b"left", b"right side"
    parts = crc_words.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))
    assert int(parts[0] ^ zlib.crc32(b)) == zlib.crc32(a + b)


def test_counts_by_bucket(sp):
    docs = documents(sp, draw_rows())
    got = {r.bucket: r.n for r in resampling.bucket_counts(docs.repartition(4)).collect()}
    assert got == collections.Counter(b for _, t in draw_rows() for b in features(t)[1])
    assert resampling.bucket_counts(docs.where(F.lit(False))).collect() == []
