"""Words outside the dictionary: each occurrence is moved once, and scores are those of a plain scorer."""

import collections
import math
import zlib

import numpy as np
import pytest

from actlens.llm import bilinear
from actlens.llm.bilinear import NONE, OUTSIDE, Scorer, Shape
from actlens.llm.common import session
from actlens.llm.word_tree import Newton, Sums, Tree


def is_held(id):
    return zlib.crc32(str(id).encode()) % 7 == 2


def some_texts(n, seed=3):
    """Texts in which rare words stand alone, beside each other, first and last; some come in held-out texts only."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"w{int(x)}" for x in (rng.zipf(1.3, rng.integers(0, 40)) % 90)]
        if is_held(i) and i % 3 == 0:
            words.insert(len(words) // 2, "newé")
        rows.append((i, " ".join(words)))
    return [*rows, (n, None), (n + 1, " \n")]


def test_an_occurrence_is_moved_once(spark, monkeypatch):
    monkeypatch.setattr(bilinear, "FLUSH", 200)
    texts = some_texts(120)
    known = [b"", *(f"w{i}".encode() for i in range(1, 9))]
    table = session(spark).createDataFrame(texts, "at long, text string").selectExpr(
        "at", "at % 7 = 2 AS held_out", "coalesce(text, '') AS text"
    )
    shape = Shape(5, 4)
    terms = Sums(shape, shape.start(np.full(5, 0.2), 1), np.zeros(4))
    encoded = bilinear.encoded(table.repartition(3), spark.sparkContext.broadcast(known))
    got = bilinear.stem_rows(encoded, 4, terms).collect()
    assert len(got) == len({r.stem for r in got}) <= 4
    place = {w: i for i, w in enumerate(known)}
    wanted, learnt = collections.defaultdict(list), set()
    for at, text in texts:
        words = bilinear.tokens_of(text or "")
        places = [NONE, NONE, *(place.get(w, OUTSIDE) for w in words), NONE, NONE]
        for i, w in enumerate(words):
            if w not in place:
                wanted[zlib.crc32(w) % 4, w].append((at, i, int(at % 7 != 2), places[i], places[i + 1], places[i + 3], places[i + 4]))
                learnt |= {w} if at % 7 != 2 else set()
    for r in got:
        c = bilinear.unpack_columns(bytes(r.packed))
        rows = collections.defaultdict(list)
        for leaf, *row in zip(*(c[x].tolist() for x in ("leaf", "at", "pos", "learnt", "m2", "m1", "p1", "p2"))):
            rows[leaf].append(tuple(row))
        mine = sorted(w for stem, w in wanted if stem == r.stem)
        seen = [w for w in mine if w in learnt]
        assert r.words == len(seen) and r.n == sum(x[2] for w in mine for x in wanted[r.stem, w])
        assert [rows[i] for i in range(len(seen))] == [wanted[r.stem, w] for w in seen]
        assert sorted(rows[-1]) == sorted(x for w in mine if w not in learnt for x in wanted[r.stem, w])


@pytest.mark.parametrize("dictionary", [0, 25, 500])
def test_scores_are_those_of_a_plain_scorer(spark, monkeypatch, dictionary):
    made = {}

    start = Scorer.__init__

    def kept(self, shape, flat, *more):
        start(self, shape, flat, *more)
        made.update(scorer=self, shape=shape, flat=flat)

    monkeypatch.setattr(Scorer, "__init__", kept)
    texts = some_texts(300)
    table = session(spark).createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in bilinear.score_texts(table, outcomes=8, dictionary=dictionary, width=4).collect()}
    of, shape, flat = made["scorer"], made["shape"], made["flat"]
    rest, d = shape.outcomes - 1, shape.width
    learnt = [bilinear.tokens_of(t or "") for i, t in texts if not is_held(i)]
    counts = collections.Counter(w for t in learnt for w in t)
    words = bilinear.vocabulary(spark.createDataFrame([(bytearray(w), n) for w, n in counts.items()], "word binary, n long"), 8, dictionary)
    place = {w: i for i, w in enumerate(words.words)}
    outside = sorted(w for w in counts if w not in place)
    share = words.shares()
    one, two, out, _ = (a.astype(np.float64) for a in shape.split(flat))
    follows, leads = Newton([out], share), Newton([one[:-1], two[:-1]], share)
    terms = Sums(shape, flat, leads.mean)
    sums, times = {w: np.zeros(3 * d) for w in outside}, collections.Counter()
    for t in learnt:
        codes = terms.encode(*bilinear.contexts(np.array([place.get(w, -1) for w in t]), shape.outcomes))
        for w, terms_ in zip(t, terms.decode(codes)):
            if w not in place:
                sums[w] += terms_
                times[w] += 1
    own = {w: np.concatenate([follows(s[None, h], np.array([times[w]]))[0] for h in (slice(d, 2 * d), slice(2 * d, None))]) for w, s in sums.items()}
    n = np.array([times[w] for w in outside], float)
    # Few words: one stem, so the trunk has nothing to choose.
    leaves = Tree(n, n + 1, np.array([sums[w][:d] for w in outside]).reshape(-1, d), leads)
    unknown = np.zeros(2 * d)
    for i, text in texts:
        tokens = bilinear.tokens_of(text or "")
        places = np.array([NONE, NONE, *(place.get(w, OUTSIDE) for w in tokens)])
        total = 0.0
        for k, w in enumerate(tokens):
            h = of.context(places[k + 1 : k + 2], places[k : k + 1])
            for at, half in ((k - 1, slice(0, d)), (k - 2, slice(d, 2 * d))):
                if at >= 0 and tokens[at] not in place:
                    h = h + own.get(tokens[at], unknown)[half]
            p = of.token(h.astype(np.float32), places[k + 2 : k + 3])[0] / math.log(10)
            if places[k + 2] == OUTSIDE or places[k + 2] >= rest:
                p += math.log10(counts[w] + 1) - math.log10(words.rest_total())
            if w in own:
                p += leaves.gain(np.array([outside.index(w)]), (h - of.centre).astype(np.float32))[0] / math.log(10)
            total += p
        assert math.isclose(got[i].score, total, rel_tol=2e-3, abs_tol=2e-2), (i, text)
        assert got[i].n_known == sum(w in counts for w in tokens)
