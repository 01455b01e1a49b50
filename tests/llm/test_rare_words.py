"""Words below the neural outcomes are predicted and conditioned on as themselves."""

import zlib

import numpy as np
import pytest

from actlens.llm import bilinear
from actlens.llm.common import session
from actlens.llm.word_tree import Newton, Sums, Tree, occurrences, sums_by_place


def test_tree_is_normalised():
    rng = np.random.default_rng(4)
    n = rng.integers(1, 50, 300).astype(float)
    vectors = rng.normal(size=(40, 5))
    tree = Tree(n, n + 1, rng.normal(size=(300, 5)) * n[:, None], Newton([vectors], np.full(40, 1 / 40)))
    for context in rng.normal(size=(5, 5)).astype(np.float32):
        gain = tree.gain(np.arange(300), np.tile(context, (300, 1)))
        assert np.isclose(((n + 1) / (n + 1).sum() * np.exp(gain)).sum(), 1, atol=1e-4)
        assert gain.std() > 0.1


def is_held(id):
    return zlib.crc32(str(id).encode()) % 7 == 2


@pytest.mark.parametrize("dictionary", [30, 500])  # the rare words are outside the dictionary, and in it
def test_rare_words_know_what_follows(spark, dictionary):
    sp = session(spark)
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(400):
        # Half of the rare words stand before "left", half before "right"; all come equally often.
        order = rng.permutation(40)
        texts.append(" ".join(f"rare{i} {'left' if i % 2 else 'right'} {'up' if rng.random() < 0.5 else 'down'}" for i in order))
        texts.append(" ".join(f"{'here' if i % 2 else 'there'} last{i}" for i in order))
    free = (i for i in range(10**6) if not is_held(i))
    held = (i for i in range(10**6) if is_held(i))
    rows = [(next(free), t) for t in texts]
    asked = {}
    for i in range(40):
        for text in (f"rare{i} left", f"rare{i} right", f"here last{i}", f"there last{i}"):
            asked[text] = next(held)
            rows.append((asked[text], text))
    table = sp.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in bilinear.score_texts(table, outcomes=10, dictionary=dictionary).where("held_out").collect()}
    for left, right in (("rare{} left", "rare{} right"), ("here last{}", "there last{}")):
        gap = [got[asked[left.format(i)]] - got[asked[right.format(i)]] for i in range(40)]
        # Conditioned on the rest class alone all gaps are the same.
        assert np.mean(gap[1::2]) - np.mean(gap[::2]) > 0.1


@pytest.mark.parametrize("known", [["a", "", "é"], ["b"], []])
def test_encoded_texts_come_back(spark, known):
    """Places and rare words say what the text's tokens are, in less room."""
    known = [w.encode() for w in known]
    texts = ["", "A b\tc  é É", "b b zz", " \n", "x" * 50 + " a" * 70_000]
    rows = session(spark).createDataFrame([(i, t) for i, t in enumerate(texts)], "no int, text string")
    got = bilinear.encoded(rows, spark.sparkContext.broadcast(known)).orderBy("no").collect()
    for text, r in zip(texts, got):
        places = bilinear.unpack_places(bytes(r.places))
        at, rare = bilinear.rare_words(bytes(r.rare), places)
        words = [known[i] if i >= 0 else None for i in places]
        for i, word in zip(at, rare, strict=True):
            words[i] = word
        assert words == bilinear.tokens_of(text)


def test_occurrences_are_moved_by_bucket(spark):
    """One row per bucket of words and flush, and the sums of all occurrences."""
    shape = bilinear.Shape(6, 4)
    share = np.full(6, 1 / 6)
    terms = Sums(shape, shape.start(share, 1), np.zeros(4))
    rng = np.random.default_rng(8)
    # Some words are met often, most rarely; some places are outcomes or unknown.
    texts = [np.concatenate([rng.integers(-1, 1300, 300), rng.integers(5, 30, 300)]) for _ in range(8)]
    rows = session(spark).createDataFrame([(bytearray(bilinear.pack_places(t)),) for t in texts], "places binary").repartition(2)

    def coded(raw):
        places = bilinear.unpack_places(raw)
        return places, terms.encode(*bilinear.contexts(places, 6))

    found = occurrences(rows, 1300 - 5, coded, terms)
    assert found.count() <= 2 * 2 * 3  # tasks, kinds of rows, buckets
    n, sums = np.zeros(1300), np.zeros((1300, 12))
    for t in texts:
        codes = terms.encode(*bilinear.contexts(t, 6))
        np.add.at(n, t[t >= 5], 1)
        np.add.at(sums, t[t >= 5], terms.decode(codes[t >= 5]))
    got = {r.place: r for r in sums_by_place(found, terms).collect()}
    assert set(got) == set(np.flatnonzero(n).tolist())
    for place, r in got.items():
        assert r.n == n[place] and np.allclose(np.frombuffer(r.sums), sums[place], atol=1e-4)
