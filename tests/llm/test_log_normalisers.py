"""Work of a score: each context is normalised once, frequent pairs by a table, words are split in Arrow."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from actlens.llm import bilinear
from actlens.llm.bilinear import NONE, OUTSIDE, Scorer, Shape
from actlens.llm.word_tree import Newton, Tree


def scorer(pairs, scale=1.0, words=60):
    rng = np.random.default_rng(5)
    shape = Shape(12, 4)
    flat = np.concatenate([rng.normal(0, 1, (3 * 12 + 2) * 4), rng.normal(0, 2, 12)]).astype(np.float32)
    n = rng.integers(1, 30, words - 11).astype(float)
    sums = rng.normal(size=(words - 10, 4))
    tree = Tree(np.append(9.0, n), np.append(10.0, n + 1), sums, Newton([rng.normal(size=(11, 4))], np.full(11, 1 / 11)))
    own = (rng.normal(size=(words - 11, 8)) * scale).astype(np.float32)
    return Scorer(shape, flat, tree, own, np.zeros(4), pairs)


def plain_log_z(of, context):
    logits = context.astype(np.float64) @ of.out.T.astype(np.float64) + of.bias
    top = logits.max(1)
    return np.log(np.exp(logits - top[:, None]).sum(1)) + top


@pytest.mark.parametrize("scale", [1.0, 40.0])  # of the long vectors some logits are out of float's range
@pytest.mark.parametrize("pairs", [0, 12, 30, 60])
def test_normalisers_of_pairs_are_those_of_their_contexts(pairs, scale):
    of = scorer(pairs, scale)
    last, before = (x.ravel() for x in np.meshgrid(np.append(np.arange(60), NONE), np.append(np.arange(60), NONE)))
    context = of.context(last, before)
    wanted = plain_log_z(of, context)
    assert np.allclose(of.log_z(context), wanted, rtol=1e-5, atol=1e-4)
    assert np.allclose(of.known_log_z(last, before, context), wanted, rtol=1e-5, atol=1e-4)


def test_a_context_is_normalised_once(monkeypatch):
    asked = []
    plain = Scorer.log_z
    monkeypatch.setattr(Scorer, "log_z", lambda self, context: asked.append(len(context)) or plain(self, context))
    rng = np.random.default_rng(6)
    text = rng.integers(0, 60, 50)
    places = np.concatenate([np.tile(text, 40), [OUTSIDE], text])
    starts = np.array([0, len(places) - 20])
    got = scorer(20).tokens(places, starts)
    assert sum(asked) <= 60
    asked.clear()
    assert np.allclose(got, scorer(0).tokens(places, starts), atol=1e-4)
    of, total = scorer(0), []
    for a, b in ((0, len(places) - 20), (len(places) - 20, len(places))):
        mine = np.concatenate([[NONE, NONE], places[a:b]])
        for i in range(2, len(mine)):
            if OUTSIDE in mine[i - 2 : i]:
                total.append(0.0)
                continue
            h = of.context(mine[i - 1 : i], mine[i - 2 : i - 1])
            k = min(mine[i], of.rest) if mine[i] >= 0 else of.rest
            p = float(h[0] @ of.out[k] + of.bias[k]) - plain_log_z(of, h)[0]
            total.append(p + (of.leaf(h, mine[i : i + 1])[0] if k == of.rest else 0.0))
    assert np.allclose(got, total, atol=1e-4)


def test_a_tree_is_built_in_little_room():
    rng = np.random.default_rng(7)
    n, sums = rng.integers(1, 9, 1 << 16).astype(float), rng.normal(size=(1 << 16, 16))
    newton = Newton([rng.normal(size=(20, 16))], np.full(20, 0.05))
    tracemalloc.start()
    try:
        tree = Tree(n, n + 1, sums, newton)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2 * sums.nbytes  # over four times before
    assert sum(v.size for v, _ in tree.levels) >= sums.size


def test_gain_is_that_of_a_walk_down_the_tree():
    rng = np.random.default_rng(8)
    n, sums = rng.integers(1, 50, 700).astype(float), rng.normal(size=(700, 5)) * 9
    tree = Tree(n, n + 1, sums, Newton([rng.normal(size=(40, 5))], np.full(40, 1 / 40)))
    # Both few and many tokens of a node.
    leaf = np.concatenate([np.arange(700), np.full(3000, 5), rng.integers(0, 40, 9000), [0, 699]])
    context = rng.normal(size=(len(leaf), 5)).astype(np.float32)
    got = tree.gain(leaf, context)
    for i in range(0, len(leaf), 13):
        total = 0.0
        for depth, (vectors, shares) in enumerate(tree.levels):
            child = leaf[i] // 16 ** (len(tree.levels) - 1 - depth)
            pull = vectors[child // 16].astype(np.float64) @ context[i]
            total += pull[child % 16] - math.log((np.exp(shares[child // 16].astype(np.float64)) * np.exp(pull)).sum())
        assert math.isclose(got[i], total, rel_tol=1e-4, abs_tol=1e-4)


def test_split_words_are_the_tokens():
    texts = ["", "A b\tc  é É", " x\x0b\x0cy \r", "\x1c\x85  q r\x00s", " \n", "İK ẞ zZ", "end "]
    for some in (pa.array(texts), pa.array(texts).slice(2, 4), pa.array([], pa.string()), pa.array(["", " "])):
        found, sizes = bilinear.split_words(some)
        words, at = found.to_pylist(), 0
        for text, size in zip(some.to_pylist(), sizes, strict=True):
            assert [*words[at : at + size], bilinear.END] == bilinear.tokens_of(text)
            at += size
        assert at == len(words)


def test_counts_are_those_of_the_tokens(spark, monkeypatch):
    monkeypatch.setattr(bilinear, "FLUSH", 50)
    rng = np.random.default_rng(9)
    texts = ["", " ", *(" ".join(f"W{int(x)}" for x in rng.zipf(1.2, 30) % 300) for _ in range(60))]
    wanted = {}
    for t in texts:
        for w in bilinear.tokens_of(t):
            wanted[w] = wanted.get(w, 0) + 1
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert {bytes(r.word): r.n for r in bilinear.count_tokens(rows).collect()} == wanted
