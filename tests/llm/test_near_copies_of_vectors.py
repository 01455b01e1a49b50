"""Neighbours in a cluster that is larger than the beam and that single precision cannot resolve."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlens.llm import ann
from actlens.llm.common import session


@pytest.mark.parametrize("noise", [1e-4, 1e-3])
def test_cluster_larger_than_the_beam(spark, noise):
    sp = session(spark)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    near = centre * (1 + noise * rng.normal(size=(400, 64)))
    scaled = [centre * 2.0**k for k in range(-20, 20)]  # the same direction, exactly
    x = np.concatenate([near, scaled, rng.normal(size=(200, 64))]).astype(np.float32).astype(float)
    ids = rng.permutation(len(x))
    table = sp.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    rows = ann.nearest_neighbours(table, F.col("vec_id") % 20 == 0, shard=4096).collect()
    length = np.sqrt((x * x).sum(1))
    for at in np.flatnonzero(ids % 20 == 0):
        scores = (x * x[at]).sum(1) / (length * length[at])
        want = sorted((-s, int(i)) for s, i in zip(scores, ids) if i != ids[at])[:5]
        mine = sorted((r for r in rows if r.query_id == ids[at]), key=lambda r: r.rank)
        assert [(r.vec_id, r.score) for r in mine] == [(i, -s) for s, i in want]


def brute(x, ids, every):
    """Nearest five of each query by cosine in double precision, rows brought below one first."""
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    for at in np.flatnonzero(ids % every == 0):
        scores = unit @ unit[at]
        yield int(ids[at]), sorted((-round(s, 12), int(i)) for s, i in zip(scores, ids) if i != ids[at])[:5]


def test_doubles_beyond_single_precision(spark):
    sp = session(spark)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 16)) * 10.0 ** rng.integers(-250, 250, size=(90, 1))
    x[:30] = x[0] * (1 + 1e-9 * rng.normal(size=(30, 16)))
    ids = np.arange(90)
    table = sp.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    rows = ann.nearest_neighbours(table, F.col("vec_id") % 20 == 0, shard=40).collect()
    found = {(r.query_id, r.rank): r for r in rows}
    for query, want in brute(x, ids, 20):
        mine = [found[query, k] for k in range(1, 6)]
        assert np.allclose([r.score for r in mine], [-s for s, _ in want], rtol=0, atol=1e-12)
        if query >= 30:
            assert [r.vec_id for r in mine] == [i for _, i in want]


def test_recall_on_shards_larger_than_the_beam(spark):
    sp = session(spark)
    rng = np.random.default_rng(7)
    x, ids = rng.normal(size=(2400, 64)).astype(np.float32).astype(float), rng.permutation(2400)
    table = sp.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    rows = ann.nearest_neighbours(table, F.col("vec_id") % 20 == 0, shard=800, beam=96).collect()
    hits = [len({i for _, i in want} & {r.vec_id for r in rows if r.query_id == query}) for query, want in brute(x, ids, 20)]
    assert len(rows) == 5 * len(hits) == 600 and np.mean(hits) / 5 >= 0.9
