"""Registered queries on the small tables: against their SQL, or against a plain version."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from actlens.llm import packing, parity_join
from actlens.llm.hnsw import build
from actlens.llm.queries import ORACLES, QUERIES
from actlens.llm.repeat_windows import covered, sliding_argmin

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, width):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute_components(rows, width, per_cent):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= per_cent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return {d: (min(least[find(i)]), len(sets[i])) for i, (d, _) in enumerate(rows)}


def test_near_duplicates(spark, docs):
    want = brute_components([(r.doc_id, r.text) for r in docs], 4, 85)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in QUERIES["op1_parity_join"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("width,per_cent", [(4, 85), (5, 80)])
def test_near_duplicates_of_edited_texts(spark, width, per_cent):
    rng = np.random.default_rng(7)
    rows = []
    for size in (1, 3, 4, 5, 8, 9, 11, 16, 25, 33, 60, 64, 120, 250):
        text = [f"w{x}" for x in rng.integers(0, 300, size)]
        for _ in range(14):
            edited = list(text)
            for _ in range(rng.integers(0, 2 + size // 25)):
                at = rng.integers(0, len(edited))
                edited[at : at + rng.integers(0, 2)] = [f"w{rng.integers(0, 300)}"]
            rows.append((len(rows), " ".join(edited)))
            if rng.random() < 0.4:
                text = edited
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = parity_join.near_duplicates(table, width=width, per_cent=per_cent).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in found} == brute_components(rows, width, per_cent)


@pytest.mark.parametrize("least_keys,short_bits", [(1, 64), (8, 1024)])
def test_a_pair_comes_once(spark, monkeypatch, least_keys, short_bits):
    """Near copies that hang on a common text but seldom on each other: the same links however few keys a row knows."""
    monkeypatch.setattr(parity_join, "LEAST_KEYS", least_keys)
    monkeypatch.setattr(parity_join, "SHORT_BITS", short_bits)
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    rows = []
    for i in range(60):
        text = list(base)
        for edit in rng.choice(20, 4, replace=False):  # two texts link if they share two edits or more
            text[5 + 7 * edit] = f"v{edit}"
        rows.append((i, " ".join(text)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    given = []
    inner = parity_join._pairs_apart

    def counted(rest, per_cent):
        given.append((rest, inner(rest, per_cent)))
        return given[-1][1]

    monkeypatch.setattr(parity_join, "_pairs_apart", counted)
    found = parity_join.near_duplicates(table).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in found} == brute_components(rows, 4, 85)
    (rest, pairs), = given
    assert pairs.count() > 0
    if least_keys > 1:  # what the join gives before repeats are dropped
        joined = rest.alias("l").join(rest.alias("r"), F.expr("l.key = r.key AND l.node < r.node AND l.component != r.component"))
        assert joined.count() > 3 * pairs.count()


def test_repeated_windows(spark, docs):
    length = 200
    raw = {r.doc_id: (r.text or "").encode() for r in docs}
    seen = collections.Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    rows = QUERIES["op2_suffix_windows"](spark, SF).collect()
    assert len(rows) == len(raw)
    for r in rows:
        b = raw[r.doc_id]
        cuts = covered([(i, i + length) for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1])
        edges = [0, *(x for c in cuts for x in c), len(b)]
        kept = b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2]))
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), len(b) - len(kept), len(cuts))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_large_groups_go_window_by_window(spark, docs):
    from actlens.llm.suffix_windows import kept_texts, repeated_bytes

    table = spark.read.parquet(f"{SF}/documents.parquet")
    a = {r.doc_id: r.kept_sha256 for r in kept_texts(repeated_bytes(table, together=1)).collect()}
    assert a == {r.doc_id: r.kept_sha256 for r in QUERIES["op2_suffix_windows"](spark, SF).collect()}


def test_sliding_argmin():
    values = np.random.default_rng(1).integers(0, 9, 500).astype(np.uint64) << np.uint64(40)
    got = sliding_argmin(values, 37)
    assert got.tolist() == [i + int(values[i : i + 37].argmin()) for i in range(500 - 36)]


def test_shards(spark, docs):
    rows = {r.doc_id: r for r in QUERIES["op4_balanced_shards"](spark, SF).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        raw = (d.text or "").encode()
        assert (rows[d.doc_id].size, rows[d.doc_id].text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    ordered = sorted(docs, key=lambda d: (hashlib.md5((d.text or "").encode()).hexdigest(), d.doc_id))
    placed = [(rows[d.doc_id].shard, rows[d.doc_id].slot) for d in ordered]
    assert placed == sorted(placed)
    assert all(slot == 0 if i == 0 or placed[i - 1][0] != shard else slot == placed[i - 1][1] + 1 for i, (shard, slot) in enumerate(placed))


def test_neighbours(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in table], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in table])
    found = collections.defaultdict(set)
    for r in QUERIES["op6_sharded_graphs"](spark, SF).collect():
        found[r.query_id].add(r.vec_id)
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        near = x @ x[ids == q][0]
        want = [v for v in ids[np.lexsort((ids, -near))] if v != q][:5]
        hits, total = hits + len(found[q] & set(want)), total + 5
    assert hits >= 0.95 * total


def test_graph_finds_neighbours():
    x = np.random.default_rng(3).normal(size=(3000, 24))
    graph = build(x)
    ids, _ = graph.search(graph.vectors[:200], 64)
    want = np.argsort(-(graph.vectors[:200] @ graph.vectors.T), axis=1)[:, :5]
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(ids, want)]) > 0.95


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op7_rule_ensemble"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    mine = [r for r in rows if r.held_out and r.doc_id in marks]
    assert np.mean([r.predicted == marks[r.doc_id] for r in mine]) > 0.95


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = QUERIES["op8_swap_packing"](spark, SF).collect()
    pieces = collections.defaultdict(dict)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
    for d in docs:
        ids = np.array([*encoder.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, start in enumerate(range(0, len(ids), 2048)):
            part, r = ids[start : start + 2048], pieces[d.doc_id].pop(k)
            assert (r.start, r.length, r.ids_crc32) == (start, len(part), zlib.crc32(part.tobytes()))
        assert not pieces[d.doc_id]
    fills = collections.Counter()
    for r in rows:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 2048
    assert len(fills) <= -(-sum(fills.values()) // 2048) + 1


def best_fit(lengths, size):
    """Bins of best fit, longest first: what the search is compared with."""
    free = []
    for need in sorted(lengths, reverse=True):
        room = min((f for f in free if f >= need), default=None)
        if room is not None:
            free.remove(room)
        free.append((size if room is None else room) - need)
    return len(free)


def test_swaps_empty_bins():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(20, 70, 120)
        bins = packing.pack_lengths(lengths, 100)
        fills = np.bincount(bins, lengths)
        assert fills.max() <= 100
        assert len(fills) < packing.next_fit(lengths, 100)[0].max()
        assert len(fills) <= best_fit(lengths, 100) + 3


def test_search_on_given_documents(spark, monkeypatch):
    """The search moves items of a given table; squared fill never falls, and it ends where best fit does."""
    pieces = packing.token_pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    lengths = pieces.orderBy("ids_crc32", "doc_id", "piece").toPandas()["length"].to_numpy()
    lengths = lengths[lengths < 2048]
    bin_of, free = packing.next_fit(lengths, 2048)
    search = packing.SwapSearch(lengths, bin_of.copy(), free.copy(), 2048)
    squares = [int(((2048 - free) ** 2).sum())]
    shift = search.shift
    at_shift = []
    monkeypatch.setattr(search, "shift", lambda items, to: (at_shift.append(1), shift(items, to)))
    for step in ("move", "swap", "swap_two"):
        def told(victim, items, inner=getattr(search, step)):
            done = inner(victim, items)
            squares.append(int(((2048 - search.free) ** 2).sum()))
            return done

        monkeypatch.setattr(search, step, told)
    search.run()
    assert at_shift and (search.bin_of != bin_of).any()
    assert squares == sorted(squares)
    assert (np.bincount(search.bin_of, lengths, len(free)) + search.free == 2048).all()
    assert search.bins() < len(free)
    assert search.bins() <= best_fit(lengths.tolist(), 2048) + 1


def test_many_equal_lengths():
    bins = packing.pack_lengths(np.full(8192, 3), 2048)
    assert np.bincount(bins).max() == 682 and bins.max() == 8192 // 682


def test_token_ids_are_those_of_the_tokenizer():
    ids = packing.WordIds(None, memory=50)
    texts = ["it's A.B, c., X <|endoftext|> y <|ENDOFTEXT|>", "Été. 12.5, á́ á. café　x ..., ,", "", " \n ", "a\x0bb c ΑΣ."]
    for t in [*texts, *texts]:
        assert np.frombuffer(ids(t), "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids


def test_latin_parts_go_straight_to_the_model():
    """Only other parts pass the normalizer and pre-tokenizer."""

    class Told:
        def __init__(self, inner):
            self.inner, self.words = inner, []

        def encode_batch_fast(self, words, **options):
            self.words += words
            return self.inner.encode_batch_fast(words, **options)

    rng = np.random.default_rng(3)
    ids = packing.WordIds(None)
    ids.tokenizer = told = Told(ids.tokenizer)
    letters = list("abcXYZ's'tréÉßÿÀ0129.,!?-\"<>_$^`~")
    for n in rng.integers(0, 15, 2000):
        text = " ".join("".join(rng.choice(letters, k)) for k in rng.integers(0, 9, n))
        assert np.frombuffer(ids(text), "<u4").tolist() == told.inner.encode(text, add_special_tokens=False).ids
    assert not told.words
    for text in ("ª × ÷ 中 é\u0301 x\u00a0y \u00ad z\x1cA", "<|endoftext|>A <|ENDOFTEXT|>B <|"):
        assert np.frombuffer(ids(text), "<u4").tolist() == told.inner.encode(text, add_special_tokens=False).ids
    assert told.words


def test_words_in_use_outlast_a_full_memory(monkeypatch):
    ids = packing.WordIds(None, memory=40)
    learnt = []
    learn = ids.learn
    monkeypatch.setattr(ids, "learn", lambda part: (learnt.append(part), learn(part))[1])
    ids.known = packing.Known(ids.learn, {})
    for i in range(200):
        text = f"often again word{chr(97 + i // 26)}{chr(97 + i % 26)}"
        assert np.frombuffer(ids(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(ids.known) + len(ids.known.before) <= 40
    assert learnt.count(b"often") == learnt.count(b"again") == 1 and len(learnt) == 202


def test_chat(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    rows = {r.conv_id: r for r in QUERIES["op9_chat_masks"](spark, SF).collect()}
    by = collections.defaultdict(list)
    for t in turns:
        by[t.conv_id].append((t.role, t.text or ""))
    by[-1] = [(role, "</s>[INST] ok [/INST]") for role in ("user", "assistant")]
    assert set(rows) == set(by)
    for conv, mine in by.items():
        loss = "".join(t for role, t in mine if role == "assistant")
        r = rows[conv]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(mine), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_language_model(spark, docs):
    counts = collections.Counter()
    for d in docs:
        if zlib.crc32(str(d.doc_id).encode()) % 7 != 2:
            counts.update([*words(d.text), b""])
    n, v = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in QUERIES["op10_bilinear_scores"](spark, SF).collect()}
    for d in docs:
        tokens, r = [*words(d.text), b""], rows[d.doc_id]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in counts for w in tokens), n)


def test_language_model_is_normalised():
    from actlens.llm.bilinear import Model, Shape, Trainer

    rng = np.random.default_rng(2)
    shape, share = Shape(20, 4), np.full(20, 0.05)
    trainer = Trainer(shape, shape.start(share, 1), share, 8, 0.5, 1)
    last, before = rng.integers(0, 21, 4000), rng.integers(0, 21, 4000)
    follows = np.minimum(last, 19)  # each token tends to follow itself
    for _ in range(40):
        trainer.step(last, before, follows)
    model = Model.of(shape, trainer.flat)
    a, b = np.meshgrid(np.arange(21), np.arange(21))
    total = sum(np.exp(model.log_prob(a.ravel(), b.ravel(), np.full(a.size, w))) for w in range(20))
    assert np.allclose(total, 1, atol=1e-4)
    assert model.log_prob(last, before, follows).mean() > math.log(0.05) + 0.5


def test_pipeline(spark, docs):
    from actlens.llm.common import session

    session(spark)
    docs_table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    left = docs_table
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, SF)
        left = spark.createDataFrame(left.collect(), left.schema)
        kept[name] = left.collect()
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {r.doc_id for r in kept["quality"]}
    known = [d.doc_id for d in docs if d.doc_id in marks]
    assert np.mean([(d in good) == (marks[d] == 1) for d in known]) > 0.9
    lower = [r.text.encode().lower() for r in kept["exact_copies"]]
    assert set(lower) == {r.text.encode().lower() for r in kept["quality"]} and len(lower) == len(set(lower))
    comps = brute_components([(r.doc_id, r.text) for r in kept["exact_copies"]], 5, 80)
    assert {r.doc_id for r in kept["near_copies"]} == {d for d, (c, _) in comps.items() if c == d}
    times = collections.Counter(r.doc_id for r in kept["mix"])
    assert set(times) <= {r.doc_id for r in kept["near_copies"]} and max(times.values()) <= 2
    packed = collections.Counter(r.doc_id for r in kept["pack"] if r.piece == 0)
    assert packed == times
