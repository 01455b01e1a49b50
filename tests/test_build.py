"""The staged build from corpus to shuffled training tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlens import schemas
from actlens.plans import build
from actlens.plans.dataset_build import BuildConfig, DatasetBuild, base_rows, marker_tokens
from actlens.functions.text import tokenize
from actlens.session import scratch_path
from actlens.slots import HashEncoder, StubCompleter, WordTokenizer
from actlens.sources.manifest import TokenInfo, manifest_read


@pytest.fixture(scope="module")
def corpus(spark):
    words = F.transform(F.sequence(F.lit(0), (F.lit(45) + F.col("id")).cast("int")), lambda i: F.concat(F.lit("w"), i))
    return spark.range(60).select(F.col("id").alias("doc_idx"), F.array_join(words, " ").alias("text"))


@pytest.fixture(scope="module")
def built(spark, corpus):
    config = BuildConfig.from_dict(
        {
            "output_dir": scratch_path(spark, "build"),
            "model": "qwen7b",
            "corpus": {"name": "corp", "split": "train", "start": 0, "length": 60},
            "stage0": {"positions_per_doc": 5, "seed": 7},
            "stage1": {"av_sft_frac": 0.25, "ar_sft_frac": 0.25, "rl_frac": 0.5},
            "stage3": {"actor_template": "Explain <c> {injection_char} </c> now.", "injection_char": "@"},
            "shuffle": {"enabled": True, "seed": 3},
            "control": {"enabled": True, "seed": 4},
        },
        {"corpus.length": 58},
    )
    job = DatasetBuild(spark, config, corpus, HashEncoder(8), StubCompleter(), WordTokenizer())
    return job, job.run()


BARE = {"output_dir": "o", "corpus": {"name": "c"}}


def test_config():
    c = BuildConfig.from_dict({**BARE, "model": "gemma12b", "layer_index": 5})
    assert (c.base_model, c.layer_index, c.corpus) == ("google/gemma-3-12b-it", 5, "c")
    assert BuildConfig.from_dict({**BARE, "model": "llama70b"}).layer_index == 53
    with pytest.raises(ValueError, match="no model preset"):
        BuildConfig.from_dict({**BARE, "model": "unknown"})
    with pytest.raises(ValueError, match="base_model"):
        BuildConfig.from_dict(BARE)
    with pytest.raises(ValueError, match="stage2.instructions"):
        BuildConfig.from_dict({**BARE, "model": "qwen7b", "stage2": {"instructions": "x"}})
    full = {
        "model": "qwen7b",
        "stage0": {"chunk_size": 9, "extractor_kwargs": {"batch_size": 1}},
        "stage1": {"seed": 8, "av_sft_frac": 0.5, "ar_sft_frac": 0.25, "rl_frac": 0.25},
        "stage2": {"instruction": "i {text}", "pattern": "(p)", "min_features": 3, "chunk_size": 7, "prior": {"av_sft": "a"}},
        "tokens": {"injection_char": "x", "injection_token_id": 1, "injection_left_neighbor_id": 2, "injection_right_neighbor_id": 3},
    }
    c = BuildConfig.from_dict({**BARE, **full}, {"stage1.rl_frac": 0.2, "corpus.start": 4, "model": "gemma27b"})
    assert (c.instruction, c.pattern, c.min_features, c.texts_per_chunk) == ("i {text}", "(p)", 3, 7)
    assert c.fractions == {"av_sft": 0.5, "ar_sft": 0.25, "rl": 0.2} and c.split_seed == 8 and c.start == 4
    assert c.tokens == TokenInfo("x", 1, 2, 3) and c.prior == {"av_sft": "a"} and c.base_model.endswith("27b-it")


def test_marker_tokens():
    word = lambda w: WordTokenizer().encode([w], False)[0][0]
    info = marker_tokens(WordTokenizer(), "a {injection_char} b", "s <t>{explanation}</t> <u> v", "@")
    assert info == TokenInfo("@", word("@"), word("a"), word("b"), [word("<u>"), word("v")])
    with pytest.raises(ValueError, match="marker"):  # merged with its neighbours
        marker_tokens(WordTokenizer(), "a <{injection_char}> b", "{explanation} u", "@")
    with pytest.raises(ValueError, match="marker"):  # no right neighbour
        marker_tokens(WordTokenizer(), "a {injection_char}", "{explanation} u", "@")
    with pytest.raises(ValueError, match="tail"):
        marker_tokens(WordTokenizer(), "a {injection_char} b", "u {explanation}", "@")


def test_tables(spark, built):
    job, manifests = built
    c = job.config
    read = lambda name: spark.read.parquet(c.path(name))
    base = read("base")
    assert base.count() == sum(min(max(46 + i - 50, 0), 5) for i in range(58))
    splits = {t: read(f"{t}_raw") for t in ("av_sft", "ar_sft", "rl")}
    assert sum(d.count() for d in splits.values()) == base.count()
    docs = [{r.doc_id for r in d.select("doc_id").distinct().collect()} for d in splits.values()]
    n = base.select("doc_id").distinct().count()
    assert [len(d) for d in docs] == [int(n * 0.25), int(n * 0.25), n - 2 * int(n * 0.25)]
    assert not (docs[0] & docs[1] or docs[0] & docs[2] or docs[1] & docs[2])
    assert len(manifests) == 6
    for table in splits:
        manifest = manifests[f"{table}_shuf"]
        assert manifest.tokens.critic_suffix_ids == WordTokenizer().encode(["<summary>"], False)[0]
        assert manifest.tokens.injection_token_id == WordTokenizer().encode(["@"], False)[0][0]
        stored = read(f"{table}_shuf")
        assert manifest.row_count == stored.count() > 0
        assert manifest.stage == table and manifest.dataset_id.endswith("__shuf3")
        assert sorted(r.shuffle_rank for r in stored.collect()) == list(range(stored.count()))
        want = schemas.stage_schema(table).fieldNames()
        assert stored.columns == [*want, "shuffle_rank"]
        assert read(table).exceptAll(stored.drop("shuffle_rank")).isEmpty()
    chain = manifest_read(spark, c.path("ar_sft"))
    assert chain.parent_datasets == [manifest_read(spark, c.path("ar_sft_explained")).dataset_id]
    # The splits share a folder; their manifests do not show up as rows or partitions.
    assert spark.read.parquet(c.path("rl_raw").rpartition("/")[0]).count() == base.count()


def test_order_of_files_follows_the_shuffle(spark, built):
    job, _ = built
    rows = spark.read.parquet(job.config.path("rl_shuf")).select(
        F.col("_metadata.file_name").alias("f"), "shuffle_rank"
    )
    files = rows.groupBy("f").agg(F.min("shuffle_rank").alias("lo"), F.max("shuffle_rank").alias("hi"))
    spans = [(r.lo, r.hi) for r in files.orderBy("f").collect()]
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_control_permutes_vectors_only(spark, built):
    job, manifests = built
    for table in ("av_sft", "ar_sft", "rl"):
        plain, control = (spark.read.parquet(job.config.path(t)) for t in (table, f"{table}_control"))
        assert manifests[f"{table}_control"].dataset_id.endswith("__control4")
        drop = lambda d: d.drop("activation_vector")
        assert drop(plain).exceptAll(drop(control)).isEmpty()
        assert plain.select("activation_vector").exceptAll(control.select("activation_vector")).isEmpty()
        # Documents share their first words, so another row may have an equal vector.
        assert plain.join(control, ["doc_id", "n_raw_tokens", "activation_vector"]).count() < plain.count() / 2


def test_figures(spark, built):
    job, _ = built
    found = {(r.step, r.figure): r.value for r in job.figures().collect()}
    assert found["sample", "docs"] == 58
    assert found["sample", "docs_skipped"] == 5 and found["sample", "docs_short"] == 4
    assert found["sample", "rows"] == spark.read.parquet(job.config.path("base")).count()
    for table in ("av_sft", "ar_sft"):
        raw, kept = (spark.read.parquet(job.config.path(f"{table}_{s}")).count() for s in ("raw", "explained"))
        assert sum(v for (s, _), v in found.items() if s == f"explain_{table}") == raw - kept
    assert {f for s, f in found if s.startswith("explain")} <= {"dropped_gave_up", "dropped_no_tag", "dropped_too_few"}


def test_only_missing_tables_are_made(spark, built):
    job, manifests = built

    class Refuses:
        d_model = 8

        def encode(self, *args):
            raise AssertionError("encoded again")

        def complete(self, prompts):
            raise AssertionError("asked again")

    idle = DatasetBuild(spark, job.config, job.corpus, Refuses(), Refuses(), WordTokenizer())
    assert idle.run() == manifests
    again = idle.run("ar_sft_shuf", "rl_control", again=["build"])
    assert {t: m.row_count for t, m in again.items()} == {t: manifests[t].row_count for t in again}
    assert again["rl_control"].created_at > manifests["rl_control"].created_at
    with pytest.raises(ValueError, match="unknown tables or stages"):
        job.run("nothing")
    with pytest.raises(ValueError, match="unknown tables or stages"):
        job.run(again=["9"])
    with pytest.raises(ValueError, match="token ids"):
        DatasetBuild(spark, job.config, job.corpus, Refuses(), Refuses())


def test_cut_off_build_goes_on(spark, built, corpus):
    job, _ = built
    config = BuildConfig(**{**job.config.__dict__, "output_dir": scratch_path(spark, "cut")})

    class Dies(StubCompleter):
        def complete(self, prompts):
            raise RuntimeError("gone")

    with pytest.raises(Exception):
        DatasetBuild(spark, config, corpus, HashEncoder(8), Dies(), WordTokenizer()).run("av_sft")
    second = DatasetBuild(spark, config, corpus, None, StubCompleter(), WordTokenizer())  # nothing is encoded again
    assert second.stored("av_sft_explained") is None and second.stored("base").row_count > 0
    second.run("av_sft")
    a, b = (spark.read.parquet(c.path("av_sft")) for c in (job.config, config))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert second.stored("rl") is None


def test_prior_run_instead_of_asking(spark, built, corpus):
    job, _ = built
    prior = {t: job.config.path(t) for t in ("av_sft", "ar_sft")}
    # The prior run lost the rows without explanation, so its match rate is below the limit.
    config = BuildConfig(**{**job.config.__dict__, "output_dir": scratch_path(spark, "prior"), "prior": prior})
    with pytest.raises(ValueError, match="match rate too low"):
        DatasetBuild(spark, config, corpus, HashEncoder(8), None, WordTokenizer()).run("ar_sft")

    class Always:
        def complete(self, prompts):
            return ["<analysis>\n1. one\n2. two\n</analysis>"] * len(prompts)

    first = BuildConfig(**{**job.config.__dict__, "output_dir": scratch_path(spark, "all")})
    DatasetBuild(spark, first, corpus, HashEncoder(8), Always(), WordTokenizer()).run("av_sft", "ar_sft")
    config.output_dir = scratch_path(spark, "reuse")
    config.prior = {t: first.path(t) for t in ("av_sft", "ar_sft")}
    reuse = DatasetBuild(spark, config, corpus, HashEncoder(8), None, WordTokenizer())
    reuse.run("av_sft", "ar_sft")
    for t in ("av_sft", "ar_sft"):
        a, b = (spark.read.parquet(c.path(t)) for c in (first, config))
        assert a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_explanations_reused_as_cache(spark, built, corpus):
    job, _ = built
    stored = [job.config.path(f"{t}_explained") for t in ("av_sft", "ar_sft")]

    class Refuses:
        def complete(self, prompts):
            return [None] * len(prompts)

    config = BuildConfig(**{**job.config.__dict__, "output_dir": scratch_path(spark, "again"), "cache_from": stored})
    again = DatasetBuild(spark, config, corpus, HashEncoder(8), Refuses(), WordTokenizer())
    again.run(*(t for t in ("av_sft", "ar_sft")))
    for t in ("av_sft", "ar_sft"):
        a, b = (spark.read.parquet(j.config.path(t)) for j in (job, again))
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_sharded_extraction_equals_serial(spark, corpus):
    docs = corpus.select(
        F.concat(F.lit("c:"), "doc_idx").alias("doc_id"), "doc_idx", tokenize(F.col("text")).alias("tokens")
    )
    serial = base_rows(docs, HashEncoder(4), 3, 1, 2)
    parts = [base_rows(docs.where(F.col("doc_idx") % 3 == i), HashEncoder(4), 3, 1, 2) for i in range(3)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert merged.exceptAll(serial).isEmpty() and serial.exceptAll(merged).isEmpty()
    vector = np.array(serial.first().activation_vector)
    assert np.isclose(np.linalg.norm(vector), 100, rtol=1e-4)


@pytest.mark.parametrize("keep", [True, False])
def test_schemas(spark, built, keep):
    job, _ = built
    explained = spark.read.parquet(job.config.path("av_sft_explained"))
    for stage, fn in (("av_sft", build.build_av), ("ar_sft", build.build_ar), ("rl", build.build_rl)):
        table = fn(explained, keep_debug=keep)
        want = schemas.stage_schema(stage, keep)
        assert table.schema.simpleString() == want.simpleString()
    row = build.build_av(explained).first()
    assert row.response.startswith("<explanation>\n") and "<INJECT>" in row.prompt[0].content
    with pytest.raises(Exception, match="lacks the expected suffix"):
        build.build_ar(explained, suffix=["other"]).collect()
