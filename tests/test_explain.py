"""Explanations: caches, completer, prior runs, streams."""

import os
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_text import cleaned

from actlens import fixed_values as fv
from actlens.functions import text as tx
from actlens.operators import aggregates, filters, joins
from actlens.operators.packs import pack_keys, packed, unpacked
from actlens.plans.evaluate import score_rollouts
from actlens.plans.explain import explain
from actlens.session import materialize, scratch_path
from actlens.slots import RetryingCompleter, SignReconstructor, StubCompleter, ThreadedCompleter, complete_prompts
from actlens.sources.answers import ANSWERS, AnswerStore, CompleterFailed
from actlens.streaming import jobs
from actlens.streaming.gather import gathered, lane_partitions
from actlens.streaming.jobs import _by_batch, explain_stream, reward_batches, reward_stream

TEXTS = [f"text {'x' * (i % 13)} number {i}" for i in range(60)] + ["copied text"] * 40


@pytest.fixture(scope="module")
def rows(spark):
    schema = "id long, detokenized_text_truncated string"
    return spark.createDataFrame(list(enumerate(TEXTS)), schema).repartition(4)


@pytest.fixture(scope="module")
def caches(spark):
    schema = "detokenized_text_truncated string, api_explanation string, row_no long"
    first = [(t, f"a {i}\n\nb", i) for i, t in enumerate(TEXTS[:20])] + [(TEXTS[0], "later\n\nrow", 99)]
    second = [(t, "only one", i) for i, t in enumerate(TEXTS[10:14])]
    return [spark.createDataFrame(first, schema), spark.createDataFrame(second, schema)]


def expected(cache):
    stub, out = StubCompleter("", ""), {}
    for i, t in enumerate(TEXTS):
        if t in cache:
            e = cache[t]
        else:
            raw = stub._answer(t)
            m = re.search(fv.RESPONSE_PATTERN, raw, re.DOTALL) if raw else None
            e = cleaned(m.group(1)) if m else None
        if e is not None and e.count("\n\n") + 1 >= 2:
            out[i] = e
    return out


def test_explain(rows, caches):
    cache = {t: f"a {i}\n\nb" for i, t in enumerate(TEXTS[:20])}
    cache[TEXTS[0]] = "later\n\nrow"
    cache |= {t: "only one" for t in TEXTS[10:14]}
    got = explain(rows, joins.cache_source(caches), StubCompleter())
    assert {r.id: r.api_explanation for r in got.collect()} == expected(cache)
    none = explain(rows, None, StubCompleter())
    assert {r.id: r.api_explanation for r in none.collect()} == expected({})


def test_copies_cost_one_call(spark, rows):
    path = scratch_path(spark, "calls").removeprefix("file:")

    def note(prompt):
        import os
        import uuid

        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        return "<analysis>a\nb</analysis>"

    out = explain(rows, None, ThreadedCompleter(note))
    assert out.count() == len(TEXTS) and out.count() == len(TEXTS)
    import os

    assert len(os.listdir(path)) == len(set(TEXTS))


def test_completer_contract(spark, rows):
    class Short:
        def complete(self, prompts):
            return prompts[1:]

    with pytest.raises(Exception, match="completions for"):
        rows.select(complete_prompts(Short())(F.col("detokenized_text_truncated"))).collect()
    with pytest.raises(Exception, match="empty completion"):
        explain(rows, None, ThreadedCompleter(lambda p: "")).collect()

    def sometimes(prompt):
        if "number 1" in prompt:
            raise TimeoutError
        return prompt

    answered = rows.select(
        "id", complete_prompts(ThreadedCompleter(sometimes, 3, (TimeoutError,)))(F.col("detokenized_text_truncated")).alias("a")
    ).collect()
    assert all((r.a is None) == ("number 1" in TEXTS[r.id]) for r in answered)
    with pytest.raises(Exception, match="TimeoutError"):
        rows.select(complete_prompts(ThreadedCompleter(sometimes))(F.col("detokenized_text_truncated"))).collect()


# --- the answer store -----------------------------------------------------------------


def counting(path, fail_on=None):
    """Writes down every prompt it is asked; fails for good on prompts with ``fail_on``."""
    path = path.removeprefix("file:")

    def call(prompt):
        import os
        import uuid

        os.makedirs(path, exist_ok=True)
        if fail_on and fail_on in prompt:
            raise ValueError("broken completer")
        with open(f"{path}/{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        return "<analysis>a\nb</analysis>"

    return call


def asked(path):
    path = path.removeprefix("file:")
    return [open(f"{path}/{n}").read() for n in os.listdir(path)] if os.path.isdir(path) else []


def test_a_failed_run_goes_on_where_it_stopped(spark, rows):
    """The run dies in one of several chunks; started again, no text is asked twice."""
    store = AnswerStore(spark, scratch_path(spark, "answers"))
    calls = scratch_path(spark, "calls")
    with pytest.raises(CompleterFailed, match="broken completer"):
        explain(rows, None, RetryingCompleter(counting(calls, "number 33<")), store=store, per_chunk=7)
    before = asked(calls)
    assert 0 < len(before) < len(set(TEXTS)) and 0 < store.commits().count()
    done = explain(rows, None, RetryingCompleter(counting(calls)), store=store, per_chunk=7)
    assert {r.id for r in done.collect()} == set(range(len(TEXTS)))
    prompts = asked(calls)
    assert len(prompts) == len(set(prompts)) == len(set(TEXTS))
    explain(rows, None, RetryingCompleter(counting(calls)), store=store).count()
    assert len(asked(calls)) == len(prompts)


def test_a_chunk_without_commit_is_not_read(spark, rows):
    """What a dead job left in the folder does not count, and is asked again."""
    store = AnswerStore(spark, scratch_path(spark, "answers"))
    left = [("x" * 64, "<analysis>a\nb</analysis>", "answered", None, 1)]
    spark.createDataFrame(left, ANSWERS).write.parquet(f"{store.path}/answers/chunk=dead-000000")
    assert store.answers().count() == 0
    explain(rows, None, StubCompleter(), store=store).count()
    assert store.answers().count() == len(set(TEXTS)) and store.commits().agg(F.sum("texts")).first()[0] == len(set(TEXTS))


def test_store_equals_one_pass(spark, rows, caches):
    cache = joins.cache_source(caches)
    store = AnswerStore(spark, scratch_path(spark, "answers"))
    explain(rows.where("id < 30"), cache, StubCompleter(), store=store, per_chunk=5)
    got = explain(rows, cache, StubCompleter(), store=store)
    want = explain(rows, cache, StubCompleter())
    assert {r.id: r.api_explanation for r in got.collect()} == {r.id: r.api_explanation for r in want.collect()}
    drops = spark.read.parquet(f"{store.path}/drops")
    assert drops.agg(F.sum("row_count")).first()[0] == len(TEXTS) - want.count()
    assert {r.reason for r in drops.collect()} <= {"gave_up", "no_tag", "too_few"}


def test_retries_back_off(monkeypatch):
    waits, tries = [], {}
    monkeypatch.setattr("actlens.slots.time.sleep", waits.append)

    def flaky(prompt):
        tries[prompt] = tries.get(prompt, 0) + 1
        if prompt == "never" or tries[prompt] < 3 and prompt == "third":
            raise TimeoutError("slow")
        if prompt == "bad":
            raise KeyError("bad")
        return None if prompt == "silent" else prompt.upper()

    completer = RetryingCompleter(flaky, concurrency=1, tries=4, wait=1.0, longest=3.0)
    rows = completer.outcomes(["first", "third", "never", "bad", "silent"])
    assert rows == [
        ("FIRST", "answered", None, 1), ("THIRD", "answered", None, 3), (None, "gave_up", "TimeoutError('slow')", 4),
        (None, "failed", "KeyError('bad')", 1), (None, "gave_up", None, 1),
    ]
    assert len(waits) == 5 and waits[0] < waits[1] and all(0.5 <= w <= 3.0 for w in waits)
    assert tries == {"first": 1, "third": 3, "never": 4, "bad": 1, "silent": 1}
    with pytest.raises(RuntimeError, match="bad"):
        completer.complete(["bad"])


def test_given_up_texts_are_asked_again_on_request(spark, rows):
    store = AnswerStore(spark, scratch_path(spark, "answers"))
    some = rows.where("id < 20")
    silent = RetryingCompleter(lambda p: None)
    assert explain(some, None, silent, store=store).count() == 0
    calls = scratch_path(spark, "calls")
    completer = RetryingCompleter(counting(calls))
    assert explain(some, None, completer, store=store).count() == 0 and not asked(calls)
    assert explain(some, None, completer, store=store, again=True).count() == 20
    plain = store.answers().where("outcome = 'answered'")
    assert plain.count() == len(asked(calls)) == 20


def test_cache_parts(rows, caches):
    cache = joins.cache_source(caches)
    assert cache.count() == 20
    assert joins.cache_join(rows, cache).where("api_explanation is not null").count() == 20
    assert joins.cache_miss(rows, cache).count() == 80
    stats = {r.source_no: r for r in joins.cache_stats(rows, caches).collect()}
    assert (stats[0].row_count, stats[0].unique_texts, stats[0].hits) == (21, 20, 20)
    assert stats[1].hit_rate == 0.04


def test_drops(spark):
    raws = [None, "no tag", "<analysis>one</analysis>", "<analysis>one\ntwo</analysis>"]
    df = spark.createDataFrame(list(enumerate(raws)), "id long, raw string")
    got = {r.reason: r.row_count for r in aggregates.drop_breakdown(df).collect()}
    assert got == {"none": 1, "no_tag": 1, "too_few": 1, "kept": 1}
    assert {r.id for r in filters.drop_failed_completion(df).collect()} == {2, 3}


# --- prior runs -------------------------------------------------------------------


def prior(spark, keys, kind):
    rows = [(f"d{k % 9}", k, f"e{k}") for k in keys]
    df = spark.createDataFrame(rows, "doc_id string, n_raw_tokens long, e string")
    if kind == "response":
        return df.withColumn("response", tx.wrap_explanation(F.col("e"))).drop("e")
    return df.withColumn("prompt", tx.fill_template(fv.CRITIC_TEMPLATE, explanation=F.col("e"))).drop("e")


@pytest.mark.parametrize("kind", ["response", "prompt"])
def test_prior_run_join(spark, kind):
    raw = spark.range(100).select(
        F.concat(F.lit("d"), F.col("id") % 9).alias("doc_id"), F.col("id").alias("n_raw_tokens")
    )
    out = joins.prior_run_join(raw, prior(spark, range(3, 120), kind))
    assert {r.n_raw_tokens: r.api_explanation for r in out.collect()} == {k: f"e{k}" for k in range(3, 100)}
    with pytest.raises(ValueError, match="match rate too low: 50 of 100"):
        joins.prior_run_join(raw, prior(spark, range(50), kind))
    assert joins.prior_run_join(raw.limit(0), prior(spark, range(50), kind)).collect() == []


def test_prior_run_join_reads_each_input_once(spark):
    """Both sides are counted as they are computed: once per row."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        read.add(1)
        return x

    raw = spark.range(100).select(F.lit("d").alias("doc_id"), seen.asNondeterministic()("id").alias("n_raw_tokens"))
    known = spark.range(100).select(F.lit("d").alias("doc_id"), F.col("id").alias("n_raw_tokens"), F.lit("<explanation>\ne\n</explanation>").alias("response"))
    assert joins.prior_run_join(raw, known).count() == 100 and read.value == 100


def test_recover(spark):
    rows = [("t", "<explanation>\na\n</explanation>"), ("u", "<explanation></explanation>")]
    df = spark.createDataFrame(rows, "detokenized_text_truncated string, response string")
    good = joins.recover_cache(df.limit(1)).collect()
    assert [tuple(r) for r in good] == [("t", "a")]
    with pytest.raises(Exception, match="without an explanation"):
        joins.recover_cache(df).collect()


def test_overlap(spark):
    a = spark.createDataFrame([("x", 1, "t"), ("x", 2, "u"), ("y", 1, "v")], "doc_id string, n_raw_tokens long, detokenized_text_truncated string")
    b = spark.createDataFrame([("x", 1, "t"), ("x", 2, "changed"), ("z", 1, "w")], a.schema)
    got = joins.dataset_overlap(a, b).first().asDict()
    assert got == {"shared_docs": 1, "shared_keys": 2, "text_mismatches": 1, "only_left": 1, "only_right": 1}


# --- streams ------------------------------------------------------------------------


def test_explain_stream_takes_each_file_once(spark, rows, caches):
    src, dst, check = (scratch_path(spark, n) for n in ("src", "dst", "check"))
    rows.where("id < 70").repartition(3).write.parquet(src)
    cache = joins.cache_source(caches)

    def run():
        stream = explain_stream(spark, src, dst, check, rows.schema, StubCompleter(), cache, max_files=1)
        stream.awaitTermination()
        return {r.id: r.api_explanation for r in spark.read.parquet(dst).collect()}

    def batch(df):
        return {r.id: r.api_explanation for r in explain(df, cache, StubCompleter()).collect()}

    first = run()
    assert first == batch(rows.where("id < 70"))
    assert run() == first
    rows.where("id >= 70").write.mode("append").parquet(src)
    assert run() == batch(rows)
    assert spark.read.parquet(dst).count() == len(run())


def stored_bytes(path):
    return sum(os.path.getsize(f"{at}/{n}") for at, _, names in os.walk(path) for n in names)


def test_prefixes_are_stored_and_joined_beside_their_neighbours(spark):
    """Ten prefixes of a text that does not compress cost about one of them, in what is asked and in what comes out."""
    folder = scratch_path(spark, "packs").removeprefix("file:")
    scratch = os.path.dirname(folder)
    os.makedirs(scratch, exist_ok=True)
    docs = [(i, "".join(random.Random(i).choices("0123456789abcdef", k=4000))) for i in range(60)]
    texts = spark.createDataFrame(docs, "doc_id long, doc string").coalesce(2)
    cut = F.explode(F.sequence(F.lit(400), F.lit(4000), F.lit(400))).alias("n")
    table = f"{folder}-rows"
    texts.select("doc_id", "doc", cut).selectExpr("doc_id", "n", "left(doc, n) || 'xxxxx' AS detokenized_text_truncated").write.parquet(table)
    df = spark.read.parquet(table)
    store = AnswerStore(spark, f"{folder}-answers")
    before = set(os.listdir(scratch))
    rows = explain(df, None, StubCompleter(), store=store)
    made = set(os.listdir(scratch)) - before
    rows.write.option("compression", "zstd").parquet(f"{folder}-out")
    whole = sum(len(r[2]) for r in df.collect())
    assert whole > 1_300_000 and spark.read.parquet(f"{folder}-out").count() == 600
    assert made and sum(stored_bytes(f"{scratch}/{n}") for n in made) < whole / 2
    assert stored_bytes(f"{folder}-out") < whole / 3
    want = {(r.doc_id, r.n): r.api_explanation for r in explain(df, None, StubCompleter()).collect()}
    assert {(r.doc_id, r.n): r.api_explanation for r in rows.collect()} == want


def test_rows_joined_in_packs_equal_a_join(spark):
    """Repeated, NULL and unknown keys, keys found twice, and columns of every kind."""
    df = spark.range(500).select(
        F.when(F.col("id") % 9 > 0, F.concat(F.lit("k"), (F.col("id") % 37).cast("string"))).alias("key"),
        F.when(F.col("id") % 4 > 0, F.array(F.col("id"), F.lit(None))).alias("v"),
        F.struct(F.col("id").alias("n"), F.lit(float("nan")).alias("x")).alias("s"),
        F.col("id"),
    )
    known = spark.createDataFrame([(f"k{i}", f"e{i}-{j}") for i in range(0, 50, 2) for j in range(1 + i % 3)], "key string, e string")
    for rows in (1, 7, 128):
        packs = materialize(packed(df.repartition(3), "key", rows), "packs")
        found = pack_keys(packs, "key").join(known, "key")
        got = unpacked(packs, found, df.drop("key").schema, "key", "e")
        assert got.columns == ["key", "v", "s", "id", "e"]
        assert sorted(map(str, got.collect())) == sorted(map(str, df.join(known, "key").collect()))
        once = unpacked(packs, pack_keys(packs, "key").withColumn("e", F.lit("")), df.drop("key").schema, "key", "e", once=True)
        of_pack = [r.n for r in packs.select(F.size(F.array_distinct(F.array_compact("_keys"))).alias("n")).collect()]
        assert once.where("key IS NOT NULL").count() == sum(of_pack)


def test_explain_stream_reads_tables_in_one_file_and_in_many(spark):
    from actlens.catalog import QUERIES

    docs = [(i, f"document number {i} {'x' * (i % 13)}") for i in range(40)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    labels = spark.range(0, 40, 3).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    folder = scratch_path(spark, "many").removeprefix("file:")
    single = scratch_path(spark, "one").removeprefix("file:")
    for path in (folder, single):
        labels.write.parquet(f"{path}/labels.parquet")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs.toPandas().to_parquet(f"{single}/documents.parquet")
    for path in (folder, single):
        got = sorted(QUERIES["explain_stream"](spark, path).collect())
        assert got and got == sorted(QUERIES["explain"](spark, path).collect())


def test_reward_stream_equals_batch(spark):
    df = spark.range(50).select(
        "id",
        F.when(F.col("id") % 5 == 0, "TRUNCATED").otherwise("COMPLETED").alias("status"),
        F.concat(F.lit("<explanation>+"), F.col("id") % 4, F.lit("</explanation>")).alias("response"),
        F.array(*[F.rand(i).cast("float") for i in range(4)]).alias("activation_vector"),
    )
    src, dst, check = (scratch_path(spark, n) for n in ("src", "dst", "check"))
    df.repartition(4).write.parquet(src)
    stored = spark.read.parquet(src)
    stream = reward_stream(spark, src, dst, check, stored.schema, SignReconstructor(4), seconds=None)
    stream.awaitTermination()
    got = {r.id: r.reward for r in spark.read.parquet(dst).collect()}
    want = {r.id: r.reward for r in score_rollouts(stored, SignReconstructor(4)).collect()}
    assert got == pytest.approx(want) and len(got) == 50


def test_reward_stream_scores_a_micro_batch_on_all_cores(spark):
    src, dst, check = (scratch_path(spark, n).removeprefix("file:") for n in ("src", "dst", "check"))
    samples(spark, 0, 64).coalesce(1).write.parquet(src)
    stream = reward_stream(spark, src, dst, check, spark.read.parquet(src).schema, SignReconstructor(4), seconds=None)
    stream.awaitTermination()
    parts = [n for n in os.listdir(f"{dst}/batch=0") if n.startswith("part-")]
    assert len(parts) > 1 and spark.read.parquet(dst).count() == 64


# --- batches by number or time ----------------------------------------------------------


def samples(spark, lo, hi):
    return spark.range(lo, hi).select(
        F.col("id").alias("sample_id"),
        F.when(F.col("id") % 5 == 0, "TRUNCATED").otherwise("COMPLETED").alias("status"),
        F.concat(F.lit("<explanation>+"), F.col("id") % 4, F.lit("</explanation>")).alias("response"),
        F.array(*[F.rand(i).cast("float") for i in range(4)]).alias("activation_vector"),
        F.when(F.col("id") % 3 == 0, F.col("id")).alias("sometimes"),
    )


def wait_for(spark, path, rows, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        folders = [f"{path}/{n}" for n in os.listdir(path)] if os.path.isdir(path) else []
        done = [f for f in folders if os.path.exists(f"{f}/_SUCCESS")]
        found = spark.read.parquet(*done).collect() if done else []
        if len(found) >= rows:
            return found
        time.sleep(0.3)
    raise AssertionError(f"{len(found)} of {rows} rows")


def test_rewards_are_batched_by_number_or_time(spark):
    """Full batches at once, the rest after the timeout, a late sample in a short batch of its own."""
    src, dst, check = (scratch_path(spark, n).removeprefix("file:") for n in ("src", "dst", "check"))
    samples(spark, 0, 11).coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream = reward_batches(spark, src, dst, check, schema, SignReconstructor(4), size=4, seconds=2.0)
    try:
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
        first = wait_for(spark, dst, 11)
        assert sorted((r.batch_no, r.batch_size, r.cause) for r in first) == (
            [(0, 4, "size")] * 4 + [(1, 4, "size")] * 4 + [(2, 3, "time")] * 3
        )
        samples(spark, 11, 12).coalesce(1).write.mode("append").parquet(src)
        rows = wait_for(spark, dst, 12)
        assert {(r.sample_id, r.batch_no, r.batch_size, r.cause) for r in rows} >= {(11, 3, 1, "time")}
    finally:
        stream.stop()
    stored = spark.read.parquet(src)
    want = {r.sample_id: (r.reward, r.sometimes) for r in score_rollouts(stored, SignReconstructor(4)).collect()}
    got = {r.sample_id: (r.reward, r.sometimes) for r in rows}
    assert len(rows) == 12 and got.keys() == want.keys()
    assert all(got[i][0] == pytest.approx(want[i][0]) and got[i][1] == want[i][1] for i in want)


def test_reward_batches_bound_what_a_micro_batch_reads(spark, monkeypatch):
    """Three files that were there before the start come in three micro-batches, and all rows are scored."""
    src, dst, check = (scratch_path(spark, n).removeprefix("file:") for n in ("src", "dst", "check"))
    for i in range(3):
        samples(spark, 8 * i, 8 * i + 8).coalesce(1).write.mode("append").parquet(src)
    monkeypatch.setattr(jobs, "LANE_BYTES", 1)
    stream = reward_batches(
        spark, src, dst, check, spark.read.parquet(src).schema, SignReconstructor(4), size=8, seconds=60.0
    )
    try:
        rows = wait_for(spark, dst, 24)
        read = [p.numInputRows for p in stream.recentProgress if p.numInputRows]
    finally:
        stream.stop()
    assert {r.sample_id for r in rows} == set(range(24)) and max(read) == 8


def test_reward_batches_keep_one_or_two_state_partitions_a_lane(spark):
    """Two lanes with the caller's 4 partitions: a partition costs every micro-batch a task and a store."""
    src, dst, check = (scratch_path(spark, n).removeprefix("file:") for n in ("src", "dst", "check"))
    samples(spark, 0, 40).coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    before = spark.conf.get("spark.sql.shuffle.partitions")
    stream = reward_batches(spark, src, dst, check, schema, SignReconstructor(4), size=4, seconds=1.0, lanes=2)
    try:
        rows = wait_for(spark, dst, 40)
        state = [s for p in stream.recentProgress for s in p.stateOperators]
    finally:
        stream.stop()
    assert {s.numShufflePartitions for s in state} == {lane_partitions(spark, 2)} and lane_partitions(spark, 2) < 4
    assert lane_partitions(spark, 1) == 1
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert {r.sample_id for r in rows} == set(range(40))
    batches = Counter((r.lane, r.batch_no, r.batch_size) for r in rows)
    assert all(n == size for (_, _, size), n in batches.items())


def test_gathered_rows_keep_every_type(spark):
    """Rows are packed, wait and are unpacked as they were: nulls, NaN, nested and binary values."""
    src, out = (scratch_path(spark, n).removeprefix("file:") for n in ("src", "out"))
    df = spark.range(25).select(
        F.when(F.col("id") % 7 > 0, F.col("id")).alias("sample_id"),
        F.when(F.col("id") % 3 > 0, (F.col("id") / 0.7).cast("decimal(12,4)")).alias("money"),
        F.when(F.col("id") % 4 > 0, F.timestamp_micros(F.col("id") * 1234567891)).alias("at"),
        F.when(F.col("id") % 5 > 0, F.encode(F.col("id").cast("string"), "utf-8")).alias("raw"),
        F.array(F.lit(float("nan")).cast("float"), F.lit(None).cast("float"), F.rand(1).cast("float")).alias("v"),
        F.struct(F.col("id").alias("n"), F.create_map(F.lit("k"), F.col("id"))).alias("nested"),
        F.lit("").alias("empty"),
    )
    df.repartition(3).write.parquet(src)
    stored = spark.read.parquet(src)
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", jobs._STATE_STORE)
    source = own.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(src)
    stream = _by_batch(gathered(source, 4, 1.0, 3, "sample_id"), lambda b: b, out, scratch_path(spark, "check"))
    query = stream.trigger(processingTime="200 milliseconds").start()
    try:
        rows = wait_for(spark, out, 25)
    finally:
        query.stop()
    assert len(rows) == 25
    columns = stored.columns
    assert sorted(str(tuple(r[c] for c in columns)) for r in rows) == sorted(str(tuple(r)) for r in stored.collect())


def test_rewards_of_a_failing_model(spark):
    class Broken:
        def reconstruct(self, texts):
            if any("+1" in t for t in texts):
                raise RuntimeError("out of memory")
            import numpy as np

            return np.ones((len(texts), 4), np.float32)

    df = samples(spark, 0, 8).coalesce(1)
    rows = score_rollouts(df, Broken(), lenient=True).collect()
    assert {r.reward for r in rows} == {-2.0}
    with pytest.raises(Exception, match="out of memory"):
        score_rollouts(df, Broken()).collect()
