"""The dataset build: sample, split, explain, build, shuffle, control.

The build is a table of steps: which stored tables a step makes and which it needs.
A table is stored once its manifest is, so a build that was cut off goes on with the
tables that are missing. Everything between two stored tables is one lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens import fixed_values as fv
from actlens import schemas
from actlens.functions import text as tx
from actlens.operators.batching import row_shuffle, vector_shuffle
from actlens.operators.joins import KEYS, cache_source, prior_run_join
from actlens.operators.sampling import doc_split, sampled_positions
from actlens.plans import build
from actlens.plans.explain import INSTRUCTION, explain
from actlens.slots import Completer, Encoder, Tokenizer, encode_positions, tokenize_with
from actlens.sources.answers import CHUNK, AnswerStore
from actlens.sources.corpus import corpus_slice
from actlens.sources.manifest import (
    Extraction,
    Manifest,
    SummaryInfo,
    TokenInfo,
    base_dataset_id,
    derive_manifest,
    manifest_read,
    manifest_write,
)
from actlens.sources.sinks import split_write, write_dataset

TABLES = ("av_sft", "ar_sft", "rl")
SUPERVISED = ("av_sft", "ar_sft")
FIGURES = "step string, figure string, value bigint"

# Keys of a nested config whose field has another name (a dot leads into a field of several values).
# Any field is also known by its own name.
KEYS_OF_CONFIG = {
    "corpus.name": "corpus",
    "corpus.split": "corpus_split",
    "corpus.start": "start",
    "corpus.length": "length",
    "corpus.text_column": "text_column",
    "stage0.positions_per_doc": "positions_per_doc",
    "stage0.seed": "seed",
    "stage0.partitions": "partitions",
    "stage1.av_sft_frac": "fractions.av_sft",
    "stage1.ar_sft_frac": "fractions.ar_sft",
    "stage1.rl_frac": "fractions.rl",
    "stage1.seed": "split_seed",
    "stage2.cache_from": "cache_from",
    "stage2.chunk_size": "texts_per_chunk",
    "stage2.instruction": "instruction",
    "stage2.pattern": "pattern",
    "stage2.min_features": "min_features",
    "stage2.prior.av_sft": "prior.av_sft",
    "stage2.prior.ar_sft": "prior.ar_sft",
    "stage3.keep_debug_metadata": "keep_debug",
    "stage3.actor_template": "actor_template",
    "stage3.critic_template": "critic_template",
    "stage3.injection_char": "injection_char",
    "shuffle.enabled": "shuffle",
    "shuffle.seed": "shuffle_seed",
    "control.enabled": "control",
    "control.seed": "control_seed",
}
# Settings of the plugged-in encoder and completer and of the storage, which come as objects and paths.
NOT_HERE = (
    "corpus.config", "stage0.chunk_size", "stage0.multigpu", "stage0.extractor_kwargs",
    "stage2.provider_cls", "stage2.provider_kwargs", "stage2.cache_storage_cls", "storage", "upload",
)


def _leaves(config: dict[str, Any], above: str = "") -> Iterator[tuple[str, Any]]:
    """Dotted keys and values of a nested config."""
    for key, value in config.items():
        if isinstance(value, dict):
            yield from _leaves(value, f"{above}{key}.")
        else:
            yield above + key, value


def _of_model(preset: str) -> dict[str, Any]:
    """Model name and layer (two thirds of its depth) of a preset."""
    try:
        name, layers, _ = fv.MODEL_PRESETS[preset]
    except KeyError:
        raise ValueError(f"no model preset {preset!r} among {', '.join(fv.MODEL_PRESETS)}") from None
    return {"base_model": name, "layer_index": 2 * layers // 3}


@dataclass
class BuildConfig:
    """Settings of one build.

    ``partitions`` spreads the documents over that many tasks before they are encoded; unset, the scan's
    splits stay. ``prior`` names, per supervised table, a training table of an earlier run whose
    explanations are taken instead of asking. ``control`` adds tables whose vectors are permuted.
    """

    output_dir: str
    base_model: str
    layer_index: int
    corpus: str
    corpus_split: str = "train"
    text_column: str = "text"
    start: int = 0
    length: int = 0
    positions_per_doc: int = 10
    seed: int = 42
    partitions: int | None = None
    split_seed: int | None = None
    fractions: dict[str, float] = field(
        default_factory=lambda: {"av_sft": 0.3, "ar_sft": 0.3, "rl": 0.4}
    )
    keep_debug: bool = True
    actor_template: str = fv.ACTOR_TEMPLATE
    critic_template: str = fv.CRITIC_TEMPLATE
    instruction: str = INSTRUCTION
    pattern: str = fv.RESPONSE_PATTERN
    min_features: int = fv.MIN_FEATURES
    texts_per_chunk: int = CHUNK
    injection_char: str = ""
    tokens: TokenInfo | None = None
    shuffle: bool = False
    shuffle_seed: int = 42
    control: bool = False
    control_seed: int = 42
    cache_from: list[str] = field(default_factory=list)
    prior: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, config: dict[str, Any], overrides: dict[str, Any] | None = None) -> BuildConfig:
        """Config from nested plain values; ``overrides`` have dotted keys and win.

        ``model`` names a preset, whose values every given key replaces. A key without a meaning is an error.
        """
        given = {**dict(_leaves(config)), **dict(_leaves(overrides or {}))}
        preset = given.pop("model", None)
        given = {**(_of_model(preset) if preset is not None else {}), **given}
        own = {f.name for f in fields(cls)}
        values: dict[str, Any] = {}
        unknown = []
        for key, value in given.items():
            if any(key == k or key.startswith(f"{k}.") for k in NOT_HERE):
                continue
            name, _, part = KEYS_OF_CONFIG.get(key, key).partition(".")
            if name not in own:
                unknown.append(key)
            elif value is not None:
                values[name] = {**values.get(name, {}), part: value} if part else value
        lacking = [n for n in ("output_dir", "base_model", "layer_index", "corpus") if n not in values]
        if unknown or lacking:
            raise ValueError(f"config: unknown keys {sorted(unknown)}, no value for {lacking}")
        if "tokens" in values:
            values["tokens"] = TokenInfo(**values["tokens"])
        return cls(**values)

    def path(self, name: str) -> str:
        """Where a stored table lies; the raw splits are folders of one write."""
        root = self.output_dir.rstrip("/")
        if name.endswith("_raw"):
            return f"{root}/splits/raw/bucket={name.removesuffix('_raw')}"
        return f"{root}/splits/{name}" if name.endswith("_explained") else f"{root}/{name}"


def marker_tokens(tokenizer: Tokenizer, actor: str, critic: str, char: str) -> TokenInfo:
    """Ids that are constant over a dataset, from its templates.

    The marker ``char`` must be one token that stands once in the actor's prompt, inside it. The suffix of
    the critic's prompt is the tail that its ids keep whatever explanation ends before it.
    """
    prompt = "".join(literal + (char if name else "") for literal, name in tx.template_parts(actor, {"injection_char"}))
    marker, ids = tokenizer.encode([char, prompt], False)
    places = [i for i, x in enumerate(ids) if list(marker) == [x]]
    if len(places) != 1 or not 0 < places[0] < len(ids) - 1:
        raise ValueError(f"the marker {char!r} is not one token inside the actor prompt")
    around = ids[places[0] - 1 : places[0] + 2]
    probes = [
        "".join(literal + (probe if name else "") for literal, name in tx.template_parts(critic, {"explanation"}))
        for probe in ("a", "Ends with 1.", "x)\n", "...")
    ]
    tails = [row[::-1] for row in tokenizer.encode(probes, False)]
    same = 0
    while same < min(map(len, tails)) and len({row[same] for row in tails}) == 1:
        same += 1
    if not same:
        raise ValueError("the critic prompt has no tail of its own after the explanation")
    return TokenInfo(char, around[1], around[0], around[2], [int(x) for x in tails[0][:same][::-1]])


def base_rows(
    docs: DataFrame, encoder: Encoder, k: int, seed: int, layer: int, seen: Observation | None = None
) -> DataFrame:
    """Base table of tokenized documents: one row per sampled position, with its vector.

    ``seen`` gets the number of documents, of those skipped and of those with fewer than ``k`` samples.
    """
    drawn = sampled_positions(docs, k, seed)
    if seen is not None:
        n = F.size("positions")
        drawn = drawn.observe(
            seen,
            F.count(F.lit(1)).alias("docs"),
            F.count_if(n <= 0).alias("docs_skipped"),
            F.count_if((n > 0) & (n < k)).alias("docs_short"),
        )
    encoded = encode_positions(drawn, encoder, layer)
    pairs = F.arrays_zip(F.col("positions").alias("position"), F.col("vectors").alias("vector"))
    return (
        encoded.withColumn("_doc", F.array_join("tokens", " "))
        .withColumn("_s", F.explode_outer(pairs))
        .where(F.col("_s.position").isNotNull())
        .withColumn("n_raw_tokens", F.col("_s.position") + 1)
        .select(
            "n_raw_tokens",
            tx.first_words(F.col("_doc"), F.col("n_raw_tokens")).alias("detokenized_text_truncated"),
            F.col("_s.vector").alias("activation_vector"),
            F.lit(layer).cast("bigint").alias("activation_layer"),
            "doc_id",
        )
    )


@dataclass(frozen=True)
class Step:
    """Stored tables made together, and the stored tables they are made from."""

    stage: str
    makes: tuple[str, ...]
    needs: tuple[str, ...]
    make: Callable[[], None]


class DatasetBuild:
    """One build on a corpus DataFrame (``doc_idx`` and the text column).

    With a ``tokenizer`` the token ids of the manifests come from it, and every critic prompt is checked
    for its suffix; without one they are the config's ``tokens``.
    """

    def __init__(
        self,
        spark: SparkSession,
        config: BuildConfig,
        corpus: DataFrame,
        encoder: Encoder,
        completer: Completer,
        tokenizer: Tokenizer | None = None,
    ):
        self.spark = spark
        self.config = config
        self.corpus = corpus
        self.encoder = encoder
        self.completer = completer
        self.tokenizer = tokenizer
        if tokenizer is None and config.tokens is None:
            raise ValueError("training tables need token ids: give a tokenizer, or tokens in the config")

    def steps(self) -> list[Step]:
        """The table of steps that the config asks for."""
        c = self.config
        raw = tuple(f"{t}_raw" for t in TABLES)
        out = [Step("sample", ("base",), (), self._sample), Step("split", raw, ("base",), self._split)]
        for t in SUPERVISED:
            ask = self._reuse if t in c.prior else self._explain
            out.append(Step("explain", (f"{t}_explained",), (f"{t}_raw",), lambda t=t, ask=ask: ask(t)))
        for t in TABLES:
            source = f"{t}_explained" if t in SUPERVISED else f"{t}_raw"
            out.append(Step("build", (t,), (source,), lambda t=t, source=source: self._build(t, source)))
            if c.shuffle:
                out.append(Step("shuffle", (f"{t}_shuf",), (t,), lambda t=t: self._shuffle(t)))
            if c.control:
                out.append(Step("control", (f"{t}_control",), (t,), lambda t=t: self._control(t)))
        return out

    def run(self, *tables: str, again: Iterable[str] = ()) -> dict[str, Manifest]:
        """Make ``tables`` and what they need and lack; returns their manifests.

        Without ``tables``, all that no other table is made from. Stored tables are kept, but for
        those of the stages in ``again`` and all that follow from them.
        """
        steps = self.steps()
        maker = {t: s for s in steps for t in s.makes}
        tables = tables or tuple(t for t in maker if not any(t in s.needs for s in steps))
        unknown = [t for t in tables if t not in maker] + [s for s in again if s not in {x.stage for x in steps}]
        if unknown:
            raise ValueError(f"unknown tables or stages {unknown}, have {list(maker)}")
        redo = set(again)
        done: set[tuple[str, ...]] = set()

        def stale(step: Step) -> bool:
            return step.stage in redo or any(stale(maker[n]) for n in step.needs)

        def ensure(table: str) -> None:
            step = maker[table]
            if step.makes in done or not stale(step) and all(self.stored(t) for t in step.makes):
                return
            for need in step.needs:
                ensure(need)
            step.make()
            done.add(step.makes)

        for table in tables:
            ensure(table)
        return {t: self.stored(t) for t in tables}

    def stored(self, name: str) -> Manifest | None:
        """Manifest of a stored table, None where there is none."""
        try:
            return manifest_read(self.spark, self.config.path(name))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def figures(self) -> DataFrame:
        """``step``, ``figure``, ``value``: documents skipped and short, rows without explanation by reason."""
        return self.spark.read.schema(FIGURES).option("recursiveFileLookup", "true").parquet(self.config.path("figures"))

    def _note(self, step: str, rows: DataFrame) -> None:
        """Store the figures (``figure``, ``value``) of a step."""
        columns = [F.lit(step).alias("step"), "figure", F.col("value").cast("bigint").alias("value")]
        rows.select(*columns).coalesce(1).write.mode("overwrite").parquet(f"{self.config.path('figures')}/{step}")

    def _read(self, name: str) -> tuple[DataFrame, Manifest]:
        path = self.config.path(name)
        return self.spark.read.parquet(path), manifest_read(self.spark, path)

    def _sample(self) -> None:
        """Sampled positions with vectors."""
        c = self.config
        chosen = corpus_slice(self.corpus, c.start, c.length)
        if c.partitions:
            chosen = chosen.repartition(c.partitions, "doc_idx")
        docs = chosen.select(
            tx.doc_key(c.corpus, c.corpus_split, F.col("doc_idx")).alias("doc_id"),
            tx.tokenize(F.col(c.text_column)).alias("tokens"),
        )
        seen = Observation()
        rows = base_rows(docs, self.encoder, c.positions_per_doc, c.seed, c.layer_index, seen)
        manifest = Manifest(
            dataset_id=base_dataset_id(c.base_model, c.layer_index, c.corpus, c.start, c.length),
            stage="base",
            row_count=0,
            extraction=Extraction(
                base_model=c.base_model,
                d_model=self.encoder.d_model,
                layer_index=c.layer_index,
                norm="none",
                corpus=c.corpus,
                corpus_slice={"start": c.start, "length": c.length},
                positions_per_doc=c.positions_per_doc,
            ),
            created_by="sample",
        )
        stored = write_dataset(rows, c.path("base"), schemas.BASE, manifest)
        found = {**seen.get, "rows": stored.row_count}
        self._note("sample", self.spark.createDataFrame(list(found.items()), "figure string, value bigint"))

    def _split(self) -> None:
        """Three tables that share no document, written in one pass."""
        c = self.config
        base, manifest = self._read("base")
        if manifest.stage != "base":
            raise ValueError(f"expected a base dataset, got {manifest.stage!r}")
        root = c.path("av_sft_raw").rpartition("/")[0]
        seed = c.seed if c.split_seed is None else c.split_seed
        split_write(doc_split(base, c.fractions, seed), root)
        sizes = {r.bucket: r["count"] for r in self.spark.read.parquet(root).groupBy("bucket").count().collect()}
        for table in TABLES:
            child = derive_manifest(
                manifest,
                dataset_id=f"{manifest.dataset_id}__{table}_raw",
                row_count=sizes.get(table, 0),
                created_by="split",
            )
            manifest_write(self.spark, child, c.path(f"{table}_raw"))

    def _store_explained(self, table: str, rows: DataFrame, manifest: Manifest, **changes: Any) -> None:
        path = self.config.path(f"{table}_explained")
        child = derive_manifest(manifest, dataset_id=f"{manifest.dataset_id}__explained", **changes)
        if write_dataset(rows, path, schemas.EXPLAINED, child).row_count == 0:
            raise ValueError(f"{table}: every row was dropped, check template and tags")

    def _explain(self, table: str) -> None:
        """Explanations from caches, the store of earlier answers, and the completer."""
        c = self.config
        raw, manifest = self._read(f"{table}_raw")
        caches = [self.spark.read.schema(schemas.CACHE).parquet(p) for p in c.cache_from]
        cache = cache_source(caches) if caches else None
        store = AnswerStore(self.spark, c.path(f"answers/{table}"))
        rows = explain(
            raw, cache, self.completer, c.instruction, c.pattern, c.min_features, store=store, per_chunk=c.texts_per_chunk
        )
        drops = self.spark.read.parquet(f"{store.path}/drops")
        by_reason = drops.groupBy(F.concat(F.lit("dropped_"), "reason").alias("figure"))
        self._note(f"explain_{table}", by_reason.agg(F.sum("row_count").alias("value")))
        info = SummaryInfo(model=type(self.completer).__name__, instruction_prompt=c.instruction)
        self._store_explained(table, rows, manifest, api_summaries=info, created_by="explain")

    def _reuse(self, table: str) -> None:
        """Explanations of an earlier run, by exact key; nothing is asked."""
        c = self.config
        raw, manifest = self._read(f"{table}_raw")
        prior = self.spark.read.parquet(c.prior[table])
        rows = prior_run_join(raw, prior, c.critic_template)
        counts = rows.agg(F.lit("rows_reused").alias("figure"), F.count(F.lit(1)).alias("value"))
        self._note(f"explain_{table}", counts)
        self._store_explained(table, rows, manifest, created_by="reuse")

    def tokens(self) -> TokenInfo:
        """Token ids of the manifests."""
        c = self.config
        if self.tokenizer is None or c.tokens is not None:
            return c.tokens
        return marker_tokens(self.tokenizer, c.actor_template, c.critic_template, c.injection_char)

    def _build(self, table: str, source: str) -> None:
        """A training table."""
        c = self.config
        rows, manifest = self._read(source)
        build.stage_guards(manifest, rows, table)
        tokens = self.tokens()
        made = {
            "av_sft": lambda: build.build_av(rows, c.actor_template, c.keep_debug),
            "rl": lambda: build.build_rl(rows, c.actor_template, c.keep_debug),
            "ar_sft": lambda: build.build_ar(rows, c.critic_template, c.keep_debug, *self._suffix(tokens)),
        }[table]()
        child = derive_manifest(
            manifest,
            dataset_id=f"{table}_{manifest.dataset_id.removeprefix('base_')}",
            stage=table,
            keep_debug_metadata=c.keep_debug,
            tokens=tokens,
            prompt_templates={"actor": c.actor_template, "critic": c.critic_template},
            created_by="build",
        )
        write_dataset(made, c.path(table), schemas.stage_schema(table, c.keep_debug), child)

    def _suffix(self, tokens: TokenInfo) -> tuple:
        """The suffix to check and its tokenizer; nothing without one."""
        if self.tokenizer is None:
            return ()
        return tokens.critic_suffix_ids, tokenize_with(self.tokenizer, add_special=False)

    def _follow(self, table: str, made: DataFrame, name: str, mark: str, *more: T.StructField) -> None:
        """Store a reordered form of a training table."""
        child = derive_manifest(
            self.stored(table), dataset_id=f"{self.stored(table).dataset_id}__{mark}", created_by=name
        )
        schema = T.StructType([*schemas.stage_schema(table, self.config.keep_debug).fields, *more])
        write_dataset(made, self.config.path(f"{table}_{name}"), schema, child)

    def _shuffle(self, table: str) -> None:
        """Rows in seeded order, with their rank."""
        seed = self.config.shuffle_seed
        rows, manifest = self._read(table)
        mixed = row_shuffle(rows, KEYS, seed, manifest.dataset_id)
        self._follow(table, mixed, "shuf", f"shuf{seed}", T.StructField("shuffle_rank", T.LongType()))

    def _control(self, table: str) -> None:
        """The same rows with the vectors of others."""
        seed = self.config.control_seed
        rows, manifest = self._read(table)
        self._follow(table, vector_shuffle(rows, KEYS, seed, manifest.dataset_id), "control", f"control{seed}")
