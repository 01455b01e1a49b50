"""Dataset manifests: constants and lineage stored beside the data as JSON."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field, is_dataclass, replace
from typing import Any, get_args, get_type_hints

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from actlens import __version__
from actlens.schemas import MANIFEST

KIND = "activation_dataset"
SCHEMA_VERSION = 1
TRAINING_STAGES = ("av_sft", "ar_sft", "rl")

_TRAINED = f"stage IN {TRAINING_STAGES}"
_MARKERS = "tokens.injection_token_id, tokens.injection_left_neighbor_id, tokens.injection_right_neighbor_id"
# What holds for every valid manifest, in SQL over its declared schema; NULL counts as broken.
RULES = {
    "kind": f"kind = '{KIND}'",
    "schema_version": f"schema_version = {SCHEMA_VERSION}",
    "tokens": f"NOT {_TRAINED} OR tokens IS NOT NULL",
    "marker_ids": f"NOT {_TRAINED} OR tokens IS NULL OR least({_MARKERS}) >= 0",
    "actor_template": f"NOT {_TRAINED} OR length(try_element_at(prompt_templates, 'actor')) > 0",
    "critic_suffix": "stage <> 'ar_sft' OR tokens.critic_suffix_ids IS NOT NULL",
    "critic_template": "stage <> 'ar_sft' OR length(try_element_at(prompt_templates, 'critic')) > 0",
}


@dataclass
class Extraction:
    """How the vectors were made."""

    base_model: str
    d_model: int
    layer_index: int
    norm: str
    corpus: str
    corpus_slice: dict[str, int]
    positions_per_doc: int


@dataclass
class TokenInfo:
    """Token ids that are constant over a dataset."""

    injection_char: str
    injection_token_id: int
    injection_left_neighbor_id: int
    injection_right_neighbor_id: int
    critic_suffix_ids: list[int] | None = None


@dataclass
class SummaryInfo:
    """Which completer wrote the explanations."""

    model: str
    max_tokens: int = -1
    temperature: float = -1.0
    instruction_prompt: str = ""


@dataclass
class Manifest:
    """Everything a reader has to know about a stored dataset."""

    dataset_id: str
    stage: str
    row_count: int
    extraction: Extraction
    kind: str = KIND
    schema_version: int = SCHEMA_VERSION
    keep_debug_metadata: bool = True
    tokens: TokenInfo | None = None
    prompt_templates: dict[str, str] = field(default_factory=dict)
    api_summaries: SummaryInfo | None = None
    parent_datasets: list[str] = field(default_factory=list)
    created_at: str = ""
    created_by: str = ""
    code_version: str = ""


def derive_manifest(parent: Manifest, **changes: Any) -> Manifest:
    """Copy of ``parent`` for a dataset made from it, without its time stamp."""
    changes.setdefault("parent_datasets", [parent.dataset_id])
    return replace(parent, created_at="", code_version="", **changes)


def derive_manifests(parents: DataFrame, id: Column, **changes: Column) -> DataFrame:
    """The same for a table of manifests; ``id`` and the changes are columns of the parents."""
    return parents.withColumns(
        {
            "parent_datasets": F.array("dataset_id"),
            "created_at": F.lit(""),
            "code_version": F.lit(""),
            "dataset_id": id,
            **changes,
        }
    )


def base_dataset_id(model: str, layer: int, corpus: str, start: int, length: int) -> str:
    """Id of a base dataset on the driver; the column form is :func:`dataset_id`."""
    content = f"{model}|{layer}|{corpus}|{ {'start': start, 'length': length} }"
    digest = hashlib.sha256(content.encode()).hexdigest()[:8]
    return f"base_{model.split('/')[-1]}_L{layer}_{digest}"


def dataset_id(model: Column, layer: Column, corpus: Column, start: Column, length: Column) -> Column:
    """Id of a base dataset as a column: model tag, layer and a hash of its slice."""
    content = F.format_string("%s|%d|%s|{'start': %d, 'length': %d}", model, layer, corpus, start, length)
    return F.concat(
        F.lit("base_"),
        F.substring_index(model, "/", -1),
        F.lit("_L"),
        layer.cast("string"),
        F.lit("_"),
        F.substring(F.sha2(content, 256), 1, 8),
    )


def manifest_frame(spark: SparkSession, manifests: list[Manifest]) -> DataFrame:
    """Manifests as a table; those without a time stamp or version get them."""
    utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    now = F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    rows = spark.createDataFrame([asdict(m) for m in manifests], MANIFEST)
    return rows.withColumns({
        name: F.when(F.length(name) > 0, F.col(name)).otherwise(value)
        for name, value in (("created_at", now), ("code_version", F.lit(__version__)))
    })


def rule_problems(manifests: DataFrame) -> DataFrame:
    """``dataset_id``, ``problem`` for each rule of ``RULES`` that a manifest breaks."""
    broken = [F.when(~F.coalesce(F.expr(holds), F.lit(False)), F.lit(name)) for name, holds in RULES.items()]
    return manifests.select("dataset_id", F.explode(F.array_compact(F.array(*broken))).alias("problem"))


def checked(manifests: DataFrame) -> DataFrame:
    """``manifests`` (a few) as they are; raises with all their problems."""
    found = rule_problems(manifests).collect()
    if found:
        raise ValueError("; ".join(f"manifest of {r.dataset_id!r} breaks rule {r.problem}" for r in found))
    return manifests


def manifest_path(path: str) -> str:
    """Where the manifest of a dataset lies: in a folder that table readers skip."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/_manifests/{name.replace('=', '-')}"


def write_manifests(manifests: DataFrame, folder: str) -> None:
    """Store a table of manifests as JSON, one per line."""
    manifests.write.mode("overwrite").json(folder)


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Stored manifests with the fixed schema; unknown keys are dropped."""
    return spark.read.schema(MANIFEST).json(folder)


def manifest_write(spark: SparkSession, manifest: Manifest, path: str) -> None:
    """Check and store the manifest of the dataset at ``path``."""
    write_manifests(checked(manifest_frame(spark, [manifest])).coalesce(1), manifest_path(path))


def manifest_read(spark: SparkSession, path: str) -> Manifest:
    """Load and check the manifest of the dataset at ``path``; unknown keys are dropped."""
    return as_object(checked(read_manifests(spark, manifest_path(path))).first())


def as_object(row: Row, kind: type = Manifest) -> Any:
    """A row of the declared schema as ``kind``; structs become the dataclasses its hints name, nulls the defaults."""
    hints = get_type_hints(kind)
    given = {}
    for name, value in row.asDict().items():
        if isinstance(value, Row):
            nested = [t for t in (hints[name], *get_args(hints[name])) if is_dataclass(t)]
            value = as_object(value, nested[0]) if nested else value.asDict()
        if value is not None:
            given[name] = value
    return kind(**given)


def parse_manifests(lines: DataFrame, col: str = "value") -> DataFrame:
    """Manifest table from JSON text, one manifest per row."""
    return lines.select(F.from_json(col, MANIFEST).alias("m")).select("m.*")


def pick_manifest(explicit: str | None, model: str | None, dataset: str | None) -> str:
    """Path whose manifest counts: an explicit one, else the model's, else the dataset's."""
    for path in (explicit, model, dataset):
        if path:
            return path.split("@[")[0]
    raise ValueError("no manifest to read: give a path, a model or a dataset")
