"""Statistics of a text that say something about its quality, computed in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

_CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "space": b" \t\n\r\x0b\x0c",
    "stop": b".,;:?",
    "loud": b"!",
    "mark": b"#$%&*+<=>@[\\]^_`{|}~/",
    "wide": bytes(range(128, 256)),
}
_OF_BYTE = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _OF_BYTE[list(_bytes), _i] = 1

STATS = (
    *(f"{name}_share" for name in _CLASSES),
    "n_words",
    "mean_word",
    "longest_word",
    "distinct_words",
    "adjacent_equal",
    "distinct_lines",
    "words_a_line",
    "stops_a_word",
)


def statistics(text: str | None) -> tuple[float, ...]:
    """The statistics of one text; all zero for a null or empty one."""
    raw = (text or "").encode()
    if not raw:
        return (0.0,) * len(STATS)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _OF_BYTE
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line]
    n = len(words)
    per_word = 1.0 / max(n, 1)
    return (
        *(shares / len(raw)),
        float(n),
        sum(map(len, words)) * per_word,
        float(max(map(len, words), default=0)),
        len(set(words)) * per_word,
        sum(map(eq, words, words[1:])) * per_word,
        len(set(lines)) / max(len(lines), 1),
        n / max(len(lines), 1),
        float(shares[4]) * per_word,
    )


@F.pandas_udf(StructType([StructField(name, DoubleType()) for name in STATS]))
def _statistics(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame(np.array([statistics(t) for t in batch]).reshape(-1, len(STATS)), columns=list(STATS))


def text_stats(text: Column) -> Column:
    """Struct of :data:`STATS`, all doubles, never null."""
    return _statistics(text)
