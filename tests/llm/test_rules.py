"""The compiled rule column against the plain score."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlens.llm.rule_ensemble import Condition, RuleModel
from actlens.llm.text_stats import STATS


@pytest.mark.parametrize("rules", [0, 1, 300])
def test_compiled_rules(spark, rules):
    """Any number of rules of any length; values on the thresholds fall below."""
    rng = np.random.default_rng(rules)
    values = rng.normal(size=(200, len(STATS))).round(2)
    made = []
    for _ in range(rules):
        features = rng.integers(0, len(STATS), rng.integers(1, 5))
        conditions = tuple(
            Condition(int(f), float(values[rng.integers(0, 200), f]), bool(rng.integers(0, 2))) for f in features
        )
        made.append((conditions, float(rng.normal())))
    model = RuleModel(-0.3, made, STATS)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    stats = F.struct(*[F.get("v", F.lit(i)).alias(name) for i, name in enumerate(STATS)]).alias("stats")
    got = df.select("id", stats).select("id", model.column("stats").alias("score")).orderBy("id").collect()
    assert np.allclose([r.score for r in got], model.score(values), atol=1e-12)
