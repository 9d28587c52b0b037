"""Exact quantiles against numpy, for one group that holds all rows as for many."""

import random

import numpy as np
import pytest

from termlake.operators.quantiles import quantiles

NAMES = {"low": 0.25, "mid": 0.5, "high": 0.75, "first": 0.0, "last": 1.0, "odd": 0.37}
SCHEMA = "name string, kind int, x double"


def want(rows):
    groups = {}
    for name, kind, x in rows:
        if x is not None:
            groups.setdefault((name, kind), []).append(x)
    return {k: (len(v), *np.quantile(v, list(NAMES.values()))) for k, v in groups.items()}


def check(spark, rows):
    found = {(r.name, r.kind): tuple(r)[2:] for r in quantiles(spark.createDataFrame(rows, SCHEMA), ["name", "kind"], "x", NAMES).collect()}
    expected = want(rows)
    assert set(found) == set(expected)
    for k, v in expected.items():
        assert np.allclose(found[k], v), k


@pytest.mark.parametrize("values", [3, 10**9])
def test_against_numpy(spark, values):
    rng = random.Random(values)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), float(rng.randrange(values)) if rng.random() < 0.9 else None) for _ in range(3000)]
    check(spark, [*rows, ("one", 1, 5.0), ("two", 1, 1.0), ("two", 1, 4.0), ("none", 1, None), ("minus", None, -0.5), ("minus", None, -0.5)])


def test_one_group_with_all_rows_is_dealt_out(spark):
    """Ranges of the hot group's values: the largest holds less than three times the median."""
    rows = spark.range(60_000).selectExpr("'same' AS name", "1 AS kind", "cast(id * 7919 % 60000 AS double) AS x")
    row = quantiles(rows, ["name", "kind"], "x", NAMES).first()
    assert (row["low"], row["mid"], row["high"], row["first"], row["last"]) == (14999.75, 29999.5, 44999.25, 0, 59999)
    counts = rows.groupBy("name", "kind", "x").count().repartitionByRange(16, "name", "kind", "x").selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    sizes = sorted(r["count"] for r in counts)
    assert len(sizes) == 16 and sizes[-1] < 3 * sizes[8]


def test_empty(spark):
    assert quantiles(spark.createDataFrame([], SCHEMA), ["name", "kind"], "x", NAMES).count() == 0
