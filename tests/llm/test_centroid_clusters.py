import hashlib
import math
import random

import numpy as np
import pytest

from termlake.llm.centroid_clusters import LARGEST, SIZE, clustered, limbs, nearest, screened
from termlake.llm.queries import ORACLES, QUERIES

from ..test_queries import oracle, table  # noqa: F401
from .helpers import SF

SCHEMA = "vec_id long, embedding array<double>, cluster int, label int"


def brute(rows, clusters=8, rounds=10):
    """The contract in Python's integers, row by row."""
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**52 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == SIZE and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [q for _, q in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c)), k) for k, c in enumerate(cents)) for _, q in kept]

    for _ in range(rounds):
        found = assign()
        for k in range(len(cents)):
            mine = [q for (_, q), (_, at) in zip(kept, found) if at == k]
            if mine:
                cents[k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    inertia = [sum(d for d, at in found if at == k) for k in range(len(cents))]
    long = lambda x: x if x < 2**63 else None
    return [
        (i, k, long(d), long(inertia[k]), long(sum(inertia)), hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, found)
    ]


def run(spark, rows):
    return [tuple(r) for r in clustered(spark.createDataFrame([(i, v, 5, 1) for i, v in rows], SCHEMA))[0].collect()]


def ordered(rows):
    return sorted(rows, key=str)


def test_equals_brute_force_with_ties_and_edge_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) if i % 3 else rng.gauss(0, 1) for _ in range(SIZE)]) for i in range(160)]
    rows += [(900 + i, [float(i % 2)] * SIZE) for i in range(40)]  # equal vectors, equally far from others
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, rows[10][1])]
    rows += [(300, None), (301, []), (302, [0.0] * 63), (303, [0.0] * 65), (304, [0.0] * 63 + [None]), (305, [float("nan")] + [0.0] * 63), (306, [0.0] * 63 + [float("-inf")])]
    assert ordered(run(spark, rows)) == ordered(brute(rows))


def test_huge_components_stay_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * 10 ** rng.choice([0, 3, 12, 40, 300]) for _ in range(SIZE)]) for i in range(30)]
    found, want = ordered(run(spark, rows)), ordered(brute(rows))
    assert found == want and any(r[2] is None for r in found)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    rows = [(i, [float(i)] * SIZE) for i in range(n)]
    assert ordered(run(spark, rows)) == ordered(brute(rows))


def test_intervals_hold_the_exact_values_and_ties_go_to_the_lowest_number():
    rng = np.random.default_rng(6)
    for scale in (3, 1000, 1 << 20, LARGEST):
        q, c = (rng.integers(-scale, scale + 1, (n, SIZE)) for n in (500, 9))
        c[5] = c[2]
        c[7] = c[2]
        c[7, 0] += 1  # differs by one unit
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, z)) for z in c] for v in q]
        may = screened(q, c)
        best, distance = nearest(q, c)
        for row, far in enumerate(exact):
            assert may[row, [k for k, d in enumerate(far) if d == min(far)]].all()
            assert (distance[row], best[row]) == min((d, k) for k, d in enumerate(far))
    small = rng.integers(-400, 400, (2000, SIZE))
    assert screened(small, small[:8]).sum() < 2100  # the intervals are narrow: hardly a row is computed again


def test_digits_of_sums():
    for value in (0, 1, -1, 2**32, -(2**32), 2**63 - 1, -(2**63), 10**40, -(10**40)):
        assert sum(d << 32 * i for i, d in enumerate(limbs(value))) == value
        assert all(abs(d) <= 2**32 for d in limbs(value))


def test_equals_sql(spark, oracle):  # noqa: F811
    name = "op12_centroid_clusters"
    assert table(QUERIES[name](spark, SF).toPandas()) == table(oracle.execute(ORACLES[name]).df())
