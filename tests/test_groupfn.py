"""A user's group function: states per task, merged in two steps, equal to the function over whole groups."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from starlens.operators import groupfn as G


def _parts():
    """(init, update, merge, finish): rows, the three least values and the total; made here so that they travel by value."""

    def update(state, rows):
        v = [x for x in rows.column("v").to_pylist() if x is not None]
        return (state[0] + rows.num_rows, sorted(set(state[1]) | set(v))[:3], state[2] + math.fsum(v))

    def merge(a, b):
        return (a[0] + b[0], sorted(set(a[1]) | set(b[1]))[:3], a[2] + b[2])

    return lambda: (0, [], 0.0), update, merge, lambda s: {"n": s[0], "least": s[1], "total": s[2]}


def _run(df, **options):
    return G.group_apply(df, ["g", "h"], ["v"], *_parts(), "n long, least array<double>, total double", **options)


def test_equals_the_function_over_whole_groups(spark):
    rows = [(None if i % 11 == 0 else ("hot" if i % 3 == 0 else f"g{i % 40}"), i % 2, None if i % 7 == 0 else float(i % 97)) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(6)
    groups = defaultdict(list)
    for g, h, v in rows:
        groups[g, h].append(v)
    want = sorted((str(k), len(v), sorted({x for x in v if x is not None})[:3], math.fsum(x for x in v if x is not None)) for k, v in groups.items())
    for options in ({}, {"max_states": 3, "fan": 2}):
        got = sorted((str((r.g, r.h)), r.n, r.least, r.total) for r in _run(df, **options).collect())
        assert got == want


def test_a_hot_group_is_one_state_a_task(spark):
    df = spark.range(30_000).select(F.lit("hot").alias("g"), F.lit(1).alias("h"), F.col("id").cast("double").alias("v")).repartition(5)
    assert G.task_states(df, ["g", "h"], ["v"], *_parts()[:2]).count() == 5
    assert _run(df).first()["n"] == 30_000


def test_empty_table(spark):
    assert _run(spark.createDataFrame([], "g string, h int, v double")).collect() == []
