"""Queries do the whole job: landing in many tasks, the full forest."""

import glob
import re

import pytest
from conftest import SF_SMALL

from starlens.plans import io as IO
from starlens.plans import ml as ML


@pytest.mark.parametrize("query, folder", [("manifest_incremental", "manifest"), ("file_status_partitioned", "part-status-src")])
def test_reviews_land_in_many_tasks(spark, monkeypatch, query, folder):
    paths, records, scratch = {}, IO.scored_records, IO.scratch_path

    def path(spark, name):
        paths[name] = scratch(spark, name)
        return paths[name]

    monkeypatch.setattr(IO, "scored_records", lambda spark, sf: records(spark, sf).repartition(3))
    monkeypatch.setattr(IO, "scratch_path", path)
    n = sum(r.n_rows for r in getattr(IO, query)(spark, SF_SMALL).collect())
    assert n == records(spark, SF_SMALL).count()
    files = glob.glob(re.sub("^file:/*", "/", paths[folder]) + "/category=*/part-*")
    assert len({re.search(r"part-(\d+)", f)[1] for f in files}) == 3


def test_rf_check_fits_the_whole_forest(spark, monkeypatch):
    class Asked(Exception):
        pass

    def fit(train, target, features, seed=42, trees=100, depth=15):
        raise Asked(trees, depth)

    monkeypatch.setattr(ML, "_numeric_products", lambda spark, sf: (None, None))
    monkeypatch.setattr(ML.M, "fit_forest", fit)
    with pytest.raises(Asked) as asked:
        ML.rf_check(spark, SF_SMALL)
    assert asked.value.args == (100, 15)


def test_more_centroids_than_one_matrix_holds(spark):
    import random

    from starlens.operators import models as M

    r = random.Random(3)
    rows = [(i, [r.choice([0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    cents = spark.createDataFrame([(f"c{i:02d}", [r.choice([0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(20)], "name string, centroid array<double>")
    whole = {x.id: x.cluster for x in M.nearest_centroid(df, cents, "v", "name").collect()}
    held = [(x["name"], x["centroid"]) for x in cents.collect()]
    assert whole == {i: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in held)[1] for i, v in rows}
    assert {x.id: x.cluster for x in M.nearest_centroid(df, cents, "v", "name", most_bytes=100).collect()} == whole


def test_a_fresh_checkpoint_does_not_bring_back_an_older_result(spark, tmp_path):
    from starlens.streaming.ingest import read_latest, write_version

    dst = str(tmp_path / "out")
    for version in range(3):
        write_version(spark.range(30), dst, version, "first")
    write_version(spark.range(7), dst, 0, "second")
    assert read_latest(spark, dst).count() == 7
