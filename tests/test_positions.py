"""Line numbers, chunk splits, CSV splitting over blocks, and batches of exactly n lines."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from starlens.sources import positions as P
from starlens.sources import readers as RD
from starlens.sources.schema import PROJECTED_REVIEW
from starlens.streaming import rows as R


@pytest.fixture
def small_blocks(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "3000")
    spark.conf.set(keys[1], "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _write(lines_by_file, ending="\n"):
    d = tempfile.mkdtemp(prefix="starlens-test-")
    for name, lines in lines_by_file.items():
        with open(f"{d}/{name}", "w", encoding="utf-8", newline="") as f:
            f.write(ending.join(lines))
    return d


def _some_lines(n, seed):
    r = random.Random(seed)
    return [f"{i}:" + "é" * r.choice([0, 1, 5, 40, 300]) if r.random() > 0.1 else "" for i in range(n)] + ["end"]


def test_line_numbers_over_many_blocks(spark, small_blocks):
    files = {"a.txt": _some_lines(700, 1), "b.txt": _some_lines(3, 2), "c.txt": _some_lines(400, 3)}
    d = _write(files)
    n = P.numbered_lines(spark, d)
    assert P._blocks(spark, d).select("source_file", "_block").distinct().count() > 10
    got = {}
    for r in n.collect():
        got.setdefault(r.source.rsplit("/", 1)[1], {})[r.line_no] = r.value
    assert {f: [x[i] for i in range(len(x))] for f, x in got.items()} == files
    run_on = P.numbered_lines(spark, d, F.lit("all"))
    got = {r.line_no: r.value for r in run_on.collect()}
    assert [got[i] for i in range(len(got))] == [x for f in sorted(files) for x in files[f]]
    assert sorted(r.value for r in P.head_lines(n, 2).collect()) == sorted(x for v in files.values() for x in v[:2])
    head = P.head_rows(n.where("value <> ''"), 450).collect()
    assert sorted(r.value for r in head) == sorted([x for f in sorted(files) for x in files[f] if x][:450])


def test_resume_behind_what_is_done(spark, small_blocks):
    files = {"a.txt": _some_lines(200, 4), "b.txt": _some_lines(50, 5)}
    n = P.numbered_lines(spark, _write(files))
    first = P.resume_lines(n, P.lines_done(n.limit(0)), most=70)
    done = P.lines_done(first)
    rest = P.resume_lines(n, done)
    assert sorted(r.done for r in done.collect()) == [51, 70]
    assert rest.count() == 201 - 70
    assert sorted(r.value for r in first.unionByName(rest).collect()) == sorted(x for v in files.values() for x in v)


def test_chunks_are_split_on_their_own(spark):
    d = spark.createDataFrame([("s", i, "ab"[i % 3 == 0], i) for i in range(250)] + [("t", i, "a", 1000 + i) for i in range(30)], "source string, line_no long, kind string, key long")
    got = P.chunk_split(d, ["kind"], ["key"], chunk_rows=100).groupBy("source", "chunk", "kind").agg(F.count_if(F.col("split") == "train").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == 7 and all(r.t == int(0.8 * r.n) for r in got)
    assert {(r.source, r.chunk): 0 for r in got}.keys() == {("s", 0), ("s", 1), ("s", 2), ("t", 0)}


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_csv_split_equals_reading_each_file_whole(spark, small_blocks, ending):
    r = random.Random(7)
    header = ",".join(PROJECTED_REVIEW.fieldNames())
    field = lambda: r.choice(["", "x", "NA", '"a ""quoted"" word"', '"line one\nline two"', '"\n\n"', '"comma, here"', '"ends with ""\n"', "é" * 30, '"' + "long\n" * r.choice([3, 200]) + '"', '" pad "', '""'])
    files = {}
    for k in range(3):
        rows = [f"{r.randint(1, 5)},{i},0,1,{r.choice(['', '3'])},P{i},{field()},U{k},{i},{field()},{field()}" for i in range((300, 1, 40)[k])]
        files[f"f{k}.csv"] = [("﻿" if k == 1 else "") + header, *rows] + [""] * (k == 2)
    d = _write(files, ending)
    got = P.read_csv_split(spark, d, PROJECTED_REVIEW)
    whole = spark.read.schema(PROJECTED_REVIEW).option("header", True).option("multiLine", True).option("escape", '"').csv(d)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))
    assert spark.read.text(d).rdd.getNumPartitions() > 20
    assert sorted(map(repr, RD.read_reviews_csv(spark, d).collect())) == sorted(map(repr, RD.read_reviews_csv(spark, d, multi_line="whole").collect()))


def test_line_ends_and_ranges():
    d = _write({"a": ["x", "", "yy", "z"], "b": ["1", "2", ""], "_c": ["hidden"]})
    start = {"file": "", "byte": 0, "row": 0}
    (a, after), (b, end) = list(R.walk(d, start, 5))
    assert (a[1:], b[1:]) == ((0, 7, 0), (0, 2, 0)) and (after["row"], end["row"], end["byte"]) == (4, 1, 2)
    assert [x[0][1:] for x in R.walk(d, end, 5)] == [(2, 4, 1)]
    assert list(R.walk(d, {**end, "byte": 4, "row": 2}, 5)) == []


def test_batches_of_exactly_n_lines_go_on_inside_a_file(spark):
    lines = [f"line {i} " + "é" * (i % 50) for i in range(230)]
    src = _write({"part-0": lines[:150], "part-1": lines[150:]})
    top = tempfile.mkdtemp(prefix="starlens-test-")
    run = lambda **o: R.ingest_rows(spark, src, f"{top}/dst", f"{top}/ck", rows=40, **o)
    out = lambda: spark.read.parquet(f"{top}/dst").collect()
    run(batches=2)
    assert sorted(r.value for r in out()) == sorted(lines[:80])
    assert R.last_offset(spark, f"{top}/ck")["row"] == 80
    run()
    sizes = {}
    for r in out():
        sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
    assert sorted(r.value for r in out()) == sorted(lines)
    assert [n for _, n in sorted(sizes.items())] == [40, 40, 40, 40, 40, 30]
    with open(f"{src}/part-2", "w") as f:
        f.write("later\n")
    run()
    run()
    assert sorted(r.value for r in out()) == sorted([*lines, "later"])


def test_many_batches_go_through_one_trigger(spark):
    lines = [f"line {i}" for i in range(230)]
    src = _write({"part-0": lines[:150], "part-1": lines[150:]})
    top = tempfile.mkdtemp(prefix="starlens-test-")
    run = lambda **o: R.ingest_rows(spark, src, f"{top}/dst", f"{top}/ck", rows=20, together=5, **o)
    out = lambda: {r.value: r.batch_id for r in spark.read.parquet(f"{top}/dst").collect()}
    run(batches=2)
    assert out() == {x: i // 20 for i, x in enumerate(lines[:40])}
    run()
    assert out() == {x: i // 20 for i, x in enumerate(lines)}
    assert R.last_offset(spark, f"{top}/ck")["batch"] == 12
    assert len(spark.read.text(f"{top}/ck/commits", wholetext=True).collect()) == 3  # 2 batches, 5, 5
    with open(f"{src}/part-2", "w") as f:
        f.write("later\n")
    run()
    assert out()["later"] == 12 and len(out()) == 231
