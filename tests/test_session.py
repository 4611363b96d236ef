"""Cluster-only shuffle sizing: decided from the session, never overriding what the cluster set."""

import pytest

from starlens.session import ADVISORY_PARTITION_BYTES, PARTITIONS_PER_CORE, ensure_checkpoint_dir, size_shuffles


class _Conf:
    def __init__(self, values):
        self.values = dict(values)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _Ctx:
    def __init__(self, master, cores):
        self.master, self.defaultParallelism = master, cores


class _Session:
    def __init__(self, master, cores, conf=()):
        self.sparkContext, self.conf = _Ctx(master, cores), _Conf(conf)


def test_cluster_session_starts_shuffles_wide():
    s = _Session("yarn", 8000)
    size_shuffles(s)
    assert s.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == str(PARTITIONS_PER_CORE * 8000)
    assert s.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == ADVISORY_PARTITION_BYTES
    assert s.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"


def test_cluster_settings_are_kept():
    s = _Session("k8s://x", 64, {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4096",
                                 "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
                                 "spark.sql.shuffle.partitions": "20000"})
    size_shuffles(s)
    assert s.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "4096"
    assert s.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "256m"


def test_shuffle_partitions_floor():
    s = _Session("spark://m:7077", 2, {"spark.sql.shuffle.partitions": "20000"})
    size_shuffles(s)
    assert s.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "20000"


def test_local_session_untouched():
    s = _Session("local[8]", 8)
    size_shuffles(s)
    assert s.conf.values == {}


def test_cluster_without_a_shared_folder_is_refused():
    for master in ("yarn", "spark://m:7077", "local-cluster[3,2,1024]"):
        s = _Session(master, 8)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(s)
        assert s.conf.values == {}


def test_scratch_has_an_owner_and_can_be_removed(spark):
    from starlens.session import materialise, remove_scratch, scratch_path, scratch_root

    df = materialise(spark.range(3), "owned")
    assert df.count() == 3 and df.inputFiles()[0].split(":", 1)[-1].lstrip("/").startswith(scratch_root(spark).split(":", 1)[-1].lstrip("/"))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    other = spark.newSession()
    assert scratch_root(other) == scratch_root(spark) and callable(remove_scratch)
