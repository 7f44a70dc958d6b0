"""Stored tables: scopes of threads, settings while writing, folders that machines share, and what is left at the end."""

import os
import subprocess
import sys
import threading
from types import SimpleNamespace

import pytest

from sieveline import tables
from sieveline.sources import tables as folders


def there(table):
    return os.path.isdir(tables._places[table].removeprefix("file://"))


def test_scopes_of_threads_are_apart(spark):
    """A page's tables outlive a stage that runs in another thread, and go with their own scope."""
    made, ready, done = {}, threading.Event(), threading.Event()

    def page():
        with tables.scratch(spark):
            made["page"] = tables.stored(spark.range(3), "page")
            ready.set()
            done.wait(60)
            made["kept"] = there(made["page"]) and made["page"].count()

    other = threading.Thread(target=page)
    with tables.scratch(spark):
        other.start()
        ready.wait(60)
        made["stage"] = tables.stored(spark.range(5), "stage")
        with tables.scratch(spark):
            made["inner"] = tables.stored(spark.range(1), "inner")
        assert not there(made["inner"]) and there(made["stage"])
    assert not there(made["stage"])
    done.set()
    other.join()
    assert made["kept"] == 3 and not there(made["page"])


def test_settings_hold_while_any_table_is_written(spark):
    key = next(iter(tables.WRITING))
    before = spark.conf.get(key)
    held = tables._Settings()
    with held(spark):
        with held(spark):
            assert spark.conf.get(key) == tables.WRITING[key]
        assert spark.conf.get(key) == tables.WRITING[key]
    assert spark.conf.get(key) == before
    threads = [threading.Thread(target=lambda: tables.dropped(tables.stored(spark.range(9), "t"))) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert spark.conf.get(key) == before


def test_local_warehouse_of_a_cluster_is_refused(spark):
    class Conf:
        def get(self, key, default=None):
            return spark.conf.get(key) if key == "spark.sql.warehouse.dir" else default

    cluster = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master="spark://host:7077"), _jvm=spark._jvm, _jsc=spark._jsc)
    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_folder(cluster)


SAYS = """
from pyspark.sql import SparkSession
from sieveline.tables import stored
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{}").getOrCreate()
print(stored(spark.range(4), "left").count())
"""


def test_nothing_is_left_at_the_end(tmp_path):
    said = subprocess.run([sys.executable, "-c", SAYS.format(tmp_path)], capture_output=True, text=True, timeout=200, cwd=os.getcwd())
    assert said.stdout.strip() == "4", said.stderr[-1500:]
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("left")]


def test_a_task_reads_many_small_files(spark, tmp_path):
    """Each file counted as 4 MB before, so that 32 of them were a task, and three million would be 94,000 tasks."""
    names = spark.range(400).selectExpr("concat('k', id) AS key", "id")
    folders.write_json_by_key(names, str(tmp_path), "key")
    seen = []

    def counted(df, label):
        with tables._writing.setdefault(spark, tables._Settings())(spark):
            seen.append(df.rdd.getNumPartitions())
        return tables.stored(df, label)

    folders.stored, kept = counted, folders.stored
    try:
        back = folders.read_json_by_key(spark, str(tmp_path), "id long")
    finally:
        folders.stored = kept
    assert {(r.key, r.value.id) for r in back.collect()} == {(f"k{i}", i) for i in range(400)}
    assert seen[0] <= 8
