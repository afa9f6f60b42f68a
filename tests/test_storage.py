"""Stored tables: resumed stages and clean-up."""

import os
import time

from pyspark.sql import functions as F

from colinear import storage


def stages(folder):
    return sorted(os.listdir(f"{folder}/stages")) if os.path.isdir(f"{folder}/stages") else []


def test_a_finished_stage_is_read_and_not_computed_again(spark, tmp_path):
    source, folder = str(tmp_path / "in"), f"file://{tmp_path}/out"
    spark.range(10).write.parquet(source)
    plan = lambda: spark.read.parquet(source).select((F.col("id") * 2).alias("x"))
    first = storage.resumed(plan(), "double", folder)
    made = stages(tmp_path / "out")
    when = os.path.getmtime(tmp_path / "out" / "stages" / made[0] / "_SUCCESS")
    assert sorted(r.x for r in first.collect()) == [2 * i for i in range(10)] and len(made) == 1
    time.sleep(1.1)
    assert storage.resumed(plan(), "double", folder).count() == 10
    assert stages(tmp_path / "out") == made and os.path.getmtime(tmp_path / "out" / "stages" / made[0] / "_SUCCESS") == when
    storage.resumed(plan(), "double", folder, cache=False)
    assert os.path.getmtime(tmp_path / "out" / "stages" / made[0] / "_SUCCESS") > when


def test_other_plans_files_and_cut_off_runs_are_computed(spark, tmp_path):
    source, folder = str(tmp_path / "in"), f"file://{tmp_path}/out"
    spark.range(10).write.parquet(source)
    storage.resumed(spark.read.parquet(source), "s", folder)
    storage.resumed(spark.read.parquet(source).where("id > 3"), "s", folder)
    assert len(stages(tmp_path / "out")) == 2
    spark.range(5).write.mode("append").parquet(source)
    assert storage.resumed(spark.read.parquet(source), "s", folder).count() == 15 and len(stages(tmp_path / "out")) == 3
    for name in stages(tmp_path / "out"):
        os.remove(tmp_path / "out" / "stages" / name / "_SUCCESS")
    assert storage.resumed(spark.read.parquet(source), "s", folder).count() == 15 and len(stages(tmp_path / "out")) == 3


def test_sweep_deletes_what_was_stored(spark):
    storage.sweep(spark)
    df = storage.stored(spark.range(3), "gone")
    path = storage._WRITTEN[-1].removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    assert storage.sweep(spark) == 1 and not os.path.exists(path)
