"""Shared folder, deletion of written tables and the in-place overwrite."""

import os

import pytest
from pyspark.sql import functions as F

from patchloom import session
from patchloom.sources import writers


def test_folder_is_needed_where_executors_have_their_own_disks():
    for master in ("local", "local[8]", "local[*]"):
        assert session._test_dir(master)
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session._test_dir(master)


def test_written_tables_can_be_dropped(spark):
    df = session.written(spark.range(10))
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    assert session.drop_written(spark) >= 1 and not os.path.exists(path)


def test_overwrite_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    writers.overwrite_in_place(spark.read.parquet(path).select((F.col("id") + 1).alias("id")), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 5]
    fails = spark.read.parquet(path).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        writers.overwrite_in_place(fails, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 5]
    assert os.listdir(tmp_path) == ["t"]
    writers.overwrite_in_place(spark.range(2), str(tmp_path / "new"))
    assert spark.read.parquet(str(tmp_path / "new")).count() == 2
