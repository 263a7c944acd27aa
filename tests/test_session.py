import os

import pytest

from loopline.session import drop_stage, shared_dir, stage


def test_stage_and_drop(spark, tmp_path):
    df = stage(spark.range(10), "x")
    assert df.count() == 10 and shared_dir(spark) in df.inputFiles()[0].replace("file:///", "file:///")
    other = str(tmp_path / "other")
    spark.range(3).write.parquet(other)
    mine = spark.read.parquet(other)
    drop_stage(mine)
    assert mine.count() == 3
    folder = os.path.dirname(df.inputFiles()[0]).replace("file://", "")
    assert os.path.isdir(folder)
    drop_stage(df)
    assert not os.path.exists(folder)
    with pytest.raises(Exception):
        df.count()
