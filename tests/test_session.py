"""Written tables are removed when they are released, and a cluster needs a shared folder."""

from pathlib import Path
from types import SimpleNamespace

import pytest
from orebody.plans.session import materialise, release, shared_folder, written


def test_release(spark):
    mark = written(spark)
    df = materialise(spark.range(5), "five")
    assert df.count() == 5 and written(spark) == mark + 1
    path = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert path.exists()
    release(spark, mark)
    assert not path.exists() and written(spark) == mark


def test_cluster_without_a_shared_folder():
    nothing = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: nothing, master="spark://host:7077"), conf=nothing)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(cluster)
