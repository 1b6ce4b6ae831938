import types

import pytest

from tidemark import workspace
from tidemark.workspace import Workspace


def session(master, folder=None):
    conf = {"spark.checkpoint.dir": folder} if folder else {}
    return types.SimpleNamespace(
        conf=types.SimpleNamespace(get=lambda key, default=None: conf.get(key, default), set=conf.__setitem__),
        sparkContext=types.SimpleNamespace(master=master),
    )


def test_shared_folder():
    assert workspace.shared_folder(session("yarn", "hdfs://nn/shared/")) == "hdfs://nn/shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_folder(session("yarn"))
    local = session("local[2]")
    assert workspace.shared_folder(local) == workspace.shared_folder(local)


def test_keep_and_release(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "run"))
    kept = space.keep(spark.range(5), "numbers")
    assert kept.count() == 5 and kept.dtypes == [("id", "bigint")]
    space.release()
    assert not (tmp_path / "run").exists()
