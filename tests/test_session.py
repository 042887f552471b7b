import pytest

from barloom.session import drop_staged, ensure_checkpoint_dir, stage_table
from tests.conftest import rows


def test_staged_tables(spark, tmp_path):
    t = stage_table(spark.range(3), "x")
    assert rows(t) == [(0,), (1,), (2,)] and drop_staged(spark) >= 1 and drop_staged(spark) == 0
    assert stage_table(spark.range(0), "empty").count() == 0


def test_the_session_names_the_folder():
    class Context:
        folder = None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder + "/own"

    class Session:
        sparkContext = Context()

        def __init__(self, given):
            self.conf = {"spark.checkpoint.dir": given} if given else {}

    cluster = Session(None)
    cluster.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(cluster)
    Session.sparkContext = Context()
    assert ensure_checkpoint_dir(Session("file:///shared")) == "file:///shared"
    Session.sparkContext = Context()
    assert ensure_checkpoint_dir(Session(None), "/tmp/x") == "/tmp/x/own"
