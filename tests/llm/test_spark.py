import os

import pytest

from voltlake.llm._spark import cut, shared_dir


class Context:
    """A context of some master, without a shared folder."""

    applicationId = "none"

    def __init__(self, master):
        self.master = master

    def getConf(self):
        return {}

    def getCheckpointDir(self):
        return None


class Session:
    conf = {}

    def __init__(self, master):
        self.sparkContext = Context(master)


@pytest.mark.parametrize("master", ["spark://h:7077", "yarn", "k8s://https://h", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_its_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session(master))


def test_a_table_is_written_and_reread(spark):
    df = cut(spark.range(5).selectExpr("id", "cast(null as string) as none"), "test")
    assert df.count() == 5 and df.dtypes == [("id", "bigint"), ("none", "string")]
    assert any("voltlake-test-" in f for f in df.inputFiles())
    assert os.path.isdir(shared_dir(spark).removeprefix("file:"))
