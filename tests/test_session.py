"""Durable tables between stages."""

import os

import pytest

from rastrel import session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Fake:
    """As much of a session as ``shared_dir`` reads."""

    def __init__(self, master, **conf):
        self.conf = Conf(conf)
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"app-{master}"})()


def test_the_shared_folder_is_the_session_s_own():
    assert session.shared_dir(Fake("spark://x", **{"spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake("spark://x"))
    one = session.shared_dir(Fake("local[2]"))
    assert os.path.isdir(one) and session.shared_dir(Fake("local[2]")) == one


def test_cut_tables_are_read_back_and_deleted(spark):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    one = session.cut(spark.range(10).selectExpr("id", "id % 3 as k"))
    path = one.rastrel_path.removeprefix("file:")
    two = session.cut(one.groupBy("k").count(), one)
    assert not os.path.exists(path) and sorted(r["count"] for r in two.collect()) == [3, 3, 4]
    session.release(two, spark.range(1))
    assert not hasattr(two, "rastrel_path") and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before
