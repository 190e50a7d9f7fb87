"""Staged tables and bounded parameters."""

import os

import pytest

from glyphmill.plans import drop_stages, shared_dir, stage
from glyphmill.queries import bounded


def test_stages_are_dropped(spark):
    drop_stages(spark)
    staged = stage(spark.range(3), "numbers")
    path = staged.inputFiles()[0].removeprefix("file://")
    assert staged.count() == 3 and os.path.exists(path)
    assert drop_stages(spark) == 1 and not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        pass

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        shared_dir(Session)
    Session.conf["spark.checkpoint.dir"] = "hdfs:///shared/"
    assert shared_dir(Session) == "hdfs:///shared"


def test_parameters_are_never_cut(spark):
    assert len(bounded(spark.range(5), 5)) == 5
    with pytest.raises(ValueError):
        bounded(spark.range(6), 5)
