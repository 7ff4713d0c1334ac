"""Where intermediate tables lie, and that they go."""

import os

import pytest

from fieldweave.llm.line_dedup import line_dedup
from fieldweave.llm.simhash import simhash_components
from fieldweave.llm.storage import scratch, shared_folder, stage, unset_folder


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,3000]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        unset_folder(master, "file:/some/warehouse", lambda path: "file")
    assert unset_folder(master, "hdfs://host/warehouse/", lambda path: "hdfs") == "hdfs://host/warehouse/_staged"


def test_a_local_master_has_a_folder_of_its_own():
    assert os.path.isdir(unset_folder("local[4]", "file:/some/warehouse", lambda path: "file"))


def test_nothing_is_left_after_a_query(spark):
    docs = spark.createDataFrame([(k, "a\nb\nc\nd" if k % 2 else f"one two three four {k // 4}") for k in range(40)], "doc_id long, text string")
    before = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    with scratch():
        assert len(simhash_components(docs).collect()) == len(line_dedup(docs).collect()) == 40
        with scratch():
            kept = stage(docs, "kept", outlive=True)
        assert kept.count() == 40
        assert set(os.listdir(shared_folder(spark).removeprefix("file:"))) > before
    assert set(os.listdir(shared_folder(spark).removeprefix("file:"))) == before
