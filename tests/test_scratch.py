"""What iterative steps leave on the disk, and folds that go with edges."""

import glob

from cohortspark.operators import graph


def test_rounds_of_components_are_deleted(spark):
    folder = graph.shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/cohortspark-*"))
    found = graph.connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long"))
    assert len(set(glob.glob(f"{folder}/cohortspark-*")) - before) == 1
    assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_folds_need_no_shuffle_of_edges(spark, capsys):
    import __spark_entry__ as e

    e.queries()["mg17_fold_legal"](spark, "/root/testdata/sf0.001").explain()
    assert capsys.readouterr().out.count("Join") == 1
