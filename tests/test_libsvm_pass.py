"""Sparse LibSVM lines are parsed in passes, not once per entry."""

import pytest

from annspark.sources.libsvm import read_libsvm_sparse


def test_indices_are_checked_in_one_pass(spark, tmp_path):
    path = str(tmp_path / "ok")
    spark.createDataFrame([("1 1:0.5 3:2 # x",), ("0",), ("2 4:1",)], "value string").coalesce(1).write.text(path)
    df = read_libsvm_sparse(spark, path, 4)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "aggregate(" in plan
    assert [(r.label, r.features["indices"], r.features["values"]) for r in df.collect()] == [
        (1.0, [0, 2], [0.5, 2.0]), (0.0, [], []), (2.0, [3], [1.0])]


@pytest.mark.parametrize("line", ["1 0:1", "1 5:1", "1 2:1 2:1", "1 3:1 1:1 4:1"])
def test_wrong_indices_are_errors(spark, tmp_path, line):
    path = str(tmp_path / "wrong")
    spark.createDataFrame([(line,)], "value string").write.text(path)
    with pytest.raises(Exception, match="indices must ascend"):
        read_libsvm_sparse(spark, path, 4).collect()
