"""Scores of an empty query set are 0 of 0, not an error; thresholds are not negative."""

import pytest

from annspark import accuracy, recall_at_k, strict_majority_accuracy
from annspark.operators.blocks import BlockKernel


def test_accuracy_of_nothing(spark):
    row = accuracy(spark.createDataFrame([], "label int, prediction int")).first()
    assert (row["n"], row["hits"], row["accuracy"]) == (0, 0, 0.0)


def test_recall_and_majority_of_nothing(spark):
    lists = spark.createDataFrame([], "q_id long, t_id long, rn int")
    query = spark.createDataFrame([], "id long, label int")
    row = recall_at_k(lists, lists, query, 5).first()
    assert (row["n_queries"], row["hits"], row["recall"]) == (0, 0, 0.0)
    near = spark.createDataFrame([], "q_id long, t_id long, t_label double")
    row = strict_majority_accuracy(near, query).first()
    assert (row["n_queries"], row["n_majority"], row["accuracy"]) == (0, 0, 0.0)


def test_negative_threshold_is_refused():
    for bad in (-1.0, float("nan")):
        with pytest.raises(ValueError, match="threshold"):
            BlockKernel(3, bad, False, False)
