"""Labels of any type, and samples drawn by key."""

import pytest
from pyspark.sql import functions as F

from annspark import SignFamily, bucket_vote_classify, knn_classify, match_share
from annspark.operators.evaluate import accuracy
from annspark.operators.search import knn_join
from annspark.sources import hash_sample

ROWS = [(k, [float(k % 7), float(k % 5)]) for k in range(40)]


def _table(spark, kind, label):
    return spark.createDataFrame([(k, v, label(k)) for k, v in ROWS], f"id long, features array<double>, label {kind}")


@pytest.mark.parametrize("kind,label", [
    ("string", lambda k: f"class {k % 3}"), ("double", lambda k: 2.7 + k % 3),
    ("long", lambda k: 2 ** 53 + 1 + 2 * (k % 3)), ("decimal(20,2)", lambda k: __import__("decimal").Decimal(k % 3))])
def test_labels_survive(spark, kind, label):
    train, query = _table(spark, kind, label), _table(spark, "int", lambda k: k % 3)
    known = {label(k) for k, _ in ROWS}
    for pred in (knn_classify(query, train, SignFamily(3, 2), 3), knn_classify(query, train, None, 1),
                 bucket_vote_classify(query, train, SignFamily(3, 2))):
        assert pred.schema["prediction"].dataType == train.schema["label"].dataType
        assert {r.prediction for r in pred.collect()} <= known
    own = knn_classify(train, train, None, 1)
    assert accuracy(own).first().hits >= 30
    assert match_share(knn_join(train, train, None, 1), train).agg(F.sum("n_match")).first()[0] >= 30


def test_no_candidate_in_every_type(spark):
    far = spark.createDataFrame([(99, [float("nan"), 1.0], 1)], "id long, features array<double>, label int")
    for kind, label, none in (("string", str, "-1"), ("double", float, -1.0), ("boolean", lambda k: k > 3, None)):
        pred = knn_classify(far, _table(spark, kind, label), None, 3).first()
        assert pred.prediction == none and pred.n_candidates == 0


def test_text_against_number(spark):
    pred = spark.createDataFrame([("1", 1), ("2", 3), (None, 1)], "label string, prediction int")
    assert accuracy(pred).first()[:] == (3, 1, pytest.approx(1 / 3))


def test_hash_sample_is_nested_and_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "id")
    small, large = ({r.id for r in hash_sample(df.repartition(n), f).collect()} for n, f in ((3, 0.1), (11, 0.3)))
    assert small < large and {r.id for r in hash_sample(df, 0.1).collect()} == small
    assert 350 < len(small) < 650 and 1300 < len(large) < 1700
    assert hash_sample(df, 1.0).count() == 5000 and hash_sample(df, 0.0).count() == 0
    assert {r.id for r in hash_sample(df, 0.1, seed=5).collect()} != small
    with pytest.raises(ValueError):
        hash_sample(df, 1.5)
    nulls = spark.createDataFrame([(None,), (None,), (1,)], "id long")
    assert hash_sample(nulls, 1.0).count() == 3
