import numpy as np
import pytest

from annspark.functions.hashing import (
    EuclideanFamily,
    EuclideanPlanes,
    SignFamily,
    SignPlanes,
    hash_vectors,
)
from tests.conftest import vectors_df


def test_sign_planes_are_seeded_and_extend():
    a = SignFamily(3, 4, seed=7).planes(10)
    b = SignFamily(3, 4, seed=7).planes(10)
    c = SignFamily(5, 4, seed=7).planes(10)
    assert a.shape == (3, 4, 10)
    np.testing.assert_array_equal(a, b)
    np.testing.assert_array_equal(a, c[:3])  # more tables extend fewer tables
    assert not np.array_equal(a, SignFamily(3, 4, seed=8).planes(10))


def test_euclidean_planes_unit_length():
    a = EuclideanFamily(0.5, 4, seed=3).planes(16)
    np.testing.assert_allclose(np.linalg.norm(a, axis=1), 1.0)


def test_tiny_planes_bits_and_packing():
    # tbl 0: planes [1,0],[0,1]; tbl 1: [1,1],[1,-1]
    fam = SignPlanes([[[1, 0], [0, 1]], [[1, 1], [1, -1]]])
    x = np.array([[0.0, 0.0], [1.0, -2.0], [-1.0, 2.0], [3.0, 1.0]])
    sig = fam.signatures(x)
    # [0,0]: every dot is 0 -> bit 1 (">= 0"), packed 0b11 = 3 in both tables
    assert sig[0].tolist() == [3, 3]
    # [1,-2]: tbl0 bits (1,0) -> 1; tbl1 dots (-1, 3) -> bits (0,1) -> 2
    assert sig[1].tolist() == [1, 2]
    # [-1,2]: tbl0 (0,1) -> 2; tbl1 (1,-3) -> (1,0) -> 1
    assert sig[2].tolist() == [2, 1]
    assert sig[3].tolist() == [3, 3]


def test_sign_hash_unchanged_by_positive_scaling():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((50, 8))
    fam = SignFamily(4, 6, seed=1)
    np.testing.assert_array_equal(fam.signatures(x), fam.signatures(3.7 * x))


def test_hash_column_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 6))
    df = vectors_df(spark, [(i, x[i], 0) for i in range(40)])
    for fam in (SignFamily(3, 5, seed=2), EuclideanFamily(0.7, 4, seed=2)):
        got = {r["id"]: r["sig"] for r in hash_vectors(df, fam, 6).select("id", "sig").collect()}
        want = fam.signatures(x)
        for i in range(40):
            assert got[i] == want[i].tolist()


def test_width_mismatch_is_an_error(spark):
    df = vectors_df(spark, [(1, [1.0, 2.0, 3.0], 0)])
    with pytest.raises(Exception):
        hash_vectors(df, SignFamily(1, 2), 2).collect()


def test_euclidean_matches_spark_estimator(spark, tmp_path):
    """Same hashes as pyspark's BucketedRandomProjectionLSH fed that model's planes."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 5))
    df = vectors_df(spark, [(i, x[i], 0) for i in range(60)])
    vdf = df.withColumn("v", array_to_vector("features"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.8,
                                        numHashTables=3, seed=11).fit(vdf)
    path = str(tmp_path / "brp")
    model.save(path)
    planes_row = spark.read.parquet(f"{path}/data").first()["randUnitVectors"]
    planes = planes_row.toArray()
    fam = EuclideanPlanes(planes, 0.8)
    theirs = {r["id"]: [int(h[0]) for h in r["h"]] for r in model.transform(vdf).select("id", "h").collect()}
    ours = fam.signatures(x)
    for i in range(60):
        assert theirs[i] == ours[i].tolist()
    assert vector_to_array  # imported for parity with the sparse path
    from_model = EuclideanPlanes.from_model(model)
    np.testing.assert_array_equal(from_model.planes(5), planes)
    assert from_model.bucket_length == 0.8


def test_planted_angles_collision_rate():
    """Sign collisions per bit happen with probability 1 - theta / pi."""
    rng = np.random.default_rng(9)
    d, n = 32, 4000
    theta = np.pi / 3
    a = rng.standard_normal((n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.standard_normal((n, d))
    r -= (r * a).sum(1, keepdims=True) * a
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    b = np.cos(theta) * a + np.sin(theta) * r
    fam = SignFamily(1, 1, seed=4)
    same = (fam.signatures(a) == fam.signatures(b)).mean()
    assert abs(same - (1 - theta / np.pi)) < 0.03
