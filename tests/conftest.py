import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from annspark.session import get_session

    s = get_session("local[4]", shuffle_partitions=8, conf={
        # No shared folder in tests: a private checkpoint folder per run.
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("ckpt")),
    })
    yield s
    s.stop()


def vectors_df(spark, rows, with_label=True):
    """rows: (id, [components], label)"""
    schema = "id long, features array<double>, label int" if with_label else "id long, features array<double>"
    data = [(int(r[0]), [float(x) for x in r[1]], *( [int(r[2])] if with_label else [])) for r in rows]
    return spark.createDataFrame(data, schema)


@pytest.fixture
def tiny_2d(spark):
    train = vectors_df(spark, [(1, [0, 0], 0), (2, [1, 0], 0), (3, [0, 1], 1), (4, [5, 5], 1), (5, [5, 6], 1)])
    query = vectors_df(spark, [(10, [0.2, 0.1], 0), (11, [5, 5.4], 1)])
    return query, train
