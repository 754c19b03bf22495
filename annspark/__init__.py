"""annspark: nearest-neighbour search and k-NN classification on Spark DataFrames.

Vector tables follow one contract: ``id long, features array<double>, label``.
Every operator returns a lazy DataFrame; nothing is collected except small,
size-checked planning metadata (hot-bucket lists, the single key of a one-key search).
"""

import sys

from pyspark import cloudpickle

# Ship this package's code inside the pickled UDFs, so executors run them without the
# package installed on their Python path (no zip to distribute, nothing per node).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from annspark.functions.hashing import EuclideanFamily, SignFamily  # noqa: E402
from annspark.operators.classify import (  # noqa: E402
    bucket_vote_classify,
    exact_classify,
    knn_classify,
    vote,
)
from annspark.operators.evaluate import (  # noqa: E402
    accuracy,
    match_share,
    recall_at_k,
    strict_majority_accuracy,
)
from annspark.operators.index import bucket_histogram, bucket_index, bucket_summary  # noqa: E402
from annspark.operators.late import late_knn_join  # noqa: E402
from annspark.operators.pruned import exact_knn_pruned  # noqa: E402
from annspark.operators.search import exact_knn, knn_join, knn_one, similarity_join  # noqa: E402
from annspark.operators.sweeps import sweep, sweep_sign  # noqa: E402

__all__ = [
    "EuclideanFamily",
    "SignFamily",
    "accuracy",
    "bucket_histogram",
    "bucket_index",
    "bucket_summary",
    "bucket_vote_classify",
    "exact_classify",
    "exact_knn",
    "exact_knn_pruned",
    "knn_classify",
    "knn_join",
    "knn_one",
    "late_knn_join",
    "match_share",
    "recall_at_k",
    "similarity_join",
    "strict_majority_accuracy",
    "sweep",
    "sweep_sign",
    "vote",
]
