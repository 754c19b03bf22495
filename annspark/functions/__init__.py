"""Column expressions and hash families over ``array<double>`` vectors."""

from annspark.functions.hashing import EuclideanFamily, SignFamily, hash_vectors
from annspark.functions.vectors import (
    assemble,
    l2_distance,
    mint_ids,
    pack_longs,
    pad,
    sqdist,
    to_double_array,
    vector_sum,
    vector_width,
)

__all__ = [
    "EuclideanFamily",
    "SignFamily",
    "assemble",
    "hash_vectors",
    "l2_distance",
    "mint_ids",
    "pack_longs",
    "pad",
    "sqdist",
    "to_double_array",
    "vector_sum",
    "vector_width",
]
