"""Readers and writers of vector tables: Parquet, LibSVM (plain or bz2), CSV."""

from annspark.sources.csv import read_csv_vectors, read_ground_truth, write_csv_vectors, write_ground_truth
from annspark.sources.embeddings import load_embeddings, load_vectors, split_query_train
from annspark.sources.libsvm import load_pair, read_libsvm, read_libsvm_sparse, write_libsvm
from annspark.sources.samples import bernoulli_sample, hash_sample, head_sample

__all__ = [
    "bernoulli_sample",
    "hash_sample",
    "head_sample",
    "load_embeddings",
    "load_pair",
    "load_vectors",
    "read_csv_vectors",
    "read_ground_truth",
    "read_libsvm",
    "read_libsvm_sparse",
    "split_query_train",
    "write_csv_vectors",
    "write_ground_truth",
    "write_libsvm",
]
