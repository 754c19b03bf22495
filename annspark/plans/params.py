"""Parameters of the registered queries (one place, shared with the SQL oracles)."""

from annspark.functions.hashing import EuclideanFamily, SignFamily

# Fixed values of the registered queries. The driver's vectors are unit length in 64
# dimensions, so useful bucket lengths are near 0.1 and a distance cut near 1.3
# (random pairs sit near sqrt(2)).
SIGN = SignFamily(n_tables=8, n_bits=6, seed=1234)
EUCLID = EuclideanFamily(bucket_length=0.1, n_tables=3, seed=1234)
K = 5
THRESHOLD = 1.3
WIDTH = 64
PAD_WIDTH = 72
SPARSE_CUT = 0.1  # components smaller than this are left out of the sparse files
HEAD_ROWS = 25
SAMPLE_FRACTION, SAMPLE_SEED = 0.3, 1234
BATCH_PAIRS = 20_000  # candidate pairs of a batch of queries
POSTING_IDS = 16
GT_DEPTH = K
# The reference's grid of 27 settings, its bucket lengths scaled to unit vectors.
SWEEP_BUCKET_LENGTHS = (0.1, 0.2, 0.4)
SWEEP_TABLES = (3, 5, 7)
SWEEP_KS = (1, 5, 9)
SWEEP_SIGN = ((3, 10), (5, 20), (7, 25), (5, 10))  # (bits, tables)
ROUND = 6
# Small blocks and one-bit tables: the paths of hot buckets on small tables too.
SPLIT_ROWS = 64
HOT = SignFamily(n_tables=3, n_bits=1, seed=1234)
