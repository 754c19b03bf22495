"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features. Words are runs without spaces. Two sequences of a text are cut into n-grams: its
lower-cased words (n = 1, 2) and its word shapes (n = 1, 2, 3). A shape keeps a word's marks
and replaces runs of small letters, of capitals, single capitals and digits by one sign
each; a word equal to the one before it has a shape of its own. N-grams are hashed to
``BUCKETS`` slots; a slot's value is log(1 + count), each sequence's values scaled to length
one, so that a text's length does not matter. One slot is the constant.

Training. Follow-the-regularised-leader with per-slot learning rates, L1 and L2 terms. The
labelled rows that may be learnt from are dealt by a hash over up to ``SHARDS`` tasks, one
for every ``SHARD_ROWS`` of them; a task makes ``EPOCHS`` passes over its rows in hash order,
and the shards' weights are averaged.
At most about ``TRAIN_ROWS`` labelled rows are learnt from (a seeded hash of the id decides
which, so a rerun takes the same ones); this bounds the only broadcast, their ids, and the
text shuffled. Scoring reads every whole text once: a sparse dot product per row.

Nulls and ties. A null text is an empty one; a text without words scores by the constant
alone. Rows whose id is null are scored, and are neither held out nor learnt from. An id
labelled several times counts with its largest label; null labels do not count. Rows with a
repeated id are scored, and learnt from, each on its own. Without any label every score is
0.5. Texts longer than ``PIECE`` characters are counted piece by piece, so memory follows
the piece and not the text. Further columns of the tables are never read. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annspark.llm.common import WORD, written

BITS = 18
BUCKETS = 1 << BITS
TRAIN_ROWS = 16_384
SHARDS, SHARD_ROWS = 8, 512
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
SEED = 13
PIECE = 4_000_000
STEP = 1_500_000
CONTEXT = 3

_SHAPES = [(r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]+", "\x01"), (r"\p{Lu}{2,}", "\x02"), (r"\p{Lu}", "\x03"),
           (r"\p{N}+", "\x04")]
_WORD = re.compile(WORD)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_REPEAT = np.uint64(0xD6E8FEB86659FD93)


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object))


def _mix(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind + 1)) * _MIX
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _chain(h: np.ndarray, doc: np.ndarray, n: int):
    """Hashes of the ``n``-grams that end at each word, and whether all of it is one text."""
    out, whole = h.copy(), np.ones(len(h), dtype=bool)
    for back in range(1, n):
        prior = np.empty_like(h)
        prior[:back], prior[back:] = 0, h[:-back] if back < len(h) else h[:0]
        same = np.zeros(len(h), dtype=bool)
        same[back:] = doc[back:] == doc[:-back] if back < len(h) else doc[:0] == doc[:0]
        whole &= same
        out = (out * _MIX) ^ (prior + np.uint64(back))
    return out, whole


def counts(texts: pa.Array, skip: int = 0):
    """``(text number, sequence, slot, count)`` of the texts' n-grams, sorted. With ``skip``,
    the first so many words are context: only n-grams that end behind them are counted."""
    lists = pc.ascii_split_whitespace(texts)
    doc = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    words = pc.list_flatten(lists)
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    doc, enc = doc[full], words.filter(pa.array(full)).dictionary_encode()
    code = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(code):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty
    shapes = enc.dictionary
    for pattern, sign in _SHAPES:
        shapes = pc.replace_substring_regex(shapes, pattern, sign)
    lower, shape = _hashes(pc.utf8_lower(enc.dictionary))[code], _hashes(shapes)[code]
    again = np.zeros(len(code), dtype=bool)
    again[1:] = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
    shape = np.where(again, shape ^ _REPEAT, shape)
    counted = np.arange(len(code)) >= skip
    keys = []
    for sequence, h, ns in ((0, lower, (1, 2)), (1, shape, (1, 2, 3))):
        for n in ns:
            grams, whole = _chain(h, doc, n)
            ok = whole & counted
            slot = (_mix(grams[ok], 8 * sequence + n) >> np.uint64(64 - BITS)).astype(np.int64)
            keys.append(((doc[ok] * 2 + sequence) << BITS) | slot)
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return key >> (BITS + 1), (key >> BITS) & 1, key & (BUCKETS - 1), n


def _scaled(doc: np.ndarray, sequence: np.ndarray, n: np.ndarray) -> np.ndarray:
    x = np.log1p(n)
    group = doc * 2 + sequence
    norm = np.sqrt(np.bincount(group, weights=x * x))
    return x / norm[group]


def pieces(text: str, size: int = PIECE):
    """``(piece, context words)``: cuts of a long text at spaces; each piece but the first
    begins with the last words before it."""
    start, tail = 0, []
    while start < len(text):
        end = min(len(text), start + size)
        while end < len(text) and text[end] not in " \t\n\x0b\x0c\r":
            end += 1
        part = text[start:end]
        yield " ".join([*tail, part]), len(tail)
        last = deque((m.group() for m in _WORD.finditer(part)), maxlen=CONTEXT)
        tail = [*tail, *last][-CONTEXT:]
        start = end


def long_features(text: str, size: int = PIECE):
    total = np.zeros(2 * BUCKETS, dtype=np.int64)
    for part, skip in pieces(text, size):
        _, sequence, slot, n = counts(pa.array([part]), skip)
        total[sequence * BUCKETS + slot] += n
    at = np.flatnonzero(total)
    sequence = at >> BITS
    return at & (BUCKETS - 1), _scaled(np.zeros(len(at), dtype=np.int64), sequence, total[at])


def features(texts: pa.Array):
    """``(offsets, slots, values)``: a sparse row per text; long texts one by one."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    ends, slots, values, at = [0], [], [], 0
    while at < len(texts):
        if lengths[at] > PIECE:
            slot, x = long_features(texts[at].as_py())
            per, upto = np.array([len(slot)]), at + 1
        else:
            room = np.cumsum(lengths[at:at + 4096])
            upto = at + max(1, int(np.searchsorted(room, STEP, "right")))
            wide = np.flatnonzero(lengths[at:upto] > PIECE)
            upto = at + int(wide[0]) if len(wide) else upto
            doc, sequence, slot, n = counts(texts.slice(at, upto - at))
            x = _scaled(doc, sequence, n)
            per = np.bincount(doc, minlength=upto - at)
        slots.append(slot)
        values.append(x)
        ends.extend((ends[-1] + np.cumsum(per)).tolist())
        at = upto
    join = (lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind))
    return np.array(ends), join(slots, np.int64), join(values, np.float64)


class Leader:
    """State of follow-the-regularised-leader over the slots and the constant."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(np.asarray(at) == BUCKETS, 0.0, self.l1)  # the constant pays no L1
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35.0, 35.0))) - y) * x
        n = self.n[at]
        after = n + g * g
        self.z[at] += g - (np.sqrt(after) - np.sqrt(n)) / self.alpha * w
        self.n[at] = after


def _with_constant(slots: np.ndarray, x: np.ndarray):
    # A slot may hold n-grams of both sequences: its values add up.
    at, back = np.unique(slots, return_inverse=True)
    return np.append(at, BUCKETS), np.append(np.bincount(back, weights=x, minlength=len(at)), 1.0)


def _train(batches):
    rows, labels = [], []
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        ends, slots, x = features(texts)
        for k in range(batch.num_rows):
            s = slice(ends[k], ends[k + 1])
            at, value = _with_constant(slots[s], x[s])
            rows.append((at.astype(np.int32), value.astype(np.float32)))
        labels.extend(batch.column("label").to_pylist())
    if rows:
        model = Leader()
        for _ in range(EPOCHS):
            for (at, value), y in zip(rows, labels):
                model.learn(at, value.astype(np.float64), float(y))
        w = model.weights(np.arange(BUCKETS + 1))
        at = np.flatnonzero((w != 0) | (np.arange(BUCKETS + 1) == BUCKETS))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["slot", "w"])


def fit(rows: DataFrame, id_col: str = "id", text_col: str = "text", label_col: str = "label",
        shards: int = SHARDS) -> np.ndarray:
    """Weights of the slots and, last, of the constant. All rows given are learnt from; the
    driver gets at most ``BUCKETS + 1`` numbers."""
    key = F.xxhash64(F.lit(SEED), F.col(id_col).cast("string"), F.col(text_col))
    dealt = (rows.select(F.col(text_col).alias("text"), F.col(label_col).cast("double").alias("label"),
                         key.alias("key"))
             .withColumn("shard", F.pmod("key", F.lit(shards)))
             .repartition(shards, "shard").sortWithinPartitions("shard", "key", "label"))
    parts = dealt.select("text", "label").mapInArrow(_train, "slot long, w double")
    weights = np.zeros(BUCKETS + 1)
    trained = written(parts.withColumn("_t", F.spark_partition_id()), "shard-weights")
    n = max(1, trained.where(F.col("slot") == BUCKETS).count())
    for row in trained.groupBy("slot").agg(F.sum("w").alias("w")).collect():
        weights[row["slot"]] = row["w"] / n
    return weights


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row."""
    w, constant = weights[:-1], weights[-1]

    def run(batches):
        for batch in batches:
            ends, slots, x = features(pc.fill_null(batch.column("text"), ""))
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            total = np.bincount(row, weights=w[slots] * x, minlength=batch.num_rows) + constant
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -700.0, 700.0))))],
                names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, score double")


def held_out(id_col: str) -> Column:
    """Whether the checksum of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``id, held_out, score, predicted`` per row of ``docs``, learnt from the labels of the
    rows that are not held out."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
             .where("id is not null and label is not null").where(~held_out("id"))
             .groupBy("id").agg(F.max("label").alias("label")))
    known = written(known, "labels")
    total = known.count()
    if total > train_rows:  # a seeded share of the ids, three deviations below the bound
        share = (train_rows - 3.0 * train_rows ** 0.5) / total
        draw = F.pmod(F.xxhash64(F.lit(SEED), F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
        known = known.where(draw < share)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Bounded by ``train_rows`` ids, whatever the data.
    shards = max(1, min(SHARDS, -(-min(total, train_rows) // SHARD_ROWS)))
    weights = fit(rows.join(F.broadcast(known), "id"), shards=shards)
    scored = score(rows, weights)
    return scored.select("id", held_out("id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
