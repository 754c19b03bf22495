"""Whitening, hard negatives and the quality classifier against brute force and edge rows."""

import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from annspark.llm import hard_negatives, quality_classifier, whitening
from annspark.llm.common import read_table
from annspark.llm.queries import QUERIES

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, id string, x string, n string, vec string, row string"
BAD = [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan"), 1.0], 1), (903, [float("inf"), 1.0], 1)]


def vectors(spark, rows):
    """Rows of vectors with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], VECTORS)


def random_rows(n, width, seed, copies=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width)) * rng.uniform(0.2, 2.0, size=width)
    rows = [(k, base[k].tolist(), int(rng.integers(4))) for k in range(n)]
    return rows + [(n + k, base[0].tolist(), 1) for k in range(copies)]


# --- whitening ---------------------------------------------------------------------

def whitened_by_hand(rows, width):
    x = {k: [math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for k, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(v, s)] for v in fit])
    v = centred.T @ centred / n
    values, vectors_ = np.linalg.eigh(v)
    return x, n, s, values[::-1], vectors_[:, ::-1], np.trace(v)


def check_whitened(found, rows, width):
    x, n, s, values, components, trace = whitened_by_hand(rows, width)
    k = min(16, int((values > 1e-9 * values[0]).sum()))
    assert len(found) == len(rows) * k
    assert found.n.eq(n).all() and found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-9
    for c in range(k):
        part = found[found.component == c + 1]
        assert np.allclose(part.explained, values[c] / trace, rtol=1e-9)
        w = np.array([float(sum(Fraction(n * a - b, n) * Fraction(float(u)) for a, b, u in zip(x[i], s, components[:, c])))
                      / math.sqrt(values[c]) for i in part.id])
        sign = 1 if (w * part.whitened).sum() > 0 else -1
        assert np.allclose(part.whitened, sign * w, atol=1e-7)
    for i, d in found[found.component == 1][["id", "deviation"]].itertuples(index=False):
        assert int(d) == sum((n * a - b) ** 2 for a, b in zip(x[i], s))


def test_whitening_equals_brute_force(spark):
    rows = random_rows(300, 6, 1, copies=200) + BAD + [(950, [0.5, 0.25], 1), (951, [], 2)]
    found = whitening.whiten(vectors(spark, rows)).toPandas()
    good = [(k, v) for k, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    check_whitened(found, good, 6)


def test_whitening_of_the_given_table(spark):
    found = QUERIES["op11_whitening"](spark, SF).toPandas().rename(columns={"vec_id": "id"})
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in read_table(spark, SF, "embeddings").collect()]
    assert str(found.deviation.dtype) == "int64"
    check_whitened(found, rows, 64)


def test_whitening_of_huge_entries_is_exact(spark):
    rows = [(k, [3e9 * (k % 7), float(k)], 0) for k in range(40)]
    found = whitening.whiten(vectors(spark, rows)).toPandas()
    x, n, s, *_ = whitened_by_hand([(k, v) for k, v, _ in rows], 2)
    for i, d in found[found.component == 1][["id", "deviation"]].itertuples(index=False):
        assert int(d) == sum((n * a - b) ** 2 for a, b in zip(x[i], s))
    assert found.identity_error.iloc[0] < 1e-9


def test_whitening_without_a_direction(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, BAD)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0), (None, [3.0, 2.0], 0)])).toPandas()
    assert len(one) == 2 and sorted(one.whitened) == pytest.approx([-1, 1])


@pytest.mark.parametrize("values", [
    np.linspace(1, 5, 40), np.r_[np.linspace(1, 1 + 1e-8, 15), np.linspace(2, 5, 25)],
    np.r_[np.ones(10), np.full(10, 1 + 1e-11), np.linspace(2, 5, 20)], 10.0 ** np.linspace(-6, 2, 40), np.ones(40)])
def test_refinement_reaches_higher_precision(values):
    rng = np.random.default_rng(5)
    wide = whitening.WIDE
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0].astype(wide)
    for _ in range(4):
        q = q + q @ ((np.eye(40, dtype=wide) - q.T @ q) / 2)
    a = (q * values.astype(wide)) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.refined_eigenvectors(a)
    assert np.abs(x.T @ x - np.eye(40)).max() < 1e-15
    assert np.abs(a @ x - x * found).max() < 1e-15 * values.max()
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-15 * values.max()


# --- hard negatives ----------------------------------------------------------------

def mined_by_hand(rows, every, scale=256, low=50, high=95):
    good = [(k, [math.floor(scale * c) for c in v], label) for k, v, label in rows
            if k is not None and label is not None and v is not None
            and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, (a, x, label) in enumerate(good):
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), k, other) for j, (k, y, other) in enumerate(good) if j != i]
        best = sorted((s, k) for s, k, other in scored if other == label)[:5]
        for s, k in best:
            hard = sorted((t, m) for t, m, other in scored if other != label and low * -s <= 100 * -t <= high * -s)
            out += [(a, k, r + 1, m, -s, -t) for r, (t, m) in enumerate(hard[:3])]
    return sorted(out)


def mined(spark, rows, every=7, **opts):
    found = hard_negatives.hard_negatives(vectors(spark, rows), F.col("id") % every == 0, **opts).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score)
                  for r in found)


@pytest.mark.parametrize("shard_values", [1 << 18, 600])
def test_negatives_equal_brute_force(spark, shard_values):
    rows = random_rows(400, 8, 2, copies=60) + BAD + [
        (None, [1.0] * 8, 1), (905, [1.0] * 8, None), (906, [0.5, 0.5], 2), (907, [], 2), (910, [0.0] * 8, 0)]
    assert mined(spark, rows, shard_values=shard_values) == mined_by_hand(rows, 7)


def test_negatives_of_correlated_and_tied_vectors(spark):
    rng = random.Random(4)
    rows = [(k, [1.0 + rng.randrange(3) / 8, rng.randrange(3) / 8, 0.0], rng.randrange(3)) for k in range(300)]
    assert mined(spark, rows, shard_values=300) == mined_by_hand(rows, 7)


def test_negatives_of_scores_beyond_doubles(spark):
    rng = random.Random(6)
    rows = [(k, [rng.randrange(1 << 20) / 1.0, rng.randrange(1 << 21) / 1.0], k % 2) for k in range(40)]
    assert mined(spark, rows) == mined_by_hand(rows, 7)


def test_access_stops_early():
    """Where a few rows stand out, sorted access ends long before the lists do."""
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(4096, 4)) * 100).astype(np.int64)
    x[:10] += 5000
    rows, scores = hard_negatives.Lists(x).access(
        np.array([3, 1, 2, 5]), lambda found, s, t: len(s) >= 5 and t < np.sort(s)[-5])
    assert len(rows) < 200
    assert sorted(rows[np.argsort(-scores)[:5]]) == sorted(np.argsort(-(x @ [3, 1, 2, 5]), kind="stable")[:5])


def test_negatives_of_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert mined(spark, [(7, [1.0], 0), (2, [1.0], 1)]) == []


# --- quality classifier ------------------------------------------------------------

DOCS = "doc_id long, text string, score string, id string, held_out string"


def test_classifier_learns_held_out_labels(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    found = quality_classifier.classify(docs, labels).toPandas()
    assert len(found) == docs.count()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.id]).all()
    truth = found.merge(labels.toPandas(), left_on="id", right_on="doc_id")
    held = truth[truth.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert held[held.quality == 0].score.max() < held[held.quality == 1].score.max()
    again = quality_classifier.classify(docs.repartition(7), labels).toPandas()
    both = found.merge(again, on="id")
    assert np.allclose(both.score_x, both.score_y, atol=1e-9)


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    docs, labels = (read_table(spark, SF, t) for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out("doc_id"), 1 - F.col("quality"))
                               .otherwise(F.col("quality")))
    first = quality_classifier.classify(docs, labels).toPandas().sort_values("id")
    other = quality_classifier.classify(docs.withColumn("lang", F.lit("x")).drop("source"), turned)
    assert np.allclose(first.score, other.toPandas().sort_values("id").score, atol=1e-12)


def test_classifier_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c"), (5, "same same"), (5, "same same"), (6, "x" * 300_000)]
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], DOCS)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 0), (3, None), (5, 0)], "doc_id long, quality int")
    found = quality_classifier.classify(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert len({r.score for r in found if r.id in (1, 2, 3)}) == 1
    assert {r.held_out for r in found if r.id is None} == {False}
    unknown = quality_classifier.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in unknown} == {0.5} and {r.predicted for r in unknown} == {1}
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


def test_bound_on_training_rows(spark):
    docs = spark.createDataFrame([(k, "good words" if k % 2 else "BAD!! BAD!!") for k in range(3000)],
                                 "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    found = quality_classifier.classify(docs, labels, train_rows=200).toPandas()
    assert (found.predicted == found.id % 2).all()


def grams_by_hand(text):
    """N-grams of the lower-cased words and of the shapes, as tuples of words."""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", text) if w]
    out = {}
    for n in (1, 2):
        for k in range(len(words) - n + 1):
            key = (0, tuple(w.lower() for w in words[k:k + n]))
            out[key] = out.get(key, 0) + 1
    return out


def test_counts_of_ngrams():
    text = "The cat\tthe  cat\nTHE dog\x0bthe cat"
    doc, sequence, slot, n = quality_classifier.counts(pa.array([text, "", "the"]))
    assert sorted(n[(doc == 0) & (sequence == 0)]) == sorted(grams_by_hand(text).values())
    assert set(doc) == {0, 2}


def test_long_texts_piece_by_piece():
    rng = random.Random(2)
    words = ["ab", "Cd", "EF", "g!", "7", "é", "ab"]
    text = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", " "]) for _ in range(3000))
    _, sequence, slot, n = quality_classifier.counts(pa.array([text]))
    want = quality_classifier._scaled(np.zeros(len(slot), dtype=np.int64), sequence, n)
    got_slot, got = quality_classifier.long_features(text, size=100)
    assert (np.sort(slot) == np.sort(got_slot)).all() and np.allclose(np.sort(want), np.sort(got))
