"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base counts come from one pass over the text. A base rule rejects what is too short or
repeats itself. Further rules (symbols per word, word length, repeated lines) get their
cutoffs per stratum from labelled holdout rows:

* The cutoffs of all rules form one ladder: every rule's most lenient cutoff, then every
  rule's next, and so on. A rung stands for all rules at the cutoffs reached by then.
* A rung's false rejections are the good rows (label 1, past the base rule) that any rule
  rejects there, ``k`` of ``n``. The exact binomial test of "its false-rejection rate is above ``a``"
  has the p-value P(Binomial(n, a) <= k); this is the Clopper-Pearson upper bound turned
  round, with no approximation by a normal law.
* Rungs are tested from lenient to strict and testing stops at the first that is not
  certified (a fixed sequence, which needs no correction inside a stratum). The highest
  certified rung is used; rules it has not reached stay off in that stratum.
* The error probability ``delta`` is divided by the number of strata (Bonferroni). So with
  probability 1 - delta, in every stratum all rules together reject at most ``alpha`` of
  the good documents.

All labelled rows take part, at any size. The thresholds table has one row per stratum; it
is broadcast only when checked to be small, else joined with salted keys.

Nulls and ties. A null text counts as empty: all counts 0, rejected by the base rule. A
null stratum is a stratum of its own. Labels that are null are ignored; a row labelled
more than once is good if any label is 1; rows that share an id share their label. Rows
are never merged. An empty table gives an empty result, and empty labels leave only the
base rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annspark.llm.common import SPACES, attach, columns_of, written

WINDOW = 5
ALPHA = 0.02
DELTA = 0.05
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects where ``scale * value > cutoff * per`` (``below``: ``<``); cutoffs run from
    lenient to strict."""

    name: str
    value: str
    per: str
    scale: int
    cutoffs: tuple
    below: bool = False

    def rejects(self, cutoff: Column) -> Column:
        left, right = F.lit(self.scale) * F.col(self.value), cutoff * F.col(self.per)
        return left < right if self.below else left > right


RULES = (
    Rule("symbols", "n_symbols", "n_words", 100, (200, 150, 100, 75, 50, 40, 30, 20, 15, 10, 5)),
    Rule("long_words", "word_chars", "n_words", 10, (150, 120, 100, 90, 85, 80, 75, 70, 65)),
    Rule("short_words", "word_chars", "n_words", 10, (15, 20, 25, 30, 35), below=True),
    Rule("dup_lines", "n_dup_lines", "n_words", 100, (50, 30, 20, 10, 5, 3)),
)


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus one struct column ``_q`` of the base counts and ``base_failed``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # One projection a step: each array is built once and read by the next step.
    trimmed = F.trim(text, F.lit(SPACES))
    step = docs.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>"))
                           .otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    step = step.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    lines = F.filter(F.split(text, "\n"), lambda s: F.length(F.trim(s, F.lit(SPACES))) > 0)
    step = step.withColumn("_lines", lines)
    h = F.col("_hashes")
    windows = F.slice(F.transform(h, lambda x, i: F.xxhash64(
        x, *[F.get(h, i + k) for k in range(1, WINDOW)])), F.lit(1),
        F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
    step = step.withColumn("_windows", windows)
    w = F.col("_windows")
    # Windows found twice or more lie side by side once sorted by hash.
    step = step.withColumn("_sorted", F.when(
        F.size(F.array_distinct(w)) < F.size(w),
        F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("_sorted")
    step = step.withColumn("_places", F.array_sort(F.transform(
        F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])),
        lambda x: x["i"])))
    p = F.col("_places")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    n_words = F.size("_words").cast("long")
    repeated = F.coalesce(covered, F.lit(0).cast("long"))
    step = step.withColumn("_q", F.struct(
        n_words.alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        ((n_words < 10) | (100 * repeated > 20 * n_words)).alias("base_failed")))
    return step.drop("_words", "_hashes", "_lines", "_windows", "_sorted", "_places")


def log_factorial(n: Column) -> Column:
    """ln n!: Stirling's series ten steps up, where its error is below 1e-12."""
    z = n + 11.0
    series = ((z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi)
              + 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - 1 / (1680 * z ** 7))
    for i in range(1, 11):
        series = series - F.log(n + float(i))
    return series


def binomial_tail(k: Column, n: Column, a: float) -> Column:
    """P(Binomial(n, a) <= k) where k < a n, else 1.

    The sum runs down from k. Terms more than 6 sqrt(n) below k add less than exp(-72)
    by Hoeffding's bound and are left out, so the work grows with sqrt(n)."""
    kd, nd = k.cast("double"), n.cast("double")
    top = (log_factorial(nd) - log_factorial(kd) - log_factorial(nd - kd)
           + kd * math.log(a) + (nd - kd) * math.log1p(-a))
    steps = F.sequence(F.lit(0), F.least(k, F.ceil(6 * F.sqrt(nd)) + 50).cast("int"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
    total = F.aggregate(
        steps, start,
        lambda acc, j: F.struct(
            (acc["term"] * (kd - j) * (1 - a) / ((nd - kd + j + 1) * a)).alias("term"),
            (acc["total"] + acc["term"]).alias("total")),
        lambda acc: acc["total"])
    return F.when(kd >= a * nd, F.lit(1.0)).otherwise(F.exp(top) * total)


def ladder(rules=RULES) -> list[dict]:
    """The rungs: each rule's cutoff reached by then, by rule name."""
    rungs, reached = [], {}
    for step in range(max((len(r.cutoffs) for r in rules), default=0)):
        for r in rules:
            if step < len(r.cutoffs):
                reached = {**reached, r.name: r.cutoffs[step]}
                rungs.append(reached)
    return rungs


def rejected_at(rung: dict, rules=RULES) -> Column:
    hit = F.lit(False)
    for r in rules:
        if r.name in rung:
            hit = hit | r.rejects(F.lit(rung[r.name]))
    return hit


def thresholds(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id",
               stratum_col: str = "lang", rules=RULES, alpha: float = ALPHA,
               delta: float = DELTA, label_col: str = "quality") -> DataFrame:
    """``stratum`` and one certified cutoff per rule (null: rule off).

    ``counted`` has ``id_col``, ``stratum_col`` and the base counts; ``labels`` has
    ``id_col`` and the label."""
    good = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).alias("_lid")).agg(F.max(label_col).alias("_good"))
            .where("_good = 1").select("_lid"))
    held = counted.where(~F.col("base_failed")).join(good, F.col(id_col) == F.col("_lid"))
    rungs = ladder(rules)
    sums = [F.sum(rejected_at(rung, rules).cast("long")).alias(f"k{j}") for j, rung in enumerate(rungs)]
    tallies = written(held.groupBy(F.col(stratum_col).alias("stratum"))
                      .agg(F.count(F.lit(1)).alias("n"), *sums), "tallies")
    level = delta / max(1, tallies.count())
    tests = F.explode(F.array(*[F.struct(F.lit(j).alias("rung"), F.col(f"k{j}").alias("k"))
                                for j in range(len(rungs))])).alias("t")
    tested = (tallies.select("stratum", "n", tests).select("stratum", "n", "t.*")
              .withColumn("ok", binomial_tail(F.col("k"), F.col("n"), alpha) <= level))
    # A rung rejects all that the rungs below it do, so p-values only grow up the ladder: the
    # highest certified rung has all lower ones certified.
    top = tested.groupBy("stratum").agg(F.max(F.when(F.col("ok"), F.col("rung"))).alias("top"))
    cutoffs = []
    for r in rules:
        reached = F.array(*[F.lit(rung.get(r.name)).cast("long") for rung in rungs])
        cutoffs.append(F.get(reached, F.col("top")).alias(r.name))
    return written(top.select("stratum", *cutoffs), "thresholds")


def judge(counted: DataFrame, limits: DataFrame, stratum_col: str, rules, spread: Column) -> DataFrame:
    """``counted`` plus ``kept``: past the base rule and inside all certified cutoffs.
    ``spread`` salts the join when the thresholds are too many to broadcast."""
    cuts = limits.select(F.col("stratum"), *[F.col(r.name).alias(f"_cut_{r.name}") for r in rules])
    cuts = cuts.withColumnRenamed("stratum", "_stratum")
    joined = attach(counted.withColumn("_stratum", F.col(stratum_col).cast("string")),
                    cuts.withColumn("_stratum", F.col("_stratum").cast("string")), "_stratum",
                    spread)
    bad = F.lit(False)
    for r in rules:
        bad = bad | F.coalesce(r.rejects(F.col(f"_cut_{r.name}")), F.lit(False))
    return (joined.withColumn("kept", ~F.col("base_failed") & ~bad)
            .drop("_stratum", *[f"_cut_{r.name}" for r in rules]))


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                     text_col: str = "text", stratum_col: str = "lang", rules=RULES,
                     alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``id, stratum, the counts, base_failed, kept`` per row of ``docs``."""
    counted = with_counts(docs.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"),
                                      F.col(text_col).alias("_text")), "_text")
    counted = written(counted.select("id", "stratum", "_q.*"), "counts")
    limits = thresholds(counted, labels.select(F.col(id_col).alias("id"), "quality"), "id",
                        "stratum", rules, alpha, delta)
    return judge(counted, limits, "stratum", rules, F.xxhash64("id"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", stratum_col: str = "lang", rules=RULES,
                   alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep.

    Rows are written once with their counts and read back for the verdict, so texts are
    neither counted twice nor shuffled."""
    # The row in one struct: docs may have columns named like the counts or helpers.
    packed = docs.select(F.struct(*columns_of(docs)).alias("row"), F.col(text_col).alias("text"))
    counted = written(with_counts(packed).drop("text"), "counted-documents")
    row = F.col("row")
    slim = counted.select(row[id_col].alias("id"), row[stratum_col].alias("stratum"), "_q.*")
    limits = thresholds(slim, labels.select(F.col(id_col).alias("id"), "quality"), "id",
                        "stratum", rules, alpha, delta)
    judged = judge(counted.select("row", row[stratum_col].alias("stratum"), "_q.*"), limits, "stratum",
                   rules, F.xxhash64(row[id_col]))
    return judged.where("kept").select("row.*")
