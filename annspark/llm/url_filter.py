"""URL filter by a Bloom filter cascade, in DataFrame functions only.

A rule is ``host/path``: it fits its host and all subdomains where the path starts with the
rule's path; the longest rule that fits decides. A url is turned into one key per shape
that rules have (number of host labels, length of path): its last labels and its path's
first characters. A rule fits exactly if one of these keys is the rule.

Which keys are listed is answered without a join. Level 0 of a cascade is a Bloom filter of
the listed keys; level 1 one of the keys of the corpus that level 0 lets through wrongly;
level 2 one of the listed keys that level 1 lets through, and so on until no key of the
corpus's complete key universe is judged wrongly. The first level that a key does not pass
says whether it is listed. So the answers are exact for every key the urls can ask.

Filters are arrays of 64-bit words, put into the plan as scalar subqueries. Their size
follows from the number of listed keys; when level 0 would pass ``max_bits``, a shuffle
join takes the place of the cascade, with the same answers.

Nulls and ties. A null url, or one without ``://``, has an empty host and path and fits no
rule. If a key is on both lists, block wins. Of two fitting rules of one length the one
with the longer host decides. Without rules everything gets the default verdict. Rows are
never merged; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annspark.llm.common import UPPER, written

MAX_BITS = 1 << 26
FIRST_RATE = 0.01
NEXT_RATE = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def shapes(rules: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """(host labels, path length) of the rules."""
    return sorted({(r.partition("/")[0].count(".") + 1, len(r) - r.index("/")) for r, _ in rules})


def keys(found: list[tuple[int, int]]) -> Column:
    """All keys of a row with columns ``host`` and ``path``: ``struct(key, host_size)``."""
    labels = F.split("host", r"\.")
    out = []
    for n, size in found:
        tail = F.array_join(F.slice(labels, F.size(labels) - (n - 1), n), ".")
        out.append(F.when((F.size(labels) >= n) & (F.length("path") >= size), F.struct(
            F.concat(tail, F.substring("path", 1, size)).alias("key"),
            F.length(tail).alias("host_size"))))
    return F.array(*out)


class Level:
    """One Bloom filter: ``words`` 64-bit words, ``hashes`` positions per key."""

    def __init__(self, members: DataFrame, count: int, rate: float, salt: int, name: str):
        bits = max(64, math.ceil(count * math.log2(1 / rate) / math.log(2)))
        self.words, self.salt = -(-bits // 64), salt
        self.hashes = max(1, round(math.log2(1 / rate)))
        at = F.explode(F.array(*[self._position(F.col("key"), i) for i in range(self.hashes)])).alias("at")
        set_bits = (members.select(at).groupBy(F.floor(F.col("at") / 64).alias("word"))
                    .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")))
        every = members.sparkSession.range(self.words).select(F.col("id").alias("word"))
        dense = every.join(set_bits, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"))
        # One row of as many words as the filter has: bounded by max_bits.
        row = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))),
                                    lambda x: x["bits"]).alias("filter"))
        self.filter = written(row, name)

    def _position(self, key: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.salt), F.lit(i)), F.lit(self.words * 64))

    def passes(self, key: Column) -> Column:
        words = self.filter.scalar()
        ok = F.lit(True)
        for i in range(self.hashes):
            at = self._position(key, i)
            word = F.get(words, F.floor(at / 64).cast("int"))
            ok = ok & (F.getbit(word, (at % 64).cast("int")) == 1)
        return ok


def cascade(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS) -> list[Level] | None:
    """Levels that tell listed keys from all others of ``universe`` (both: ``key``, distinct).
    None if level 0 would pass ``max_bits``; an empty list if nothing is listed."""
    count = listed.count()
    if count * math.log2(1 / FIRST_RATE) / math.log(2) > max_bits:
        return None
    levels: list[Level] = []
    inside = listed
    outside = None
    while count:
        levels.append(Level(inside, count, FIRST_RATE if not levels else NEXT_RATE, len(levels), "bloom-level"))
        passed = levels[-1].passes(F.col("key"))
        if outside is None:
            others = universe.where(passed).join(listed, "key", "left_anti")
        else:
            others = outside.where(passed)
        inside, outside = written(others, "bloom-errors"), inside
        count = inside.count()
    return levels


def listed_by(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the first level not passed decides."""
    answer = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        answer = F.when(~levels[k].passes(key), F.lit(k % 2 == 1)).otherwise(answer)
    return answer


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url",
               default: str = "allow", max_bits: int = MAX_BITS) -> DataFrame:
    """``pages`` (all its columns but ones named like a result) plus ``host, path, rule,
    verdict``. ``rules``: (``host/path``, ``allow`` or ``block``)."""
    spark = pages.sparkSession
    made = ["host", "path", "rule", "verdict", "_url", "_keys"]
    rows = pages.withColumn("_url", F.col(url_col).cast("string"))
    host, path = host_and_path(F.col("_url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    found = shapes(rules)
    kept = [c for c in pages.columns if c not in made]
    if not found:
        return rows.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"),
                           F.lit(default).alias("verdict"))
    rows = rows.withColumn("_keys", keys(found))
    universe = written(rows.select(F.explode("_keys").alias("k")).where("k is not null")
                       .select("k.key").distinct(), "url-keys")
    lists = {v: written(spark.createDataFrame(sorted({(r,) for r, w in rules if w == v}), "key string"), "rules")
             for v in ("block", "allow")}
    cascades = {v: cascade(listed, universe, max_bits) for v, listed in lists.items()}
    if any(levels is None for levels in cascades.values()):
        return _by_join(rows, universe, lists, kept, default)
    best = None
    for k in range(len(found)):
        key = F.col("_keys")[k]["key"]
        verdict = F.when(listed_by(cascades["block"], key), "block").when(
            listed_by(cascades["allow"], key), "allow")
        fit = F.when(key.isNotNull() & verdict.isNotNull(), F.struct(
            F.length(key).alias("size"), F.col("_keys")[k]["host_size"].alias("host_size"),
            key.alias("rule"), verdict.alias("verdict")))
        best = [fit] if best is None else [*best, fit]
    top = best[0] if len(best) == 1 else F.greatest(*best)
    return rows.withColumn("_best", top).select(
        *kept, "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def _by_join(rows: DataFrame, universe: DataFrame, lists: dict, kept: list, default: str) -> DataFrame:
    """The same answers by joins, for lists too long for a filter in every task."""
    every = (lists["block"].withColumn("verdict", F.lit("block")).unionByName(
        lists["allow"].join(lists["block"], "key", "left_anti").withColumn("verdict", F.lit("allow"))))
    fits = written(universe.join(every, "key"), "fitting-rules").withColumnRenamed("key", "_rule")
    numbered = written(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered-urls")
    tried = numbered.select("_row", F.explode("_keys").alias("k")).where("k is not null")
    best = (tried.join(fits, F.col("k.key") == F.col("_rule"))
            .groupBy("_row").agg(F.max(F.struct(
                F.length("_rule").alias("size"), F.col("k.host_size").alias("host_size"),
                F.col("_rule").alias("rule"), F.col("verdict"))).alias("_best")))
    return numbered.join(best, "_row", "left").select(
        *kept, "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
