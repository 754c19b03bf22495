"""Columns of the user survive every stage, whatever their names; every row is counted."""

import random

import pytest

import corpus_pipeline
from annspark.llm import bpe, license_scan, mixing, quality_rules, sentence_spans, simhash, token_rollups
from annspark.llm.queries import tokenizer_path

NAMES = ("_id _th _n _copies _src _runs _cut _q _words _ids _seq _keys _best _text _row row text_hash size id n h kept "
         "_key _order _ID_ stratum base_failed n_words span_dedup license_scan _at _spread a.b").split()
PASSAGE = ("every word of this long passage is said again in other documents and must go there. "
           "it has a second sentence of many words that follows the first one closely. "
           "and a third sentence of the same kind ends the passage of well over fifty words in all here. ")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]

    def text(k):
        body = " ".join(rng.choice(words) for _ in range(60)) + ". "
        return body + (PASSAGE if k % 4 == 0 else "") + " ".join(rng.choice(words) for _ in range(30))

    rows = [(k, text(k), "en", f"s{k % 3}", 1, *[f"{n}-{k}" for n in NAMES]) for k in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows + [rows[3]], schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int")


def untouched(result, skip=()):
    assert {*NAMES} - {*skip} <= {*result.columns}
    rows = result.collect()
    assert rows
    for r in rows:
        assert all(r[n] == f"{n}-{r.doc_id}" for n in NAMES if n not in skip)
    return rows


def test_stages_keep_user_columns(spark, docs, labels):
    assert len(untouched(quality_rules.quality_filter(docs, labels))) == 41
    assert len(untouched(simhash.simhash_dedup(docs))) == 40
    found = untouched(sentence_spans.sentence_span_dedup(docs), skip=["span_dedup"])
    assert sum(r.span_dedup.n_removed > 0 for r in found) >= 9
    assert sum(len(r.text) for r in found) < sum(len(r.text) for r in docs.collect())
    untouched(mixing.mix(docs))
    untouched(license_scan.scan_licenses(docs), skip=["license_scan"])
    untouched(bpe.encode_table(docs, tokenizer_path()))


def test_pipeline_stages_return_the_columns_of_documents(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "BPE encoding":
            assert out.columns == docs.columns
            untouched(out)


CHANGE = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long"


def test_rows_that_share_an_id_or_have_none_all_count(spark):
    rollup = token_rollups.TokenRollup(spark)
    rollup.commit("one", spark.createDataFrame([
        ("insert", 1, "a", "en", "t", 5), ("insert", 1, "b", "en", "t", 7),
        ("insert", None, "a", "en", "t", 3), ("insert", None, "a", "en", "t", 4)], CHANGE))
    assert {tuple(r) for r in rollup.totals().collect()} == {("a", "en", "t", 3, 12), ("b", "en", "t", 1, 7)}


def test_random_batches_equal_a_recount(spark):
    rng, held = random.Random(7), {}
    rollup = token_rollups.TokenRollup(spark)
    rank = {"delete": 0, "insert": 1, "revise": 2}
    for batch in range(4):
        rows = [(rng.choice(list(rank)), rng.choice([None, *range(8)]), rng.choice("ab"), rng.choice(["en", None]),
                 rng.choice(["t", None]), rng.choice([None, 1, 2, 2, 9])) for _ in range(rng.choice([1, 12, 40]))]
        for key in {(r[1], r[4]) for r in rows}:
            mine = [r for r in rows if (r[1], r[4]) == key]
            top = max(rank[r[0]] for r in mine)
            held[key] = [r for r in mine if rank[r[0]] == top and top > 0]
        changes = spark.createDataFrame(rows, CHANGE)
        if batch == 2:  # an earlier try that died before it was logged
            spark.createDataFrame([(1, "a", "en", "t", 5, 70, 3)], token_rollups.LEDGER).write.partitionBy(
                "part").parquet(f"{rollup.path}/ledger/b2")
        assert rollup.commit(f"b{batch}", changes)
        want = {}
        for (_, tokenizer), mine in held.items():
            for r in mine:
                n, total = want.get((r[2], r[3], tokenizer), (0, 0))
                want[r[2], r[3], tokenizer] = n + 1, total + (r[5] or 0)
        assert {tuple(r[:3]): tuple(r[3:]) for r in rollup.totals().collect()} == want


def test_what_a_batch_opens_does_not_grow(spark, monkeypatch):
    """A one-row commit reads the files of one part, of at most the batches not folded yet."""
    monkeypatch.setattr(token_rollups, "FOLD", 2)
    rollup = token_rollups.TokenRollup(spark)
    total, opened = 0, []
    for batch in range(5):
        rows = [("insert", 1000 * batch + k, "a", "en", "t", 1) for k in range(200 if batch % 2 == 0 else 1)]
        total += len(rows)
        assert rollup.commit(f"b{batch}", spark.createDataFrame(rows, CHANGE))
        opened.append(len(rollup.ledger([5]).inputFiles()))
        assert {tuple(r) for r in rollup.totals().collect()} == {("a", "en", "t", total, total)}
        assert len(rollup._live()) <= 3
    assert not rollup.commit("b0", spark.createDataFrame([], CHANGE))  # folded batches stay known
    plan = rollup.ledger([5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "part#" in plan.split("PartitionFilters: [")[1][:40]
    again = token_rollups.TokenRollup(spark, rollup.path)
    assert again.commit("late", spark.createDataFrame([("delete", 0, "a", "en", "t", 0)], CHANGE))
    assert again.totals().first().n_docs == total - 1
