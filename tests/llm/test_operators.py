"""The ten operators against brute force, exact round trips and edge rows."""

import hashlib
import math
import os
import random
import textwrap

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from annspark.llm import (
    bpe,
    chat_format,
    components,
    lattice,
    lexicon,
    license_scan,
    mixing,
    quality_rules,
    sentence_spans,
    simhash,
    token_rollups,
    url_filter,
)
from annspark.llm.oracle import ORACLE_SQL
from annspark.llm.queries import QUERIES, tokenizer_path
from annspark.session import checkpoint_dir
from tools.check_oracle import TABLES, normalise

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, size string"
EDGE = [(1, None, "en", "a", 0, "x", "y"), (2, "", None, None, 0, None, None), (3, " \n\t ", "en", "", 4, "", ""),
        (None, "one two three", "en", "a", 13, "x", "y"), (4, "word " * 20_000, "de", "b", 1, "x", "y"),
        (5, "same text here now", "en", "a", 1, "x", "y"), (5, "same text here now", "en", "a", 1, "x", "y"),
        (6, "<|endoftext|> </s>[INST] é  𝄞", "en", "c", 1, "x", "y")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normalise(got) == normalise(want)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]
    label = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: r for x, r in label.items() if any(x in p and p[0] != p[1] for p in pairs)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bpe_equals_library(spark, edge, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    got = bpe.encode_table(edge, tokenizer_path(), lexicon_words=3).collect()
    assert len(got) == len(EDGE) and "id" in got[0].asDict()
    texts = sorted((r[1] or "" for r in EDGE), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    for text, row in zip(texts, sorted(got, key=lambda r: r.decoded_sha256)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_table(empty, tokenizer_path()).count() == 0


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {a + b: [i] for i, (a, b) in enumerate((a, b) for a in (b"walk", b"talk", b"chalk")
                                                   for b in (b"", b"s", b"ing", b"ings"))}
    path = tmp_path / "lexicon.bin"
    path.write_bytes(lexicon.compile_lexicon(list(words.items())))
    found = lexicon.Lexicon(os.fspath(path))
    for rank, (word, ids) in zip(found.ranks(list(words)), words.items()):
        assert found.tokens(rank).tolist() == ids, word
    assert (found.ranks([b"wal", b"walkx", b"", b"zing"]) == -1).all()
    # Minimal: one state per distinct set of rests that a prefix leaves.
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    rests = {frozenset(w[len(p):] for w in words if w.startswith(p)) for p in prefixes}
    assert len(found.final) == len(rests)


def test_mixing_targets(spark, edge, empty):
    rows = [(k, "w " * n, s) for k, (n, s) in enumerate([(4, "a"), (3, "a"), (50, "b"), (40, "b"), (9, None)] * 6)]
    got = mixing.mix_table(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    total = got["size"].sum()
    goal = got.groupby("source", dropna=False).target.first()
    assert abs(goal.sum() - total) < 1e-6 and (got.target <= 3 * got.source_size + 1e-9).all()
    for _, part in got.groupby("source", dropna=False):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max()
        assert (part.taken <= 3 * part["size"]).all()
    assert mixing.mix_table(edge).count() == len(EDGE) and mixing.mix_table(empty).count() == 0
    assert mixing.mix(edge).columns == edge.columns and mixing.mix(empty).count() == 0


def test_mixing_refills_beside_a_long_document(spark):
    rows = [(k, "a", 400) for k in range(500)] + [(500, "a", 100_000)]
    sizes = spark.createDataFrame(rows, "id long, source string, size long")
    for total in (90_000, 150_000):
        missed = []
        for seed in range(3):
            got = mixing.mix_counts(sizes, total_words=total, seed=seed, refill=True)
            missed.append(abs(got.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] - total))
        assert max(missed) <= 200, (total, missed)


def test_lattice_recall_and_edges(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((150, 64))
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = 0.951 * base + math.sqrt(1 - 0.951 ** 2) * side
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, near, base[:1].repeat(40, 0) * 7]))]
    odd = [(900, None), (901, [0.0] * 64), (902, [float("nan")] + [1.0] * 63), (903, []), (904, [None] + [1.0] * 63)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    for block in (1024, 8):  # 8: the cell of the copies is cut into a grid
        got = {r.id: r for r in lattice.vector_links(df, block_rows=block).collect()}
        x = np.array([v for _, v in rows])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
        found = sum(got[i].n_links for i in range(len(x)))
        assert 0.9 * links.sum() <= found <= links.sum()
        assert all(got[i].n_links >= 40 for i in (0, 300, 339)) and got[339].component_id == 0
        assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i, _ in odd)
    assert lattice.vector_links(df.where("vec_id < 0")).count() == 0


def test_quality_thresholds_hold_the_exact_bound(spark, edge, empty):
    cases = [(1700, 0), (1700, 3), (50, 0), (100_000, 200)]
    df = spark.createDataFrame(cases, "n long, k long")
    for row in df.withColumn("p", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.0025)).collect():
        logs = [math.lgamma(row.n + 1) - math.lgamma(i + 1) - math.lgamma(row.n - i + 1)
                + i * math.log(0.0025) + (row.n - i) * math.log1p(-0.0025) for i in range(row.k + 1)]
        assert row.p == pytest.approx(sum(map(math.exp, logs)), rel=1e-7)
    labels = spark.createDataFrame([(5, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    got = quality_rules.quality_verdicts(edge, labels).collect()
    assert len(got) == len(EDGE) and {r.base_failed for r in got if r.id == 4} == {True}
    assert quality_rules.quality_filter(edge, labels).columns == edge.columns
    assert quality_rules.quality_verdicts(empty, labels.limit(0)).count() == 0


def test_url_cascade_equals_join(spark):
    urls = [(1, None), (2, "x"), (3, "http://A.Example.NET/en/a?b"), (4, "http://n.net/x"), (5, "http://net"),
            (6, "https://w.org/fr/#x"), (7, "http://example.com/de/"), (8, "http://notnet/")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("org/fr/", "allow"), ("example.com/de/", "block")]
    a = url_filter.judge_urls(pages, rules).orderBy("page_id").collect()
    assert a == url_filter.judge_urls(pages, rules, max_bits=0).orderBy("page_id").collect()
    assert [r.verdict for r in a] == ["allow", "allow", "allow", "block", "allow", "allow", "block", "allow"]
    assert a[2].rule == "example.net/en/" and a[2].host == "a.example.net" and a[0].host == ""
    many = spark.range(3000).selectExpr("concat('h', id, '.net/') AS key")
    levels = url_filter.cascade(many.where("substr(key, 2, 1) = '1'"), many)
    wrong = many.where(url_filter.listed_by(levels, F.col("key")) != (F.substring("key", 2, 1) == "1"))
    assert len(levels) > 1 and wrong.count() == 0
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_simhash_against_brute_force(spark, edge, empty):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 60, 3)).astype(np.uint64)
    fp = np.unique(np.concatenate([(centre[:, None] ^ flips[:, :, 0] ^ flips[:, :, 1]).ravel(), centre]))
    classes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    label = np.arange(len(fp))
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2)
    label = simhash.union_pairs(label, i, j)
    for block in (16_384, 32):
        found = simhash.links(classes, sample_rows=400, shard_rows=64, block_rows=block)
        got = {r.node: r.root for r in components.components(found).collect()}
        order = fp.view(np.int64)
        groups = {}
        for x, root in zip(order.tolist(), label.tolist()):
            groups.setdefault(root, set()).add(x)
        mine = {}
        for x in order.tolist():
            mine.setdefault(got.get(x, x), set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
    rows = simhash.simhash_components(edge).collect()
    assert {r.component_id for r in rows if r.fp == 0} == {1} and len(rows) == len(EDGE)
    assert simhash.simhash_dedup(edge).where("doc_id = 5").count() == 1
    assert simhash.simhash_components(empty).count() == 0 and simhash.simhash_dedup(empty).count() == 0


def test_sentence_spans(spark, edge, empty):
    passage = "The red fox ran over seven old stone walls. It slept there until the rain had gone away."
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, f"First one begins here. {passage} End of one."), (2, f"Other start is this. {passage} Last."),
            (3, f"Alone it stands here.\n{long}"), (4, f"{long}\nAnother end of text."), (5, "To be. Or not."),
            (6, "To be. Or not."), (7, f"{passage}\n{passage}")]
    got = {r.doc_id: r for r in sentence_spans.sentence_span_dedup(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    assert got[2].text == "Other start is this. Last." and got[2].span_dedup.n_removed == 1
    assert got[4].text == "Another end of text." and got[5].text == got[6].text == "To be. Or not."
    assert got[7].text == ""
    again = {r.doc_id: r for r in sentence_spans.sentence_span_dedup(
        spark.createDataFrame(rows[6:], "doc_id long, text string")).collect()}
    assert again[7].text.strip() == passage
    out = sentence_spans.sentence_span_dedup(edge)
    assert out.columns == [*edge.columns, "span_dedup"] and out.count() == len(EDGE)
    assert sentence_spans.sentence_span_dedup(empty).count() == 0


def _kept_words(spark, rows):
    out = sentence_spans.sentence_span_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r.doc_id: r.text.split() for r in out.collect()}


def test_passages_inside_long_sentences(spark):
    rng = random.Random(5)
    word = lambda n: [f"v{rng.randrange(50_000)}" for _ in range(n)]
    rows, passages = [], {}
    for k, n in enumerate([51, 60, 75, 100] * 10):
        passage = word(n)
        for doc in (2 * k, 2 * k + 1):
            rows.append((doc, " ".join(word(40 + rng.randrange(200)) + passage + word(40 + rng.randrange(200)))))
        passages[2 * k + 1] = passage
    got = _kept_words(spark, rows)
    for doc, text in rows:
        left = set(got[doc])
        if doc not in passages:
            assert got[doc] == text.split()
            continue
        # Own words stay; of the passage at most the ends, which depend on the host, stay.
        assert [w for w in text.split() if w not in passages[doc]] == [w for w in got[doc] if w not in passages[doc]]
        assert sum(w in left for w in passages[doc]) <= 4 * sentence_spans.PIECE_WORDS - 2


def test_passages_pasted_into_sentences(spark):
    rng = random.Random(6)
    word = lambda n: [f"v{rng.randrange(50_000)}" for _ in range(n)]
    rows, passages = [], {}
    for k, sizes in enumerate([(20, 20, 20), (30, 22), (17, 17, 17), (25, 26)] * 10):
        passage = ". ".join(" ".join(word(n)) for n in sizes)
        for doc in (2 * k, 2 * k + 1):
            rows.append((doc, f"{' '.join(word(1 + k % 9))} {passage} {' '.join(word(1 + (k + doc) % 7))}."))
        passages[2 * k + 1] = passage.split()
    got = _kept_words(spark, rows)
    for doc, text in rows:
        if doc not in passages:
            assert got[doc] == text.split()
            continue
        assert [w for w in text.split() if w not in passages[doc]] == [w for w in got[doc] if w not in passages[doc]]
        assert sum(w in passages[doc] for w in got[doc]) <= 4 * sentence_spans.PIECE_WORDS - 2


def _passage_rows():
    """Passages shared by many documents and repeated inside them, shared and null ids,
    rows that come twice."""
    rng = random.Random(8)
    word = lambda n: " ".join(f"v{rng.randrange(50_000)}" for _ in range(n))
    shared = [". ".join(word(15) for _ in range(4)) for _ in range(3)]
    rows = [(1000 - k if k % 7 else None if k % 2 else 500, f"{word(60)}. " + ". ".join(
        f"{p}. {word(20)}" for p in rng.choices(shared, k=rng.randrange(4))) + ".") for k in range(120)]
    return rows + rows[::5] + [(3, None), (4, "")]


def test_spans_against_all_runs(spark):
    rows = _passage_rows()
    none = sentence_spans._NO_ID
    runs_of, first = {}, {}
    for doc, text in rows:
        found = sentence_spans.pieces(text)
        made = sentence_spans.digests(found, *sentence_spans.runs(found))
        runs_of[doc, text] = made
        for digest in made:
            first[digest] = min(first.get(digest, none), none if doc is None else doc)
    want = []
    for doc, text in rows:
        made = runs_of[doc, text]
        gone = [k for k, digest in enumerate(made)
                if (none if doc is None else doc) > first[digest] or digest in made[:k]]
        kept, spans = sentence_spans.cut(text, gone) if gone else (text, [])
        want.append((doc, kept, len(spans)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.text, r.span_dedup.n_removed) for r in sentence_spans.sentence_span_dedup(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(n for _, _, n in want) > 100


def test_runs_of_many_documents_stay_in_their_task(spark):
    docs = spark.createDataFrame([r for r in _passage_rows() if r[0]], "doc_id long, text string").coalesce(1)
    made = sentence_spans.span_runs(docs).groupBy("h", "c").agg(F.count_distinct("id").alias("n")).collect()
    assert max(r.n for r in made if r.c is not None) == 1  # one document may still be the first
    pairs = lambda held: {(r.id, r.text_hash, r.run) for r in sentence_spans.span_runs(
        docs, held_runs=held).collect()}
    assert pairs(1) == pairs(1 << 18)


def test_spans_write_only_what_goes(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(f"v{rng.randrange(50_000)}" for _ in range(300)) + ".") for k in range(400)]
    root = checkpoint_dir(spark).removeprefix("file:")
    files = lambda: {os.path.join(at, f) for at, _, fs in os.walk(root) for f in fs}
    before = files()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sentence_spans.sentence_span_dedup(docs).where("span_dedup.n_removed > 0").count() == 0
    written = sum(os.path.getsize(f) for f in files() - before)
    assert written < sum(len(text) for _, text in rows) / 10


def test_rollups_are_idempotent(spark):
    schema = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long"
    rollup = token_rollups.TokenRollup(spark)
    load = spark.createDataFrame([("insert", 1, "a", "en", "t", 5), ("insert", 2, "a", None, "t", None),
                                  ("insert", None, "b", "en", "t", 2), ("insert", 1, "a", "en", "t", 5)], schema)
    assert rollup.commit("b1", load) and not rollup.commit("b1", load)
    change = spark.createDataFrame([("revise", 1, "c", "en", "t", 9), ("delete", 2, None, None, "t", None),
                                    ("delete", 77, None, None, "t", None)], schema)
    assert rollup.commit("b2", change) and rollup.commit("b3", load.limit(0))
    got = {tuple(r) for r in rollup.totals().collect()}
    assert got == {("c", "en", "t", 1, 9), ("b", "en", "t", 1, 2)}
    assert token_rollups.TokenRollup(spark).totals().count() == 0


def test_licenses(spark, edge, empty):
    s = license_scan.SENTENCES
    docs = spark.createDataFrame([(1, f"Hi there. {s[1]}\n{s[4].upper()}"), (2, f"{s[9]} a. b. {s[10]}"),
                                  (3, s[10] + " " + s[9]), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.license_scan for r in license_scan.scan_licenses(docs).collect()}
    assert got[1].licenses == ["CC-BY-NC-4.0", "MIT"] and got[1].sentence_ids == [1, 4]
    assert got[2].licenses == ["BSD-3-Clause"] and got[3].licenses == ["BSD-2-Clause"]
    assert got[4].licenses == [] and license_scan.scan_licenses(empty).count() == 0


def test_licenses_wrapped(spark):
    s = license_scan.SENTENCES
    rows = []
    for width in (40, 72, 79):
        for mark in ("", " * ", "# ", "// "):
            wrap = lambda t: "\n".join(mark + x for x in textwrap.wrap(t, width))  # noqa: E731, B023
            gap = f"\n{mark.rstrip()}\n"
            url = "http://www.apache.org/licenses/LICENSE-2.0"
            rows += [(gap.join(["MIT License", "Copyright (c) 2020 A", wrap(s[5]), wrap(s[6]), "THE SOFTWARE IS"]),
                      [5, 6], ["MIT"]),
                     (gap.join([wrap(f"Copyright 2020 B. {s[7]} You may obtain a copy of the License at"),
                                mark + "    " + url, wrap("Unless required by applicable law")]),
                      [7, 8], ["Apache-2.0"]),
                     (gap.join([wrap(s[9]), wrap("1. Redistributions of source code must retain this."),
                                wrap("3. " + s[10])]), [9, 10], ["BSD-3-Clause"]),
                     (wrap(s[9]), [9], ["BSD-2-Clause"]), (wrap(s[11]) + "\r\n" + s[1], [11, 1], ["CC-BY-4.0", "MIT"]),
                     (wrap("Not " + s[9]), [], [])]
    docs = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license_scan for r in license_scan.scan_licenses(docs).collect()}
    for k, (text, ids, names) in enumerate(rows):
        assert [i for i in got[k].sentence_ids if i != 2] == ids and got[k].licenses == names, text


def test_chat_round_trip(spark):
    for text in ("<s>", "<\\s>", "<\\\\/s>[INST][\\/INST]", "<<s>>", "a\\b", ""):
        out = chat_format.escape(text)
        assert chat_format.unescape(out) == text and not any(c in out for c in chat_format.CONTROL)
    rows = [(1, 1, "assistant", "b </s>"), (1, 0, "user", None), (1, 2, None, "[INST]x"), (None, None, "assistant", "é𝄞"),
            (2, 0, "assistant", "x"), (2, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(
        chat_format.format_turns(df, tokenizer_path()), tokenizer_path()).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\nb </s>\n\n[INST]x\n") and got[1].n_turns == 3
    assert got[1].loss_sha256 == sha("b </s>") and got[1].loss_chars == 6
    assert got[None].loss_sha256 == sha("é𝄞") and got[2].loss_sha256 == sha("xx")
    assert chat_format.read_back(chat_format.format_turns(df.limit(0), tokenizer_path()), tokenizer_path()).count() == 0


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, found, SF)
        assert found.columns == docs.columns, name
    texts = [r.text for r in found.collect()]
    got = corpus_pipeline.run(spark, SF)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) for t in texts)
    assert want == sorted(r.n_tokens for r in got.select("n_tokens").collect())
