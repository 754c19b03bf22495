"""DuckDB SQL oracles for the registered queries.

Plain SQL over the driver's views. Hash planes and widths are written into the SQL as
constants (17 significant digits, exponent form, so DuckDB reads the same doubles).
"""

from __future__ import annotations

from annspark.functions.hashing import EuclideanFamily, SignFamily
from annspark.plans import params as P

R = P.ROUND


def _num(x: float) -> str:
    return format(float(x), ".17e")


def _vec(values) -> str:
    return "[" + ", ".join(_num(x) for x in values) + "]::DOUBLE[]"


BASE = ("base AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS v, label "
        "FROM embeddings), "
        "q AS (SELECT * FROM base WHERE id % 5 = 0), "
        "t AS (SELECT * FROM base WHERE id % 5 <> 0)")


def planes_cte(name: str, family) -> str:
    if isinstance(family, SignFamily):
        planes = family.planes(P.WIDTH)
        rows = [f"({t}, {b}, {_vec(planes[t, b])})"
                for t in range(family.n_tables) for b in range(family.n_bits)]
        return f"{name}(tbl, bit, p) AS (VALUES {', '.join(rows)})"
    planes = family.planes(P.WIDTH)
    rows = [f"({t}, {_vec(planes[t])})" for t in range(family.n_tables)]
    return f"{name}(tbl, p) AS (VALUES {', '.join(rows)})"


def sig_cte(name: str, src: str, planes: str, family) -> str:
    if isinstance(family, SignFamily):
        bucket = (f"CAST(SUM(CASE WHEN list_inner_product(s.v, pl.p) >= 0 "
                  f"THEN CAST(1 AS BIGINT) << CAST(pl.bit AS BIGINT) ELSE 0 END) AS BIGINT)")
        return (f"{name} AS (SELECT s.id, pl.tbl, {bucket} AS bucket FROM {src} s "
                f"CROSS JOIN {planes} pl GROUP BY s.id, pl.tbl)")
    bucket = f"CAST(floor(list_inner_product(s.v, pl.p) / {_num(family.bucket_length)}) AS BIGINT)"
    return f"{name} AS (SELECT s.id, pl.tbl, {bucket} AS bucket FROM {src} s CROSS JOIN {planes} pl)"


def ranked_ctes(family, q: str = "q", t: str = "t", exclude_self: bool = False,
                threshold: float | None = None, suffix: str = "") -> list[str]:
    """CTEs ending in ``ranked{suffix}(q_id, t_id, t_label, distance, rn, n_candidates)``."""
    s = suffix
    ctes = []
    if family is None:
        cand = f"cand{s} AS (SELECT a.id AS q_id, b.id AS t_id FROM {q} a CROSS JOIN {t} b" + (
            " WHERE a.id <> b.id)" if exclude_self else ")")
        ctes.append(cand)
    else:
        ctes += [planes_cte(f"pl{s}", family),
                 sig_cte(f"sq{s}", q, f"pl{s}", family),
                 sig_cte(f"st{s}", t, f"pl{s}", family)]
        ctes.append(
            f"cand{s} AS (SELECT DISTINCT a.id AS q_id, b.id AS t_id FROM sq{s} a JOIN st{s} b "
            f"ON a.tbl = b.tbl AND a.bucket = b.bucket"
            + (" WHERE a.id <> b.id)" if exclude_self else ")"))
    cut = f" WHERE list_distance(qq.v, tt.v) < {_num(threshold)}" if threshold is not None else ""
    ctes.append(
        f"dist{s} AS (SELECT c.q_id, c.t_id, tt.label AS t_label, list_distance(qq.v, tt.v) AS distance "
        f"FROM cand{s} c JOIN {q} qq ON qq.id = c.q_id JOIN {t} tt ON tt.id = c.t_id{cut})")
    ctes.append(
        f"ranked{s} AS (SELECT q_id, t_id, t_label, distance, "
        f"CAST(row_number() OVER (PARTITION BY q_id ORDER BY distance, t_id) AS BIGINT) AS rn, "
        f"CAST(count(*) OVER (PARTITION BY q_id) AS BIGINT) AS n_candidates FROM dist{s})")
    return ctes


def _with(*ctes) -> str:
    return "WITH " + ", ".join([BASE, *ctes]) + " "


def neighbours_sql(family, k=P.K, threshold=None, q="q", t="t", exclude_self=False) -> str:
    return _with(*ranked_ctes(family, q, t, exclude_self, threshold)) + (
        f"SELECT q_id, t_id, t_label, round(distance, {R}) AS distance, rn, n_candidates "
        f"FROM ranked WHERE rn <= {k}")


def vote_ctes(k=P.K, suffix: str = "") -> list[str]:
    s = suffix
    return [
        f"per{s} AS (SELECT q_id, t_label, count(*) AS votes, min(distance) AS nearest, "
        f"max(n_candidates) AS n_cand FROM ranked{s} WHERE rn <= {k} GROUP BY q_id, t_label)",
        f"best{s} AS (SELECT q_id, t_label, n_cand, row_number() OVER (PARTITION BY q_id "
        f"ORDER BY votes DESC, nearest, t_label) AS r FROM per{s})",
    ]


def classify_sql(family, k=P.K, threshold=None) -> str:
    return _with(*ranked_ctes(family, threshold=threshold), *vote_ctes(k)) + (
        "SELECT q.id AS q_id, q.label, CAST(coalesce(b.t_label, -1) AS INTEGER) AS prediction, "
        "CAST(coalesce(b.n_cand, 0) AS BIGINT) AS n_candidates "
        "FROM q LEFT JOIN best b ON b.q_id = q.id AND b.r = 1")


def _stats(src="base") -> str:
    return (f"CAST(len(v) AS BIGINT) AS width, "
            f"CAST(len(list_filter(v, lambda x: x <> 0)) AS BIGINT) AS nnz, "
            f"round(list_sum(v), {R}) AS vsum, round(list_inner_product(v, v), {R}) AS vsq")


def _sweep_sql(settings) -> str:
    """``settings``: pairs of the columns that name a setting, as SQL, and its family."""
    ks = sorted(P.SWEEP_KS)
    kmax = ks[-1]
    ctes = [*ranked_ctes(None, suffix="_x")]
    selects = []
    kv = ", ".join(f"({k})" for k in ks)
    ctes.append(f"ks(k) AS (VALUES {kv})")
    for i, (names, fam) in enumerate(settings):
        s = f"_{i}"
        ctes += ranked_ctes(fam, suffix=s)
        ctes.append(
            f"per{s} AS (SELECT ks.k, q_id, t_label, count(*) AS votes, min(distance) AS nearest "
            f"FROM ranked{s} JOIN ks ON rn <= ks.k WHERE rn <= {kmax} GROUP BY ks.k, q_id, t_label)")
        ctes.append(
            f"best{s} AS (SELECT k, q_id, t_label, row_number() OVER (PARTITION BY k, q_id "
            f"ORDER BY votes DESC, nearest, t_label) AS r FROM per{s})")
        ctes.append(
            f"acc{s} AS (SELECT ks.k, avg(CASE WHEN b.t_label = q.label THEN 1.0 ELSE 0.0 END) AS accuracy "
            f"FROM q CROSS JOIN ks LEFT JOIN best{s} b ON b.q_id = q.id AND b.k = ks.k AND b.r = 1 "
            f"GROUP BY ks.k)")
        ctes.append(
            f"hit{s} AS (SELECT ks.k, count(x.q_id) AS hits FROM ks LEFT JOIN (ranked{s} a JOIN ranked_x x "
            f"ON a.q_id = x.q_id AND a.t_id = x.t_id) ON a.rn <= ks.k AND x.rn <= ks.k GROUP BY ks.k)")
        ctes.append(
            f"cnt{s} AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_candidates FROM "
            f"(SELECT q_id, max(n_candidates) AS n FROM ranked{s} GROUP BY q_id))")
        selects.append(
            f"SELECT {names}, CAST(a.k AS BIGINT) AS k, round(a.accuracy, {R}) AS accuracy, "
            f"round(h.hits / (a.k * (SELECT count(*) FROM q)), {R}) AS recall, c.n_candidates "
            f"FROM acc{s} a JOIN hit{s} h ON h.k = a.k CROSS JOIN cnt{s} c")
    return _with(*ctes) + " UNION ALL ".join(selects)


def bucket_vote_sql(family, q: str = "q", t: str = "t", extra=()) -> str:
    """Bucket vote of the rows of ``q`` by the rows of ``t``; every row of the split reported."""
    return _with(
        *extra, planes_cte("pl", family), sig_cte("sq", q, "pl", family), sig_cte("st", t, "pl", family),
        "hist AS (SELECT st.tbl, st.bucket, t.label AS t_label, count(*) AS cnt "
        "FROM st JOIN base t ON t.id = st.id GROUP BY st.tbl, st.bucket, t.label)",
        "votes AS (SELECT sq.id AS q_id, h.t_label, sum(h.cnt) AS votes FROM sq JOIN hist h "
        "ON sq.tbl = h.tbl AND sq.bucket = h.bucket GROUP BY sq.id, h.t_label)",
        "best AS (SELECT q_id, t_label, sum(votes) OVER (PARTITION BY q_id) AS n_cand, "
        "row_number() OVER (PARTITION BY q_id ORDER BY votes DESC, t_label) AS r FROM votes)",
    ) + ("SELECT q.id AS q_id, q.label, CAST(coalesce(b.t_label, -1) AS INTEGER) AS prediction, "
         "CAST(coalesce(b.n_cand, 0) AS BIGINT) AS n_candidates "
         "FROM q LEFT JOIN best b ON b.q_id = q.id AND b.r = 1")


def build() -> dict[str, str]:
    S, E, K, THR = P.SIGN, P.EUCLID, P.K, P.THRESHOLD
    sql = {}
    sql["libsvm_round_trip"] = _with() + (
        "SELECT CASE WHEN id % 5 = 0 THEN 'test' ELSE 'train' END AS split, "
        "CAST(row_number() OVER (PARTITION BY id % 5 = 0 ORDER BY id) - 1 AS BIGINT) AS row_id, "
        f"CAST(label AS DOUBLE) AS label, {_stats()} FROM base")
    sql["libsvm_bz2"] = _with() + f"SELECT CAST(label AS DOUBLE) AS label, {_stats()} FROM base"
    sql["csv_vectors"] = _with() + f"SELECT id, {_stats()} FROM base"
    sql["csv_inferred"] = sql["csv_vectors"]
    sql["csv_ground_truth"] = _with(*ranked_ctes(None)) + (
        f"SELECT q_id AS query_id, rn AS rank, t_id AS train_id FROM ranked WHERE rn <= {K}")
    sql["head_sample"] = _with() + (
        f"SELECT id, label, round(list_sum(v), {R}) AS vsum FROM base ORDER BY id LIMIT {P.HEAD_ROWS}")
    sql["bernoulli_all"] = _with() + "SELECT id, label FROM base"
    sql["hash_sample"] = _with() + (
        f"SELECT id, label FROM base WHERE CAST('0x' || substr(md5('{P.SAMPLE_SEED}:' || id), 1, 15) AS BIGINT) "
        f"< {int(P.SAMPLE_FRACTION * (1 << 60))}")
    thin = [f"{name}s AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS id, label, "
            f"list_transform(v, lambda x: CASE WHEN abs(x) < {_num(P.SPARSE_CUT)} THEN 0.0 ELSE x END) AS v "
            f"FROM {name})" for name in "qt"]
    sql["libsvm_sparse_knn"] = _with(*thin, *ranked_ctes(S, "qs", "ts")) + (
        f"SELECT q_id, t_id, t_label, round(distance, {R}) AS distance, rn, n_candidates "
        f"FROM ranked WHERE rn <= {K}")
    sql["result_view_projection"] = _with(*ranked_ctes(S, threshold=THR)) + (
        "SELECT r.t_label AS label_train, q.label AS label_test, r.t_id AS train_id, "
        f"r.q_id AS test_id, round(r.distance, {R}) AS distance FROM ranked r JOIN q ON q.id = r.q_id")
    sql["pad_vectors"] = _with() + (
        f"SELECT id, CAST({P.PAD_WIDTH} AS BIGINT) AS width, round(list_sum(v), {R}) AS vsum, "
        f"CAST({P.PAD_WIDTH - P.WIDTH} AS BIGINT) AS tail_zeros FROM base")
    sql["mint_ids"] = _with() + (
        "SELECT id, CAST(row_number() OVER (ORDER BY label, id) - 1 AS BIGINT) AS row_id FROM base")
    sql["sign_signatures"] = _with(planes_cte("pl", S), sig_cte("sb", "base", "pl", S)) + (
        "SELECT id, CAST(tbl AS INTEGER) AS tbl, bucket FROM sb")
    sql["euclid_hashes"] = _with(planes_cte("pl", E), sig_cte("sb", "base", "pl", E)) + (
        "SELECT id, CAST(tbl AS INTEGER) AS tbl, bucket FROM sb")
    sql["similarity_join"] = _with(*ranked_ctes(S, threshold=THR)) + (
        f"SELECT q_id, t_id, round(distance, {R}) AS distance FROM ranked")
    sql["similarity_join_default"] = _with(*ranked_ctes(S, threshold=2.5 * P.WIDTH)) + (
        f"SELECT q_id, t_id, round(distance, {R}) AS distance FROM ranked")
    sql["similarity_join_euclid"] = _with(*ranked_ctes(E, threshold=THR)) + (
        f"SELECT q_id, t_id, round(distance, {R}) AS distance FROM ranked")
    sql["search_one_key"] = _with(
        "key AS (SELECT * FROM base WHERE id = (SELECT min(id) FROM base))",
        planes_cte("pl", S), sig_cte("ks", "key", "pl", S), sig_cte("ts", "base", "pl", S),
        "cand AS (SELECT DISTINCT ts.id FROM ts JOIN ks ON ts.tbl = ks.tbl AND ts.bucket = ks.bucket)",
        "d AS (SELECT t.id, t.label, list_distance(t.v, key.v) AS distance "
        "FROM cand JOIN base t ON t.id = cand.id CROSS JOIN key)",
        "r AS (SELECT id, label, distance, CAST(row_number() OVER (ORDER BY distance, id) AS BIGINT) AS rn FROM d)",
    ) + f"SELECT id, label, round(distance, {R}) AS distance, rn FROM r WHERE rn <= {K}"
    sql["search_one_key_indexed"] = sql["search_one_key"]
    sql["batch_top_k"] = neighbours_sql(S)
    sql["bucketed_index_search"] = sql["batch_top_k"]
    sql["late_top_k"] = sql["batch_top_k"]
    sql["late_rerank_classify"] = classify_sql(P.HOT)
    sql["indexed_search"] = sql["batch_top_k"]
    pairs = ("pairs AS (SELECT q.id AS q_id, CAST(count(b.id) AS BIGINT) AS n_pairs FROM q JOIN sq a ON a.id = q.id "
             "LEFT JOIN st b ON a.tbl = b.tbl AND a.bucket = b.bucket GROUP BY q.id)")
    batched = (f"batched AS (SELECT q_id, n_pairs, CAST((sum(n_pairs) OVER (ORDER BY q_id) - n_pairs) "
               f"// {P.BATCH_PAIRS // 2} AS BIGINT) AS batch FROM pairs)")
    sql["batched_queries"] = _with(*ranked_ctes(E), pairs, batched) + (
        f"SELECT r.q_id, t_id, t_label, round(distance, {R}) AS distance, rn, n_candidates, b.n_pairs, b.batch "
        f"FROM ranked r JOIN batched b ON b.q_id = r.q_id WHERE rn <= {K}")
    sql["euclid_knn"] = neighbours_sql(E, threshold=THR)
    sql["exact_knn"] = neighbours_sql(None)
    sql["exact_self_knn"] = neighbours_sql(None, q="base", t="base", exclude_self=True)
    sql["bucket_histogram"] = _with(planes_cte("pl", S), sig_cte("st", "base", "pl", S)) + (
        "SELECT CAST(st.tbl AS INTEGER) AS tbl, st.bucket, t.label, CAST(count(*) AS BIGINT) AS cnt "
        "FROM st JOIN base t ON t.id = st.id GROUP BY st.tbl, st.bucket, t.label")
    sql["bucket_members"] = _with(planes_cte("pl", S), sig_cte("st", "base", "pl", S)) + (
        "SELECT CAST(tbl AS INTEGER) AS tbl, bucket, CAST(count(*) AS BIGINT) AS n_members, "
        "CAST(sum(id) AS BIGINT) AS id_sum, min(id) AS id_min, max(id) AS id_max "
        "FROM st GROUP BY tbl, bucket")
    sql["bucket_postings"] = _with(planes_cte("pl", P.HOT), sig_cte("st", "base", "pl", P.HOT)) + (
        "SELECT CAST(tbl AS INTEGER) AS tbl, bucket, CAST(count(*) AS BIGINT) AS n_members, min(id) AS first_id, "
        "max(id) AS last_id, true AS bounded FROM st GROUP BY tbl, bucket")
    sql["flatten_postings"] = sql["sign_signatures"]
    sql["bucket_vote"] = bucket_vote_sql(S)
    top = (f"SELECT q_id, t_id, t_label, round(distance, {R}) AS distance, rn, n_candidates "
           f"FROM ranked WHERE rn <= {K}")
    usable = ["qd AS (SELECT * FROM q WHERE id % 7 > 2)", "td AS (SELECT * FROM t WHERE id % 7 > 2)"]
    sql["bucket_vote_dirty"] = bucket_vote_sql(S, "qd", "td", usable)
    sql["knn_dirty_vectors"] = _with(*usable, *ranked_ctes(None, "qd", "td")) + top
    large = [f"{name}l AS (SELECT id, label, list_transform(v, lambda x: x * 1e20) AS v FROM {name})"
             for name in "qt"]
    sql["knn_large_values"] = _with(*large, *ranked_ctes(None, "ql", "tl")) + top.replace(
        "round(distance,", "round(distance / 1e20,")
    sql["batch_top_k_split"] = sql["batch_top_k"]
    sql["exact_knn_split"] = sql["exact_knn"]
    sql["hot_bucket_knn"] = neighbours_sql(P.HOT)
    sql["rerank_classify"] = classify_sql(S)
    sql["classify_text_labels"] = classify_sql(S).replace(
        "q.label, CAST(coalesce(b.t_label, -1) AS INTEGER) AS prediction",
        "'class ' || q.label AS label, coalesce('class ' || b.t_label, '-1') AS prediction")
    sql["euclid_classify"] = classify_sql(E)
    sql["exact_classify"] = classify_sql(None)
    share_ctes = [*ranked_ctes(E, threshold=THR),
                  "sh AS (SELECT r.q_id, count(*) AS n_neighbours, "
                  "sum(CASE WHEN r.t_label = q.label THEN 1 ELSE 0 END) AS n_match, "
                  "avg(CASE WHEN r.t_label = q.label THEN 1.0 ELSE 0.0 END) AS share "
                  f"FROM ranked r JOIN q ON q.id = r.q_id WHERE r.rn <= {K} GROUP BY r.q_id)"]
    sql["match_share"] = _with(*share_ctes) + (
        "SELECT q_id, CAST(n_neighbours AS BIGINT) AS n_neighbours, CAST(n_match AS BIGINT) AS n_match, "
        f"round(share, {R}) AS share FROM sh")
    sql["strict_majority_accuracy"] = _with(*share_ctes) + (
        "SELECT CAST(count(*) AS BIGINT) AS n_queries, "
        "CAST(sum(CASE WHEN sh.share > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_majority, "
        f"round(sum(CASE WHEN sh.share > 0.5 THEN 1 ELSE 0 END) / count(*), {R}) AS accuracy "
        "FROM q LEFT JOIN sh ON sh.q_id = q.id")
    acc = ("SELECT '{split}' AS split, CAST(count(*) AS BIGINT) AS n, "
           "CAST(sum(CASE WHEN coalesce(b.t_label, -1) = x.label THEN 1 ELSE 0 END) AS BIGINT) AS hits, "
           f"round(avg(CASE WHEN coalesce(b.t_label, -1) = x.label THEN 1.0 ELSE 0.0 END), {R}) AS accuracy "
           "FROM {src} x LEFT JOIN best{s} b ON b.q_id = x.id AND b.r = 1")
    sql["accuracy_train_test"] = _with(
        *ranked_ctes(S, q="t", t="t", exclude_self=True, suffix="_tr"), *vote_ctes(K, "_tr"),
        *ranked_ctes(S, suffix="_te"), *vote_ctes(K, "_te"),
    ) + acc.format(split="train", src="t", s="_tr") + " UNION ALL " + acc.format(split="test", src="q", s="_te")
    sql["neighbour_lists"] = _with(*ranked_ctes(E)) + (
        "SELECT q_id, string_agg(CAST(t_id AS VARCHAR), ',' ORDER BY rn) AS neighbours "
        f"FROM ranked WHERE rn <= {K} GROUP BY q_id")
    sql["recall_at_k"] = _with(*ranked_ctes(E), *ranked_ctes(None, suffix="_x")) + (
        f"SELECT CAST({K} AS BIGINT) AS k, CAST((SELECT count(*) FROM q) AS BIGINT) AS n_queries, "
        "CAST(count(*) AS BIGINT) AS hits, "
        f"round(count(*) / ({K} * (SELECT count(*) FROM q)), {R}) AS recall "
        f"FROM ranked a JOIN ranked_x x ON a.q_id = x.q_id AND a.t_id = x.t_id "
        f"WHERE a.rn <= {K} AND x.rn <= {P.GT_DEPTH}")
    sql["csv_recall_pipeline"] = sql["recall_at_k"]
    sql["sweep"] = _sweep_sql([
        (f"CAST({_num(bl)} AS DOUBLE) AS bl, CAST({nht} AS BIGINT) AS nht", EuclideanFamily(bl, nht, S.seed))
        for bl in P.SWEEP_BUCKET_LENGTHS for nht in P.SWEEP_TABLES])
    sql["sweep_sign"] = _sweep_sql([
        (f"CAST({bits} AS BIGINT) AS bits, CAST({tables} AS BIGINT) AS tables", SignFamily(tables, bits, S.seed))
        for bits, tables in P.SWEEP_SIGN])
    sql["exact_knn_pruned"] = _with(*ranked_ctes(None)) + (
        f"SELECT q_id, t_id, t_label, round(distance, {R}) AS distance, rn FROM ranked WHERE rn <= {K}")
    sql["accuracy_exact"] = _with(
        *ranked_ctes(None, q="t", t="t", exclude_self=True, suffix="_tr"), *vote_ctes(K, "_tr"),
        *ranked_ctes(None, suffix="_te"), *vote_ctes(K, "_te"),
    ) + acc.format(split="train", src="t", s="_tr") + " UNION ALL " + acc.format(split="test", src="q", s="_te")
    bag = ("votes{s} AS (SELECT a.id, t.label AS t_label, count(*) AS votes FROM {src} a JOIN st b "
           "ON a.tbl = b.tbl AND a.bucket = b.bucket AND a.id <> b.id JOIN t ON t.id = b.id GROUP BY a.id, t.label), "
           "best{s} AS (SELECT id AS q_id, t_label, row_number() OVER (PARTITION BY id "
           "ORDER BY votes DESC, t_label) AS r FROM votes{s})")
    sql["accuracy_bucket_vote"] = _with(
        planes_cte("pl", S), sig_cte("sq", "q", "pl", S), sig_cte("st", "t", "pl", S),
        bag.format(s="_tr", src="st"), bag.format(s="_te", src="sq"),
    ) + acc.format(split="train", src="t", s="_tr") + " UNION ALL " + acc.format(split="test", src="q", s="_te")
    return sql
