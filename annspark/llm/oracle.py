"""DuckDB SQL of the queries that SQL can express."""

from annspark.llm.hard_negatives import HIGH, LOW, NEGATIVES, POSITIVES, SCALE
from annspark.llm.license_scan import RULES as LICENSE_RULES
from annspark.llm.license_scan import SENTENCES, plain
from annspark.llm.mixing import MAX_EPOCHS, SEED
from annspark.llm.quality_rules import ALPHA, DELTA, RULES, WINDOW, ladder

WORD = r"[^\x20\x09-\x0D]+"


def mixing() -> str:
    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM sized GROUP BY source),
caps AS (
  SELECT *, ({MAX_EPOCHS} * source_size)::DOUBLE AS cap,
         row_number() OVER (ORDER BY {MAX_EPOCHS} * source_size / w, source) AS o FROM src),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM src)
             - coalesce(sum(cap) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps),
goal AS (
  SELECT source, source_size,
         least(w * (SELECT arg_min(level, o) FROM levels WHERE cap > w * level), cap) AS target
  FROM caps),
ordered AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target,
         row_number() OVER (PARTITION BY d.source ORDER BY md5('{SEED}:' || d.doc_id), d.size) AS place,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('{SEED}:' || d.doc_id), d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS whole
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
fitted AS (
  SELECT *, size > 0 AND upto <= target - whole * source_size AS fits FROM ordered),
missing AS (
  SELECT source, max(target - whole * source_size) - sum(CASE WHEN fits THEN size ELSE 0 END) AS gap
  FROM fitted GROUP BY source),
nearest AS (
  SELECT f.source, arg_min(place, (abs(size - gap), place)) AS pick
  FROM fitted f JOIN missing m ON f.source IS NOT DISTINCT FROM m.source
  WHERE NOT fits AND size > 0 AND abs(size - gap) < gap GROUP BY f.source)
SELECT doc_id, f.source, size, source_size, target,
       (size * (whole + CASE WHEN fits OR coalesce(place = pick, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM fitted f LEFT JOIN nearest n ON f.source IS NOT DISTINCT FROM n.source
"""


def quality_rules() -> str:
    rules = {r.name: r for r in RULES}

    def hit(name: str, cutoff) -> str:
        r = rules[name]
        return f"{r.scale} * {r.value} {'<' if r.below else '>'} {cutoff} * {r.per}"

    rungs = ladder()
    tallies = ", ".join(
        f"sum(CASE WHEN {' OR '.join(hit(*rung) for rung in reached.items())} THEN 1 ELSE 0 END)::BIGINT"
        for reached in rungs)
    cutoffs = ", ".join("({}, {})".format(j, ", ".join(str(reached.get(r.name, "NULL")) for r in RULES))
                        for j, reached in enumerate(rungs))
    rejects = " OR ".join(f"coalesce({hit(r.name, 'l.' + r.name)}, false)" for r in RULES)
    return rf"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws
  FROM documents),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS n
  FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM words)),
places AS (
  SELECT r, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, {WINDOW})) AS gain
  FROM windows WHERE n > 1),
repeats AS (SELECT r, sum(gain)::BIGINT AS n FROM places GROUP BY r),
lines AS (
  SELECT r, doc_id, lang, t, ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM words),
counts AS (
  SELECT doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
  FROM lines LEFT JOIN repeats USING (r)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
held AS (
  SELECT base.* FROM base JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1) USING (doc_id)
  WHERE NOT base_failed),
tallies AS (
  SELECT lang, count(*) AS n, [{tallies}] AS ks FROM held GROUP BY lang),
tested AS (
  SELECT lang, n, unnest(ks) AS k, generate_subscripts(ks, 1) - 1 AS rung FROM tallies),
certified AS (
  SELECT lang, max(rung) AS rung FROM tested
  WHERE CASE WHEN k >= {ALPHA} * n THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(
    lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) END
    <= {DELTA} / (SELECT count(*) FROM tallies)
  GROUP BY lang),
limits AS (
  SELECT lang, c.* FROM certified JOIN (VALUES {cutoffs}) AS c(rung, {', '.join(r.name for r in RULES)}) USING (rung))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (
         SELECT 1 FROM limits l WHERE l.lang IS NOT DISTINCT FROM base.lang AND ({rejects})) AS kept
FROM base
"""


def lattice() -> str:
    return """
WITH RECURSIVE usable AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b, a.vec_id AS va, b.vec_id AS vb FROM usable a JOIN usable b ON a.r <> b.r
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT reach.a, min(u.vec_id) AS m FROM reach JOIN usable u ON u.r = reach.b GROUP BY reach.a),
found AS (
  SELECT u.vec_id, (SELECT count(*) FROM links WHERE links.a = u.r) AS n_links,
         least(u.vec_id, coalesce(least.m, u.vec_id)) AS component_id
  FROM usable u LEFT JOIN least ON least.a = u.r)
SELECT e.vec_id, coalesce(f.n_links, 0)::BIGINT AS n_links, coalesce(f.component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(f.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN found f USING (vec_id)
"""


def url_filter() -> str:
    return """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rule, host, path, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(r.verdict, length(rule)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""


def license_scan() -> str:
    known = ", ".join(f"({i}, '{plain(s)}')" for i, s in SENTENCES.items())
    cases = []
    for name, ids in LICENSE_RULES:
        test = _sequence(ids)
        for _, other in LICENSE_RULES:
            if len(other) > len(ids) and set(ids) <= set(other):
                test += f" AND NOT {_sequence(other)}"
        cases.append(f"CASE WHEN {test} THEN '{name}' END")
    return rf"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(replace(regexp_replace(coalesce(text, ''), '([.!?:])[ \t\n\x0B\f\r]+',
           '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1))) AS s,
         generate_subscripts(string_split(replace(regexp_replace(coalesce(text, ''), '([.!?:])[ \t\n\x0B\f\r]+',
           '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)), 1) AS i
  FROM documents),
known(id, s) AS (VALUES {known}),
found AS (
  SELECT doc_id, string_agg(id::VARCHAR, ',' ORDER BY i) AS ids
  FROM cut JOIN known ON known.s = trim(regexp_replace(lower(cut.s), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) GROUP BY doc_id),
seqs AS (SELECT doc_id, coalesce(ids, '') AS ids, ',' || coalesce(ids, '') || ',' AS seq FROM documents LEFT JOIN found USING (doc_id))
SELECT doc_id, ids AS sentence_ids,
       array_to_string(list_sort(list_distinct(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL))), ',') AS licenses
FROM seqs
"""


def _sequence(ids: tuple) -> str:
    return "regexp_matches(seq, '," + ",(?:[0-9]+,)*?".join(str(i) for i in ids) + ",')"


def chat_format() -> str:
    escaped = r"regexp_replace({}, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
lengths AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
         17 + length({escaped.format('role')}) + length({escaped.format('text')}) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, md5(text))) AS turns_sha256,
       sum(length(learned))::BIGINT AS loss_chars,
       sha256(string_agg(learned, '' ORDER BY turn NULLS LAST, role, md5(text))) AS loss_sha256,
       (3 + sum(chars))::BIGINT AS formatted_chars
FROM lengths GROUP BY conv_id
"""


def hard_negatives() -> str:
    return f"""
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding::DOUBLE[], lambda c: floor({SCALE} * c)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, b.r,
         list_inner_product(a.x, b.x)::BIGINT AS score
  FROM usable a JOIN usable b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
positive AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) <= {POSITIVES}),
pairs AS (
  SELECT p.a, p.r AS pr, p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id,
         p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.r ORDER BY n.score DESC, n.vec_id, n.r)::INTEGER AS rank
  FROM positive p JOIN scored n ON n.a = p.a AND NOT n.same
    AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
FROM pairs WHERE rank <= {NEGATIVES}
"""


ORACLE_SQL = {
    "op2_mixing": mixing(),
    "op3_lattice": lattice(),
    "op4_quality_rules": quality_rules(),
    "op5_url_filter": url_filter(),
    "op9_license_scan": license_scan(),
    "op10_chat_format": chat_format(),
    "op12_hard_negatives": hard_negatives(),
}
