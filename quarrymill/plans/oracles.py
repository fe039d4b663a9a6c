"""DuckDB SQL for the queries that SQL can express."""

from quarrymill.functions.text import KEYBOARD

_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WS = f"[{_SPACE}]"
_CLASS = ("[^a-zA-Z0-9" + _SPACE + "".join("\\" + c if c in r"\[]^-&" else c for c in KEYBOARD) + "]").replace("'", "''")
_TOKENS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def _comments(flag: str) -> str:
    slashes = r"//.*|/\*[\s\S]*?\*/"
    python = r"#.*|\"\"\"[\s\S]*?\"\"\"|\x27\x27\x27[\s\S]*?\x27\x27\x27"
    bare = lambda p: rf"regexp_replace(rest, '{flag}^(?:(?:{p}){_WS}*){{1,50}}', '')"
    return f"CASE language WHEN 'Python' THEN {bare(python)} WHEN 'Shell' THEN {bare('#.*')} ELSE {bare(slashes)} END"


def _sim(measure: str) -> str:
    score = {"jaccard": "o / (na + nb - o)", "cosine": "o / sqrt(na * nb)", "containment_min": "o / greatest(na, nb)", "containment": "o / na"}[measure]
    pair = "a.id <> b.id" if measure == "containment" else "a.id > b.id"
    return f"""
WITH d AS (SELECT doc_id, list_sort({_TOKENS}) AS bag FROM documents), r AS (SELECT min(doc_id) AS id, bag FROM d WHERE len(bag) > 0 GROUP BY bag),
t AS (SELECT id, tok, count(*) AS c FROM (SELECT id, unnest(bag) AS tok FROM r) GROUP BY id, tok), n AS (SELECT id, len(bag)::DOUBLE AS n FROM r),
p AS (SELECT a.id AS ia, b.id AS ib, sum(least(a.c, b.c))::DOUBLE AS o FROM t a JOIN t b ON a.tok = b.tok AND {pair} GROUP BY ALL),
s AS (SELECT ia, ib, o, x.n AS na, y.n AS nb FROM p JOIN n x ON x.id = ia JOIN n y ON y.id = ib)
SELECT ia AS id_a, ib AS id_b, round({score}, 9) AS similarity FROM s WHERE {score} >= 0.9 * (1 - 1e-9)
"""


def _sim_members(measure: str) -> str:
    ways = [("doc_id", "rep"), ("rep", "doc_id")][: 2 if measure == "containment" else 1]
    links = "".join(f"UNION ALL SELECT {a}, {b}, 1.0::DOUBLE FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY bag) AS rep FROM d WHERE len(bag) > 0) WHERE doc_id <> rep\n" for a, b in ways)
    return _sim(measure) + links


_GROUPS = f"""d AS (SELECT doc_id, list_sort({_TOKENS}) AS bag FROM documents), g AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY bag) AS rep, count(*) OVER (PARTITION BY bag) AS copies FROM d WHERE len(bag) > 0)"""
_SEED = "md5('{seed}:' || doc_id::VARCHAR)"


def _sampled(cap: str, seed: int) -> str:
    return f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_SEED.format(seed=seed)}, doc_id) AS r FROM documents) WHERE r <= {cap}"


_COUNTS = """c AS (SELECT l_orderkey % 500 AS sample, l_returnflag AS experiment,
  nullif(count(*) FILTER (l_linenumber % 4 = 0), 0) AS s, nullif(count(*) FILTER (l_linenumber % 4 = 1), 0) AS c,
  nullif(count(*) FILTER (l_linenumber % 4 = 2), 0) AS v, nullif(count(*) FILTER (l_linenumber % 4 = 3), 0) AS h FROM lineitem GROUP BY ALL),
m AS (SELECT sample, max(s) AS sm, max(c) AS cm FROM c GROUP BY sample)"""
_RATES = {
    "precision": ("s + c", "s + c + v + h"), "hard_precision": ("s", "s + v + h"), "recall": ("s + c", "sm + cm"), "hard_recall": ("s", "sm"),
    "f1": ("2 * (s + c)", "2 * (s + c) + v + h + sm + cm - s - c"), "hard_f1": ("2 * s", "2 * s + v + h + sm + cm - s - c"),
}

_GRAPH = """
i AS (SELECT *, 'O' || l_orderkey AS o, 'L' || l_linenumber AS nm, 'L' || l_linenumber || CASE WHEN l_quantity > 45 THEN ' x' ELSE '' END AS id, 'F' || l_returnflag AS f FROM lineitem),
mem AS (SELECT l_orderkey AS k, nm AS name, id AS raw, replace(id, ' ', '') AS id, CASE WHEN l_partkey % 7 <> 0 THEN o END AS src, l_linestatus AS st FROM i),
nodes AS (SELECT k, 'm' AS t, name, raw, id FROM mem UNION ALL SELECT DISTINCT l_orderkey, 'c', o, o, o FROM i UNION ALL SELECT DISTINCT l_orderkey, 'v', f, f, f FROM i),
raw_e AS (SELECT l_orderkey AS k, o AS a, CASE WHEN l_partkey % 5 = 0 THEN id ELSE o END AS b FROM i UNION ALL SELECT l_orderkey, id, CASE WHEN l_suppkey % 3 = 0 THEN f ELSE 'nowhere' END FROM i),
e AS (SELECT k, replace(a, ' ', '') AS a, replace(b, ' ', '') AS b FROM raw_e WHERE b <> 'nowhere'),
st AS (SELECT l_orderkey AS k, l_linestatus AS s, count(*) AS n FROM i GROUP BY ALL),
pk AS (SELECT x.k, 'P' || x.s AS p, x.n + CASE WHEN x.s = 'O' THEN 1 + (EXISTS (SELECT 1 FROM st y WHERE y.k = x.k AND y.s = 'F'))::INT ELSE 0 END AS n FROM st x),
ch AS (SELECT k, 'P' || st AS p, id AS c FROM mem UNION ALL SELECT k, 'PO', 'O' || k FROM st WHERE s = 'O' UNION ALL SELECT k, 'PO', 'PF' FROM st x WHERE s = 'O' AND EXISTS (SELECT 1 FROM st y WHERE y.k = x.k AND y.s = 'F'))"""

SQL = {
    "leading_comments": rf"""
WITH x AS (SELECT doc_id, ['Python', 'C', 'Java', 'Shell', 'Go'][(doc_id % 5 + 1)::INT] AS language,
  ['', '/* c */' || chr(10) || chr(10), '// a' || chr(10), '#!/bin/sh' || chr(10) || '# x' || chr(10), '# y' || chr(10)][(doc_id % 5 + 1)::INT] || text AS code FROM documents),
y AS (SELECT *, {_strip("code")} AS body FROM x),
z AS (SELECT *, starts_with(body, '#!') AS headed, instr(body, chr(10)) AS nl FROM y),
r AS (SELECT *, CASE WHEN headed THEN {_strip("split_part(body, chr(10), 1)")} ELSE '' END AS head, CASE WHEN headed THEN {_strip("substr(body, nl + 1)")} ELSE body END AS rest FROM z)
SELECT doc_id, md5(CASE WHEN headed AND nl = 0 THEN body ELSE head || chr(10) || {_comments("(?s)")} END) AS stripped,
  md5(CASE WHEN headed AND nl = 0 THEN body ELSE head || chr(10) || {_comments("")} END) AS single FROM r
""",
    "quality_filter": f"SELECT doc_id, lang, n_chars FROM documents WHERE length(text) BETWEEN 3000 AND 15000 AND NOT regexp_matches(text, '{_CLASS}')",
    "predicate_rejects": f"""SELECT count(*) AS n_rows, count(*) FILTER (length(text) BETWEEN 3000 AND 15000 AND NOT regexp_matches(text, '{_CLASS}')) AS n_kept,
  count(*) FILTER (text IS NULL) AS rejected_present, count(*) FILTER (coalesce(length(text), 0) < 3000) AS rejected_long, count(*) FILTER (text IS NULL OR length(text) > 15000) AS rejected_short,
  count(*) FILTER (text IS NULL OR regexp_matches(text, '{_CLASS}')) AS rejected_keyboard FROM documents""",
    "small_groups": "SELECT doc_id, repo FROM (SELECT doc_id, source || '/' || lang AS repo, count(*) OVER (PARTITION BY source || '/' || lang) AS c FROM documents) WHERE c >= 25",
    "repo_selection": """
WITH o AS (SELECT o_custkey AS k, o_orderpriority AS name, sum(floor(o_totalprice))::BIGINT AS size FROM orders GROUP BY ALL),
s AS (SELECT *, sum(size) OVER (PARTITION BY k)::BIGINT AS total, sum(size) OVER (PARTITION BY k ORDER BY size DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o),
g AS (SELECT k, max(total) AS total, string_agg(name, ',' ORDER BY name, size) AS al, coalesce(string_agg(name, ',' ORDER BY size DESC, name) FILTER (coalesce(before, 0) / total <= 0.5), '') AS dom FROM s GROUP BY k)
SELECT c_custkey, total AS size_sum, al AS all_languages, dom AS dominant, 'https://github.com/' || c_mktsegment || '/' || c_name AS repo FROM customer JOIN g ON k = c_custkey
WHERE c_acctbal >= 25 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AND c_nationkey <> 3 AND total >= 100000""",
    "url_parts": """
WITH u AS (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN ':abc' ELSE '' END AS url FROM pages),
v AS (SELECT page_id, url, CASE WHEN contains(substr(url, 7), ':') THEN regexp_extract(url, '[^:]*$') END AS rev FROM u),
w AS (SELECT page_id, rev, CASE WHEN rev IS NULL THEN url ELSE left(url, length(url) - length(rev) - 1) END AS git_url FROM v)
SELECT page_id, git_url, rev, string_split(git_url, '/')[-2] AS maintainer, string_split(git_url, '/')[-1] AS name FROM w""",
    "token_bags": f"SELECT doc_id, len({_TOKENS})::BIGINT AS n_tokens, md5(array_to_string({_TOKENS}, ' ')) AS bag FROM documents",
    "token_frequency": f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token",
    "content_ids": "SELECT doc_id, md5(text) AS id, md5(text) || '[SEP]' || md5(lang) || '[SEP]' || source AS key FROM documents",
    **{f"sim_{m}": _sim(m) for m in ("jaccard", "containment_min")},
    **{f"sim_{m}": _sim_members(m) for m in ("cosine", "containment")},
    "sim_query": f"""
WITH d AS (SELECT min(doc_id) AS id, bag FROM (SELECT doc_id, list_sort({_TOKENS}) AS bag FROM documents) WHERE len(bag) > 0 GROUP BY bag),
b AS (SELECT min(item_id) AS id, bag FROM (SELECT item_id, list_sort({_TOKENS}) AS bag FROM benchmark) WHERE len(bag) > 0 GROUP BY bag),
x AS (SELECT id, tok, count(*) AS c FROM (SELECT id, unnest(bag) AS tok FROM d) GROUP BY ALL), y AS (SELECT id, tok, count(*) AS c FROM (SELECT id, unnest(bag) AS tok FROM b) GROUP BY ALL),
o AS (SELECT y.id AS q, x.id AS m, sum(least(x.c, y.c))::DOUBLE AS o FROM y JOIN x USING (tok) GROUP BY ALL)
SELECT q AS query_id, m AS match_id, round(o / len(bag), 9) AS similarity FROM o JOIN b ON b.id = q WHERE o / len(bag) >= 0.5 * (1 - 1e-9)""",
    "exact_groups": f"WITH {_GROUPS} SELECT id, rep, copies FROM g",
    "neighbour_lists": f"""WITH {_GROUPS}, p AS ({_sim("jaccard").replace("WITH d AS", "WITH d2 AS").replace("FROM d WHERE", "FROM d2 WHERE")}),
l AS (SELECT r, string_agg(x::VARCHAR, ',' ORDER BY x) AS others FROM (SELECT id_a AS r, id_b AS x FROM p UNION ALL SELECT id_b, id_a FROM p) GROUP BY r)
SELECT id, rep, copies, coalesce(others, '') AS others FROM g LEFT JOIN l ON rep = r""",
    "keep_first": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1",
    "top_n": "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3",
    "capped_sample": _sampled("CASE WHEN lang = 'en' THEN 750 ELSE 150 END", 1111),
    "quota_sample": f"""
WITH s AS (SELECT lang, count(*) AS c, sum(count(*)) OVER () AS t FROM documents GROUP BY lang), q AS (SELECT lang, least(100, t) * c / t::DOUBLE AS x, t FROM s),
r AS (SELECT lang, floor(x) + (row_number() OVER (ORDER BY floor(x) - x, lang) <= least(100, t) - sum(floor(x)) OVER ())::INT AS quota FROM q)
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_SEED.format(seed=1111)}, doc_id) AS k FROM documents) JOIN r USING (lang) WHERE k <= quota""",
    "one_per_group": _sampled("1", 7),
    "train_split": f"""WITH v AS (SELECT md5(text) AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM ({_sampled("3", 7)})))
SELECT doc_id, CASE WHEN md5(text) IN (SELECT id FROM v) THEN 'validation' ELSE 'train' END AS part FROM documents""",
    "sft_rows": "SELECT 'Be brief.' AS system, md5(text || '-' || role || '-' || turn) AS instruction, conv_id::VARCHAR AS output FROM conversations",
    "prompt_messages": """SELECT conv_id, turn, 'system' AS role, md5('Be brief.') AS content FROM conversations UNION ALL SELECT conv_id, turn, 'user', md5(text || ' (missing)') FROM conversations
UNION ALL SELECT conv_id, turn, 'assistant', md5('Go on.') FROM conversations""",
    "generated": "SELECT item_id, string_split(text, ' ')[-1] AS output, len(string_split(text, ' '))::BIGINT AS total_tokens FROM benchmark",
    "versions": "SELECT item_id, unnest(['minimal', 'medium', 'full']) AS version FROM benchmark",
    "unpivot": """SELECT s_suppkey, 'minimal' AS version, s_name AS diagram FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT s_suppkey, 'medium', upper(s_name) FROM supplier WHERE s_suppkey % 4 <> 0
UNION ALL SELECT s_suppkey, 'full', lower(s_name) FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT s_suppkey, NULL, NULL FROM supplier WHERE s_suppkey % 4 = 0""",
    "tag_extract": f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN md5(nullif({_strip('text')}, '')) END AS output FROM conversations",
    "json_parse": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
    "literal_parse": "SELECT event_id, event_type AS description, 0 AS nodes, false AS valid FROM events",
    "kappa_ci": """
WITH c AS (SELECT quality AS i, toxic AS j, count(*) / sum(count(*)) OVER () AS p, sum(count(*)) OVER () AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL),
a AS (SELECT i AS l, sum(p) AS pi FROM c GROUP BY i), b AS (SELECT j AS l, sum(p) AS pj FROM c GROUP BY j), e AS (SELECT sum(pi * pj) AS pe FROM a JOIN b USING (l)),
m AS (SELECT l, coalesce(pi, 0) AS pi, coalesce(pj, 0) AS pj FROM a FULL JOIN b USING (l)),
s AS (SELECT max(n)::BIGINT AS n, coalesce(sum(p) FILTER (i = j), 0) AS po, coalesce(sum(p * (x.pi + y.pj)) FILTER (i = j), 0) AS d, sum(p * (x.pi + y.pj) ^ 2) AS q FROM c JOIN m x ON x.l = i JOIN m y ON y.l = j),
k AS (SELECT n, (po - pe) / (1 - pe) AS kappa, 1.959963984540054 * sqrt(greatest(0, (po * (1 - po) / (1 - pe) ^ 2 + 2 * (1 - po) * (2 * po * pe - d) / (1 - pe) ^ 3 + (1 - po) ^ 2 * (q - 4 * pe ^ 2) / (1 - pe) ^ 4) / n)) AS half FROM s, e)
SELECT n, round(kappa, 9) AS kappa, round(greatest(-1, kappa - half), 9) AS low, round(least(1, kappa + half), 9) AS high FROM k""",
    "prf_micro": f"WITH {_COUNTS}, t AS (SELECT sum(sm) AS sm, sum(cm) AS cm FROM m), x AS (SELECT experiment, coalesce(sum(s), 0) AS s, coalesce(sum(c), 0) AS c, coalesce(sum(v), 0) AS v, coalesce(sum(h), 0) AS h FROM c GROUP BY experiment) SELECT experiment, "
    + ", ".join(f"round(({a})::DOUBLE / nullif({b}, 0), 3) AS {n}" for n, (a, b) in _RATES.items()) + " FROM x, t",
    "prf_macro": f"WITH {_COUNTS} SELECT experiment, " + ", ".join(f"round(avg(coalesce(({a})::DOUBLE / nullif({b}, 0), 1)), 3) AS {n}" for n, (a, b) in _RATES.items()) + " FROM c JOIN m USING (sample) GROUP BY experiment",
    "graph_components": f"""WITH RECURSIVE {_GRAPH}, ids AS (SELECT DISTINCT k, id FROM nodes),
b AS (SELECT k, a, b FROM e UNION SELECT k, b, a FROM e), r(k, id, x) AS (SELECT k, id, id FROM ids UNION SELECT r.k, r.id, b.b FROM r JOIN b ON b.k = r.k AND b.a = r.x)
SELECT k AS graph_id, count(DISTINCT m) AS components FROM (SELECT k, id, min(x) AS m FROM r GROUP BY k, id) GROUP BY k""",
    "graph_check": f"""WITH RECURSIVE {_GRAPH}, ids AS (SELECT DISTINCT k, id FROM nodes), bb AS (SELECT k, a, b FROM e UNION SELECT k, b, a FROM e),
r(k, id, x) AS (SELECT k, id, id FROM ids UNION SELECT r.k, r.id, bb.b FROM r JOIN bb ON bb.k = r.k AND bb.a = r.x),
comp AS (SELECT k, count(DISTINCT m) AS n FROM (SELECT k, id, min(x) AS m FROM r GROUP BY k, id) GROUP BY k),
nn AS (SELECT k, count(*) AS n FROM nodes GROUP BY k), ec AS (SELECT k, a, b, count(*) AS n FROM e GROUP BY ALL), holds AS (SELECT k, c, list(p) AS ps FROM ch GROUP BY k, c),
z AS (
  SELECT k, 'R1' AS rule, 'Low' AS severity, count(DISTINCT raw) AS number FROM nodes WHERE contains(raw, ' ') GROUP BY k
  UNION ALL SELECT k, 'R2', 'Low', count(*) FROM pk GROUP BY k
  UNION ALL SELECT k, 'R3', 'Medium', count(*) - count(DISTINCT raw) FROM nodes GROUP BY k
  UNION ALL SELECT k, 'R5', 'Medium', count(*) FROM raw_e WHERE b = 'nowhere' GROUP BY k
  UNION ALL SELECT k, 'R7', 'Low', 1 FROM nn WHERE n <= 3
  UNION ALL SELECT k, 'R9', 'Low', count(DISTINCT a) FROM e WHERE a = b GROUP BY k
  UNION ALL SELECT k, 'R10', 'Low', sum(n - 1) FROM ec GROUP BY k
  UNION ALL SELECT k, 'R11', 'Low', count(DISTINCT a) FROM ec WHERE n > 1 GROUP BY k
  UNION ALL SELECT k, 'R12', 'Medium', count(*) FROM mem WHERE src IS NULL GROUP BY k
  UNION ALL SELECT m.k, 'R14', 'Low', count(*) FROM mem m WHERE src IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ec WHERE ec.k = m.k AND a = src AND b = m.id) GROUP BY m.k
  UNION ALL SELECT k, 'R18', 'Low', count(*) FROM nodes WHERE id <> name GROUP BY k
  UNION ALL SELECT k, 'R19', 'Low', count(*) FROM nodes WHERE NOT contains('O' || k || ' L1 L2 L3 FA FN', name) GROUP BY k
  UNION ALL SELECT k, 'R20', 'Low', count(*) FROM pk WHERE n = 1 GROUP BY k
  UNION ALL SELECT k, 'R22', 'Low', count(*) FROM holds WHERE len(ps) > 1 GROUP BY k
  UNION ALL SELECT m.k, 'R22m', 'Low', count(*) FROM mem m JOIN holds s ON s.k = m.k AND s.c = m.src AND len(s.ps) = 1 LEFT JOIN holds h ON h.k = m.k AND h.c = m.id
    WHERE h.ps IS NULL OR (len(h.ps) = 1 AND h.ps[1] <> s.ps[1] AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.k = m.k AND ch.p = s.ps[1] AND ch.c = h.ps[1])) GROUP BY m.k
  UNION ALL SELECT k, 'R24', 'Medium', 1 FROM comp WHERE n > 1)
SELECT k AS graph_id, rule, severity, number::BIGINT AS number FROM z WHERE number > 0""",
    "dedup_greedy": f"""WITH RECURSIVE {_GROUPS}, p AS ({_sim("jaccard").replace("WITH d AS", "WITH d2 AS").replace("FROM d WHERE", "FROM d2 WHERE")}),
nb AS (SELECT id_a AS hi, list(id_b) AS los FROM p GROUP BY id_a), o AS (SELECT hi, los, row_number() OVER (ORDER BY hi) AS k FROM nb),
w(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.k, CASE WHEN len(list_filter(los, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, hi) ELSE gone END FROM w JOIN o ON o.k = w.k + 1),
gone AS (SELECT unnest(gone) AS id FROM (SELECT gone FROM w ORDER BY k DESC LIMIT 1))
SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT id FROM gone) AND doc_id NOT IN (SELECT id FROM g WHERE id <> rep)""",
}
_RATED = """r AS (SELECT DISTINCT l_orderkey % 300 AS sample, l_returnflag AS task, l_linestatus AS version, CASE WHEN l_linenumber % 2 = 0 THEN 'first' ELSE 'second' END AS annotator,
['Sufficiency', 'Completeness', 'Verbosity', 'Hallucinations'][l_suppkey % 4 + 1] AS label, l_partkey % 10 AS item FROM lineitem WHERE l_linenumber <> 7 AND l_returnflag IN ('A', 'N')),
both_rated AS (SELECT a.label AS quality, b.label AS toxic FROM r a JOIN r b USING (sample, task, version, item) WHERE a.annotator = 'first' AND b.annotator = 'second')"""
_CHECKED = SQL["graph_check"].removesuffix("SELECT k AS graph_id, rule, severity, number::BIGINT AS number FROM z WHERE number > 0")
_COUNTED = """, every AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), counted AS (SELECT every.k, coalesce(low, 0) AS low, coalesce(med, 0) AS med, coalesce(n, 0) AS n FROM every LEFT JOIN (
SELECT k, count(*) AS n, arg_max(number, ord) FILTER (severity = 'Low') AS low, arg_max(number, ord) FILTER (severity = 'Medium') AS med FROM (
  SELECT *, list_position(['R1', 'R2', 'R3', 'R5', 'R9', 'R10', 'R11', 'R12', 'R14', 'R19', 'R20', 'R22', 'R22m', 'R24'], rule) AS ord FROM z WHERE number > 0) WHERE ord IS NOT NULL GROUP BY k) x USING (k))"""
SQL |= {
    "exploded_sizes": """SELECT l_orderkey, 'L' || l_linenumber AS name, l_quantity::BIGINT AS size, all_names FROM lineitem JOIN (
SELECT l_orderkey, string_agg('L' || l_linenumber, ',' ORDER BY l_linenumber) AS all_names FROM lineitem GROUP BY l_orderkey) USING (l_orderkey) WHERE l_quantity::BIGINT >= 45""",
    "rater_pairs": f"WITH {_RATED} SELECT quality AS label_first, toxic AS label_second, count(*) AS n FROM both_rated GROUP BY ALL",
    "rater_kappa": SQL["kappa_ci"].replace("WITH c AS", f"WITH {_RATED}, c AS", 1).replace("FROM labels", "FROM both_rated"),
    "split_share": _CHECKED + "SELECT round(count(DISTINCT z.k) FILTER (rule = 'R24') / (SELECT count(DISTINCT l_orderkey) FROM lineitem)::DOUBLE, 9) AS share FROM z",
    "status_counts": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "merged_versions": """SELECT s_suppkey::INT AS at, CASE s_suppkey WHEN 3 THEN 'v2,v3' WHEN 7 THEN 'v5,v6,v7' ELSE 'v' || s_suppkey END AS possible_version FROM supplier WHERE s_suppkey NOT IN (2, 5, 6, 9)""",
    "graph_texts": _CHECKED
    + _COUNTED.lstrip()
    + """ SELECT k AS graph_id, NOT (k % 5 = 0 OR k % 7 = 0 OR k % 11 = 0) AS drawn, CASE WHEN k % 5 = 0 OR (k % 7 <> 0 AND k % 11 = 0) THEN 0 ELSE n END AS n_messages FROM counted""",
    "diagram_rows": """WITH b AS (SELECT item_id, item_id % 4 <> 0 AS ok FROM benchmark) SELECT item_id, 'minimal' AS version, 'm' AS diagram, 'a' || item_id AS text_answer, NULL::VARCHAR AS output FROM b WHERE ok
UNION ALL SELECT item_id, 'medium', 'n' || item_id, 'a' || item_id, NULL FROM b WHERE ok UNION ALL SELECT item_id, 'full', NULL, 'a' || item_id, NULL FROM b WHERE ok
UNION ALL SELECT item_id, NULL, NULL, NULL, 'no answer' FROM b WHERE NOT ok""",
    "question_rows": f"""WITH s AS ({SQL["quota_sample"]}), c AS (SELECT s.doc_id, s.lang, string_split(coalesce(regexp_extract(text, '^\\S+(?: \\S+)?'), ''), ' ') AS w FROM s JOIN documents USING (doc_id))
SELECT doc_id, lang, nullif(w[-1], '') AS user_queries, md5('<candidates>' || w[1] || '</candidates><final_output> ' || w[-1] || ' </final_output>') AS generated_output FROM c""",
    "severity_rollup": _CHECKED
    + _COUNTED
    + """, nodes_of AS (SELECT k, count(*) AS nodes FROM nodes GROUP BY k), j AS (SELECT low, med, (low > 0)::INT AS ulow, (med > 0)::INT AS umed, nodes FROM counted JOIN nodes_of USING (k)),
m AS (SELECT avg(low) AS low, avg(med) AS med, avg(ulow) AS ulow, avg(umed) AS umed, avg(nodes) AS nodes, avg(low / nodes::DOUBLE) AS mlow, avg(med / nodes::DOUBLE) AS mmed FROM j)
SELECT 'last None' AS kind, round(low, 6) AS "Low", round(med, 6) AS "Medium", 0.0::DOUBLE AS "High" FROM m UNION ALL SELECT 'unique None', round(ulow, 6), round(umed, 6), 0.0 FROM m
UNION ALL SELECT 'last micro', round(low / nodes, 6), round(med / nodes, 6), 0.0 FROM m UNION ALL SELECT 'last macro', round(mlow, 6), round(mmed, 6), 0.0 FROM m""",
}
