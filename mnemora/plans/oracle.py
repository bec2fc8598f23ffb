"""DuckDB SQL for the queries of ``mnemora.plans.queries``, written from the definitions."""

from __future__ import annotations

from mnemora.functions.stopwords import STOPWORDS

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_NOW = "1706745600.0::DOUBLE"


def _keywords(name: str, table: str, key: str) -> str:
    """CTE name(key, w): distinct words that no other word of the text contains."""
    return f"""
{name}_w AS (SELECT DISTINCT {key}, w FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM {table}) WHERE len(w) >= 2 AND w NOT IN ({_STOP})),
{name} AS (SELECT * FROM {name}_w a WHERE NOT EXISTS (SELECT 1 FROM {name}_w b WHERE a.{key} = b.{key} AND a.w <> b.w AND contains(b.w, a.w)))"""


def _weighted(name: str, table: str, key: str) -> str:
    """CTE name(id, word, weight, rank) and name_long(id, long)."""
    return f"""
{name}_t AS (SELECT {key} AS id, len(text) > 80 AS long, regexp_extract_all(lower(text), '\\p{{L}}+') AS ws FROM {table}),
{name}_n AS (SELECT count(*)::DOUBLE AS n FROM {table}),
{name}_df AS (SELECT w, count(*) AS df FROM (SELECT DISTINCT id, unnest(ws) AS w FROM {name}_t) GROUP BY w),
{name}_tf AS (SELECT id, w, count(*) AS tf FROM (SELECT id, unnest(ws) AS w FROM {name}_t WHERE long) WHERE len(w) >= 2 AND w NOT IN ({_STOP}) GROUP BY id, w),
{name}_s AS (SELECT id, w, round(tf * ln(n / df), 6) AS weight FROM {name}_tf JOIN {name}_df USING (w), {name}_n),
{name}_r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, w) AS r FROM {name}_s) WHERE r <= 50),
{name}_k AS (SELECT * FROM {name}_r a WHERE NOT EXISTS (SELECT 1 FROM {name}_r b WHERE a.id = b.id AND a.w <> b.w AND contains(b.w, a.w))),
{name}_l AS (SELECT id, w AS word, weight, row_number() OVER (PARTITION BY id ORDER BY weight DESC, w)::INT AS rank FROM {name}_k),
{name}_sw AS (SELECT DISTINCT id, w FROM (SELECT id, unnest(ws) AS w FROM {name}_t WHERE NOT long) WHERE len(w) >= 2 AND w NOT IN ({_STOP})),
{name}_sk AS (SELECT * FROM {name}_sw a WHERE NOT EXISTS (SELECT 1 FROM {name}_sw b WHERE a.id = b.id AND a.w <> b.w AND contains(b.w, a.w))),
{name} AS (SELECT * FROM {name}_l WHERE rank <= 25 UNION ALL
  SELECT id, w, 1.0, row_number() OVER (PARTITION BY id ORDER BY len(w) DESC, w)::INT FROM {name}_sk)"""


_TIERS = (
    _weighted("b", "benchmark", "item_id")
    + """,
b_n AS (SELECT id, count(*) AS n FROM b GROUP BY id),
tiers AS (SELECT id AS query_id, word, CASE WHEN NOT long THEN 'core' WHEN rank <= greatest(3, floor(n * 0.2)) THEN 'core'
  WHEN rank <= greatest(3, floor(n * 0.2)) + greatest(3, floor(n * 0.4)) THEN 'important' ELSE 'supplement' END AS tier
  FROM b JOIN b_n USING (id) JOIN b_t USING (id))"""
).replace("b_n AS (SELECT count(*)", "b_total AS (SELECT count(*)").replace("USING (w), b_n)", "USING (w), b_total)")

_K = _keywords("k", "documents", "doc_id")
_IDX = "idx AS (SELECT w AS keyword, doc_id::VARCHAR AS entry_id FROM k UNION SELECT lang, doc_id::VARCHAR FROM documents WHERE lang <> '')"
_INDEX = f"{_K},\n{_IDX}"


def _similar(name: str, words: str) -> str:
    """CTE name(word, keyword, s): similar words of the index for the words of a relation."""
    return f"""
{name} AS (SELECT q.word, v.keyword, CASE WHEN contains(v.keyword, q.word) THEN len(q.word) / len(v.keyword) ELSE len(v.keyword) / len(q.word) * 0.8 END AS s
  FROM (SELECT DISTINCT word FROM {words}) q, (SELECT DISTINCT keyword FROM idx) v
  WHERE q.word <> v.keyword AND (contains(v.keyword, q.word) OR contains(q.word, v.keyword)))"""


_FUZZY = _similar("sim", "(SELECT word FROM tiers WHERE tier = 'core')")
_LABELLED = "(SELECT d.*, greatest(1, least(5, 3 + coalesce(q, 0) - 2 * coalesce(x, 0)))::INT AS importance FROM documents d LEFT JOIN (SELECT doc_id, max(quality) q, max(toxic) x FROM labels GROUP BY 1) USING (doc_id))"
_BASKET = """
words AS (SELECT DISTINCT l_orderkey, unnest(string_split(p_name, ' ') || [p_brand, p_type]) AS w FROM lineitem JOIN part ON l_partkey = p_partkey),
cells AS (SELECT x.w AS a, y.w AS b, count(*) AS n FROM words x JOIN words y ON x.l_orderkey = y.l_orderkey AND x.w <= y.w GROUP BY ALL),
docs AS (SELECT count(*)::DOUBLE AS d FROM (SELECT l_orderkey FROM words GROUP BY 1 HAVING count(*) >= 2)),
full_cells AS (SELECT a, b, n FROM cells UNION ALL SELECT b, a, n FROM cells WHERE a <> b),
df AS (SELECT a AS w, n FROM cells WHERE a = b)"""
#: All keywords of documents that have two at least, and the cells of at least five of them; beside the keywords k.
_DOC_WORDS = "words AS MATERIALIZED (SELECT doc_id, w FROM k WHERE doc_id IN (SELECT doc_id FROM k GROUP BY 1 HAVING count(*) >= 2)),\ndocs AS (SELECT count(DISTINCT doc_id)::DOUBLE AS d FROM words)"
_REST = """
full_cells AS (SELECT a, b, n FROM cells UNION ALL SELECT b, a, n FROM cells WHERE a <> b),
df AS (SELECT a AS w, n FROM cells WHERE a = b)"""


def _frequent(where: str = "true") -> str:
    return f"common AS (SELECT w FROM words WHERE {where} GROUP BY w HAVING count(*) >= 5),\nf AS MATERIALIZED (SELECT doc_id, w FROM words SEMI JOIN common USING (w) WHERE {where})"


def _doc_cells(where: str = "true") -> str:
    cells = "cells AS MATERIALIZED (SELECT x.w AS a, y.w AS b, count(*) AS n FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.w <= y.w GROUP BY ALL HAVING count(*) >= 5)"
    return f"{_DOC_WORDS},\n{_frequent(where)},\n{cells},{_REST}"


_DOC = f"{_K},\n{_doc_cells()}"
_ALL = f"{_K},\n{_DOC_WORDS},\ncells AS MATERIALIZED (SELECT x.w AS a, y.w AS b, count(*) AS n FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w <= y.w GROUP BY ALL),{_REST}"
_PPMI_ALONE = "ppmi AS MATERIALIZED (SELECT a, b, log2(c.n * d / (x.n * y.n)) AS ppmi FROM cells c JOIN df x ON a = x.w JOIN df y ON b = y.w, docs WHERE a <> b AND log2(c.n * d / (x.n * y.n)) > 0),\nm AS (SELECT a, b, ppmi FROM ppmi UNION ALL SELECT b, a, ppmi FROM ppmi)"
_COND_ALONE = "st AS MATERIALIZED (SELECT a, b, f.n / x.n AS p FROM full_cells f JOIN df x ON a = x.w)"
_PPMI, _DOC_PPMI = f"{_BASKET},\n{_PPMI_ALONE}", f"{_DOC},\n{_PPMI_ALONE}"
_COND, _DOC_COND = f"{_BASKET},\n{_COND_ALONE}", f"{_DOC},\n{_COND_ALONE}"
_EDGES = "g AS MATERIALIZED (SELECT a AS src, b AS dst, ppmi AS weight, 1 / (ppmi + 1e-8) AS distance FROM m WHERE ppmi >= {least})"
_GRAPH, _DOC_GRAPH = f"{_PPMI},\n{_EDGES.format(least=0.001)}", f"{_DOC_PPMI},\n{_EDGES.format(least=0.1)}"
_FREQ = "freq AS (SELECT a AS word, 2 * sum(n) AS f FROM full_cells GROUP BY a), kept AS (SELECT * FROM freq WHERE f >= 1000), gone AS (SELECT word FROM freq WHERE f < 1000 UNION ALL SELECT word FROM (SELECT word, row_number() OVER (ORDER BY f, word DESC) AS r FROM kept) WHERE r <= (SELECT count(*) FROM kept) - 30)"
_LOGS = "logs AS (SELECT event_id AS id, event_type AS topic, user_id::VARCHAR AS source, props AS summary, epoch_us(ts) / 1e6 AS timestamp, strftime(ts, '%Y-%m-%d') AS date_str FROM events)"
_SEEDS = "('anvil', 'gizmo', 'Brand#7')"
_DOC_SEEDS = "('thtion', 'attion', 'eriner')"


def _reach(start: str) -> str:
    return f"r AS (SELECT {start} AS node UNION SELECT dst FROM r JOIN g ON src = node)"


def _ranks(seeds: str) -> str:
    """CTE rank_(node, rank): after as many rounds, in fours, as it takes until the ranks' change is under a millionth of the nodes, or 100."""
    return f"""
o AS MATERIALIZED (SELECT src, sum(weight) AS t FROM g GROUP BY src), nn AS MATERIALIZED (SELECT count(*) AS n, count(*) FILTER (src IN {seeds}) AS k FROM o),
go AS MATERIALIZED (SELECT g.src, dst, weight / t AS p FROM g JOIN o ON g.src = o.src),
it AS (SELECT src AS node, 1.0::DOUBLE / n AS rank, 0 AS i FROM o, nn
  UNION ALL
  SELECT dst, 0.85::DOUBLE * sum(it.rank * p) + CASE WHEN dst IN {seeds} THEN 0.15::DOUBLE / max(k) ELSE 0 END, i + 1
  FROM it JOIN go ON go.src = it.node, nn WHERE i < 100 GROUP BY dst, i),
stop AS (SELECT coalesce(min(i), 100) AS i FROM (SELECT x.i, sum(abs(x.rank - y.rank)) AS moved FROM it x JOIN it y ON x.node = y.node AND x.i = y.i + 1 WHERE x.i % 4 = 0 GROUP BY x.i), nn WHERE moved < n * 1e-6),
rank_ AS MATERIALIZED (SELECT node, rank FROM it JOIN stop USING (i))"""


def _shortest(seeds: str) -> str:
    """CTE path_(source, target, distance, path, total_weight, hops); paths have few hops, and of equals the first in the alphabet counts."""
    return f"""
sp AS (SELECT DISTINCT src AS source, src AS node, 0.0::DOUBLE AS d, 0.0::DOUBLE AS tw, [src] AS path, 0 AS i FROM g WHERE src IN {seeds}
  UNION ALL
  SELECT source, dst, arg_min(d + distance, (round(d + distance, 12), list_append(path, dst))), arg_min(tw + weight, (round(d + distance, 12), list_append(path, dst))),
    arg_min(list_append(path, dst), (round(d + distance, 12), list_append(path, dst))), i + 1
  FROM sp JOIN g ON src = node WHERE i < 14 AND NOT list_contains(path, dst) GROUP BY source, dst, i),
path_ AS MATERIALIZED (SELECT source, node AS target, min(d) AS distance, arg_min(path, (round(d, 12), path)) AS path, round(arg_min(tw, (round(d, 12), path)), 4) AS total_weight
  FROM sp WHERE node IN {seeds} AND node <> source GROUP BY ALL)"""


_PATHS = "SELECT source, target, round(distance, 4) AS distance, array_to_string(path, ' > ') AS path, total_weight, len(path)::INT - 1 AS hops FROM path_"


def _chain(seeds: str) -> str:
    """CTE chain(word, ppr_score, path_count, combined_score) of hidden words between the seeds, which are connected."""
    return f"""{_ranks(seeds)},
near AS (SELECT node FROM r),
top AS (SELECT node, rank FROM rank_ SEMI JOIN near USING (node) WHERE node NOT IN {seeds} ORDER BY rank DESC, node LIMIT 50),
{_shortest(seeds)},
votes AS (SELECT node, count(*) AS c FROM (SELECT unnest(path[2:len(path) - 1]) AS node FROM path_ WHERE source < target) WHERE node NOT IN {seeds} GROUP BY node),
chain AS MATERIALIZED (SELECT coalesce(top.node, votes.node) AS word, round(coalesce(rank, 0), 6) AS ppr_score, coalesce(c, 0) AS path_count,
  round(CASE WHEN coalesce(rank, 0) > 0 THEN rank * (1 + coalesce(c, 0)) ELSE 0.001::DOUBLE * c END, 6) AS combined_score
  FROM top FULL JOIN votes ON top.node = votes.node ORDER BY combined_score DESC, word LIMIT 10)"""


def _merged(n: int) -> str:
    """Query (target, score, whys): of the 2n best in best(target, score, w) the shorter ones folded into the first longer one that contains them."""
    return f"""
held AS (SELECT x.target, arg_min(y.target, (-len(y.target), -y.score, y.target)) AS host FROM best x JOIN best y ON contains(y.target, x.target)
  WHERE NOT EXISTS (SELECT 1 FROM best z WHERE contains(z.target, y.target) AND z.target <> y.target) GROUP BY x.target),
folded AS (SELECT host AS target, round(sum(score), 6) AS score, list_sort(flatten(list(w)))[:3] AS w FROM held JOIN best USING (target) GROUP BY host)
SELECT target, score, array_to_string(list_transform(w, lambda x: x.what), '; ') AS whys FROM folded ORDER BY score DESC, target LIMIT {n}"""


def _group(strength: str, seeds: str) -> str:
    merged = _merged(10).replace("SELECT target, score, array", "SELECT target, score AS confidence, array")
    return f"""WITH {strength}, p AS (SELECT x.a AS word, x.b AS mid, y.b AS target, x.p * y.p AS s FROM st x JOIN st y ON x.b = y.a WHERE x.a IN {seeds} AND x.b NOT IN {seeds} AND y.b NOT IN {seeds} AND x.p > 0.01 AND y.p > 0.01),
best AS (SELECT target, round(sum(s), 6) AS score, list_sort(list({{'s': -round(s, 9), 'word': word, 'mid': mid, 'what': word || ' > ' || mid}}))[:3] AS w FROM p GROUP BY target ORDER BY 2 DESC, 1 LIMIT 20),{merged}"""


def _hubs(strength: str, percentile: float, least: float) -> str:
    return f"WITH {strength}, d AS (SELECT a AS node, count(*) AS degree FROM st WHERE p > {least} AND a <> b GROUP BY a) SELECT node, degree FROM d WHERE degree > (SELECT quantile_cont(degree, {percentile}) FROM d)"


def _beam(strength: str, seeds: str) -> str:
    """Three hops, each with the 20 best paths of every seed."""
    hop = ""
    for i, damp in ((1, 1.0), (2, 0.5), (3, 0.25)):
        last = "SELECT word, a, cum, path FROM b0" if i == 1 else f"SELECT word, a, cum, path FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY round(cum, 12) DESC, path) AS r FROM h{i - 1}) WHERE r <= 20"
        hop += f"""
h{i} AS MATERIALIZED (SELECT word, e.b AS a, cum * p * {damp}::DOUBLE * CASE WHEN hub.node IS NULL THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS cum, list_append(path, e.b) AS path
  FROM ({last}) x JOIN e ON e.a = x.a LEFT JOIN hub ON hub.node = x.a WHERE NOT list_contains(path, e.b) AND cum * p * {damp}::DOUBLE * CASE WHEN hub.node IS NULL THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END >= 0.001),"""
    return f"""WITH {strength}, d AS (SELECT a AS node, count(*) AS degree FROM st WHERE p > 0 AND a <> b GROUP BY a),
hub AS MATERIALIZED (SELECT node FROM d WHERE degree > (SELECT quantile_cont(degree, 0.95) FROM d)),
e AS MATERIALIZED (SELECT a, b, p FROM st WHERE p > 0.01 AND a <> b AND b NOT IN {seeds}),
b0 AS (SELECT w AS word, w AS a, 1.0::DOUBLE AS cum, [w] AS path FROM df WHERE w IN {seeds}),{hop}
s AS (SELECT a AS target, sum(cum) AS s, count(DISTINCT word) AS sources, count(DISTINCT path[2]) AS bridges, list_sort(list({{'s': -round(cum, 9), 'what': array_to_string(path, ' > ')}}))[:3] AS w FROM h3 GROUP BY a),
direct AS (SELECT b AS target, count(DISTINCT a) AS near FROM st WHERE a IN {seeds} AND p > 0 AND a <> b GROUP BY b),
best AS (SELECT target, round(s * sqrt(coalesce(near, 0) / 3) * CASE WHEN sources = 3 THEN 1.5 WHEN sources > 1 THEN 1 + 0.2 * (sources - 1) ELSE 1.0 END * CASE WHEN bridges <= 1 THEN 0.6 ELSE 1.0 END, 6) AS score, w
  FROM s LEFT JOIN direct USING (target) WHERE sources = 3 OR coalesce(near, 0) = 3 ORDER BY 2 DESC, 1 LIMIT 20),{_merged(10)}"""


_ENTRIES = f"ent AS (SELECT doc_id::VARCHAR AS entry_id, text, {_NOW} - doc_id * 3600.0 AS ts, importance FROM {_LABELLED})"
_EXACT_FUZZY = """
ex AS (SELECT query_id, entry_id, count(*) AS e FROM tiers JOIN idx ON word = keyword WHERE tier <> 'supplement' GROUP BY ALL),
fu AS (SELECT query_id, entry_id, max(s) AS f FROM (SELECT * FROM tiers WHERE tier = 'core') JOIN sim USING (word) JOIN idx USING (keyword) GROUP BY ALL)"""
_EXPANDED = """
sc_ AS (SELECT query_id, b AS word, round(sum(ppmi), 6) AS score FROM (SELECT DISTINCT query_id, word FROM tiers WHERE tier = 'core') q JOIN m ON word = a GROUP BY ALL),
xp AS MATERIALIZED (SELECT * FROM (SELECT query_id, word, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, word)::INT AS rank FROM sc_
  WHERE (query_id, word) NOT IN (SELECT query_id, word FROM tiers WHERE tier = 'core')) WHERE rank <= 10)"""


def _ranked(hits: str, columns: str) -> str:
    """Entries ranked by hits(query_id, entry_id, rel), with the bonus of supplement words."""
    return f"""{hits},
{_ENTRIES},
sup AS (SELECT query_id, word FROM tiers WHERE tier = 'supplement'),
own AS (SELECT w AS word, doc_id::VARCHAR AS entry_id, true AS has FROM k),
bon AS (SELECT query_id, entry_id, 1 + 0.5::DOUBLE * count(*) FILTER (contains(text, word) OR coalesce(has, false)) / count(*) AS b
  FROM hits JOIN sup USING (query_id) JOIN ent USING (entry_id) LEFT JOIN own USING (word, entry_id) GROUP BY ALL),
sc AS (SELECT query_id, entry_id, rel, 1 / (1 + 0.1::DOUBLE * 3 / importance * greatest(0, ({_NOW} - ts) / 86400)) AS tw, importance, ts, coalesce(b, 1) AS b FROM hits JOIN ent USING (entry_id) LEFT JOIN bon USING (query_id, entry_id)),
fin AS (SELECT *, round(rel * b * tw * importance / 3, 4) AS final_score FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, ts DESC, entry_id) AS rank FROM fin)
SELECT {columns} FROM rk WHERE rank <= 10"""


def _with_association(chain: bool) -> str:
    """CTE hits of all tiers; the words of ``chain`` count besides if asked for."""
    parts = "SELECT query_id, entry_id, count(*)::DOUBLE AS e, 0::DOUBLE AS f, 0::DOUBLE AS c FROM xp JOIN idx ON word = keyword GROUP BY ALL UNION ALL SELECT query_id, entry_id, 0, max(s), 0 FROM xp JOIN xsim USING (word) JOIN idx USING (keyword) GROUP BY ALL"
    if chain:
        parts += " UNION ALL SELECT 'q', entry_id, 0, 0, count(*) FROM (SELECT word FROM chain ORDER BY combined_score DESC, word LIMIT 5) JOIN idx ON word = keyword GROUP BY ALL"
    return f"""{_similar("xsim", "xp")},
ass AS (SELECT query_id, entry_id, greatest(0.5::DOUBLE * max(e), 0.3::DOUBLE * max(f)) + 0.4::DOUBLE * max(c) AS s FROM ({parts}) GROUP BY ALL),
tri AS (SELECT query_id, entry_id, e::DOUBLE AS e, 0::DOUBLE AS f, 0::DOUBLE AS s FROM ex UNION ALL SELECT query_id, entry_id, 0, f, 0 FROM fu UNION ALL SELECT query_id, entry_id, 0, 0, s FROM ass),
hits AS (SELECT query_id, entry_id, max(e) + 0.6::DOUBLE * max(f) + 0.4::DOUBLE * max(s) AS rel FROM tri GROUP BY ALL)"""


def _decay(words: str, key: str, least: float) -> str:
    """Cells of words(key, w) in the order of the key when every 500 rows all are scaled by 0.995 and those under 0.5 dropped."""
    kept = "(CASE WHEN s.v * pow(0.995::DOUBLE, CASE WHEN s.e > 0 THEN greatest(y.e - s.e - 1, 0) ELSE 0 END) < 0.5 THEN 0 ELSE s.v * pow(0.995::DOUBLE, CASE WHEN s.e > 0 THEN greatest(y.e - s.e - 1, 0) ELSE 0 END) END)"
    return f"""ep AS (SELECT x.w AS a, y.w AS b, ceil(q / 500)::INT AS e, count(*)::DOUBLE AS c FROM {words} x JOIN {words} y ON x.{key} = y.{key} AND x.w <= y.w JOIN num ON num.{key} = x.{key} GROUP BY ALL),
done AS (SELECT max(q) // 500 AS m FROM num),
l AS (SELECT a, b, list({{'e': e, 'v': c}} ORDER BY e) AS x FROM ep GROUP BY a, b),
fo AS (SELECT a, b, m, list_reduce(list_prepend({{'e': 0, 'v': 0.0::DOUBLE}}, x), lambda s, y: {{'e': y.e, 'v':
  CASE WHEN y.e <= m THEN CASE WHEN ({kept} + y.v) * 0.995::DOUBLE < 0.5 THEN 0 ELSE ({kept} + y.v) * 0.995::DOUBLE END ELSE {kept} + y.v END}}) AS r FROM l, done)
SELECT a, b, round(r.v * pow(0.995::DOUBLE, greatest(m - r.e, 0)), 6) AS n FROM fo WHERE r.v * pow(0.995::DOUBLE, greatest(m - r.e, 0)) >= {least}"""


_SUMS = "SELECT a AS word, count(*) AS cells, sum(n)::BIGINT AS total FROM full_cells GROUP BY a"
_RARE = "freq AS (SELECT a AS word, 2 * sum(n) AS f FROM full_cells GROUP BY a), kept AS (SELECT * FROM freq WHERE f >= 5), gone AS (SELECT word FROM freq WHERE f < 5 UNION ALL SELECT word FROM (SELECT word, row_number() OVER (ORDER BY f, word DESC) AS r FROM kept) WHERE r <= (SELECT count(*) FROM kept) - 20000)"
_TOP_PAIRS = "SELECT a, b, round(ppmi, 6) AS ppmi FROM m WHERE ppmi >= 0 AND ppmi < 10 ORDER BY 3 DESC, a, b LIMIT 20"
_STATS = "SELECT (SELECT d FROM docs)::BIGINT AS total_docs, (SELECT count(*) FROM df) AS vocab_size, (SELECT count(*) FROM full_cells) AS nnz, round((SELECT count(*) FROM full_cells) / (SELECT count(*) FROM df)::DOUBLE ^ 2, 6) AS density"

ORACLE_SQL: dict[str, str] = {
    "keyword_extract": f"WITH {_keywords('k', 'documents', 'doc_id')} SELECT doc_id, w AS word FROM k",
    "keyword_index": f"WITH {_INDEX} SELECT keyword, entry_id FROM idx",
    "inverted_index": f"WITH {_INDEX} SELECT keyword, count(*) AS n, min(entry_id) AS first_id FROM idx GROUP BY keyword",
    "document_ingest": f"WITH {_keywords('k', 'documents', 'doc_id')} SELECT doc_id, count(*) AS n_words FROM k GROUP BY doc_id HAVING count(*) >= 2",
    "weighted_keywords": f"WITH {_weighted('x', 'documents', 'doc_id')} SELECT id, word, weight, rank FROM x",
    "longtext_tiers": f"WITH {_TIERS} SELECT query_id, word, tier FROM tiers",
    "search_exact": f"WITH {_TIERS}, {_INDEX} SELECT query_id, entry_id, count(*) AS hits FROM tiers JOIN idx ON word = keyword GROUP BY ALL",
    "search_fuzzy": f"WITH {_TIERS}, {_INDEX}, {_FUZZY} SELECT query_id, entry_id, round(max(s), 6) AS score FROM (SELECT * FROM tiers WHERE tier = 'core') JOIN sim USING (word) JOIN idx USING (keyword) GROUP BY ALL",
    "retrieve_fast": f"WITH {_TIERS}, {_INDEX}, {_FUZZY}, {_EXACT_FUZZY}, "
    + _ranked("hits AS (SELECT query_id, entry_id, coalesce(e, 0) + 0.6::DOUBLE * coalesce(f, 0) AS rel FROM ex FULL JOIN fu USING (query_id, entry_id))",
              "query_id, entry_id, round(rel * b, 4) AS relevance, round(tw, 4) AS time_weight, importance, final_score, rank"),
    "retrieve_standard": f"WITH {_TIERS}, {_INDEX}, {_FUZZY}, {_EXACT_FUZZY}, {_doc_cells()}, {_PPMI_ALONE}, {_EXPANDED}, "
    + _ranked(_with_association(False), "query_id, entry_id, round(rel * b, 4) AS relevance, final_score, rank"),
    "retrieve_deep": f"WITH RECURSIVE tiers AS (SELECT 'q' AS query_id, unnest(['thtion', 'attion', 'eriner']) AS word, 'core' AS tier), {_INDEX}, {_FUZZY}, {_EXACT_FUZZY}, {_doc_cells()}, {_PPMI_ALONE}, {_EDGES.format(least=0.1)}, {_reach("'thtion'")}, {_chain(_DOC_SEEDS)}, {_EXPANDED}, "
    + _ranked(_with_association(True), "query_id, entry_id, round(rel * b, 4) AS relevance, final_score, rank"),
    "keyword_scan": f"WITH {_INDEX} SELECT DISTINCT keyword FROM idx",
    "time_weight": f"SELECT doc_id::VARCHAR AS id, round(1 / (1 + 0.1::DOUBLE * 3 / importance * (doc_id * 3600.0::DOUBLE / 86400)), 6) AS time_weight FROM {_LABELLED}",
    "filter_time_range": f"WITH {_LOGS} SELECT id, topic FROM logs WHERE timestamp BETWEEN {_NOW} - 20 * 86400 AND {_NOW} - 5 * 86400",
    "list_entries": f"SELECT doc_id::VARCHAR AS id, source, importance FROM {_LABELLED} WHERE source = 'src3'",
    "entries_since": f"WITH {_LOGS} SELECT id, topic FROM logs WHERE timestamp >= {_NOW} - 10 * 86400",
    "source_scan": "SELECT doc_id::VARCHAR AS id FROM documents WHERE source = 'src7'",
    "point_read": f"SELECT doc_id::VARCHAR AS id, lang AS topic, source, importance FROM {_LABELLED} WHERE doc_id = 42",
    "store_stats": f"WITH {_INDEX} SELECT (SELECT count(*) FROM documents) AS total_entries, (SELECT count(DISTINCT keyword) FROM idx) AS total_keywords, (SELECT string_agg(source, ',' ORDER BY source) FROM (SELECT DISTINCT source FROM documents)) AS sources",
    "current_entries": """WITH ops AS (SELECT l_orderkey AS id, l_linenumber * 100000000::BIGINT + l_partkey AS seq,
  CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'remove' WHEN l_returnflag = 'R' THEN 'set_imp' WHEN l_returnflag = 'A' THEN 'demote' ELSE 'access' END AS op,
  (l_quantity % 7)::INT AS level, epoch(l_shipdate) AS ts FROM lineitem),
steps AS (SELECT id, list({'seq': seq, 's': op = 'set_imp', 'v': level} ORDER BY seq, op = 'set_imp', level) FILTER (op IN ('set_imp', 'demote')) AS st, bool_or(op = 'remove') AS gone,
  count(*) FILTER (op = 'access') AS ac, max(ts) FILTER (op = 'access') AS la FROM ops GROUP BY id)
SELECT o_orderkey AS id, o_orderpriority AS topic,
  CASE WHEN st IS NULL THEN o_custkey % 5 + 1 ELSE list_reduce(list_prepend({'seq': 0::BIGINT, 's': true, 'v': (o_custkey % 5 + 1)::INT}, st),
    lambda a, x: {'seq': x.seq, 's': x.s, 'v': CASE WHEN x.s THEN greatest(1, least(5, x.v)) ELSE greatest(1, a.v - 1) END}).v END::INT AS importance,
  coalesce(ac, 0) AS access_count, la AS last_accessed
FROM orders LEFT JOIN steps ON o_orderkey = id WHERE NOT coalesce(gone, false)""",
    "importance_fold": """WITH s AS (SELECT user_id, list({'e': event_id, 's': event_type = 'purchase', 'v': floor(value % 7)::INT} ORDER BY event_id) AS st FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)
SELECT user_id, list_reduce(list_prepend({'e': -1::BIGINT, 's': true, 'v': 3}, st), lambda a, x: {'e': x.e, 's': x.s, 'v': CASE WHEN x.s THEN greatest(1, least(5, x.v)) ELSE greatest(1, a.v - 1) END}).v AS importance FROM s""",
    "supersede_demote": """WITH o AS (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS superseded_by, o_orderkey % 5 + 1 AS imp FROM orders)
SELECT o_orderkey, superseded_by, CASE WHEN superseded_by IS NULL THEN imp ELSE greatest(1, imp - 1) END::INT AS importance FROM o""",
    "access_counts": "SELECT user_id AS id, count(*) AS access_count, max(epoch_us(ts)) AS last_accessed FROM events WHERE event_type = 'view' GROUP BY 1",
    "remove_entries": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "cooc_build": f"WITH {_BASKET} SELECT a, b, n FROM cells",
    "cooc_documents": f"WITH {_weighted('x', 'documents', 'doc_id')} SELECT x.word AS a, y.word AS b, count(*) AS n FROM x JOIN x y ON x.id = y.id AND x.word <= y.word GROUP BY ALL HAVING count(*) >= 2",
    "cooc_prune": f"WITH {_BASKET} SELECT a, b, n FROM cells WHERE n >= 200",
    "cooc_stats": f"WITH {_BASKET} {_STATS}",
    "cooc_decay": f"WITH {_BASKET}, num AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) AS q FROM (SELECT DISTINCT l_orderkey FROM words)), {_decay('words', 'l_orderkey', 0.5)}",
    "keyword_channel": """WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part), k AS (SELECT p_partkey FROM w GROUP BY 1 HAVING count(*) >= 2), v AS (SELECT * FROM w WHERE p_partkey IN (SELECT p_partkey FROM k))
SELECT x.w AS a, y.w AS b, count(*) AS n, 0::BIGINT AS total_docs FROM v x JOIN v y ON x.p_partkey = y.p_partkey AND x.w <= y.w GROUP BY x.w, y.w""",
    "ppmi": f"WITH {_PPMI} SELECT a, b, round(ppmi, 6) AS ppmi FROM ppmi",
    "cond_prob": f"WITH {_COND} SELECT a, b, round(p, 6) AS p FROM st",
    "top_associations": f"WITH {_PPMI} {_TOP_PAIRS}",
    "expand_keywords": f"""WITH {_PPMI},
q AS (SELECT DISTINCT p_name AS query_id, unnest(string_split(p_name, ' ')) AS word FROM part),
s AS (SELECT query_id, b AS word, round(sum(ppmi), 6) AS score FROM q JOIN m ON word = a GROUP BY ALL)
SELECT * FROM (SELECT query_id, word, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, word)::INT AS rank FROM s WHERE (query_id, word) NOT IN (SELECT query_id, word FROM q)) WHERE rank <= 10""",
    "cleanup_vocab": f"WITH {_BASKET}, {_FREQ} SELECT word FROM gone",
    "remove_words": f"WITH {_BASKET}, {_FREQ} SELECT a, b, n FROM cells WHERE a NOT IN (SELECT word FROM gone) AND b NOT IN (SELECT word FROM gone)",
    "consolidate_recent": f"WITH {_BASKET}, r AS (SELECT words.* FROM words JOIN orders ON l_orderkey = o_orderkey WHERE epoch(o_orderdate) >= 915148800) SELECT x.w AS a, y.w AS b, count(*) AS n FROM r x JOIN r y ON x.l_orderkey = y.l_orderkey AND x.w <= y.w GROUP BY ALL",
    "recall_by_date": f"WITH {_LOGS} SELECT id, topic, source FROM logs WHERE date_str = '2024-01-10'",
    "recall_by_range": f"WITH {_LOGS} SELECT id, source, date_str FROM logs WHERE date_str BETWEEN '2024-01-05' AND '2024-01-12' AND topic = 'purchase' AND contains(summary, '7')",
    "summarize_week": f"WITH {_LOGS} SELECT coalesce(date_str, 'all') AS date_str, coalesce(topic, 'all') AS category, count(*) AS n FROM logs WHERE date_str BETWEEN '2024-01-14' AND '2024-01-20' GROUP BY CUBE (date_str, topic)",
    "category_stats": "SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1",
    "stream_day_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS category, count(*) AS n FROM events GROUP BY ALL",
    "two_hop": f"WITH {_COND} SELECT x.b AS mid, y.b AS target, round(x.p * y.p, 6) AS score FROM st x JOIN st y ON x.b = y.a WHERE x.a = 'anvil' AND x.b <> 'anvil' AND y.b <> 'anvil' AND y.a <> y.b ORDER BY 3 DESC, 1, 2 LIMIT 20",
    "group_inference": _group(_COND, _SEEDS),
    "hub_nodes": _hubs(_COND, 0.5, 0.2),
    "connected_anchors": f"WITH RECURSIVE {_GRAPH}, {_reach("'anvil'")} SELECT node FROM r",
    "ppr": f"WITH RECURSIVE {_GRAPH}, {_ranks(_SEEDS)} SELECT node, round(rank, 6) AS rank FROM rank_",
    "shortest_path": f"WITH RECURSIVE {_GRAPH}, {_shortest(_SEEDS)} {_PATHS}",
    "beam_search": _beam(_DOC_COND, _DOC_SEEDS),
    "hidden_chain": f"WITH RECURSIVE {_DOC_GRAPH}, {_reach("'thtion'")}, {_chain(_DOC_SEEDS)} SELECT word, ppr_score, path_count, combined_score FROM chain",
    "cooc_build_documents": f"WITH {_ALL} {_SUMS}",
    "cooc_prune_documents": f"WITH {_DOC} SELECT a, b, n FROM cells",
    "cooc_stats_documents": f"WITH {_ALL} {_STATS}",
    "cooc_decay_documents": f"WITH {_K}, {_DOC_WORDS}, num AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS q FROM (SELECT DISTINCT doc_id FROM words)), {_frequent()}, {_decay('f', 'doc_id', 5)}",
    "ppmi_documents": f"WITH {_DOC_PPMI} SELECT a, b, round(ppmi, 6) AS ppmi FROM ppmi",
    "cond_prob_documents": f"WITH {_DOC_COND} SELECT a, b, round(p, 6) AS p FROM st",
    "top_associations_documents": f"WITH {_DOC_PPMI} {_TOP_PAIRS}",
    "expand_keywords_documents": f"WITH {_TIERS}, {_DOC_PPMI}, {_EXPANDED} SELECT query_id, word, score, rank FROM xp",
    "cleanup_vocab_documents": f"WITH {_ALL}, {_RARE} SELECT word FROM gone",
    "remove_words_documents": f"WITH {_ALL}, {_RARE} {_SUMS.replace('GROUP BY', 'WHERE a NOT IN (SELECT word FROM gone) AND b NOT IN (SELECT word FROM gone) GROUP BY')}",
    "consolidate_recent_documents": f"WITH {_K}, {_doc_cells('doc_id <= 720')} SELECT a, b, n FROM cells",
    "two_hop_documents": f"WITH {_DOC_COND} SELECT x.b AS mid, y.b AS target, round(x.p * y.p, 6) AS score FROM st x JOIN st y ON x.b = y.a WHERE x.a = 'thtion' AND x.b <> 'thtion' AND y.b <> 'thtion' AND y.a <> y.b ORDER BY 3 DESC, 1, 2 LIMIT 20",
    "group_inference_documents": _group(_DOC_COND, _DOC_SEEDS),
    "hub_nodes_documents": _hubs(_DOC_COND, 0.95, 0),
    "connected_anchors_documents": f"WITH RECURSIVE {_DOC_GRAPH}, {_reach("'thtion'")} SELECT node FROM r",
    "ppr_documents": f"WITH RECURSIVE {_DOC_GRAPH}, {_ranks(_DOC_SEEDS)} SELECT node, round(rank, 6) AS rank FROM rank_",
    "shortest_path_documents": f"WITH RECURSIVE {_DOC_GRAPH}, {_shortest(_DOC_SEEDS)} {_PATHS}",
    "evidence": f"""WITH {_TIERS}, {_INDEX}, {_FUZZY}, h AS (SELECT word, entry_id, 2.0 AS s FROM (SELECT DISTINCT word FROM tiers WHERE tier = 'core') JOIN idx ON word = keyword UNION ALL SELECT word, entry_id, s FROM sim JOIN idx USING (keyword)),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY s DESC, entry_id) AS k FROM h)
SELECT word, entry_id, lang AS topic FROM r JOIN documents ON doc_id::VARCHAR = entry_id WHERE k = 1""",
    "parse_time": """SELECT o_orderkey, epoch(date_trunc('month', o_orderdate))::DOUBLE AS start_ts, epoch(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DOUBLE - 1 AS end_ts,
year(o_orderdate) || '年' || month(o_orderdate) || '月' AS time_expr, '查看的订单' AS cleaned_text, 1.0::DOUBLE AS confidence FROM orders""",
    "csv_ingest": "SELECT count(*) FILTER (len(trim(text, E' \\t\\n\\r\\f\\v')) >= 10) AS docs_processed, count(*) FILTER (len(trim(text, E' \\t\\n\\r\\f\\v')) < 10) AS docs_skipped FROM documents",
}
