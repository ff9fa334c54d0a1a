"""Queries that serve many requests at once (paths, fan-outs, routes, seeds), causal chunks, and incremental views.

Requests are the orders whose key is divisible by 20, against all symbols and edges.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.catalog import query
from quarry.operators import chunks, fanout, paths, routes, token_index, vector_index
from quarry.plans.tables import kb
from quarry.session import shared_folder, table
from quarry.streaming import views

_DEPTH, _MOST = 4, 200


def _connect_sql() -> str:
    steps = [
        "e AS (SELECT DISTINCT caller, callee FROM sym_edges WHERE edge_type IN ('call', 'type_ref'))",
        "n AS (SELECT grp, source_name, qname, min(pos) AS pos FROM path_targets GROUP BY 1, 2, 3)",
        "r AS (SELECT *, first_value(qname) OVER (PARTITION BY grp ORDER BY pos, qname) AS root FROM n)",
        "p AS (SELECT grp, source_name, root, qname AS target FROM r WHERE qname <> root)",
        "st AS (SELECT source_name, root AS start FROM p UNION SELECT source_name, target FROM p)",
        "v0 AS (SELECT st.source_name, start, id, NULL::VARCHAR AS parent, 0 AS level FROM st JOIN symbols s ON s.source_name = st.source_name AND s.qname = start)",
    ]
    for k in range(_DEPTH):
        seen = " UNION ALL ".join(f"SELECT source_name, start, id FROM v{i}" for i in range(k + 1))
        steps.append(f"f{k} AS (SELECT * FROM v{k} QUALIFY row_number() OVER (PARTITION BY source_name, start ORDER BY id) <= {_MOST})")
        steps.append(f"s{k} AS ({seen})")
        steps.append(
            f"v{k + 1} AS MATERIALIZED (SELECT f.source_name, f.start, callee AS id, min(caller) AS parent, {k + 1} AS level FROM f{k} f JOIN e ON caller = f.id"
            f" WHERE (f.source_name, f.start, callee) NOT IN (SELECT (source_name, start, id) FROM s{k}) GROUP BY 1, 2, 3)"
        )
    v = " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(_DEPTH + 1))
    steps.append(f"v AS MATERIALIZED ({v})")
    hit = (
        "SELECT p.grp, p.target, {back} AS backward, p.source_name, p.{start} AS start, min((level, v.id)) AS hit FROM p JOIN symbols s ON s.source_name = p.source_name AND s.qname = p.{finish}"
        " JOIN v ON v.source_name = p.source_name AND v.start = p.{start} AND v.id = s.id AND level > 0 GROUP BY 1, 2, 3, 4, 5"
    )
    steps.append(f"a AS ({hit.format(back='false', start='root', finish='target')})")
    steps.append(f"b AS (SELECT * FROM ({hit.format(back='true', start='target', finish='root')}) WHERE (grp, target) NOT IN (SELECT (grp, target) FROM a))")
    steps.append("h AS (SELECT * FROM a UNION ALL SELECT * FROM b)")
    steps.append(
        "w AS (SELECT grp, target, backward, h.source_name, h.start, v.id, v.parent, v.level FROM h JOIN v ON v.source_name = h.source_name AND v.start = h.start AND v.id = struct_extract_at(hit, 2)"
        " UNION ALL SELECT grp, target, backward, w.source_name, w.start, v.id, v.parent, v.level FROM w JOIN v ON v.source_name = w.source_name AND v.start = w.start AND v.id = w.parent)"
    )
    steps.append("x AS (SELECT w.*, qname, lag(level) OVER (PARTITION BY grp, target ORDER BY level) AS before FROM w JOIN symbols s ON s.source_name = w.source_name AND s.id = w.id)")
    return (
        "WITH RECURSIVE "
        + ",\n".join(steps)
        + "\nSELECT grp, target, backward, (row_number() OVER (PARTITION BY grp, target ORDER BY level) - 1)::INTEGER AS pos, id, qname, coalesce(before = level - 1, level = 0) AS cited FROM x"
        " QUALIFY count(*) OVER (PARTITION BY grp, target) > 1"
    )


@query("g35_connect_targets", _connect_sql())
def g35c(spark, d):
    return paths.connect_targets(kb(spark, d, "sym_edges"), kb(spark, d, "symbols"), kb(spark, d, "path_targets"), _DEPTH, _MOST)


_PROD = "NOT regexp_matches({0}, '/(test|tests|benchmark|benchmarks|target|generated)/')"


def _calls_sql(requests: str, per_root: int, depth: int, recursive: int, total: int) -> list[str]:
    """Common table expressions that end in ``calls``."""
    steps = [
        f"y AS (SELECT * FROM symbols WHERE NOT starts_with(id, 'local ') AND {_PROD.format('file')})",
        f"ce AS (SELECT caller, callee, edge_type, file, line FROM sym_edges WHERE edge_type IN ('call', 'implements') AND {_PROD.format('file')})",
        f"k0 AS (SELECT DISTINCT q, source_name, name FROM ({requests}))",
    ]
    for n in range(depth):
        steps.append(
            f"r{n} AS (SELECT k.q, k.source_name, c.qname AS parent, t.qname AS target, ce.edge_type, min((ce.file, ce.line, t.file, t.line_start, t.line_end)) AS s, CASE ce.edge_type WHEN 'call' THEN 0 ELSE 1 END AS kind"
            f" FROM k{n} k JOIN y c ON c.qname = k.name AND c.source_name = k.source_name JOIN ce ON ce.caller = c.id JOIN y t ON t.id = ce.callee AND t.source_name = k.source_name GROUP BY 1, 2, 3, 4, 5)"
        )
        order = "kind, struct_extract_at(s, 1), struct_extract_at(s, 2), target"
        steps.append(f"c{n} AS (SELECT * FROM r{n} QUALIFY row_number() OVER (PARTITION BY q, source_name, parent ORDER BY {order}) <= {per_root})")
        if n:
            used = " UNION ALL ".join(["SELECT q, source_name FROM k0 WHERE false", *(f"SELECT q, source_name FROM o{i}" for i in range(1, n))])
            steps.append(f"u{n} AS (SELECT q, source_name, count(*) AS used FROM ({used}) GROUP BY 1, 2)")
            steps.append(
                f"o{n} AS MATERIALIZED (SELECT c.* FROM (SELECT *, row_number() OVER (PARTITION BY q, source_name ORDER BY parent, {order}) AS place FROM c{n}) c LEFT JOIN u{n} USING (q, source_name) WHERE place + coalesce(used, 0) <= {total})"
            )
        else:
            steps.append("o0 AS MATERIALIZED (SELECT *, 0 AS place FROM c0)")
        if n + 1 < depth:
            been = " UNION ALL ".join(f"SELECT q, source_name, name FROM k{i}" for i in range(n + 1))
            steps.append(f"been{n} AS ({been})")
            steps.append(
                f"m{n} AS (SELECT q, source_name, parent, target, row_number() OVER (PARTITION BY q, source_name ORDER BY parent, {order}) AS i FROM o{n}"
                f" WHERE regexp_replace(struct_extract_at(s, 1), '/[^/]*$', '') = regexp_replace(struct_extract_at(s, 3), '/[^/]*$', '') AND (q, source_name, target) NOT IN (SELECT (q, source_name, name) FROM been{n}))"
            )
            steps.append(
                f"l{n} AS (SELECT DISTINCT q, source_name, 0::BIGINT AS i, []::VARCHAR[] AS ts, []::VARCHAR[] AS ps FROM m{n}"
                f" UNION ALL SELECT l.q, l.source_name, m.i, CASE WHEN ok THEN list_append(ts, m.target) ELSE ts END, CASE WHEN ok THEN list_append(ps, m.parent) ELSE ps END"
                f" FROM (SELECT l.*, m.i AS mi, NOT list_contains(ts, m.target) AND len(list_filter(ps, lambda p: p = m.parent)) < {recursive} AS ok FROM l{n} l JOIN m{n} m ON m.q = l.q AND m.source_name = l.source_name AND m.i = l.i + 1) l"
                f" JOIN m{n} m ON m.q = l.q AND m.source_name = l.source_name AND m.i = l.mi)"
            )
            steps.append(f"k{n + 1} AS (SELECT q, source_name, unnest(ts) AS name FROM l{n} QUALIFY i = max(i) OVER (PARTITION BY q, source_name))")
    every = " UNION ALL ".join(f"SELECT *, {n + 1} AS hop FROM o{n}" for n in range(depth))
    steps.append(
        "calls AS (SELECT q, source_name, parent, target, edge_type, hop::INTEGER AS hop, struct_extract_at(s, 1) AS call_file, struct_extract_at(s, 2) AS call_line, struct_extract_at(s, 3) AS file,"
        f" struct_extract_at(s, 4) AS line_start, struct_extract_at(s, 5) AS line_end FROM ({every}))"
    )
    return steps


@query("g31_qualified_calls", "WITH RECURSIVE " + ",\n".join(_calls_sql("SELECT * FROM fan_requests", 4, 3, 3, 12)) + "\nSELECT * FROM calls")
def g31q(spark, d):
    return fanout.call_fanout(kb(spark, d, "fan_requests"), kb(spark, d, "symbols"), kb(spark, d, "sym_edges"), 4, 3, 3, 12)


_UP = [
    f"""z AS (SELECT r.q, r.source_name, t.id AS t_id, t.qname AS t_qname, t.file AS t_file, t.line_start AS t_line, coalesce(nullif(t.parent, ''), regexp_replace(t.qname, '[.][^.]*$', '')) AS owner,
  c.id AS c_id, c.qname AS c_qname, c.file AS c_file, c.line_start, c.line_end, coalesce(c.parent, 'None') AS c_owner, e.edge_type, e.file AS call_file, e.line AS call_line
  FROM (SELECT DISTINCT * FROM fan_requests) r JOIN symbols t ON t.qname = r.name AND t.source_name = r.source_name AND {_PROD.format('t.file')}
  JOIN sym_edges e ON e.callee = t.id AND e.edge_type IN ('call', 'implements') JOIN symbols c ON c.id = e.caller AND c.source_name = r.source_name AND {_PROD.format('c.file')})""",
    "g AS (SELECT q, source_name, t_id FROM z GROUP BY 1, 2, 3 HAVING count(DISTINCT c_id) <= 8)",
    """b AS MATERIALIZED (SELECT z.* FROM z JOIN g USING (q, source_name, t_id) QUALIFY row_number() OVER (PARTITION BY q, source_name, t_id
  ORDER BY c_owner <> owner, c_file <> t_file, abs(call_line - t_line), call_file, call_line, c_id, edge_type) <= 1)""",
]


@query("g31_qualified_callers", "WITH RECURSIVE " + ",\n".join([*_UP, *_calls_sql("SELECT q, source_name, c_qname AS name FROM b", 16, 2, 4, 24)]) + """
SELECT q, source_name, c_qname AS parent, t_qname AS target, edge_type, 0 AS hop, call_file, call_line, c_file AS file, line_start, line_end FROM b UNION ALL SELECT * FROM calls""")
def g31u(spark, d):
    return fanout.caller_fanout(kb(spark, d, "fan_requests"), kb(spark, d, "symbols"), kb(spark, d, "sym_edges"))


_TOK = "list_distinct(list_transform(regexp_extract_all({0}, '[A-Z]?[a-z]+|[0-9]+'), lambda x: regexp_replace(lower(x), '^(.{{3,}})s$', '\\1')))"
_STOP = ", ".join(f"'{w}'" for w in fanout.STOPWORDS)


def _round_sql(n: int, names: str, barred: str, owned: str, limit: int, room: str) -> list[str]:
    """Round ``n`` of the reverse references: ``names``, ``barred`` and ``owned`` (q, source_name, name), ``room`` per request."""
    return [
        f"""x{n} AS (SELECT k.q, k.source_name, t.qname AS target, t.file AS t_file, c.qname AS caller, c.file, c.line_start, c.line_end, coalesce(c.parent, '') AS owner, e.file AS call_file, e.line AS call_line,
  coalesce(t.parent <> '' AND starts_with(t.qname, t.parent || '.') AND coalesce(c.parent, '') = t.parent, false) AS beside, len(list_intersect({_TOK.format('c.qname')}, a.asked)) AS shared, len(list_intersect({_TOK.format('t.qname')}, a.asked)) AS t_shared
  FROM {names} k JOIN y t ON t.qname = k.name AND t.source_name = k.source_name JOIN te e ON e.callee = t.id JOIN y c ON c.id = e.caller AND c.source_name = k.source_name JOIN asked a ON a.q = k.q)""",
        f"""g{n} AS (SELECT * FROM x{n} x WHERE shared > 0 AND caller <> target AND owner <> target AND NOT EXISTS (SELECT 1 FROM {barred} b WHERE b.q = x.q AND b.source_name = x.source_name AND b.name = x.caller)
  AND (beside OR NOT EXISTS (SELECT 1 FROM {owned} b WHERE b.q = x.q AND b.source_name = x.source_name AND b.name = x.owner)))""",
        f"""h{n} AS (SELECT * FROM g{n} QUALIFY row_number() OVER (PARTITION BY q, source_name, target, caller ORDER BY NOT beside, split_part(call_file, '/', 1) <> split_part(t_file, '/', 1), -shared, call_file <> file, file, line_start, line_end, owner, call_file, call_line) = 1)""",
        f"""i{n} AS (SELECT *, row_number() OVER (PARTITION BY q, source_name, target ORDER BY NOT beside, split_part(call_file, '/', 1) <> split_part(t_file, '/', 1), -shared, call_file <> file, caller, file, line_start) AS r FROM h{n}
  QUALIFY r <= {limit} AND count(*) OVER (PARTITION BY q, source_name, target) <= 16)""",
        f"""round{n} AS MATERIALIZED (SELECT i.* FROM (SELECT *, row_number() OVER (PARTITION BY q, source_name ORDER BY t_shared DESC, target, r) AS place FROM i{n}) i JOIN ({room}) USING (q, source_name) WHERE place <= room)""",
    ]


def _references_sql(limit: int, owner_limit: int, total: int, kept: int) -> str:
    steps = [
        f"y AS (SELECT * FROM symbols WHERE NOT starts_with(id, 'local ') AND {_PROD.format('file')})",
        f"te AS (SELECT caller, callee, file, line FROM member_refs WHERE edge_type = 'type_ref' AND {_PROD.format('file')})",
        f"asked AS (SELECT q, list_filter({_TOK.format('question')}, lambda x: x NOT IN ({_STOP})) AS asked FROM fan_questions)",
        "k1 AS (SELECT DISTINCT q, source_name, name FROM fan_requests)",
        "picked AS (SELECT DISTINCT k.q, k.source_name, s.qname AS name, s.parent AS owner FROM k1 k JOIN y s ON s.qname = k.name AND s.source_name = k.source_name)",
        "owned1 AS (SELECT q, source_name, owner AS name FROM picked WHERE owner <> '')",
        *_round_sql(1, "k1", "picked", "owned1", limit, f"SELECT DISTINCT q, source_name, {total - kept} AS room FROM k1"),
        "k2 AS (SELECT DISTINCT q, source_name, owner AS name FROM round1 WHERE owner <> '')",
        "barred2 AS (SELECT q, source_name, name FROM picked UNION SELECT q, source_name, caller FROM round1)",
        "owned2 AS (SELECT * FROM owned1 UNION SELECT * FROM k2)",
        *_round_sql(2, "k2", "barred2", "owned2", owner_limit, f"SELECT k.q, k.source_name, {total} - count(r.q) AS room FROM (SELECT DISTINCT q, source_name FROM k1) k LEFT JOIN round1 r ON r.q = k.q AND r.source_name = k.source_name GROUP BY 1, 2"),
    ]
    cols = "q, source_name, target, caller, file, line_start, line_end, call_file, call_line"
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT * FROM (SELECT {cols}, 1 AS round FROM round1 UNION ALL SELECT {cols}, 2 FROM round2) QUALIFY row_number() OVER (PARTITION BY q, source_name, target, caller, call_file, call_line ORDER BY round) = 1"
    )


@query("g31_reverse_references", _references_sql(2, 1, 8, 3))
def g31r(spark, d):
    t = {k: kb(spark, d, k) for k in ("fan_requests", "fan_questions", "symbols", "member_refs")}
    return fanout.reverse_references(t["fan_requests"], t["fan_questions"], t["symbols"], t["member_refs"], max_total=8, reserve=True)


_FAMILIES = """SELECT q, obligation, module, entry, terminal, relations, nodes, min((identity, -overlap, relevance, direction, file, line)) AS rank, regexp_replace(entry, '[.][^.]*$', '') AS owner FROM families GROUP BY 1, 2, 3, 4, 5, 6, 7"""
_FORDER = "rank, entry, terminal, relations, nodes"


@query("g36_family_ledger", f"""WITH a AS ({_FAMILIES}), b AS (SELECT *, struct_extract_at(rank, 3) AS origin, row_number() OVER (PARTITION BY q, obligation, module, owner ORDER BY {_FORDER}) AS ro FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY q, obligation, origin ORDER BY {_FORDER}) AS rg FROM b WHERE ro <= 3), d AS (SELECT *, row_number() OVER (PARTITION BY q, obligation ORDER BY {_FORDER}) AS slot FROM c WHERE rg <= 2),
e AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY slot, obligation) AS turn FROM d WHERE slot <= 10),
f AS (SELECT a.*, CASE WHEN c.q IS NULL THEN 'owner-cap' WHEN d.q IS NULL THEN 'origin-cap' WHEN e.q IS NULL THEN 'budget' WHEN turn > 64 THEN 'total' ELSE 'kept' END AS status, e.slot FROM a
  LEFT JOIN c USING (q, obligation, module, entry, terminal, relations, nodes) LEFT JOIN d USING (q, obligation, module, entry, terminal, relations, nodes) LEFT JOIN e USING (q, obligation, module, entry, terminal, relations, nodes))
SELECT q, obligation, module, entry, terminal, relations, nodes, struct_extract_at(rank, 1) AS identity, -struct_extract_at(rank, 2) AS overlap, struct_extract_at(rank, 3) AS relevance, struct_extract_at(rank, 4) AS direction,
  struct_extract_at(rank, 5) AS file, struct_extract_at(rank, 6) AS line, status, slot::INTEGER AS slot, coalesce(slot <= 3, false) AS reserved FROM f""")
def g36l(spark, d):
    return routes.family_ledger(kb(spark, d, "families"))


def _inter(name: str) -> str:
    return f"len(list_intersect({_TOK.format(name)}, asked))"


@query("g38_document_matches", f"""WITH asked AS (SELECT q, {_TOK.format('question')} AS asked, lower(question) AS lowered FROM fan_questions),
nm AS (SELECT q, source_name, name, min(rank) AS origin FROM (SELECT q, source_name, rank, unnest(names) AS name FROM doc_names) GROUP BY 1, 2, 3),
ex AS (SELECT nm.q, nm.source_name, origin, s.id, s.qname, s.file, coalesce(s.parent, '') AS parent, 0 AS member FROM nm JOIN symbols s ON s.qname = nm.name AND s.source_name = nm.source_name),
ow AS (SELECT q, source_name, origin, arg_min(qname, (len(string_split(qname, '.')), qname)) AS owner FROM ex GROUP BY 1, 2, 3),
me AS (SELECT o.q, o.source_name, o.origin, s.id, s.qname, s.file, s.parent, 1 AS member FROM (SELECT DISTINCT q, source_name, qname, origin FROM ex) o JOIN symbols s ON s.parent = o.qname AND s.source_name = o.source_name),
ev AS (SELECT * FROM (SELECT * FROM ex UNION ALL SELECT * FROM me) QUALIFY row_number() OVER (PARTITION BY q, source_name, id ORDER BY member DESC, origin, qname) = 1),
qu AS (SELECT q, source_name, greatest(2, least(8, greatest(1, 48 // count(DISTINCT origin)))) AS quota FROM ev GROUP BY 1, 2),
al AS (SELECT ev.*, quota, asked, lowered FROM ev JOIN qu USING (q, source_name) JOIN asked USING (q)),
sa AS (SELECT q, source_name, origin, last, max(place) AS place FROM (SELECT q, source_name, rank AS origin, unnest(list_transform(mentions, lambda x: lower(x))) AS last, unnest(generate_series(0, len(mentions) - 1)) AS place FROM doc_names) GROUP BY 1, 2, 3, 4),
w0 AS (SELECT al.q, al.source_name, al.origin, id, quota, 0 AS way, place, qname FROM al JOIN sa ON sa.q = al.q AND sa.source_name = al.source_name AND sa.origin = al.origin AND sa.last = lower(split_part(qname, '.', -1)) WHERE member = 1),
sc AS (SELECT *, {_inter("qname || ' ' || file")} AS shared, split_part(file, '/', 1) AS folder, CASE WHEN contains(lowered, lower(qname)) THEN 4 ELSE 0 END AS whole FROM al),
sd AS (SELECT *, shared + whole AS score, max(shared + whole) OVER (PARTITION BY q, source_name, origin) AS top FROM sc),
se AS (SELECT *, row_number() OVER (PARTITION BY q, source_name, origin, folder ORDER BY score DESC, shared DESC, qname, id) AS k, max((score, shared)) OVER (PARTITION BY q, source_name, origin, folder) AS lead FROM sd WHERE top = 0 OR score > 0),
w1 AS (SELECT q, source_name, origin, id, quota, 1 AS way, row_number() OVER (PARTITION BY q, source_name, origin
  ORDER BY CASE WHEN top > 0 THEN k ELSE member END, CASE WHEN top > 0 THEN -struct_extract_at(lead, 1) ELSE 0 END, CASE WHEN top > 0 THEN -struct_extract_at(lead, 2) ELSE 0 END, CASE WHEN top > 0 THEN folder ELSE '' END, qname, id) AS place, qname FROM se QUALIFY place <= quota),
pi AS (SELECT *, row_number() OVER (PARTITION BY q, source_name, origin ORDER BY way, place, qname, id) AS p FROM (SELECT * FROM w0 UNION ALL SELECT * FROM w1) QUALIFY p <= quota),
ro AS (SELECT q, source_name, id, struct_extract_at(b, 1) AS origin, row_number() OVER (PARTITION BY q, source_name ORDER BY b, id) AS root FROM (SELECT q, source_name, id, min((origin, p)) AS b FROM pi GROUP BY 1, 2, 3) QUALIFY root <= 24),
he AS (SELECT al.q, al.source_name, al.id, al.qname, al.file, asked, root, ro.origin, owner, (coalesce(owner, '') <> '' AND al.parent = owner)::INTEGER AS direct FROM ro JOIN al USING (q, source_name, id) LEFT JOIN ow ON ow.q = ro.q AND ow.source_name = ro.source_name AND ow.origin = ro.origin),
ed AS (SELECT DISTINCT caller, callee, edge_type FROM member_refs WHERE edge_type IN ('call', 'implements', 'type_ref') AND caller <> callee),
ne AS (SELECT DISTINCT h.q, h.source_name, root, h.qname, h.file, origin, asked, owner, direct, side, s.qname AS name, edge_type, coalesce(s.parent, '') AS name_parent
  FROM he h JOIN (SELECT callee AS node, caller AS other, edge_type, 0 AS side FROM ed UNION ALL SELECT caller, callee, edge_type, 1 FROM ed) x ON x.node = h.id JOIN symbols s ON s.id = other AND s.source_name = h.source_name AND {_PROD.format("'/' || lower(s.file)")} AND s.qname <> h.qname),
rk AS (SELECT *, row_number() OVER (PARTITION BY q, source_name, root, side ORDER BY {_inter("regexp_extract(name, '([^.]*[.])?[^.]*$')")} DESC, {_inter("split_part(name, '.', -1)")} DESC, edge_type <> 'call', name, edge_type, name_parent) AS d FROM ne QUALIFY d <= 3),
st AS (SELECT q, source_name, root, file, origin, CASE side WHEN 0 THEN name || ' > ' || qname ELSE qname || ' > ' || name END AS route, 2 * d + side AS spot, (edge_type = 'call')::INTEGER + direct + (coalesce(owner, '') <> '' AND name_parent = owner)::INTEGER AS structure_score FROM rk
  UNION ALL SELECT q, source_name, root, file, origin, qname, 0, direct FROM he),
o1 AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY q, source_name, root, route ORDER BY spot) = 1), o2 AS (SELECT *, row_number() OVER (PARTITION BY q, source_name, root ORDER BY spot) - 1 AS depth FROM o1),
o3 AS (SELECT * FROM o2 QUALIFY row_number() OVER (PARTITION BY q, source_name, route ORDER BY depth, root) = 1)
SELECT q, row_number() OVER (PARTITION BY q, source_name ORDER BY depth, root)::INTEGER AS n, route, file, origin AS origin_rank, depth::INTEGER AS depth, structure_score FROM o3 QUALIFY n <= 48""")
def g38m(spark, d):
    t = {k: kb(spark, d, k) for k in ("doc_names", "fan_questions", "symbols", "member_refs")}
    return routes.document_matches(t["doc_names"], t["fan_questions"], t["symbols"], t["member_refs"])


_ENT = "'\\b(?:[A-Z][A-Z0-9_]{1,}|[A-Za-z_]+[A-Z][A-Za-z0-9_]*)\\b'"
_QTOK = "list_distinct(list_transform(regexp_extract_all({0}, '[A-Z]+|[A-Z]?[a-z]+|[0-9]+'), lambda x: regexp_replace(lower(x), '^(.{{3,}})s$', '\\1')))"
_QSTOP = ", ".join(f"'{w}'" for w in token_index.STOPWORDS)


@query("g33_question_seeds", f"""WITH nt AS MATERIALIZED (SELECT *, {_TOK.format('qname')} AS held FROM symbols),
en AS (SELECT q, source_name, question, entity, min(place) AS place FROM (SELECT q, source_name, question, unnest(regexp_extract_all(question, {_ENT})) AS entity, generate_subscripts(regexp_extract_all(question, {_ENT}), 1) AS place FROM code_questions) GROUP BY 1, 2, 3, 4),
ep AS (SELECT *, {_QTOK.format('entity')} AS parts, list_filter({_QTOK.format('question')}, lambda x: x NOT IN ({_QSTOP})) AS asked FROM en),
pt AS (SELECT source_name, id, unnest(held) AS token FROM nt), et AS (SELECT q, source_name, entity, place, parts, asked, unnest(parts) AS token FROM ep),
ca AS (SELECT q, et.source_name, entity, place, parts, asked, id FROM et JOIN pt ON pt.source_name = et.source_name AND pt.token = et.token GROUP BY ALL HAVING count(*) = len(parts)),
sc AS (SELECT ca.*, s.qname, s.file, s.line_start, coalesce(nullif(s.parent, ''), regexp_replace(s.qname, '[.][^.]*$', '')) AS owner, len(list_intersect(held, parts)) AS a, len(list_intersect(held, asked)) AS b, lower(kind) NOT IN ('method', 'function', 'constructor') AS c, len(held) AS l
  FROM ca JOIN nt s ON s.id = ca.id AND s.source_name = ca.source_name WHERE contains(lower(s.qname), lower(entity))),
o1 AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY q, source_name, place, owner ORDER BY a DESC, b DESC, c, l, qname, file, line_start, id) = 1),
o2 AS (SELECT *, row_number() OVER (PARTITION BY q, source_name, place ORDER BY a DESC, b DESC, c, l, qname, file, line_start, id) AS depth FROM o1 QUALIFY depth <= 12),
o3 AS (SELECT * FROM o2 QUALIFY row_number() OVER (PARTITION BY q, source_name, id ORDER BY depth, place) = 1)
SELECT q, row_number() OVER (PARTITION BY q, source_name ORDER BY depth, place)::INTEGER AS n, id, entity FROM o3 QUALIFY n <= 12""")
def g33s(spark, d):
    return token_index.question_seeds(kb(spark, d, "code_questions"), token_index.token_index(kb(spark, d, "symbols")))


def _bridges_sql(targets: int | None, callers: int | None) -> str:
    telling = "asked" if targets is not None else "CASE WHEN len(code) > 0 THEN code ELSE coalesce(rare, []) END"
    cut_targets = f"QUALIFY row_number() OVER (PARTITION BY q, source_name ORDER BY folders DESC, len(list_intersect({_TOK.format('name')}, asked)) DESC, hop DESC, name, callee) <= {targets}" if targets is not None else ""
    own = "(c.qname = regexp_replace(r.name, '[.][^.]*$', '') OR starts_with(c.qname, regexp_replace(r.name, '[.][^.]*$', '') || '.'))"
    cut_callers = f"QUALIFY row_number() OVER (PARTITION BY r.q, r.source_name, r.callee ORDER BY NOT {own}, len(list_intersect({_TOK.format('c.qname')}, r.asked)) DESC, r.call_file, r.call_line, r.caller) <= {callers}" if callers is not None else ""
    return f"""WITH nm AS (SELECT q, source_name, name, max(hop) AS hop FROM cited_types GROUP BY 1, 2, 3),
aq AS (SELECT q, source_name, {_QTOK.format('question')} AS asked, list_distinct(flatten(list_transform(regexp_extract_all(question, {_ENT}), lambda e: {_QTOK.format('e')}))) AS code FROM code_questions),
he AS (SELECT nm.*, asked, code, {_TOK.format('name')} AS held, count(*) OVER (PARTITION BY q, source_name) AS n FROM nm JOIN aq USING (q, source_name)),
fr AS (SELECT q, source_name, token, count(*) AS f, max(n) AS n FROM (SELECT q, source_name, n, asked, unnest(held) AS token FROM he) WHERE list_contains(asked, token) GROUP BY 1, 2, 3),
ra AS (SELECT q, source_name, list(token) AS rare FROM fr WHERE f <= greatest(1, n // 10) GROUP BY 1, 2),
ma AS (SELECT he.*, len(list_filter(held, lambda x: NOT list_contains(code, x))) AS extra FROM he LEFT JOIN ra USING (q, source_name) WHERE list_has_any(held, {telling})),
ch AS (SELECT * FROM ma QUALIFY len(code) = 0 OR extra = min(extra) OVER (PARTITION BY q, source_name)),
rf AS (SELECT caller, callee, min((file, line)) AS s FROM sym_edges WHERE edge_type = 'type_ref' GROUP BY 1, 2),
r AS (SELECT ch.q, ch.source_name, ch.name, hop, asked, s.id AS callee, caller, struct_extract_at(rf.s, 1) AS call_file, struct_extract_at(rf.s, 2) AS call_line FROM ch JOIN symbols s ON s.qname = ch.name AND s.source_name = ch.source_name JOIN rf ON rf.callee = s.id),
w AS (SELECT q, source_name, name, hop, asked, callee, count(*) AS callers, count(DISTINCT split_part(call_file, '/', 1)) AS folders FROM r GROUP BY ALL),
op AS (SELECT * FROM w WHERE callers BETWEEN 2 AND 8 {cut_targets})
SELECT DISTINCT q, name AS target, true AS gated, NULL AS caller, NULL AS file, NULL::BIGINT AS line_start, NULL::BIGINT AS line_end, NULL AS call_file, NULL::BIGINT AS call_line FROM w WHERE callers > 8
UNION ALL SELECT * FROM (SELECT r.q, r.name, false, c.qname, c.file, c.line_start, c.line_end, r.call_file, r.call_line FROM r JOIN op USING (q, source_name, callee) JOIN symbols c ON c.id = r.caller AND c.source_name = r.source_name {cut_callers})"""


def _bridges(spark, d, **how):
    t = {k: kb(spark, d, k) for k in ("cited_types", "code_questions", "symbols", "sym_edges")}
    return token_index.reference_bridges(t["cited_types"], t["code_questions"], t["symbols"], t["sym_edges"], **how)


@query("g34_question_bridges", _bridges_sql(None, None))
def g34q(spark, d):
    return _bridges(spark, d)


@query("g34_limited_bridges", _bridges_sql(2, 1))
def g34l(spark, d):
    return _bridges(spark, d, target_limit=2, callers_per_target=1)


_BODIES = """bodies AS (SELECT page_id AS body, page_id % 90 AS line_start, regexp_replace(regexp_replace(regexp_replace(html, '</[a-z0-9]+>', chr(10) || ')' || chr(10), 'g'), '<([a-z0-9]+)[^>]*>', chr(10) || '\\1(' || chr(10), 'g'), '[\\n]+', chr(10), 'g') AS content FROM pages),
seeds AS (SELECT body, line_start + i AS line FROM (SELECT body, line_start, string_split(content, chr(10)) AS ls, unnest(generate_series(0, len(string_split(content, chr(10))) - 1)) AS i FROM bodies) WHERE regexp_matches(ls[i + 1], 'ñ.*,|^(b|h2)\\($'))"""


def _chunks_sql(max_span: int, short_body: int) -> str:
    strings = chunks.STRINGS.replace("'", "''")
    return f"""WITH {_BODIES},
r AS (SELECT body, i AS ln, ls[i + 1] AS text, regexp_replace(regexp_replace(ls[i + 1], '{strings}', '', 'g'), '{chunks.COMMENT}', '') AS code FROM (SELECT body, string_split(content, chr(10)) AS ls, unnest(generate_series(0, len(string_split(content, chr(10))) - 1)) AS i FROM bodies)),
l AS MATERIALIZED (SELECT body, ln, text, sum(length(code) - length(translate(code, '([{{', '')) - length(code) + length(translate(code, ')]}}', ''))) OVER (PARTITION BY body ORDER BY ln) AS depth,
  NOT regexp_matches(code, '{chunks.DOWN}') AND NOT coalesce(lead(regexp_matches(code, '{chunks.UP}')) OVER (PARTITION BY body ORDER BY ln), false) AS closed, regexp_matches(code, '{chunks.OPENS_BODY}') AS opens FROM r),
a AS (SELECT l.body, l.ln, least(l.depth, coalesce(p.depth, 0)) AS base FROM (SELECT DISTINCT s.body, line - line_start AS ln FROM seeds s JOIN bodies b ON b.body = s.body) s JOIN l ON l.body = s.body AND l.ln = s.ln LEFT JOIN l p ON p.body = l.body AND p.ln = l.ln - 1),
e AS (SELECT a.body, a.ln, e.ln AS j, e.depth AS b FROM a JOIN l e ON e.body = a.body AND e.closed AND abs(e.ln - a.ln) <= {max_span} AND e.depth <= a.base UNION ALL SELECT body, ln, -1, 0 FROM a WHERE ln <= {max_span}),
x AS (SELECT *, min(b) OVER (PARTITION BY body, ln ORDER BY j DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM e WHERE j < ln QUALIFY low IS NULL OR b < low OR j = -1),
y AS (SELECT *, min(b) OVER (PARTITION BY body, ln ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM e WHERE j >= ln QUALIFY low IS NULL OR b < low),
m AS (SELECT x.body, x.ln, max((x.j, -y.j)) AS s FROM x JOIN y ON y.body = x.body AND y.ln = x.ln AND (x.b = y.b OR (x.j = -1 AND y.b <= 0)) GROUP BY 1, 2),
f AS (SELECT a.body, a.ln, struct_extract_at(s, 1) + 1 AS first, -struct_extract_at(s, 2) AS last FROM a LEFT JOIN m ON m.body = a.body AND m.ln = a.ln AND -struct_extract_at(s, 2) - struct_extract_at(s, 1) - 1 < {max_span}),
z AS (SELECT l.body, count(*) AS n, min(CASE WHEN opens AND l.ln < {chunks.SIGNATURE_LINES} THEN l.ln END) AS sign, max(loose) AS loose FROM l LEFT JOIN (SELECT body, bool_or(first IS NULL) AS loose FROM f GROUP BY body) g ON g.body = l.body GROUP BY l.body),
k AS (SELECT l.body, l.ln, CASE WHEN loose THEN 'unisolatable' ELSE 'short_body' END AS reason FROM l JOIN z USING (body) WHERE loose OR (loose IS NULL AND n <= {short_body})
  UNION SELECT body, unnest(generate_series(0, CASE WHEN loose IS NULL THEN 0 ELSE coalesce(sign, 0) END)), 'signature' FROM z WHERE (loose IS NULL AND n > {short_body}) OR NOT loose
  UNION SELECT f.body, unnest(generate_series(first, last)), 'call_site' FROM f JOIN z USING (body) WHERE NOT loose),
w AS (SELECT body, ln, list(DISTINCT reason) AS why FROM k GROUP BY 1, 2), i AS (SELECT w.*, text, ln - row_number() OVER (PARTITION BY body ORDER BY ln) AS run FROM w JOIN l USING (body, ln))
SELECT i.body, any_value(line_start) + min(ln) AS line_start, any_value(line_start) + max(ln) AS line_end, array_to_string(list_sort(list_distinct(flatten(list(why)))), ',') AS reason, string_agg(text, chr(10) ORDER BY ln) AS text FROM i JOIN bodies b ON b.body = i.body GROUP BY i.body, run"""


@query("t17_causal_chunks", _chunks_sql(chunks.MAX_SPAN, 90))
def t17c(spark, d):
    """The nesting of each page's elements as brackets; some texts with a comma and the heads of bold texts are seeds."""
    pages = table(spark, d, "pages")
    nested = F.regexp_replace(F.regexp_replace("html", "</[a-z0-9]+>", "\n)\n"), "<([a-z0-9]+)[^>]*>", "\n$1(\n")
    bodies = pages.select(F.col("page_id").alias("body"), (F.col("page_id") % 90).alias("line_start"), F.regexp_replace(nested, "[\n]+", "\n").alias("content"))
    seeds = bodies.select("body", "line_start", F.posexplode(F.split("content", "\n")).alias("i", "_t")).where(F.col("_t").rlike(r"ñ.*,|^(b|h2)\($")).select("body", (F.col("line_start") + F.col("i")).alias("line"))
    return chunks.causal_chunks(bodies, seeds, short_body=90)


@query("st_incremental_usage", """SELECT strftime(ts, '%Y-%m-%d') AS day, tool_name, outcome, count(*) AS n, count(score) AS scored, coalesce(sum(score), 0)::BIGINT AS total FROM usage GROUP BY 1, 2, 3""")
def st_inc(spark, d):
    """The event log as micro-batches by a hash of the id, some of them repeated, merged into a view day by day."""
    events = kb(spark, d, "usage").select("id", F.col("ts").cast("timestamp").alias("ts"), "tool_name", "outcome", F.col("score").cast("int").alias("score"))
    view = views.DailyUsage(spark, f"{shared_folder(spark)}/usage-{uuid.uuid4().hex}")
    part = F.pmod(F.xxhash64("id"), F.lit(3))
    for k in range(3):
        view.apply(events.where(part == k).unionByName(events.where((part == k - 1) & (F.col("id") % 5 == 0))), k)
    view.apply(events, 2)  # merged before
    return view.read()


@query("k13_dirty_themes", """WITH ch AS (SELECT id FROM docs WHERE n % 20 = 0), m AS (SELECT id, 'k' || (n % 60) AS cluster FROM docs), own AS (SELECT DISTINCT cluster FROM m WHERE id IN (SELECT id FROM ch)),
e AS (SELECT source_id AS a, target_id AS b FROM doc_graph UNION SELECT target_id, source_id FROM doc_graph), near AS (SELECT DISTINCT y.cluster FROM e JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE x.cluster <> y.cluster AND x.cluster IN (SELECT cluster FROM own))
SELECT cluster, 'changed' AS reason FROM own UNION ALL SELECT cluster, 'neighbour' FROM near WHERE cluster NOT IN (SELECT cluster FROM own)""")
def k13d(spark, d):
    docs = kb(spark, d, "docs")
    graph = kb(spark, d, "doc_graph").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return views.dirty_themes(docs.where("n % 20 = 0").select("id"), docs.select("id", F.concat(F.lit("k"), F.col("n") % 60).alias("cluster")), graph)


@query("k04_kept_index")
def k04k(spark, d):
    """Built from the rows of all ids but those divisible by 3, which are added after; ids divisible by 20 are the queries."""
    vecs = kb(spark, d, "vecs").select("id", "v", F.lit("2024-01-01").alias("updated_at"))
    index = vector_index.VectorIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index.build(vecs.where("id % 3 <> 0"))
    index.add(vecs.where("id % 3 = 0"))
    return index.search(vecs.where("id % 20 = 0").select("id", "v"), vecs)


_SHORT = "regexp_extract(node, '([^.]*[.])?[^.]*$')"


@query("g37_component_menu", f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT q, a, b, relation FROM evidence), u AS MATERIALIZED (SELECT DISTINCT q, a, b FROM (SELECT q, a, b FROM e UNION ALL SELECT q, b, a FROM e)),
c(q, node, x) AS (SELECT q, a, a FROM u UNION SELECT c.q, c.node, u.b FROM c JOIN u ON u.q = c.q AND u.a = c.x),
p AS (SELECT q, node, min(x) AS part FROM c GROUP BY 1, 2),
n AS (SELECT p.*, CASE WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.q = p.q AND e.b = p.node) THEN 'entry' WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.q = p.q AND e.a = p.node) THEN 'terminal' ELSE 'via' END AS role FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY q, part, role ORDER BY node) AS k FROM n),
m AS (SELECT q, part, count(*) AS nodes, coalesce(string_agg({_SHORT}, ', ' ORDER BY k) FILTER (role = 'entry' AND k <= 2), '') AS entry, coalesce(string_agg({_SHORT}, ', ' ORDER BY k) FILTER (role = 'via' AND k <= 4), '') AS via,
  coalesce(string_agg({_SHORT}, ', ' ORDER BY k) FILTER (role = 'terminal' AND k <= 4), '') AS terminal FROM r GROUP BY 1, 2),
d AS (SELECT e.q, part, count(*) AS edges FROM e JOIN p ON p.q = e.q AND p.node = e.a GROUP BY 1, 2),
h AS (SELECT q, part, string_agg(route, ',' ORDER BY route) AS routes FROM (SELECT DISTINCT v.q, part, route FROM evidence v JOIN p ON p.q = v.q AND p.node = v.a) GROUP BY 1, 2)
SELECT q, row_number() OVER (PARTITION BY q ORDER BY part)::INTEGER AS label, nodes, edges, entry, via, terminal, coalesce(routes, '') AS routes FROM m JOIN d USING (q, part) LEFT JOIN h USING (q, part)""")
def g37m(spark, d):
    hops = kb(spark, d, "evidence")
    return routes.component_menu(hops, hops.select("q", "route", F.col("a").alias("symbol")))
