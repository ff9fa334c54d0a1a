"""DuckDB SQL for the operators that SQL can express; each gives all the rows of its query."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
base AS (
  SELECT r, doc_id, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols
  FROM d),
ln AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
g AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS k
      FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i+1, i+2]) AS p FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
f AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 4 * (5 * n_symbols > n_words)::BIGINT + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
    + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, fail_bits FROM f
"""

#: The ledger once more, and each rule's documents counted on it.
ABLATION = f"""
WITH ledger AS ({OP2}), rules(bit, rule) AS (VALUES (0, 'too_few_words'), (1, 'repeated_words'), (2, 'symbol_heavy'), (3, 'repeated_lines'), (4, 'short_words'), (5, 'long_words'))
SELECT bit::INTEGER AS bit, rule, count(*) FILTER ((fail_bits >> bit) & 1 = 1) AS failed, count(*) FILTER (fail_bits = 1::BIGINT << bit) AS failed_by_this_alone
FROM rules, ledger GROUP BY bit, rule HAVING count(*) FILTER ((fail_bits >> bit) & 1 = 1) > 0 OR (SELECT count(*) FROM ledger) > 0
"""

OP3 = r"""
WITH d AS (  -- pieces of a text: a unit and the separator after it (a blank that ends a unit becomes U+E000 first)
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(regexp_replace(coalesce(text, ''), '([.!?]) ', '\1' || chr(57344), 'g'), '[^\n' || chr(57344) || ']*[\n' || chr(57344) || ']?') AS ls FROM documents),
u AS (
  SELECT doc_id, i, ls[i] AS p, rtrim(ls[i], chr(10) || chr(57344)) AS l, (sum(length(ls[i])) OVER (PARTITION BY doc_id ORDER BY i) - length(ls[i])) AS s,
         regexp_extract_all(rtrim(ls[i], chr(10) || chr(57344)), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS w
  FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM d)),
k AS (SELECT *, len(w) AS n FROM u WHERE len(w) > 0),
v AS (  -- words with the blanks after them; the blanks before the first one go with it
  SELECT doc_id, i, n, j, CASE WHEN j = 1 THEN length(l) - list_sum(list_transform(w, lambda x: length(x))) ELSE 0 END + length(w[j]) AS size,
         translate(rtrim(w[j], chr(9) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word
  FROM (SELECT *, unnest(generate_series(1, len(w))) AS j FROM k)),
m AS (SELECT *, n > 25 AND lag(list_sum(list_transform(string_split(word, ''), lambda x: unicode(x))) % 32 = 0) OVER (PARTITION BY doc_id, i ORDER BY j) AS marked FROM v),
g AS (SELECT *, sum((j = 1 OR marked)::INT) OVER (PARTITION BY doc_id, i ORDER BY j) AS part FROM m),
h AS (SELECT *, j = 1 OR marked OR (n > 25 AND (row_number() OVER (PARTITION BY doc_id, i, part ORDER BY j) - 1) % 24 = 0) AS begins FROM g),
y AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id, i ORDER BY j) AS t FROM h),
tile AS (SELECT doc_id, i, t, sum(size) AS size, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS norm, max(t) OVER (PARTITION BY doc_id, i) AS tiles FROM y GROUP BY doc_id, i, t),
unit AS (SELECT doc_id, i, sum(n) AS n, string_agg(norm, ' ' ORDER BY t) AS norm, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS o,
                sum(sum(n)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM tile GROUP BY doc_id, i),
item AS (SELECT doc_id, i, 0 AS t, norm FROM unit WHERE n >= 14 UNION ALL SELECT doc_id, i, t, norm FROM tile WHERE n >= 14 AND tiles > 1),
twice AS (SELECT * FROM item QUALIFY row_number() OVER (PARTITION BY norm ORDER BY doc_id, i, t) > 1),
block AS (
  SELECT a.doc_id, a.i, max(b.i) AS last, string_agg(b.norm, ' ' ORDER BY b.i) AS norm FROM unit a JOIN unit b ON b.doc_id = a.doc_id AND b.o >= a.o AND b.upto - b.n - (a.upto - a.n) < 40
  GROUP BY a.doc_id, a.i HAVING sum(b.n) >= 40 AND count(*) > 1 AND min(b.n) < 14),
later AS (SELECT * FROM block QUALIFY min(doc_id) OVER (PARTITION BY norm) < doc_id),
cover AS (SELECT DISTINCT u.doc_id, u.i FROM unit u JOIN later b ON b.doc_id = u.doc_id AND u.i BETWEEN b.i AND b.last),
state AS (
  SELECT tile.*, c.i IS NOT NULL OR w.i IS NOT NULL OR p.i IS NOT NULL AS gone FROM tile LEFT JOIN cover c ON c.doc_id = tile.doc_id AND c.i = tile.i
  LEFT JOIN twice w ON w.doc_id = tile.doc_id AND w.i = tile.i AND w.t = 0 LEFT JOIN twice p ON p.doc_id = tile.doc_id AND p.i = tile.i AND p.t = tile.t AND p.t > 0),
spot AS (SELECT *, sum(size) OVER (PARTITION BY doc_id, i ORDER BY t) - size AS a, t - sum(gone::INT) OVER (PARTITION BY doc_id, i ORDER BY t) AS run, bool_and(gone) OVER (PARTITION BY doc_id, i) AS whole FROM state),
span AS (SELECT spot.doc_id, spot.i, min(u.s + a) AS s, max(u.s + a + size) AS e FROM spot JOIN u ON u.doc_id = spot.doc_id AND u.i = spot.i WHERE gone GROUP BY spot.doc_id, spot.i, run),
x AS (SELECT doc_id, count(*) AS n_removed, string_agg(s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s) AS spans FROM span GROUP BY doc_id),
part AS (
  SELECT u.doc_id, u.i, CASE WHEN bool_or(spot.whole) THEN '' WHEN bool_or(spot.gone) THEN
         string_agg(substr(u.l, (a + 1)::BIGINT, size::BIGINT), '' ORDER BY t) FILTER (NOT gone) || substr(any_value(u.p), length(any_value(u.l)) + 1) ELSE any_value(u.p) END AS kept
  FROM u LEFT JOIN spot ON spot.doc_id = u.doc_id AND spot.i = u.i GROUP BY u.doc_id, u.i),
z AS (SELECT doc_id, string_agg(replace(kept, chr(57344), ' '), '' ORDER BY i) AS kept FROM part GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_units FROM unit GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(spans, '') AS spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN z USING (doc_id)
"""

OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i+m-1], ' ') AS k
  FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i
        FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM win),
g AS (
  SELECT r, m, i, array_to_string(w[i:i+m-1], ' ') AS k
  FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, lens WHERE len(w) >= m)),
h AS (SELECT r, g.i, g.m, item_id FROM g JOIN win ON g.k = win.k AND g.m = win.m),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items,
              string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r)
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>{}\[\]]', '', 'g')) AS clutter,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 12))::BIGINT + 0.5::DOUBLE)
           / 281474976710656::DOUBLE AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
o AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM s),
lv AS (
  SELECT min(CASE WHEN ((total - used)::DOUBLE / left_weight::DOUBLE) * weight <= 3 * source_size THEN source_size::DOUBLE / weight END) AS edge FROM o),
t AS (
  SELECT source, source_size, weight,
         CASE WHEN edge IS NULL OR source_size::DOUBLE / weight < edge THEN (3 * source_size)::DOUBLE
              ELSE (SELECT first((total - used)::DOUBLE / left_weight::DOUBLE ORDER BY source NULLS LAST) FROM o
                    WHERE source_size::DOUBLE / weight = edge) * weight END AS target
  FROM o, lv),
k AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs,
         -ln(u) / (0.5::DOUBLE + 0.5::DOUBLE * (size + 1) / (size + 1 + clutter)) AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, size, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM k)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + CASE WHEN upto - size / 2::DOUBLE <= target - epochs * source_size THEN size ELSE 0 END)::BIGINT AS taken
FROM c
"""

OP1 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+least(5, len(w))-1], ' ') AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 85 * (na.n + nb.n - m)),
reach(doc_id, x) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON r.x = e.a),
c AS (SELECT doc_id, min(x) AS component_id FROM reach GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
t AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, count(*)::BIGINT AS df FROM t GROUP BY term),
q AS (SELECT item_id, term, count(*)::BIGINT AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
   FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
x AS (
  SELECT item_id, d.r, d.doc_id, sum(qtf * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT
         * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN f USING (term) JOIN d USING (r) CROSS JOIN s GROUP BY item_id, d.r, d.doc_id)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
FROM x WHERE score > 0 QUALIFY rank <= 20
"""


def merkle(depth: int = 7) -> str:
    """OP12 for at most ``8 ** depth`` rows a language, one step a level."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
    other = leaf.replace(field.format("text"), field.format(lower))
    steps = [
        # crc32 by its table of 256 remainders
        "bits AS (SELECT i AS k, i AS v, 0 AS step FROM range(256) t(i) UNION ALL SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM bits WHERE step < 8)",
        "tab AS (SELECT list(v ORDER BY k) AS t FROM bits WHERE step = 8)",
        "c AS (SELECT *, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),"
        " lambda a, b: xor(a >> 8, t[xor(a, b) & 255 + 1])), 4294967295) % 3 END AS m FROM documents, tab)".replace("xor(a, b) & 255 + 1", "(xor(a, b) & 255) + 1"),
        f"v AS (SELECT lang, doc_id, {leaf} AS leaf, CASE WHEN m = 0 THEN {other} ELSE {leaf} END AS folded FROM c)",
        "l AS (SELECT lang, doc_id, leaf, folded, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM v)",
        "n0 AS (SELECT lang AS g, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM l)",
        "p0 AS (SELECT row_number() OVER () AS id, lang AS g, doc_id, leaf, i, folded AS f, '' AS proof FROM l)",
    ]

    def climb(node: str, way: str, depth: int) -> None:
        for k in range(depth):
            a, b = f"{node}{k}", f"{way}{k}"
            steps.append(
                f"{node}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (max(n) + 7) // 8 AS n FROM {a} GROUP BY g, i // 8)"
            )
            steps.append(
                f"{way}x{k} AS (SELECT p.id, max(s.n) AS n, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < p.i), '') AS lo, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > p.i), '') AS hi"
                f" FROM {b} p JOIN {a} s ON s.g IS NOT DISTINCT FROM p.g AND s.i // 8 = p.i // 8 GROUP BY p.id)"
            )
            steps.append(
                f"{way}{k + 1} AS (SELECT p.* REPLACE (i // 8 AS i, CASE WHEN x.n = 1 THEN f ELSE sha256(x.lo || f || x.hi) END AS f, proof || x.lo || x.hi AS proof) FROM {b} p JOIN {way}x{k} x USING (id))"
            )

    climb("n", "p", depth)
    steps.append(f"m0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n, g AS lang FROM n{depth})")
    steps.append(f"q0 AS (SELECT p.id, 0 AS g, p.doc_id, p.leaf, m.i, p.f, p.proof, m.h AS subroot FROM p{depth} p JOIN m0 m ON m.lang IS NOT DISTINCT FROM p.g)")
    climb("m", "q", 4)
    return "WITH RECURSIVE " + ",\n".join(steps) + "\nSELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM q4, m4 r"


OP12 = merkle()
