"""DuckDB SQL of the operators that SQL can express over whole tables."""

from __future__ import annotations

from .secrets import ADDED, BASE, MAX_OWNERS, MAX_REPOSITORIES

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"

#: Rule bits as in quality_rules.RULES.
OP8 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 3),
t AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS up, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS az,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
f AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT + 8 * (2 * up > az)::INT
             + 16 * (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines)::INT + 32 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT)::INT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""

_TOKENS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP2 = rf"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_TOKENS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[j : j + least(len(w), 13) - 1], ' ') AS k
       FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS j FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, j, array_to_string(w[j : j + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, j, dw.n FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id),
side AS (SELECT DISTINCT item_id, j, w[j : j + 12] AS p FROM (SELECT item_id, w, unnest(list_distinct(list_concat(range(1, len(w) - 11, 13), [len(w) - 12]))) AS j FROM b WHERE len(w) >= 13)),
pass AS (SELECT p, row_number() OVER () AS k FROM (SELECT DISTINCT p FROM side)),
pt AS (SELECT k, unnest(p) AS term, generate_subscripts(p, 1) AS i FROM pass),
dt AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS q FROM d),
sh AS (SELECT doc_id, k, i, unnest(range(q - i - 2, q - i + 3)) AS s FROM dt JOIN pt ON dt.term = pt.term),
nr AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, k, s FROM sh GROUP BY doc_id, k, s HAVING count(DISTINCT i) >= 11)),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM nr JOIN pass ON nr.k = pass.k JOIN side ON side.p = pass.p GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN items ON d.doc_id = items.doc_id LEFT JOIN near ON d.doc_id = near.doc_id
"""

def _op5() -> str:
    """The ownership scan, with whole values in place of hashes."""
    kinds = {**BASE, **ADDED}
    quoted = {k: p.replace("'", "''") for k, (p, _, _) in kinds.items()}
    parts = " UNION ALL ".join(
        f"SELECT doc_id, source, {n} AS kind, {least} AS least, string_split_regex(text, '{quoted[k]}') AS g, regexp_extract_all(text, '{quoted[k]}') AS w, regexp_extract_all(text, '{quoted[k]}', {group}) AS v FROM d WHERE regexp_matches(text, '{quoted[k]}')"
        for n, (k, (_, group, least)) in enumerate(kinds.items()))
    names = "[" + ", ".join(f"'{k}'" for k in kinds) + "]"
    listing = f"string_agg({names}[kind + 1] || ':' || b || ':' || e, ',' ORDER BY b, kind)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {n}) AS n_{k}" for n, k in enumerate(BASE))
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
c AS ({parts}),
s AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM c),
x AS (SELECT doc_id, source, kind, (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(w[1:i], lambda x: length(x))))::BIGINT AS e, length(w[i]) AS n, v[i] AS v FROM s WHERE length(v[i]) >= least),
o AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repositories FROM x GROUP BY v),
f AS (SELECT doc_id, kind, e - n AS b, e, NOT copied AS live, owners, repositories FROM x JOIN (SELECT *, owners > {MAX_OWNERS} OR (owners > 1 AND repositories > {MAX_REPOSITORIES}) AS copied FROM o) AS o ON x.v = o.v WHERE kind < {len(BASE)} OR NOT copied),
a AS (SELECT doc_id, {counts}, {listing} FILTER (WHERE kind < {len(BASE)}) AS base, {listing} AS spans, count(*) FILTER (WHERE live) AS n_live, max(owners) AS n_owners, max(repositories) AS n_repositories FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_owners, 0)::BIGINT AS n_owners, coalesce(n_repositories, 0)::BIGINT AS n_repositories
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""


def _tree(name, rows, order):
    """Levels of a tree for each key: rows (key, idx, node, n) up to one node."""
    return f"""{name} AS (
  SELECT key, 0 AS level, row_number() OVER (PARTITION BY key ORDER BY {order}) - 1 AS idx, node, count(*) OVER (PARTITION BY key) AS n FROM {rows}
  UNION ALL
  SELECT key, level + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY key, level, idx // 3, n)"""


def _paths(name, tree, leaves):
    """Siblings to the left and right of each leaf, level by level."""
    return f"""{name}_runs AS (SELECT key, level, idx // 3 AS run, list(node ORDER BY idx) AS nodes FROM {tree} WHERE n > 1 GROUP BY ALL),
{name} AS (
  SELECT l.key, l.idx, list({{'l': array_to_string(nodes[: (l.idx // (3 ** level)::BIGINT) % 3], ''), 'r': array_to_string(nodes[(l.idx // (3 ** level)::BIGINT) % 3 + 2 :], ''), 'h': ''}} ORDER BY level) AS path
  FROM {leaves} l JOIN {name}_runs r ON l.key = r.key AND l.idx // (3 ** (level + 1))::BIGINT = r.run GROUP BY ALL)"""


def _fields(text):
    """A leaf's input: lengths in bytes and values."""
    return " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text))

OP12 = rf"""
WITH RECURSIVE bytes AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
codes AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM documents), bytes),
texts AS (SELECT d.*, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS found FROM documents d LEFT JOIN codes c ON d.doc_id = c.doc_id),
leaves AS (SELECT doc_id, coalesce('s' || source, '') AS key, sha256({_fields("text")}) AS node, sha256({_fields("found")}) AS now FROM texts),
{_tree("low", "leaves", "doc_id NULLS FIRST, node")},
tops AS (SELECT '' AS key, key AS of_key, node FROM low WHERE n = 1),
{_tree("high", "tops", "of_key")},
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, node) - 1 AS idx FROM leaves),
sources AS (SELECT *, row_number() OVER (ORDER BY of_key) - 1 AS idx FROM tops),
{_paths("low_path", "low", "placed")},
{_paths("high_path", "high", "sources")},
proofs AS (
  SELECT p.doc_id, p.node AS leaf, s.node AS subroot, (SELECT node FROM high WHERE n = 1) AS root, now,
         list_concat(coalesce(a.path, []), coalesce(b.path, [])) AS path
  FROM placed p JOIN sources s ON p.key = s.of_key LEFT JOIN low_path a ON a.key = p.key AND a.idx = p.idx LEFT JOIN high_path b ON b.idx = s.idx),
checked AS (
  SELECT *, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256,
         list_reduce(list_prepend({{'l': '', 'r': '', 'h': now}}, path), lambda a, x: {{'l': '', 'r': '', 'h': sha256(x.l || a.h || x.r)}}).h AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM checked
"""


ORACLES = {"op2_decontamination": OP2, "op5_secrets": _op5(), "op8_quality_rules": OP8, "op12_merkle": OP12}
