"""DuckDB statements for the corpus queries that SQL can state."""

from __future__ import annotations

from reelspark.llm.license_scan import CUTS, HINT, LICENCES, NEUTRAL, RELATED, RESERVED, SENTENCES, TOPIC, UNKNOWN
from reelspark.llm.secret_scan import BASE_KINDS, RULES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licences() -> str:
    named = " ".join(f"WHEN regexp_matches(s, {_quoted(p)}) THEN '{i}'" for i, p in SENTENCES)
    ident = (f"CASE WHEN NOT regexp_matches(s, {_quoted(HINT)}) THEN NULL {named} "
             f"WHEN regexp_matches(s, {_quoted(TOPIC)}) THEN '{UNKNOWN}' END")
    lines = "text"
    for pattern, to in CUTS:
        to = to.replace("{1}", r"\1").replace("{2}", r"\2")
        lines = f"regexp_replace({lines}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
    steps, last = "", "c0"
    for n, (name, run) in enumerate(LICENCES, 1):
        seq = "," + ",".join(run) + ","
        steps += (f", c{n} AS (SELECT doc_id, ids, replace(l, '{seq}', ',#,') AS l, "
                  f"CASE WHEN contains(l, '{seq}') AND NOT list_contains(f, '{name}') THEN list_append(f, '{name}') ELSE f END AS f FROM {last})")
        last = f"c{n}"
    neutral = ", ".join(f"'{x}'" for x in NEUTRAL)
    return f"""WITH cut AS (
  SELECT doc_id, CASE WHEN regexp_matches(lower(text), {_quoted(RELATED)}) THEN string_split({lines}, '\n') ELSE [] END AS raw FROM documents),
norm AS (SELECT doc_id, list_transform(raw, lambda r: regexp_replace(regexp_replace(lower(r), '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')) AS ss FROM cut),
named AS (SELECT doc_id, coalesce(list_filter(list_transform(ss, lambda s: {ident}), lambda i: i IS NOT NULL), []) AS ids FROM norm),
c0 AS (SELECT doc_id, ids, ',' || array_to_string(list_filter(ids, lambda i: i NOT IN ({neutral})), ',') || ',' AS l, []::VARCHAR[] AS f FROM named){steps}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentences,
  array_to_string(CASE WHEN list_contains(ids, 'AllRights') THEN list_append(f, '{RESERVED}') ELSE f END, ',') AS licenses FROM {last}"""


def secrets() -> str:
    parts = []
    for k, r in enumerate(RULES):
        p = _quoted(r.pattern)
        parts.append(f"""SELECT rid, {k} AS k, '{r.kind}' AS kind, m[i] AS hit, len(t[i]) AS tested,
  list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT rid, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {r.group}) AS t, string_split_regex(text, {p}) AS g FROM d))
  WHERE len(t[i]) >= {r.least}""")
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
hits AS ({' UNION ALL '.join(parts)}),
spans AS (SELECT rid, k, kind, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + len(hit) AS BIGINT) AS span FROM hits),
found AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)},
  string_agg(span, ',' ORDER BY start, k) FILTER (kind IN ({base})) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM spans GROUP BY rid)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (rid)"""


def contamination() -> str:
    words = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    return f"""WITH b AS (SELECT item_id, {words} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: w[i:i+9])
                                   WHEN len(w) > 0 THEN [w] ELSE [] END) AS win FROM b),
d AS (SELECT doc_id, row_number() OVER () AS rid, {words} AS w FROM documents),
n AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT rid, n, i, w[i:i+n-1] AS win FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
hits AS (SELECT rid, n, i, item_id FROM dw JOIN bw USING (win)),
covered AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)"""


def manifest() -> str:
    crc = ("xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(t) + 1), lambda i: ascii(t[i])::BIGINT), lambda c, b: "
           "list_reduce([xor(c, b)] || list_transform(range(8), lambda z: 0::BIGINT), "
           "lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)")

    def leaf(n_chars: str) -> str:
        values = ("doc_id", "source", "lang", n_chars, "text")
        return "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"

    def tree(name: str, key: str, leaves: str) -> str:
        return f"""{name} AS (SELECT {key} AS lang, 0 AS lvl, {leaves}
  UNION ALL SELECT lang, lvl + 1, list_transform(range(0, len(l), 2), lambda i: sha256(l[i + 1] || coalesce(l[i + 2], ''))) FROM {name} WHERE len(l) > 1),
{name}_nodes AS (SELECT lang, lvl, unnest(l) AS digest, generate_subscripts(l, 1) - 1 AS idx FROM {name})"""

    def steps(name: str, pos: str, lang: str, base: int) -> str:
        return f"""SELECT p.rid, {base} + v.lvl AS k, CASE WHEN ({pos} >> v.lvl) % 2 = 1 THEN 'b' ELSE 'a' END || coalesce(s.digest, '') AS step
  FROM p JOIN sub ON p.lang IS NOT DISTINCT FROM sub.lang JOIN {name} v ON v.lang IS NOT DISTINCT FROM {lang} AND len(v.l) > 1
  LEFT JOIN {name}_nodes s ON s.lang IS NOT DISTINCT FROM {lang} AND s.lvl = v.lvl AND s.idx = xor({pos} >> v.lvl, 1)"""

    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, lang, {leaf('n_chars')} AS leaf,
  {leaf('CAST(n_chars AS HUGEINT) + 1')} AS other, CAST(doc_id AS VARCHAR) AS t FROM documents),
p AS (SELECT rid, doc_id, lang, leaf, CASE WHEN {crc} % 7 = 0 THEN other ELSE leaf END AS given,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos FROM d),
{tree('up', 'lang', 'list(leaf ORDER BY pos) AS l FROM p GROUP BY lang')},
sub AS (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM up WHERE len(l) = 1),
{tree('top', "''", 'list(subroot ORDER BY tree) AS l FROM sub')},
steps AS ({steps('up', 'p.pos', 'p.lang', 0)}
  UNION ALL {steps('top', 'sub.tree', "''", 1000)}),
proofs AS (SELECT rid, list(step ORDER BY k) AS steps FROM steps GROUP BY rid),
folded AS (SELECT p.*, coalesce(steps, []) AS steps, list_reduce([given] || coalesce(steps, []), lambda acc, x:
  CASE WHEN x[1] = 'b' THEN sha256(substr(x, 2) || acc) ELSE sha256(acc || substr(x, 2)) END) AS folded_root FROM p LEFT JOIN proofs USING (rid))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: substr(x, 2)), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM folded JOIN sub ON folded.lang IS NOT DISTINCT FROM sub.lang, (SELECT l[1] AS root FROM top WHERE len(l) = 1)"""
