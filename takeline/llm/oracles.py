"""DuckDB SQL for the queries that SQL can say over whole tables."""

from __future__ import annotations

from takeline.llm.url_filters import WORD_RULES

_ESCAPED = r"regexp_replace(regexp_replace(coalesce({0}, ''), '\\', '\\\\', 'g'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g')"

OP1 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length('<s>[INST][/INST] </s>') + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

_WORDS = "|".join(r.regex.removeprefix(r"^(?:[^\n]*[.-])?").removesuffix(r"[.\n-]") for r in WORD_RULES)
OP2 = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '(^|[.-])({_WORDS})([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35
), keyed AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS k FROM win
), rep AS (
  SELECT doc_id, i FROM keyed WHERE k IN (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1)
), gone AS (
  SELECT doc_id, list_sort(list_distinct(flatten(list(range(i, i + 35))))) AS g FROM rep GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
    CASE WHEN g IS NULL THEN w ELSE list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(g, x[2])).list_transform(lambda x: x[1]) END AS k
  FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""

OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d
), n AS (
  SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(list_sort(s), chr(1))) END AS k, s FROM s
), rep AS (
  SELECT k, min(doc_id) AS r, any_value(n) AS n FROM n WHERE k IS NOT NULL GROUP BY k
), e AS (
  SELECT r, n.n, unnest(n.s) AS x FROM rep JOIN n ON n.doc_id = rep.r
), link AS (
  SELECT a.r AS u, b.r AS v FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(u, v) AS (
  SELECT r, r FROM rep UNION SELECT reach.u, link.v FROM reach JOIN link ON reach.v = link.u
), comp AS (
  SELECT u, min(v) AS c FROM reach GROUP BY u
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(c, n.doc_id) AS component_id, coalesce(c, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN rep ON n.k = rep.k LEFT JOIN comp ON comp.u = rep.r
"""

_LEVELS = 6  # 16 ** 6 rows of a source, and as many sources


def _climb(name: str, start: str) -> str:
    """Tables ``{name}0`` to ``{name}6`` of a tree's nodes, from ``tree, place, node``; a tree that is one node stays."""
    out = f"{name}0 AS ({start})"
    for k in range(_LEVELS):
        out += f""", {name}r{k} AS (
  SELECT tree, place // 16 AS place, string_agg(node, '' ORDER BY place) AS run, any_value(n) = 1 AS done
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k}) GROUP BY tree, place // 16
), {name}{k + 1} AS (SELECT tree, place, CASE WHEN done THEN run ELSE sha256(run) END AS node FROM {name}r{k})"""
    return out


def _siblings(name: str, place: str, k: int) -> tuple[str, str]:
    at = f"64 * (({place} // {16**k}) % 16)"
    return f"CASE WHEN {name}{k}.done THEN '' ELSE substr({name}{k}.run, 1, {at}) END", f"CASE WHEN {name}{k}.done THEN '' ELSE substr({name}{k}.run, {at} + 65) END"


def _op12() -> str:
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(map(value, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    joins, proof, folded = "", [], "presented"
    for name, place, tree in (("s", "l.place", "l.tree"), ("t", "o.place", "''")):
        for k in range(_LEVELS):
            joins += f" JOIN {name}r{k} AS {name}{k} ON {name}{k}.tree = {tree} AND {name}{k}.place = {place} // {16 ** (k + 1)}"
            left, right = _siblings(name, place, k)
            proof += [left, right]
    steps = ", ".join(f"f{i} AS (SELECT *, CASE WHEN done[{i + 1}] THEN now ELSE sha256(part[{2 * i + 1}] || now || part[{2 * i + 2}]) END AS nxt FROM (SELECT * EXCLUDE (nxt, now), nxt AS now FROM f{i - 1}))" for i in range(2 * _LEVELS))
    done = ", ".join(f"{name}{k}.done" for name in "st" for k in range(_LEVELS))
    return f"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), d AS (
  SELECT *, list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), CAST(4294967295 AS BIGINT)) AS c FROM documents, crc
), leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf("text")} AS node,
    CASE WHEN xor(c, 4294967295) % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {leaf("text")} END AS presented FROM d
), l AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS place FROM leaves
), {_climb("s", "SELECT tree, place, node FROM l")}, o AS (
  SELECT tree AS source, row_number() OVER (ORDER BY tree) - 1 AS place, node FROM s{_LEVELS}
), {_climb("t", "SELECT '' AS tree, place, node FROM o")}, p AS (
  SELECT l.doc_id, l.node AS leaf, l.presented, o.node AS subroot, [{", ".join(proof)}] AS part, [{done}] AS done
  FROM l JOIN o ON o.source = l.tree{joins}
), f_start AS (SELECT *, presented AS nxt, presented AS now FROM p), {steps.replace("f-1", "f_start")}
SELECT doc_id, leaf, subroot, (SELECT node FROM t{_LEVELS}) AS root, sha256(array_to_string(part, '')) AS proof_sha256, nxt AS folded_root, nxt = (SELECT node FROM t{_LEVELS}) AS verified FROM f{2 * _LEVELS - 1}
"""


OP12 = _op12()

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), l AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term
), s AS (
  SELECT lang, source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (s.n + 2 * l.v) AS BIGINT) AS p,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (k.n + 2)) // (l.n + 2 * l.v) AS BIGINT) AS q
  FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
), o AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10
"""

ORACLES = {"op13_divergence": OP13, "op12_merkle": OP12, "op1_chat_format": OP1, "op2_url_filter": OP2, "op4_substring_dedup": OP4, "op5_near_dedup": OP5}
