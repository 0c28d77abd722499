"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import math
import string

from . import linkgraph, quality, sharding
from .sharding import Node

WORDS = r"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"


def quality_sql() -> str:
    stops = ", ".join(f"'{x}'" for x in sorted(quality.STOP_WORDS))
    bullets = "".join(quality.BULLETS[1:]) + quality.BULLETS[0]
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format(x="coalesce(text, '')")} AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, (w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
b AS (SELECT d.doc_id, t, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(l.l) - len(list_distinct(l.l)) AS n_dup_lines, len(l.l) AS n_lines, coalesce(c.n, 0) AS n_repeat_words FROM d JOIN l ON d.doc_id = l.doc_id LEFT JOIN c ON d.doc_id = c.doc_id),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b),
q AS (SELECT doc_id, max(n) AS pair FROM (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, w[i] AS x, w[i + 1] AS y FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)) GROUP BY doc_id, x, y) GROUP BY doc_id),
e AS (SELECT d.doc_id, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS alpha, len(list_filter(w, lambda x: list_contains([{stops}], lower(x)))) AS stops,
  len(list_filter(l.l, lambda x: regexp_matches(x, '^[ \t]*[{bullets}]'))) AS bullets, len(list_filter(l.l, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) AS dots FROM d JOIN l ON d.doc_id = l.doc_id)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > {quality.MAX_SYMBOLS_PER_10_WORDS} * n_words OR 2 * len(regexp_extract_all(t, '[A-ZÀ-ÖØ-Þ]')) > word_chars
    OR 2 * (length(t) - length(replace(t, '!', ''))) > n_words OR 2 * n_dup_lines > n_lines OR word_chars > {quality.MAX_WORD_CHARS} * n_words
    OR 100 * alpha < {quality.MIN_ALPHA_PERCENT} * n_words OR 100 * bullets > {quality.MAX_BULLET_PERCENT} * n_lines OR 100 * dots > {quality.MAX_ELLIPSIS_PERCENT} * n_lines
    OR stops < {quality.MIN_STOP_WORDS} OR (coalesce(pair, 0) > 1 AND 200 * pair > {quality.MAX_TOP_PAIR_PERCENT} * n_words)) AS kept
FROM f JOIN e ON f.doc_id = e.doc_id LEFT JOIN q ON f.doc_id = q.doc_id"""


def neardup_sql() -> str:
    lowered = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(x=lowered)} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.least, d.doc_id) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.doc_id"""


def _unit(path: str) -> str:
    return f"((('0x' || substr(md5('{path}|' || key), 1, 13))::BIGINT::DOUBLE + 1) / {1 << 52}::DOUBLE)"


def _draw(nodes: tuple[Node, ...], path: str) -> str:
    """The shard that a row's draws end in."""
    below = lambda n: str(n.shard) if n.shard is not None else _draw(n.children, f"{path}/{n.name}")
    if len(nodes) == 1:
        return below(nodes[0])
    straws = [f"(-ln({_unit(f'{path}/{n.name}')}) / {n.weight}::DOUBLE)" for n in nodes]
    least = f"least({', '.join(straws)})"
    return "CASE " + " ".join(f"WHEN {s} = {least} THEN {below(n)}" for s, n in zip(straws, nodes, strict=True)) + " END"


def shard_sql(tree: tuple[Node, ...]) -> str:
    places = [(r.name, k.name, leaf.shard) for r in tree for k in r.children for leaf in k.children]
    name = lambda i: "CASE shard " + " ".join(f"WHEN {p[2]} THEN '{p[i]}'" for p in places) + " END"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = f"list_transform(range(256), lambda b: list_reduce(list_concat([b::BIGINT], range(8)), lambda c, i: {step}))"
    return rf"""WITH tab AS MATERIALIZED (SELECT {table} AS t),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, encode(coalesce(text, '')) AS x FROM documents),
h AS (SELECT doc_id, key, octet_length(x) + 1 AS size, CASE WHEN octet_length(x) = 0 THEN 0 ELSE
  xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(x)), lambda i: ('0x' || substr(hex(x), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END AS text_crc32 FROM d, tab),
p AS (SELECT *, CAST({_draw(tree, "")} AS INT) AS shard, CAST({_draw(sharding.grown(tree), "")} AS INT) AS grown_shard,
  ('0x' || substr(md5('slot|' || key || '|' || size || '|' || text_crc32), 1, 4))::BIGINT AS h FROM h)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, size, text_crc32) - 1 AS slot, grown_shard, {name(0)} AS region, {name(1)} AS rack FROM p"""


def link_sql(rules: tuple[linkgraph.Rule, ...] = linkgraph.RULES) -> str:
    longest = sorted(rules, key=lambda r: -len(r.text))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    pick = lambda f: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{f(r)}'" for r in longest) + " END"
    lower = lambda x: f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    link = linkgraph.LINK.replace("'", "''")
    a = linkgraph.DAMPING
    # passes beyond which a movement is damped away, each host's distance from the seeds added
    damped = math.ceil(math.log(linkgraph.TOLERANCE) / math.log(a))
    return rf"""WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, {lower("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS MATERIALIZED (SELECT page_id, html, host, path, {pick(lambda r: r.text)} AS rule, {pick(lambda r: r.verdict)} AS ruled FROM p),
c AS (SELECT host, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM j WHERE host <> '' GROUP BY host),
q AS (SELECT host, coalesce(a::DOUBLE / nullif((SELECT sum(a) FROM c), 0), 0) AS good, coalesce(b::DOUBLE / nullif((SELECT sum(b) FROM c), 0), 0) AS bad FROM c),
e AS (SELECT host AS src, {lower("x")} AS dst, count(*)::DOUBLE AS n FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS x FROM j WHERE host <> '') WHERE host <> {lower("x")} GROUP BY 1, 2),
w AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY src) AS all_out, sum(n) OVER (PARTITION BY dst) AS all_in FROM e),
h AS MATERIALIZED (SELECT host, sum(good) AS good, sum(bad) AS bad FROM (SELECT * FROM q UNION ALL SELECT src, 0.0, 0.0 FROM w UNION ALL SELECT dst, 0.0, 0.0 FROM w) GROUP BY host),
k AS MATERIALIZED (SELECT src AS here, dst AS there, n / all_out AS kt, 0.0::DOUBLE AS kd FROM w UNION ALL SELECT dst, src, 0.0, n / all_in FROM w),
m(pass, host, t, d) AS (SELECT 0, host, good::DOUBLE, bad::DOUBLE FROM h WHERE good > 0 OR bad > 0
  UNION ALL SELECT pass + 1, there, sum({a}::DOUBLE * t * kt), sum({a}::DOUBLE * d * kd) FROM m JOIN k ON host = here WHERE pass < (SELECT count(*) FROM h) + {damped} GROUP BY pass, there HAVING sum(t * kt) > 0 OR sum(d * kd) > 0),
s AS (SELECT host, sum(t) AS t, sum(d) AS d FROM m GROUP BY host),
f AS (SELECT (SELECT sum(good) FROM h) / nullif((SELECT sum(t) FROM s), 0) AS ft, (SELECT sum(bad) FROM h) / nullif((SELECT sum(d) FROM s), 0) AS fd),
r AS (SELECT host, coalesce(t * ft, 0) AS trust, coalesce(d * fd, 0) AS distrust FROM s, f)
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN trust + distrust > 0 AND round(distrust / (trust + distrust), 9) > {linkgraph.MOST_DISTRUST} THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN r ON j.host = r.host"""
