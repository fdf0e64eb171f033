"""DuckDB SQL for the queries that SQL expresses: op1, op3, op7, op8, op11, op12.

The others (byte-wise suffix matches, trained models, token packing, cut texts,
keyed permutations) are compared with plain-Python forms in tests/llm."""

from __future__ import annotations

import math

from tableflow.llm import licenses, merkle, mixing, quality_rules

_WORDS = r"[^\x20\x09-\x0D]+"

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_VALUES = ", ".join(f"('{k}', '{t.replace(chr(39), chr(39) * 2)}')" for k, t in licenses.TEMPLATES.items())


def _normal_lines(text: str) -> str:
    between = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"list_transform(string_split(lower(regexp_replace({text}, '{between}', ' ', 'g')), chr(10)), lambda x: trim(x, ' '))"


_WHOLE = "array_to_string(list_filter({0}, lambda x: x <> ''), ' ')"

# Sentence ends before white space, as a sign that normalising leaves alone.
_MARKED = r"regexp_replace(coalesce(text, ''), '[.!?]+([\x20\x09-\x0D])', chr(8233) || '\1', 'g')"

OP1 = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, {_normal_lines("coalesce(text, '')")} AS lines,
           {_normal_lines(_MARKED)} AS marked
    FROM documents),
parts AS (
    SELECT rid, doc_id, list_distinct(list_concat(
        lines,
        CASE WHEN contains(array_to_string(lines, chr(10)), chr(10) || chr(10))
             THEN list_transform(regexp_split_to_array(array_to_string(lines, chr(10)), '\n\n+'), lambda x: trim(replace(x, chr(10), ' '), ' '))
             ELSE [] END,
        flatten(list_transform(regexp_split_to_array(array_to_string(marked, chr(10)), '\n\n+'),
                               lambda p: list_transform(string_split(replace(p, chr(10), ' '), chr(8233)), lambda s: trim(s, ' ')))),
        [{_WHOLE.format('lines')}])) AS units
    FROM docs),
units AS (SELECT rid, unit, row_number() OVER () AS uid FROM (SELECT rid, unnest(units) AS unit FROM parts)),
unit_words AS (SELECT rid, uid, string_split(unit, ' ') AS w FROM units),
unit_grams AS (
    SELECT rid, uid, g, count(*) AS c FROM (SELECT rid, uid, w[i] || ' ' || w[i + 1] AS g FROM (SELECT rid, uid, w, unnest(range(1, len(w))) AS i FROM unit_words))
    GROUP BY ALL),
unit_sizes AS (SELECT uid, len(w) - 1 AS a FROM unit_words),
templates AS (SELECT license_id, string_split({_WHOLE.format(_normal_lines('t'))}, ' ') AS w FROM (VALUES {_VALUES}) v(license_id, t)),
template_grams AS (
    SELECT license_id, g, count(*) AS c FROM (SELECT license_id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT license_id, w, unnest(range(1, len(w))) AS i FROM templates))
    GROUP BY ALL),
template_sizes AS (SELECT license_id, len(w) - 1 AS b FROM templates),
common AS (
    SELECT u.rid, u.uid, t.license_id, sum(least(u.c, t.c)) AS n
    FROM unit_grams u JOIN template_grams t USING (g) GROUP BY ALL),
matched AS (
    SELECT rid, license_id, CAST(2.0 AS DOUBLE) * n / (a + b) AS dice
    FROM common JOIN unit_sizes USING (uid) JOIN template_sizes USING (license_id)
    WHERE CAST(2.0 AS DOUBLE) * n / (a + b) >= {licenses.THRESHOLD}),
best AS (
    SELECT rid, count(*) AS n_matches, min(struct_pack(d := -dice, l := license_id)) AS top FROM matched GROUP BY rid)
SELECT doc_id, CAST(len(units) AS BIGINT) AS n_units, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, top.l AS license_id, -top.d AS dice
FROM parts LEFT JOIN best USING (rid)
"""

_LOG_GAMMA = repr(math.log((1 + quality_rules.ACCURACY) / (1 - quality_rules.ACCURACY)))
_GAMMA = repr((1 + quality_rules.ACCURACY) / (1 - quality_rules.ACCURACY))


def _ratio(name: str) -> str:
    numerator, denominator, *_ = quality_rules.RULES[name]
    return f"CASE WHEN {denominator} > 0 THEN CAST({numerator} AS DOUBLE) / {denominator} ELSE 0.0 END"


def _level(keys: str) -> str:
    """Quantiles of the merged sketches per keys."""
    own = f"{keys}, " if keys else ""
    ranks = "floor(CAST({0} AS DOUBLE) * (total - 1)) + 1"
    value = f"CASE WHEN {{0}} <= -1000000 THEN 0.0 ELSE 2 * exp({{0}} * CAST({_LOG_GAMMA} AS DOUBLE)) / (CAST({_GAMMA} AS DOUBLE) + 1) END"
    p50, p75 = (f"min(bucket) FILTER (seen >= {ranks.format(q)})" for q in (0.5, 0.75))
    return f"""
    SELECT {own}measure, any_value(total) AS n_docs, {value.format(f'({p50})')} AS p50, {value.format(f'({p75})')} AS p75
    FROM (
        SELECT *, sum(n) OVER (PARTITION BY {own}measure ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY {own}measure) AS total
        FROM (SELECT {own}measure, bucket, count(*) AS n FROM long GROUP BY {own}measure, bucket))
    GROUP BY {own}measure"""


_CUT = "p50 + CASE measure " + " ".join(f"WHEN '{m}' THEN {s} * greatest(p75 - p50, {f})" for m, (_, _, s, f) in quality_rules.RULES.items()) + " END"
_MIN = quality_rules.MIN_GROUP

OP3 = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
starts AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM docs),
twice AS (SELECT rid, i FROM starts QUALIFY count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) > 1),
covered AS (SELECT rid, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) v(d) GROUP BY rid),
measured AS (
    SELECT rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
           CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
           CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
           CAST(len(lines) AS BIGINT) AS n_lines,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(len(regexp_extract_all(t, '\p{{Lu}}')) AS BIGINT) AS n_upper,
           CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
    FROM docs LEFT JOIN covered USING (rid)),
ratios AS (SELECT *, {", ".join(f"{_ratio(m)} AS {m}" for m in quality_rules.RULES)} FROM measured),
long AS (
    SELECT lang, source, measure, CAST(CASE WHEN v > {quality_rules._ZERO} THEN ceil(ln(v) / CAST({_LOG_GAMMA} AS DOUBLE)) ELSE -1000000 END AS BIGINT) AS bucket
    FROM ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM ratios" for m in quality_rules.RULES)})),
fine AS ({_level("lang, source")}), coarse AS ({_level("lang")}), every AS ({_level("")}),
cuts AS (
    SELECT f.lang, f.source, f.measure,
           CASE WHEN f.n_docs >= {_MIN} THEN f.cut WHEN c.n_docs >= {_MIN} THEN c.cut ELSE e.cut END AS cut
    FROM (SELECT *, {_CUT} AS cut FROM fine) f
    JOIN (SELECT *, {_CUT} AS cut FROM coarse) c ON f.measure = c.measure AND f.lang IS NOT DISTINCT FROM c.lang
    JOIN (SELECT *, {_CUT} AS cut FROM every) e ON f.measure = e.measure),
failed AS (
    SELECT DISTINCT rid FROM ratios r JOIN cuts k ON r.lang IS NOT DISTINCT FROM k.lang AND r.source IS NOT DISTINCT FROM k.source
    WHERE CASE measure {" ".join(f"WHEN '{m}' THEN {m}" for m in quality_rules.RULES)} END > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND rid NOT IN (SELECT rid FROM failed) AS kept
FROM ratios
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP7 = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark),
patterns AS (
    SELECT DISTINCT item, array_to_string(w[i : i + 9], ' ') AS p, least(len(w), 10) AS size
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM patterns),
windows AS (
    SELECT rid, size, i, array_to_string(w[i : i + size - 1], ' ') AS p
    FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes)),
found AS (SELECT rid, size, i, item FROM windows JOIN patterns USING (p, size)),
hits AS (SELECT rid, count(DISTINCT spot) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS spot FROM (SELECT DISTINCT rid, i, size FROM found)) GROUP BY rid),
of AS (SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(of.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (rid) LEFT JOIN of USING (rid)
"""

OP8 = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
    WHERE 100 * pairs.n >= 85 * (a.n + b.n - pairs.n)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, head) AS (
    SELECT doc_id, doc_id FROM docs
    UNION
    SELECT both_ways.y, reach.head FROM reach JOIN both_ways ON both_ways.x = reach.doc_id)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(head) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

def _crc32(text: str) -> str:
    """Unsigned crc32 of ASCII text, bit by bit."""
    bit = "lambda x, y: xor(x >> 1, CASE WHEN (x & 1) = 1 THEN 3988292384 ELSE 0 END)"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || {codes}, lambda a, b: list_reduce([xor(a, b)] || CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]), {bit})), 4294967295)"


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in (*merkle.FIELDS[:-1], text))})"


def _tree(name: str, levels: int) -> str:
    """CTEs over {name}0 (tree, i, n, digest): {name}k are the nodes k levels
    up, {name}_kin_k each node's siblings on level k.  A tree that is down to
    one node keeps it."""
    fan, out = merkle.FAN, []
    for k in range(levels):
        run = f"PARTITION BY tree, i // {fan} ORDER BY i ROWS BETWEEN"
        out.append(f"""
{name}_kin_{k} AS MATERIALIZED (
    SELECT tree, i, n,
           coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {name}{k}),
{name}{k + 1} AS MATERIALIZED (
    SELECT tree, i // {fan} AS i, n, CASE WHEN n > {fan**k} THEN sha256(string_agg(digest, '' ORDER BY i)) ELSE min(digest) END AS digest
    FROM {name}{k} GROUP BY tree, i // {fan}, n),""")
    return "".join(out)


def _climb(start: str, name: str, levels: int) -> str:
    """CTEs {start}_k: the rows of {start} (tree, i, node, proof) k levels up."""
    fan = merkle.FAN
    return "".join(
        f"""
{start}_{k + 1} AS (
    SELECT s.* REPLACE (CASE WHEN n > {fan**k} THEN sha256(l || node || r) ELSE node END AS node, proof || l || r AS proof)
    FROM {start}_{k} s JOIN (SELECT tree AS kt, i AS ki, n, l, r FROM {name}_kin_{k}) ON kt = tree AND ki = i // {fan**k}),"""
        for k in range(levels)
    )


# Enough levels for 8**7 documents of a language and 8**3 languages.
_UP, _OVER = 7, 3

OP11 = f"""
WITH docs AS MATERIALIZED (
    SELECT doc_id, lang, {_leaf("text")} AS leaf,
           CASE WHEN {_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 3 = 0 THEN {_leaf(_LOWER.format("text"))} ELSE {_leaf("text")} END AS claimed
    FROM documents),
langs AS MATERIALIZED (SELECT lang AS name, count(*) AS size, row_number() OVER (ORDER BY lang NULLS FIRST) AS tree FROM docs GROUP BY lang),
leaves AS MATERIALIZED (
    SELECT doc_id, tree, size AS n, leaf, claimed, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
    FROM docs JOIN langs ON lang IS NOT DISTINCT FROM name),
low0 AS (SELECT tree, i, n, leaf AS digest FROM leaves),{_tree("low", _UP)}
high0 AS MATERIALIZED (SELECT 0 AS tree, tree - 1 AS i, (SELECT count(*) FROM langs) AS n, digest FROM low{_UP}),{_tree("high", _OVER)}
row_0 AS (SELECT doc_id, leaf, tree, i, claimed AS node, '' AS proof FROM leaves),{_climb("row", "low", _UP)}
top_0 AS (SELECT doc_id, leaf, tree AS of, 0 AS tree, tree - 1 AS i, node, proof FROM row_{_UP}),{_climb("top", "high", _OVER)}
roots AS (SELECT digest AS root FROM high{_OVER})
SELECT doc_id, leaf, digest AS subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM top_{_OVER} CROSS JOIN roots JOIN (SELECT i AS si, digest FROM high0) ON si = i
"""

_REPEATS = mixing.REPEATS

OP12 = rf"""
WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0) AS BIGINT) AS size, md5(coalesce(text, '-')) AS digest
    FROM documents),
sized AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM docs GROUP BY source),
weighed AS (SELECT *, {list(mixing.WEIGHTS)}[1 + CAST(sid % {len(mixing.WEIGHTS)} AS BIGINT)] AS w FROM sized),
shares AS (
    SELECT CAST((SELECT sum(s) FROM weighed) - (sum({_REPEATS} * s) OVER upto - {_REPEATS} * s) AS DOUBLE) / CAST(sum(w) OVER () - (sum(w) OVER upto - w) AS DOUBLE) AS share,
           CAST({_REPEATS} * s AS DOUBLE) / w AS full_at, row_number() OVER upto AS pos
    FROM weighed WINDOW upto AS (ORDER BY CAST({_REPEATS} * s AS DOUBLE) / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
level AS (SELECT arg_min(share, pos) AS share FROM shares WHERE share <= full_at),
goals AS MATERIALIZED (SELECT source, sid, s, least(CAST({_REPEATS} * s AS DOUBLE), share * w) AS target FROM weighed, level),
queue AS MATERIALIZED (
    SELECT rid, doc_id, sid, size, s, target, sum(size) OVER (PARTITION BY sid ORDER BY md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || digest), size, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
    FROM docs JOIN goals ON docs.source IS NOT DISTINCT FROM goals.source),
packets AS (
    SELECT rid, sid, least({mixing.PACKET}, size - f) AS words, e * s + start + f + least({mixing.PACKET}, size - f) AS upto, target
    FROM (SELECT *, unnest(range(0, size, {mixing.PACKET})) AS f FROM (SELECT *, unnest(range(0, least({_REPEATS}, CAST(floor(target / s) AS BIGINT) + 1))) AS e FROM queue WHERE size > 0 AND target > 0))),
stream AS (
    SELECT rid, words, sum(words) OVER (ORDER BY CAST(upto AS DOUBLE) / target, sid, upto ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words AS before FROM packets),
taken AS (
    SELECT rid, sum(least(words, (SELECT sum(s) FROM weighed) - before)) AS taken FROM stream WHERE before < (SELECT sum(s) FROM weighed) GROUP BY rid)
SELECT doc_id, size, s AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM queue LEFT JOIN taken USING (rid)
"""

ORACLES = {"op1_license_scan": OP1, "op3_quality_rules": OP3, "op7_decontamination": OP7, "op8_jaccard_join": OP8, "op11_merkle_manifest": OP11, "op12_source_mixing": OP12}
