"""DuckDB SQL of the operators, or of their base parts, that SQL can express on small tables."""

from __future__ import annotations

from .mixing import WEIGHTS
from .quality import COMMON

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TEXT = "coalesce(text, '')"


def jaccard_sql(k: int, percent: int) -> str:
    """Sets of k-word shingles, links by counting shared shingles, components by reaching out along links."""
    window = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    lowered = f"translate({_TEXT}, '{UPPER}', '{LOWER}')"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(lowered)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: {window})) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS d, doc_id AS root FROM s UNION SELECT r.d, p.b FROM r JOIN p ON p.a = r.root)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(root) AS component_id FROM s JOIN r ON r.d = s.doc_id GROUP BY s.doc_id, len(s)"""


def _js(p: str, q: str, n: int) -> str:
    share = lambda x: f"({x}[i] / list_sum({x}))"
    a, b = share(p), share(q)
    part = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, {n + 1}), lambda i: ({part(a, b)} + {part(b, a)}) / 2))))"


def quality_sql(max_char_js: float = 0.25, max_word_js: float = 0.28, min_chars: int = 300, min_words: int = 100, min_ref_words: int = 2_000) -> str:
    """Base counts, both histograms against their language's sums, and the verdict."""
    classes = ["[a-z]", r"[^\x00-\x7F]", r"[\x20\x09-\x0D]", "[A-Z]", "[0-9]", r"[.,;:!?''\"()-]"]
    counts = [f"length(t) - length(regexp_replace(t, '{c}', '', 'g'))" for c in classes]
    rest = f"length(t) - ({' + '.join(f'({c})' for c in counts)})"
    lists = " ".join(f"WHEN lang = '{lang}' THEN [{', '.join(repr(w) for w in ws)}]" for lang, ws in COMMON.items())
    n = len(next(iter(COMMON.values())))
    common = ", ".join(f"len(list_filter(wl, lambda x: x = cl[{i + 1}]))" for i in range(n))
    sums = lambda c, m: "[" + ", ".join(f"sum({c}[{i + 1}])" for i in range(m)) + "]"
    return rf"""WITH d AS (SELECT doc_id, lang, {_TEXT} AS t, {WORDS.format(_TEXT)} AS w, CASE {lists} END AS cl, {WORDS.format(f'lower({_TEXT})')} AS wl FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM x),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, unnest([0, 1, 2]) AS v(k) WHERE c > 1 GROUP BY doc_id),
f AS (SELECT d.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, [{', '.join(counts)}, {rest}] AS ch, CASE WHEN cl IS NOT NULL THEN [{common}] END AS co FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
f2 AS (SELECT *, CASE WHEN co IS NOT NULL THEN list_append(co, n_words - CAST(list_sum(co) AS BIGINT)) END AS cw FROM f),
r AS (SELECT lang AS r_lang, sum(n_words) AS r_words, {sums('ch', 7)} AS rch, CASE WHEN count(cw) > 0 THEN {sums('cw', n + 1)} END AS rcw FROM f2 GROUP BY lang),
j AS (SELECT f2.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN r_words >= {min_ref_words} AND word_chars >= {min_chars} THEN {_js('ch', 'rch', 7)} END AS cjs,
  CASE WHEN r_words >= {min_ref_words} AND n_words >= {min_words} AND cw IS NOT NULL THEN {_js('cw', 'rcw', n + 1)} END AS wjs FROM f2 JOIN r ON lang IS NOT DISTINCT FROM r_lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(cjs, 0) <= {max_char_js} AND coalesce(wjs, 0) <= {max_word_js} AS kept, round(cjs, 6) AS char_js, round(wjs, 6) AS word_js FROM j"""


def targets_sql(share: float = 1.5, repeat: int = 2) -> str:
    """Sizes and targets: sources stop at their limit in the order of limit by weight, the level of the rest follows."""
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return rf"""WITH d AS (SELECT doc_id, source, CAST(len({WORDS.format(_TEXT)}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k {weights} END AS weight FROM s),
o AS (SELECT *, {float(repeat)} * source_size / weight AS r, row_number() OVER (ORDER BY {float(repeat)} * source_size / weight, source) AS pos FROM w),
l AS (SELECT *, ({share} * sum(source_size) OVER () - {float(repeat)} * (sum(source_size) OVER upto - source_size)) / (sum(weight) OVER () - sum(weight) OVER upto + weight) AS level FROM o WINDOW upto AS (ORDER BY pos ROWS UNBOUNDED PRECEDING)),
b AS (SELECT arg_min(level, pos) FILTER (level <= r) AS level FROM l)
SELECT doc_id, size, source_size, round(least({float(repeat)} * source_size, coalesce(b.level, 1e18) * weight), 4) AS target FROM d JOIN l ON l.source IS NOT DISTINCT FROM d.source, b"""


def _pattern_sql(name: str, pattern: str, group: int, least: int, kind: int) -> str:
    """start, kind, end of the kept matches: the lengths of gaps and matches before them."""
    value = f"regexp_extract(ms[i], '{pattern}', {group})"
    return f"""{name}_m AS (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d WHERE regexp_matches(t, '{pattern}')),
{name} AS (SELECT doc_id, {kind} AS kind, st, st + length(ms[i]) AS en FROM (SELECT *, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS st
  FROM {name}_m, unnest(range(1, len(ms) + 1)) AS u(i)) WHERE length({value}) >= {least})"""


def secrets_sql() -> str:
    """The base spans of every text and their digest."""
    assign = r"""(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    parts = [_pattern_sql("assign", assign, 1, 12, 0), _pattern_sql("access", "AKIA[A-Z0-9]+", 0, 18, 1), _pattern_sql("hexa", "[0-9a-f]+", 0, 16, 2)]
    return f"""WITH d AS (SELECT doc_id, {_TEXT} AS t FROM documents), {', '.join(parts)}, a AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hexa)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
sha256(coalesce(string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || st || ':' || en, ',' ORDER BY st, kind), '')) AS base_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id GROUP BY d.doc_id"""


def audit_sql() -> str:
    """Every document against every step of all orders: which filters fail it, and which of those come earlier in the order."""
    return rf"""WITH RECURSIVE l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, {_TEXT} AS t, {WORDS.format(_TEXT)} AS w FROM documents),
f AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
  || (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
o AS (SELECT '' AS o UNION ALL SELECT o || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS v(x) WHERE NOT contains(o, x)),
s AS (SELECT o AS filter_order, CAST(i AS INT) AS step, o[i] AS letter, o[1:i - 1] AS before FROM o, unnest(range(1, 6)) AS v(i) WHERE length(o) = 5),
x AS (SELECT part, filter_order, step, letter, good, toxic, contains(fails, letter) AS fails_it, translate(fails, before, '') <> fails AS gone, fails FROM f, s),
m AS (SELECT part, filter_order, step, letter, count(*) FILTER (NOT gone AND NOT fails_it) AS kept, count(*) FILTER (NOT gone AND fails_it) AS removed, count(*) FILTER (gone AND fails_it) AS redundant,
  count(*) FILTER (fails = letter) AS unique_fails, count(*) FILTER (NOT gone AND fails_it AND good = 1) AS good_lost, count(*) FILTER (NOT gone AND fails_it AND toxic = 1) AS toxic_lost FROM x GROUP BY ALL)
SELECT * EXCLUDE letter, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM m"""


def fim_sql(seed: int = 1) -> str:
    """Tokens as a list, cut at the two hashed places and put together again."""
    h = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
    return rf"""WITH d AS (SELECT doc_id, {_TEXT} AS t, regexp_extract_all({_TEXT}, '[A-Za-z]+|[^A-Za-z]') AS tk, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT *, CAST(len(tk) AS BIGINT) AS n, least({h(0)} % (len(tk) + 1), {h(1)} % (len(tk) + 1)) AS a, greatest({h(0)} % (len(tk) + 1), {h(1)} % (len(tk) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {h(2)} % 100 >= 90 THEN 'plain' WHEN {h(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, t, n, form, array_to_string(tk[1:a], '') AS p, array_to_string(tk[a + 1:b], '') AS m, array_to_string(tk[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
