"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import decontamination, host_rules, mixing, resampling, secrets, substring_dedup, url_filter, vector_codes


def _op7() -> str:
    lower = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = "CAST(regexp_matches(u, '(^|[^a-z0-9]){0}([^a-z0-9]|$)') AS INTEGER)".format
    strict = " + ".join(hit(t) for t in url_filter.STRICT_TERMS)
    n_soft = " + ".join(hit(t) for t in url_filter.SOFT_TERMS)
    weight = " + ".join(f"{w} * {hit(t)}" for t, w in url_filter.SOFT_TERMS.items())
    rules = sorted(url_filter.RULES, key=lambda r: len(r[1] + r[2]), reverse=True)
    fits = "(host = '{0}' OR host LIKE '%.{0}') AND starts_with(path, '{1}')".format
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in rules) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in rules) + " END"
    return f"""
WITH lowered AS (
  SELECT page_id, {lower} AS u,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
scored AS (SELECT *, {strict} AS n_strict, {n_soft} AS n_soft, {weight} AS w FROM lowered)
SELECT page_id, host, path, {rule} AS rule,
  coalesce({said}, CASE WHEN n_strict > 0 OR (n_soft >= 2 AND w >= 2) THEN 'block' ELSE 'allow' END) AS verdict
FROM scored"""


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _op6() -> str:
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM twice) GROUP BY 1),
f AS (SELECT d.doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
a AS (SELECT *, base_failed OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * n_lines AS any_failed FROM b),
h AS (SELECT host, count(*) AS n, count(*) FILTER (any_failed) AS failed FROM a GROUP BY 1),
m AS (SELECT sum(failed) / sum(n) AS mean FROM h),
v AS (SELECT mean, (SELECT sum(n * pow(failed / n - mean, 2)) / sum(n) FROM h) AS v FROM m),
s AS (SELECT mean, CASE WHEN v > 0 THEN least(greatest(mean * (1 - mean) / v - 1, 1e0), 1e6) ELSE 1e6 END AS k FROM v),
r AS (SELECT host, (failed + mean * k) / (n + k) AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate <= {host_rules.REJECT_RATE} AND NOT (rate > {host_rules.WATCH_RATE} AND any_failed) AS kept
FROM a JOIN r USING (host)"""


def _fill(rows: str, family: str, name: str) -> str:
    """Water-filling of rows (family, name, weight, cap, budget) as in the operator."""
    part = f"PARTITION BY {family} ORDER BY cap / weight, {name}"
    return f"""(
  SELECT *, CASE WHEN is_full THEN cap ELSE weight * first_value(CASE WHEN NOT is_full THEN lvl END IGNORE NULLS)
      OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS given
  FROM (SELECT *, cap / weight <= lvl AS is_full FROM (
    SELECT *, (budget - coalesce(sum(cap) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER ({part} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM {rows})))"""


def _op8() -> str:
    weight = lambda name, of: "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {w}e0" for k, w in of.items()) + f" ELSE {mixing.OTHER_WEIGHT}e0 END"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, CAST(len({_WORDS}) AS BIGINT) AS tokens FROM documents),
n AS (SELECT *, CASE WHEN right(source, 1) IN ('0', '1', '2', '3') THEN 'web' WHEN right(source, 1) IN ('4', '5', '6') THEN 'books' ELSE 'forum' END AS domain FROM d),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS held, sum(tokens) * {mixing.MAX_EPOCHS}e0 AS cap FROM n GROUP BY ALL HAVING sum(tokens) > 0),
bl AS (SELECT domain, lang, sum(cap) AS cap FROM leaves GROUP BY ALL),
t AS (SELECT domain, {weight("domain", mixing.DOMAIN_WEIGHTS)} AS weight, sum(cap) AS cap, (SELECT floor(sum(tokens) * {mixing.FRACTION}e0) FROM d) AS budget, 0 AS root FROM bl GROUP BY 1),
t1 AS {_fill("t", "root", "domain")},
l AS (SELECT bl.domain, lang, {weight("lang", mixing.LANGUAGE_WEIGHTS)} AS weight, bl.cap, given AS budget FROM bl JOIN t1 USING (domain)),
l1 AS {_fill("l", "domain", "lang")},
s AS (SELECT leaves.domain, leaves.lang, source, held, 1e0 AS weight, leaves.cap, given AS budget FROM leaves JOIN l1 USING (domain, lang)),
s1 AS {_fill("s", "domain, lang", "source")},
p AS (SELECT domain, lang, source, CAST(floor(given + 1e-6) AS BIGINT) // held AS whole, CAST(floor(given + 1e-6) AS BIGINT) % held AS rest FROM s1),
k AS (SELECT doc_id, n.domain, n.lang, n.source, tokens, whole, rest,
    sum(tokens) OVER (PARTITION BY n.domain, n.lang, n.source ORDER BY md5('{mixing.SEED}:' || whole || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM n JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, CAST(unnest(generate_series(0, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END - 1)) AS INTEGER) AS epoch FROM k"""


def _op2() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = [("assign", secrets.ASSIGN, 2, secrets.LEAST["assign"]), ("access", secrets.ACCESS, 0, secrets.LEAST["access"]), ("hex", secrets.HEX, 0, secrets.LEAST["hex"]), ("random", secrets.TOKEN, 0, 0)]

    def matches(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
        p = quote(pattern)
        return f"""SELECT doc_id, {rank} AS r, '{kind}' AS kind, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS a, length(v) >= {least} AS ok
  FROM (SELECT doc_id, unnest(found) AS m, unnest(gaps[:len(found)]) AS g, unnest(tested) AS v, unnest(generate_series(1, len(found))) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, {p}) AS found, regexp_split_to_array(text, {p}) AS gaps, regexp_extract_all(text, {p}, {group}) AS tested FROM d) WHERE len(found) > 0)"""

    alphabet = "CASE " + " ".join(f"WHEN {test} THEN {quote(a)}" for test, a in ((_alphabet_test(p), a) for _, p, a in secrets.ALPHABETS)) + " END"
    t = "(1 / (1 + 0.3275911e0 * (abs({0}) / sqrt(2e0))))"
    tail = f"({t} * (0.254829592e0 + {t} * (-0.284496736e0 + {t} * (1.421413741e0 + {t} * (-1.453152027e0 + {t} * 1.061405429e0)))) * exp(-{{0}} * {{0}} / 2) / 2)".format
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(matches(r, *k) for r, k in enumerate(kinds))}),
spans AS (SELECT doc_id, r, kind, m, CAST(a AS BIGINT) AS a, CAST(a AS BIGINT) + length(m) AS z FROM found WHERE ok),
base AS (SELECT * FROM spans WHERE r < 3),
tok AS (SELECT s.doc_id, s.a, s.z, s.m, {alphabet.replace("tok", "s.m")} AS alphabet FROM spans s WHERE r = 3
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b.a < s.z AND s.a < b.z) AND regexp_matches(s.m, '[0-9]') AND regexp_matches(s.m, '[A-Za-z]')),
named AS (SELECT *, CAST(length(m) AS DOUBLE) AS n, CAST(length(alphabet) AS DOUBLE) AS k FROM tok WHERE alphabet IS NOT NULL),
chars AS (SELECT doc_id, a, z, n, k, i, c, instr(alphabet, c) - (k + 1) / 2 AS y FROM (SELECT *, unnest(string_split(m, '')) AS c, unnest(generate_series(1, length(m))) AS i FROM named)),
square AS (SELECT doc_id, a, sum(q * q) AS q FROM (SELECT doc_id, a, c, count(*) AS q FROM chars GROUP BY ALL) GROUP BY ALL),
pairs AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, a ORDER BY i) AS x FROM chars),
sums AS (SELECT doc_id, a, z, n, k, CAST(count(*) FILTER (y > 0) AS DOUBLE) AS high, 1 + count(*) FILTER (x IS NOT NULL AND (x > 0) <> (y > 0)) AS runs, sum(y * y) AS yy, coalesce(sum(x * y), 0) AS xy FROM pairs GROUP BY ALL),
stats AS (SELECT *, k / n * q - n AS chi, k - 1 AS df, 2 * high * (n - high) / n + 1 AS mean FROM sums JOIN square USING (doc_id, a)),
z AS (SELECT *, (pow(greatest(chi, 0) / df, 1 / 3e0) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df)) AS z1,
  CASE WHEN (mean - 1) * (mean - 2) > 0 THEN (runs - mean) / sqrt((mean - 1) * (mean - 2) / (n - 1)) ELSE 9e0 END AS z2, CASE WHEN yy > 0 THEN xy / yy * sqrt(n) ELSE 9e0 END AS z3 FROM stats),
p AS (SELECT doc_id, a, z.z AS z, n, least(1e0, 3 * least(CASE WHEN z1 >= 0 THEN {tail("z1")} ELSE 1 - {tail("z1")} END, 2 * {tail("z2")}, 2 * {tail("z3")})) AS p FROM z),
bins AS (SELECT *, CAST(least({secrets.BINS}, greatest(0, floor(-10 * log10(greatest(p * (SELECT avg(n) FROM p) / n, 1e-30))))) AS INTEGER) AS b FROM p),
cut AS (SELECT coalesce(min(t), {secrets.BINS + 1}) AS cut FROM (SELECT t, count(*) AS held FROM (SELECT unnest(generate_series(0, {secrets.BINS})) AS t) JOIN bins ON b >= t GROUP BY t)
  WHERE (SELECT count(*) FROM bins) * pow(10e0, -t / 10e0) / held <= {secrets.ALPHA}),
every AS (SELECT doc_id, r, kind, a, z FROM base UNION ALL SELECT doc_id, 3, 'random', a, z FROM bins, cut WHERE b < cut),
said AS (SELECT doc_id, count(*) FILTER (r = 0) AS n0, count(*) FILTER (r = 1) AS n1, count(*) FILTER (r = 2) AS n2,
  string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, r, z) FILTER (r < 3) AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, r, z) AS spans FROM every GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN said USING (doc_id)"""


def _alphabet_test(pattern: str) -> str:
    """A pattern's test in RE2, which has no look-ahead: the mixed alphabets ask for both cases beside."""
    plain = pattern.replace("(?=.*[a-z])(?=.*[A-Z])", "")
    both = "regexp_matches(tok, '[a-z]') AND regexp_matches(tok, '[A-Z]') AND " if plain != pattern else ""
    return f"{both}regexp_matches(tok, '{plain}')"


def _op3() -> str:
    w = substring_dedup.WIDTH
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {w - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {w - 1})) AS i FROM d)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {w - 1})) AS p FROM m WHERE least < doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""


_ALNUM_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _op9() -> str:
    words = _ALNUM_WORDS
    w = decontamination.WIDTH
    return f"""
WITH b AS (SELECT item_id, {words} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), {w}) AS m, array_to_string(w[i:i + {w - 1}], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {w - 1}, 1))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {words} AS w FROM documents),
win AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM p))),
hit AS (SELECT doc_id, m, i, item_id FROM win JOIN p USING (m, g)),
h AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS q FROM hit) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _op4() -> str:
    call = "'c' || conv_id || '-' || {0}".format
    return f"""
WITH RECURSIVE c AS (
  SELECT conv_id, {call("turn")} AS call_id, min(turn) AS turn, min(text) AS text, count(*) AS n_calls,
    CASE WHEN min(turn) >= 2 THEN {call("(min(turn) - 2)")} END AS dep
  FROM conversations WHERE role = 'user' GROUP BY conv_id, conversations.turn),
r AS (SELECT conv_id, {call("(turn - 1)")} AS call_id, min(turn) AS result_turn, min(text) AS content, count(*) AS n_results
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id, conversations.turn),
lv AS (
  SELECT conv_id, call_id, 0 AS level FROM c WHERE dep IS NULL OR dep NOT IN (SELECT call_id FROM c)
  UNION ALL SELECT c.conv_id, c.call_id, lv.level + 1 FROM c JOIN lv ON c.dep = lv.call_id),
j AS (SELECT conv_id, call_id, turn, text, dep, n_calls, result_turn, content, n_results FROM c FULL JOIN r USING (conv_id, call_id))
SELECT conv_id, coalesce(turn, result_turn) AS turn, call_id, level,
  CASE WHEN n_calls IS NULL THEN 'orphan' WHEN n_results IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
  CASE WHEN n_calls IS NULL THEN '' WHEN text IS NULL THEN 'required .prompt' WHEN length(text) < 1 THEN 'minLength .prompt' WHEN length(text) > 400 THEN 'maxLength .prompt' ELSE '' END AS errors,
  CASE WHEN n_calls IS NULL THEN '{{"content":' || to_json(content) || ',"role":"tool","tool_call_id":' || to_json(call_id) || '}}'
    ELSE '{{"arguments":{{' || CASE WHEN dep IS NULL THEN '' ELSE '"context":' || to_json('${{' || dep || '}}') || ',' END || '"prompt":' || to_json(text) || ',"turn":' || turn || '}},"id":' || to_json(call_id) || ',"name":"reply"'
      || CASE WHEN n_results IS NULL THEN '' ELSE ',"result":' || to_json(content) END || '}}' END AS json
FROM j LEFT JOIN lv USING (conv_id, call_id)
UNION ALL
SELECT conv_id, turn, NULL, NULL, 'message', 0, 0, '', '{{"content":' || to_json(text) || ',"role":' || to_json(role) || '}}' FROM conversations WHERE role NOT IN ('user', 'assistant')"""


def _op11() -> str:
    r = resampling
    features = "w || list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])"
    byte = "lambda i: (instr('0123456789ABCDEF', h[2 * i - 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i]) - 1"
    return f"""
WITH RECURSIVE turn AS (SELECT i, i AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM turn WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM turn WHERE k = 8),
d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
df AS (SELECT doc_id, unnest({features}) AS f FROM d),
bf AS (SELECT unnest({features}) AS f FROM (SELECT {_ALNUM_WORDS} AS w FROM benchmark)),
x AS (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM df UNION SELECT DISTINCT f FROM bf)),
b AS (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(generate_series(1, len(h) // 2), {byte})),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % {r.BUCKETS} AS bucket FROM x, crc),
s AS (SELECT bucket, count(*) AS s FROM df JOIN b USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN b USING (f) GROUP BY 1),
g AS (SELECT bucket, floor({r.SCALE} * ln((coalesce(t, 0) + 1e0) * ((SELECT count(*) FROM df) + {r.BUCKETS}e0) / ((coalesce(s, 0) + 1e0) * ((SELECT count(*) FROM bf) + {r.BUCKETS}e0)))) AS gain
  FROM s FULL JOIN t USING (bucket)),
m AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM df JOIN b USING (f) JOIN g USING (bucket) GROUP BY 1),
h AS (SELECT doc_id, sha256('{r.SEED}:' || doc_id)[:8] AS h FROM d),
z AS (SELECT doc_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(generate_series(1, 8), lambda i: CAST(instr('0123456789abcdef', h[i]) - 1 AS BIGINT))), lambda c, y: c * 16 + y) AS h FROM h),
q AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-{r.SCALE}e0 * ln(-ln((h + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM d JOIN z USING (doc_id) LEFT JOIN m USING (doc_id)),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM q WHERE n_words >= {r.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN k <= {r.PERCENT} * (SELECT count(*) FROM k) // 100 THEN k END AS rank FROM q LEFT JOIN k USING (doc_id)"""


def _op13() -> str:
    v = vector_codes
    near = """near{0} AS MATERIALIZED (SELECT vec_id, p, min(CAST(list_dot_product(x, x) - 2 * list_dot_product(x, y) + list_dot_product(y, y) AS BIGINT) * {1} + e) AS m
  FROM sub JOIN book{0} USING (p) GROUP BY ALL)""".format
    book = """mean{0} AS (SELECT p, e, list(c ORDER BY i) AS z FROM (SELECT p, e, i, floor(sum(c) / count(*)) AS c
  FROM (SELECT p, m % {2} AS e, unnest(x) AS c, unnest(generate_series(1, len(x))) AS i FROM near{1} JOIN sub USING (vec_id, p)) GROUP BY ALL) GROUP BY ALL),
book{0} AS MATERIALIZED (SELECT p, e, coalesce(z, y) AS y FROM book{1} LEFT JOIN mean{0} USING (p, e))""".format
    rounds = ",\n".join(near(r, v.ENTRIES) + ",\n" + book(r + 1, r, v.ENTRIES) for r in range(v.ROUNDS))
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({v.UNIT} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
sub AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {v.PARTS} + 1:(p + 1) * len(v) // {v.PARTS}] AS x FROM k, range({v.PARTS}) r(p)),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS y FROM sub WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {v.ENTRIES})),
{rounds},
{near(v.ROUNDS, v.ENTRIES)},
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', m % {v.ENTRIES}), '' ORDER BY p) AS code, CAST(sum(m // {v.ENTRIES}) AS BIGINT) AS error FROM near{v.ROUNDS} GROUP BY 1),
said AS (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(y) AS c, unnest(generate_series(1, len(y))) AS i FROM book{v.ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN k USING (vec_id), said"""


def oracle_sql() -> dict[str, str]:
    return {"op2_random_secrets": _op2(), "op3_suffix_trees": _op3(), "op9_wu_manber": _op9(), "op4_tool_call_links": _op4(), "op6_host_rules": _op6(), "op7_url_vocabulary": _op7(), "op8_hierarchical_mix": _op8(), "op11_importance_resampling": _op11(), "op13_partial_distance": _op13()}
