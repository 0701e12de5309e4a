"""DuckDB SQL for the queries that SQL can express. Rules, weights and windows come from the operators' own parameters."""

from __future__ import annotations

from . import mixing, quality

SPACE = r"[\x20\x09-\x0D]+"
LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, gap: str = SPACE) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{gap}'), lambda x: x <> '')"


def _op2() -> str:
    failed = " + ".join(f"CASE WHEN {test} THEN {1 << i} ELSE 0 END" for i, (_, test) in enumerate(quality.RULES))
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t, {_words('text')} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM k WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    len(l) AS n_lines, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclamations,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09\\x0D]*$'))) AS n_ellipsis_lines
  FROM d LEFT JOIN r USING (rid)),
f AS (SELECT *, CAST({failed} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {quality.BASE}) <> 0 AS base_failed,
  (failed & {quality.POLICIES['v3']}) = 0 AS kept, failed FROM f"""


def _ablations() -> str:
    per = ", ".join(f"('{p}', '{name}', {mask}, {quality.BITS[name]})" for p, mask in quality.POLICIES.items() for name, _ in quality.RULES if mask & quality.BITS[name])
    n = "CAST(count(*) FILTER ({}) AS BIGINT) AS {}".format
    return f"""
WITH led AS ({_op2()}), per AS (SELECT * FROM (VALUES {per}) AS v(policy, rule, mask, bit))
SELECT policy, rule, {n('failed & bit > 0', 'failing')}, {n('failed & mask = bit', 'sole')}, {n('failed & mask = 0', 'kept')}, {n('failed & mask & ~bit = 0', 'kept_without')} FROM per LEFT JOIN led ON true GROUP BY policy, rule"""


def _op3() -> str:
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len({_words('text')}) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, SUM(size) AS source_size FROM d GROUP BY source),
t AS ({mixing.targets_sql(sizes='sizes')}),
r AS (SELECT doc_id, size, t.source_size, target, CASE WHEN t.source_size > 0 THEN target / CAST(t.source_size AS DOUBLE) ELSE 0 END AS rate,
  CAST(CAST('0x' || substr(md5('5:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / {float(16**13)!r} AS draw
  FROM d LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.mix_source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""


def _op4() -> str:
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH b AS (SELECT item_id, {_words(LOW.format('text'), gap)} AS w FROM benchmark),
i AS (SELECT item_id, unnest(CASE WHEN len(w) >= 13 THEN list_transform(range(1, len(w) - 11), lambda p: w[p:p + 12]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM b),
n AS (SELECT DISTINCT len(g) AS n FROM i),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_words(LOW.format('text'), gap)} AS w FROM documents),
p AS (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS pos FROM d, n WHERE len(w) >= n),
h AS (SELECT DISTINCT rid, pos, n, item_id FROM (SELECT rid, pos, n, w[pos:pos + n - 1] AS g FROM p) JOIN i USING (g)),
c AS (SELECT rid, count(DISTINCT pos + o) AS n_hit FROM (SELECT rid, pos, unnest(range(0, n)) AS o FROM h) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) WHERE item IS NOT NULL GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN s USING (rid)"""


OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM k"""


def _op10(num: int = 85, den: int = 100) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(LOW.format('text'))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING {den} * count(*) >= {num} * (x.n + y.n - count(*))),
both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
c AS (SELECT u AS id, u AS r FROM both_ways UNION SELECT v, r FROM c JOIN both_ways ON u = id),
m AS (SELECT id, min(r) AS component_id FROM c GROUP BY id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = doc_id"""



def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes. The table of the checksum is linear in the bits of its index, so the entries of the eight single bits make it."""
    table = [1 << k for k in range(8)]
    for _ in range(8):
        table = [(x >> 1) ^ (0xEDB88320 * (x & 1)) for x in table]
    entry = "0"
    for k, x in enumerate(table):
        entry = f"xor({entry}, ((i >> {k}) & 1) * {x})"
    step = f"list_transform([xor(c, b) & 255], lambda i: xor(c >> 8, {entry}))[1]"
    digits = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda k: CAST('0x' || substr(hex(encode({text})), k, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda c, b: {step}), 4294967295)"


def _op11() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words('text')} AS w, {_crc32('CAST(doc_id AS VARCHAR)')} AS h FROM documents),
a AS (SELECT *, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g FROM d),
b AS (SELECT *, CASE WHEN planted THEN g % n END AS a0, CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM a),
t AS (SELECT rid, doc_id, n, CASE WHEN planted THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a0 THEN i ELSE a0 + (i - a0) % p END]) ELSE w END AS w FROM b),
s AS (SELECT rid, unnest(range(0, n - 5)) AS i, w FROM t WHERE n >= 12),
g AS MATERIALIZED (SELECT rid, i, hash(w[i + 1:i + 6]) AS k, w[i + 1:i + 6] AS six FROM s),
m AS (SELECT x.rid, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.rid = y.rid AND x.k = y.k AND x.six = y.six AND x.i < y.i),
e AS (SELECT rid, q, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island, i FROM m),
u AS (SELECT rid, q, min(i) AS start, count(*) + 5 AS lcp FROM e GROUP BY rid, q, island),
r AS (SELECT rid, start, lcp + q AS length, min(q) AS period FROM u WHERE lcp >= q AND lcp + q >= 12 GROUP BY rid, start, lcp + q),
o AS (SELECT rid, count(*) AS n_runs, max(length) AS longest, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY rid),
f AS (SELECT rid, start, length, period FROM r QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length DESC, start, period) = 1),
x AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT v.rid, string_agg(v.word, ' ' ORDER BY v.i) AS collapsed FROM (SELECT rid, unnest(w) AS word, unnest(range(0, n)) AS i FROM t) v LEFT JOIN x ON x.rid = v.rid AND x.i = v.i WHERE x.i IS NULL GROUP BY v.rid)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM t LEFT JOIN o USING (rid) LEFT JOIN f USING (rid) LEFT JOIN k USING (rid)"""


def _op12() -> str:
    return f"""
WITH RECURSIVE l AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({LOW.format("coalesce(text, '')")}, '[a-zÀ-ÿ]+')) AS run FROM documents),
o AS (SELECT id, run, count(*) AS c FROM l WHERE length(run) >= 5 GROUP BY id, run),
h AS (SELECT run, c, {_crc32("(id || ':' || run)")} AS h FROM o),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, 2 + h % length(run)) ELSE run END AS word, c FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
x AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
e AS (SELECT DISTINCT word, cut FROM x),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.cut = b.cut AND a.p = b.p AND a.word <> b.word
  UNION ALL SELECT e.word, v.word, v.n FROM e JOIN v ON v.word = e.cut
  UNION ALL SELECT e.cut, e.word, u.n FROM e JOIN v ON v.word = e.cut JOIN v u ON u.word = e.word),
once AS (SELECT DISTINCT word, other, m FROM near),
b AS (SELECT word, count(*) AS n_near, max(m) AS m FROM once GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.m >= 2 * v.n THEN b.m END AS form_n FROM v LEFT JOIN b USING (word)),
g AS MATERIALIZED (SELECT f.word, f.n, f.n_near, f.form_n, (SELECT min(other) FROM once WHERE once.word = f.word AND once.m = f.form_n) AS form FROM f),
c AS (SELECT word, form AS goal, 1 AS step FROM g WHERE form IS NOT NULL UNION ALL SELECT c.word, g.form, step + 1 FROM c JOIN g ON g.word = c.goal WHERE g.form IS NOT NULL),
r AS (SELECT word, max_by(goal, step) AS root FROM c GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM g LEFT JOIN r USING (word)"""


OP13 = """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.rid <> c.rid),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10"""


SQL = {
    "op2_quality_ledger": _op2(),
    "quality_ablations": _ablations(),
    "op3_source_mix": _op3(),
    "op4_decontamination": _op4(),
    "op7_warc": OP7,
    "op10_near_duplicates": _op10(),
    "op11_periodic_runs": _op11(),
    "op12_spelling_variants": _op12(),
    "op13_top_vectors": OP13,
}
