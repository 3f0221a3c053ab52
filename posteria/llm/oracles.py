"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from posteria.llm import sharding

#: CRC-32 as a list of 256 remainders and a fold over the bytes of a text.
CRC_TABLE = (
    "SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda a, b: "
    "CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END) AS c FROM range(256) r(n))"
)


def shard_sql(shards: int, seed: int) -> str:
    """Row numbers by key order, the permutation round by round, and a recursive walk back inside."""
    last = f"SELECT id, steps, a, b, n, v // b AS x, v % b AS y FROM walk WHERE steps = 0 OR v >= n"
    for i, (key, factor) in enumerate(sharding.rounds(seed)):
        source, target, side = ("x", "y", "b") if i % 2 else ("y", "x", "a")
        p = sharding.PRIME
        t = f"(({source} + {key}) % {p})"
        mixed = f"((({t} * {t}) % {p} + {t}) * {factor} % {p})"
        last = f"SELECT id, steps, a, b, n, {source}, ({target} + {mixed}) % {side} AS {target} FROM ({last})"
    step = f"SELECT id, steps + 1, a, b, n, x * b + y FROM ({last})"
    return f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
raw AS (SELECT doc_id, strlen(coalesce(text, '')) AS bytes, hex(encode(coalesce(text, ''))) AS h FROM documents),
lists AS (SELECT doc_id, bytes, list_transform(range(bytes), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS l FROM raw),
docs AS (SELECT doc_id, bytes + 1 AS size, xor(4294967295, list_reduce(list_prepend(4294967295, l),
 lambda a, x: xor(a // 256, tab[(xor(a, x) & 255) + 1]))) AS text_crc32 FROM lists, crc),
placed AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS id, count(*) OVER () AS n FROM docs),
grid AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT max(n) AS n, ceil(sqrt(max(n)))::BIGINT AS a FROM placed)),
walk(id, steps, a, b, n, v) AS (SELECT id, 0::BIGINT, a, b, g.n, id FROM placed, grid g UNION ALL {step}),
ended AS (SELECT id, v FROM walk WHERE steps > 0 AND v < n)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (v % {shards})::INT AS shard,
 (v // {shards})::BIGINT AS slot, NULL::INT AS grown_shard FROM placed JOIN ended USING (id)"""


def url_sql(rules: list[tuple[str, str, str]]) -> str:
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    after = "CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE '' END"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH rest AS (SELECT page_id, url, {after} AS r FROM (SELECT page_id, url, coalesce(url, '') AS u FROM pages)),
cut AS (SELECT page_id, url, translate(regexp_extract(r, '(?s)\\A([^/?#]*)', 1), '{upper}', '{upper.lower()}') AS host,
 regexp_extract(r, '(?s)\\A[^/?#]*([^?#]*)', 1) AS path, regexp_extract(r, '(?s)\\A[^?#]*\\?([^#]*)', 1) AS query FROM rest),
canon AS (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda f: f <> '' AND
 NOT regexp_matches(f, '\\A(utm_[a-z]+|ref|fbclid|gclid)(=|\\z)'))) AS fields FROM cut),
named AS (SELECT *, CASE WHEN regexp_replace(host, '\\Awww\\.', '') <> '' THEN regexp_replace(host, '\\Awww\\.', '')
 || regexp_replace(path, '/\\z', '') || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END END AS canonical FROM canon),
toxic AS (SELECT DISTINCT canonical AS c FROM named WHERE canonical IS NOT NULL AND
 try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) IN (SELECT doc_id FROM labels WHERE toxic = 1)),
rules(v, h, p) AS (VALUES {listed}),
hits AS (SELECT DISTINCT host, path, arg_max(h || p, len(h || p)) AS rule, arg_max(v, len(h || p)) AS verdict
 FROM (SELECT DISTINCT host, path FROM named) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, n.host, n.path, t.rule, coalesce(t.verdict, CASE WHEN canonical IN (SELECT c FROM toxic) THEN 'block' ELSE 'allow' END) AS verdict,
 canonical FROM named n LEFT JOIN hits t ON n.host = t.host AND n.path = t.path"""


def near_duplicate_sql(words: int, percent: int) -> str:
    """Sets of word runs, links by counted overlaps, components by walking links from each document down."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(l) >= {words} THEN list_transform(range(len(l) - {words - 1}), lambda i: array_to_string(l[i + 1:i + {words}], ' '))
 WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS l FROM w),
flat AS (SELECT doc_id, unnest(l) AS g FROM s),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= {percent} * (len(p.l) + len(q.l) - n)),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(d, r) AS (SELECT doc_id, doc_id FROM s UNION SELECT d, b FROM reach JOIN sym ON r = a)
SELECT d AS doc_id, any_value(len(l))::BIGINT AS n_shingles, min(r) AS component_id, d = min(r) AS kept FROM reach JOIN s ON s.doc_id = d GROUP BY d"""


def repeats_sql(width: int) -> str:
    """Every window as hex, counted; starts of repeated windows joined to runs; the rest hashed."""
    return f"""
WITH raw AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, n, h, unnest(range(n - {width - 1})) AS s FROM raw WHERE n >= {width}),
windows AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, {2 * width})) AS w FROM starts),
hot AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY w) AS c FROM windows) WHERE c > 1),
runs AS (SELECT doc_id, min(s) AS lo, max(s) + {width} AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM
 (SELECT *, coalesce((s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {width})::INT, 1) AS new FROM hot)) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, count(*) AS spans, sum(hi - lo) AS removed, list_sort(list_concat([0], list_concat(list(lo), list(hi)))) AS e FROM runs GROUP BY doc_id),
edges AS (SELECT r.doc_id, n, h, coalesce(spans, 0) AS spans, coalesce(removed, 0) AS removed, list_append(coalesce(e, [0]), n) AS e FROM raw r LEFT JOIN gaps USING (doc_id))
SELECT doc_id, n::BIGINT AS n_bytes, removed::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(array_to_string(list_transform(range(spans + 1),
 lambda i: substr(h, 2 * e[2 * i + 1] + 1, 2 * (e[2 * i + 2] - e[2 * i + 1]))), ''))) AS kept_sha256 FROM edges"""


def search_sql(k: int) -> str:
    """Terms of items and documents counted and joined, contributions in whole numbers, the best of each item."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS l FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, {terms} AS l FROM benchmark),
q AS (SELECT item, item_id, t, count(*) AS times FROM (SELECT item, item_id, unnest(l) AS t FROM i) GROUP BY ALL),
whole AS (SELECT count(*)::BIGINT AS nn, sum(len(l))::BIGINT AS ll FROM d WHERE len(l) > 0),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(l) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t), whole),
m AS (SELECT r, doc_id, (100 - 75 + (75 * len(l)::BIGINT * nn) // ll)::BIGINT AS m FROM d, whole),
s AS (SELECT item, item_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
 FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY item, item_id, r HAVING score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s JOIN m USING (r)) WHERE rank <= {k}"""


def conversation_sql() -> str:
    """Damage, faults, and for each row the least "cost, audit" string of the four states of the roles."""
    blank = "'[^\\x20\\x09-\\x0D]'"
    add = lambda v, cost, edit: f"(lpad((substr({v}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({v}, 10) || '{edit}')"
    none, insert = "'800000000'", lambda v: add(v, 3, "I")
    close = lambda inner: f"""SELECT *, least(x3, {insert('w2')}) AS w3 FROM (SELECT *, x0 AS w0, x1 AS w1,
 least(x2, {insert('x0')}, {insert('x1')}, {insert('x3')}) AS w2 FROM ({inner}))"""  # noqa: E731
    delete = lambda q: add(f"w{q}", 4, "D")
    keep = lambda q, initial: f"CASE WHEN initial = '{initial}' THEN {add(f'w{q}', 'more', 'K')} ELSE {none} END"
    rerole = lambda q: add(f"w{q}", "(more + 3)", "R")
    only = lambda q, *ways: f"CASE WHEN must THEN {delete(q)} ELSE least({', '.join([delete(q), *ways])}) END AS x{q}"
    steps = ", ".join([
        f"{delete(0)} AS x0",
        only(1, keep(0, "s")),
        only(2, *[way for q in (0, 1, 3) for way in (keep(q, "u"), rerole(q))]),
        only(3, keep(2, "a"), rerole(2)),
    ])
    columns = "conv_id, n, w0, w1, w2, w3"
    return f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
 hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations),
hurt AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
 lambda a, x: xor(a // 256, tab[(xor(a, x) & 255) + 1]))) % 20 AS c FROM raw, crc),
after AS (SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
 CASE WHEN c = 1 THEN '' WHEN c = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
 FROM (SELECT *, unnest(range(CASE c WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM hurt)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, left(role, 1) AS initial FROM after),
judged AS (SELECT *, NOT regexp_matches(text, {blank}) AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
 NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM placed),
faults AS (SELECT *, blank OR again AS must, CASE WHEN cut AND NOT blank AND NOT again THEN 3 ELSE 0 END AS more FROM judged),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
 count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (more > 0) AS truncated,
 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM faults GROUP BY conv_id),
dp({columns}) AS (SELECT conv_id, 0::BIGINT, w0, w1, w2, w3 FROM ({close(f"SELECT conv_id, '000000000' AS x0, {none} AS x1, {none} AS x2, {none} AS x3 FROM facts")})
 UNION ALL SELECT conv_id, n, w0, w1, w2, w3 FROM ({close(f"SELECT f.conv_id, f.n, {steps} FROM dp JOIN faults f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.n = dp.n + 1")})),
best AS (SELECT d.conv_id, substr(least(w0, w3), 1, 9)::BIGINT AS cost, substr(least(w0, w3), 10) AS audit
 FROM dp d JOIN facts f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.n = d.n),
edits AS (SELECT conv_id, p, substr(audit, p, 1) AS e FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM best)),
counted AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS n, count(*) FILTER (e <> 'D') OVER w AS f FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
turns AS (SELECT c.conv_id, p, e, f, role, text, initial, max((f = 1 AND e = 'K' AND initial = 's')::INT) OVER (PARTITION BY c.conv_id) AS shift
 FROM counted c LEFT JOIN faults t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.n = c.n AND e <> 'I' WHERE e <> 'D'),
lines AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (f - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS said FROM turns GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
 coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
 sha256(coalesce(said, '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) a
 LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id
 LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM a.conv_id"""
