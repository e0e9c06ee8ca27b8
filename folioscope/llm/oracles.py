"""DuckDB SQL of the queries that SQL can express."""

_HOST = r"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"

_START = """kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT 16))"""


def _rounds(n: int) -> str:
    """For each round the distances a<i>, and the centroids c<i> made of them; a<n> is the last."""
    out = []
    for i in range(n + 1):
        away = "list_sum(list_transform(list_zip(k.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        out.append(f"""a{i} AS (SELECT vec_id, v, b.c AS c, b.d AS d FROM (SELECT vec_id, any_value(k.v) AS v, min({{'d': {away}, 'c': m.c}}) AS b FROM kept k CROSS JOIN c{i} m GROUP BY vec_id))""")
        if i < n:
            out.append(f"""p{i} AS (SELECT c, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY c, pos),
c{i + 1} AS (SELECT m.c, coalesce(p.v, m.v) AS v FROM c{i} m LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS v FROM p{i} GROUP BY c) p ON m.c = p.c)""")
    return ",\n".join(out)


SQL = {
    "op8_url_filter": rf"""
WITH u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
rules(rule, rhost, rpath, said) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'block'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(said,
  CASE WHEN len(list_intersect(string_split(host, '.'), ['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])) > 0
       THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit ON u.page_id = fit.page_id""",
    "op9_source_mix": r"""
WITH d AS (SELECT doc_id, source, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT AS at,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST([5, 2, 1][(n - 1) % 3 + 1] AS DOUBLE) AS w, 3 * source_size AS lim FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS lv
  FROM w WINDOW before AS (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(lim::DOUBLE, (max(lv) OVER ())::DOUBLE * w) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS repeats FROM t),
r AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.repeats, b.target - b.repeats * b.source_size AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS incl,
    sum(d.size) OVER (PARTITION BY d.source, d.at) AS same
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  (size * (repeats + CASE WHEN incl <= budget OR (incl - same < budget AND incl - budget <= budget - (incl - same)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r""",
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL),
i AS (SELECT unnest(range(5)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda x: chr((65 + x)::INT)), '') AS filter_order, s.i + 1 AS step, o[s.i + 1] AS f, (1 << o[s.i + 1]) AS bit,
    list_sum(list_transform([0] || o[:s.i], lambda x, k: CASE WHEN k = 1 THEN 0 ELSE 1 << x END))::BIGINT AS earlier FROM o, i s),
r AS (SELECT part, filter_order, step, f,
    sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r""",
    "op12_centroid_clusters": f"""
WITH {_START},
{_rounds(3)}
SELECT vec_id, a3.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a3.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON a3.c = c3.c""",
    "op13_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, '<\\*(?:/?s>|</?(?:SYS|ROLE)>>|<(?:IS|NEXT)>>)|\[\\*/?INST\]' AS marks, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t),
n AS (SELECT *, length(text) + len(regexp_extract_all(text, marks)) + CASE WHEN role = before THEN 8 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 7
    WHEN role = 'system' THEN 15 ELSE 23 + length(role) + len(regexp_extract_all(role, marks)) END AS chars FROM m)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id""",
}
