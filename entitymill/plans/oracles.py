"""DuckDB text of the queries, put together from named common parts."""

from __future__ import annotations

from ..operators.validate import INJECTION_PATTERNS

PARTS = {
    "raw": (
        "",
        r"""SELECT o_orderkey AS seq, CAST(o_orderkey % 3 AS VARCHAR) AS source_file,
 CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN '0' || CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey + 1000 AS VARCHAR) END AS id_raw,
 CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' Customer ' || CAST(o_custkey AS VARCHAR) || ' ' END AS name_raw,
 CASE WHEN o_orderkey % 7 = 0 THEN '12' WHEN o_orderkey % 4 = 0 THEN '' ELSE '+1 (555) ' || lpad(CAST((o_custkey + o_orderkey % 2) % 100 AS VARCHAR), 3, '0') || '-' || lpad(CAST(o_custkey % 50 AS VARCHAR), 4, '0') END AS alias_a_raw,
 CASE WHEN o_orderkey % 9 = 0 THEN 'x!' WHEN o_orderkey % 3 = 0 THEN '' ELSE '@User_' || CAST(o_custkey AS VARCHAR) END AS alias_b_raw,
 '{"st":"' || o_orderstatus || '","pr":"' || o_orderpriority || '"}' AS extras_raw FROM orders""",
    ),
    "checked": (
        "raw",
        r"""SELECT seq, source_file, id_raw, trim(id_raw) AS id, trim(name_raw) AS name,
 CASE WHEN regexp_full_match(regexp_replace(alias_a_raw, '[\s()-]', '', 'g'), '\+?[0-9]{7,15}') THEN regexp_replace(alias_a_raw, '[\s()-]', '', 'g') ELSE '' END AS alias_a,
 CASE WHEN regexp_full_match(lower(ltrim(trim(alias_b_raw), '@')), '[a-z_][a-z0-9_]{2,63}') THEN lower(ltrim(trim(alias_b_raw), '@'))
      WHEN regexp_full_match(regexp_replace(lower(alias_b_raw), '[^a-z0-9_]', '', 'g'), '[a-z_][a-z0-9_]{2,63}') THEN regexp_replace(lower(alias_b_raw), '[^a-z0-9_]', '', 'g') ELSE '' END AS alias_b,
 CASE WHEN trim(extras_raw) = '' THEN '{}' ELSE trim(extras_raw) END AS extras,
 CASE WHEN trim(id_raw) = '' THEN 'missing id' WHEN NOT regexp_full_match(trim(id_raw), '0|[1-9][0-9]{0,31}') THEN 'invalid id' END AS reason FROM raw""",
    ),
    "acc": ("checked", "SELECT * FROM checked WHERE reason IS NULL"),
    "merged": (
        "acc",
        """SELECT id, coalesce(arg_max(name, seq) FILTER (WHERE name <> ''), '') AS name, coalesce(arg_max(alias_a, seq) FILTER (WHERE alias_a <> ''), '') AS alias_a,
 coalesce(arg_max(alias_b, seq) FILTER (WHERE alias_b <> ''), '') AS alias_b, count(*) AS n_rows FROM acc GROUP BY id""",
    ),
    "carried": (
        "acc",
        """SELECT id, seq, kind, last_value(nullif(v, '') IGNORE NULLS) OVER (PARTITION BY kind, id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS alias
 FROM (SELECT id, seq, 'alias_a' AS kind, alias_a AS v FROM acc UNION ALL SELECT id, seq, 'alias_b', alias_b FROM acc)""",
    ),
    "finals": ("carried", "SELECT kind, id, arg_max(alias, seq) AS final FROM carried WHERE alias IS NOT NULL GROUP BY kind, id"),
    "aliases": (
        "finals",
        """SELECT c.kind, c.alias, c.id, c.alias = f.final AS is_current FROM (SELECT kind, alias, arg_max(id, seq) AS id FROM carried WHERE alias IS NOT NULL GROUP BY kind, alias) c
 JOIN finals f ON f.kind = c.kind AND f.id = c.id""",
    ),
    "idx": ("merged aliases", "SELECT 'id' AS kind, id AS key, id FROM merged UNION ALL SELECT kind, alias, id FROM aliases"),
    "ev0": ("", "SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    "ev": (
        "ev0",
        """SELECT event_id, user_id, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%d') AS day, event_type, value AS latency_ms, k,
 CASE WHEN event_type = 'signup' THEN 'credit' WHEN event_type = 'purchase' THEN 'debit' END AS ledger_type,
 CAST(CASE WHEN event_type = 'signup' THEN 5 WHEN event_type = 'purchase' THEN 1 + k % 4 END AS BIGINT) AS amount,
 CASE WHEN k % 17 = 0 THEN 'a!' WHEN k % 3 = 0 THEN CAST(900 + 2 * k AS VARCHAR) WHEN k % 3 = 1 THEN '+1 (555) ' || lpad(CAST(k % 100 AS VARCHAR), 3, '0') || '-' || lpad(CAST(k % 50 AS VARCHAR), 4, '0')
      ELSE '@User_' || CAST(k AS VARCHAR) END AS probe FROM ev0""",
    ),
    "led": ("ev", "SELECT *, CASE WHEN ledger_type = 'credit' THEN amount ELSE -amount END AS signed FROM ev WHERE ledger_type IS NOT NULL AND amount > 0"),
    "routed0": (
        "ev",
        r"""SELECT *, CASE WHEN regexp_full_match(probe, '[0-9]+') THEN 'id' WHEN probe LIKE '+%' OR regexp_full_match(regexp_replace(probe, '[\s()+-]', '', 'g'), '[0-9]{7,}') THEN 'alias_a' ELSE 'alias_b' END AS kind FROM ev""",
    ),
    "routed": (
        "routed0",
        r"""SELECT *, CASE WHEN kind = 'id' AND regexp_full_match(probe, '0|[1-9][0-9]{0,31}') THEN probe
 WHEN kind = 'alias_a' AND regexp_full_match(regexp_replace(probe, '[\s()-]', '', 'g'), '\+?[0-9]{7,15}') THEN regexp_replace(probe, '[\s()-]', '', 'g')
 WHEN kind = 'alias_b' AND regexp_full_match(lower(ltrim(probe, '@')), '[a-z_][a-z0-9_]{2,63}') THEN lower(ltrim(probe, '@')) END AS key FROM routed0""",
    ),
    "looked": (
        "routed idx",
        "SELECT r.*, i.id, CASE WHEN r.key IS NULL THEN 'invalid' WHEN i.id IS NULL THEN 'miss' ELSE 'hit' END AS outcome FROM routed r LEFT JOIN idx i ON i.kind = r.kind AND i.key = r.key",
    ),
    "cleared": ("ev", "SELECT user_id, min(us) AS cleared_us FROM ev WHERE user_id % 4 = 0 GROUP BY user_id"),
    "gate": (
        "looked",
        "SELECT *, CASE WHEN user_id IS NULL OR user_id <= 0 THEN 'unauthorized' WHEN user_id = 1 THEN 'owner' WHEN user_id % 5 = 0 THEN 'deny' ELSE 'allow' END AS decision FROM looked",
    ),
}


def sql(parts: str, body: str) -> str:
    """``body`` after the definitions of the parts that it and they name."""
    need: list[str] = []

    def add(name: str) -> None:
        for n in PARTS[name][0].split():
            add(n)
        if name not in need:
            need.append(name)

    for name in parts.split():
        add(name)
    head = ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in need)
    return f"WITH {head}\n{body}" if need else body


CLEAN_A = r"regexp_replace(alias_a_raw, '[\s()-]', '', 'g')"
DIGITS = r"regexp_replace(regexp_replace(trim(alias_a_raw), '^\+', ''), '[-(). ]', '', 'g')"
REASON_TEXT = r"""CASE WHEN text IS NULL THEN 'is empty' WHEN strlen(text) > 4096 THEN 'exceeds size' WHEN trim(text) = '' THEN 'is empty' WHEN regexp_matches(regexp_replace(trim(text), '[\n\t\r]', '', 'g'), '\p{Cc}') THEN 'control characters' ELSE '' END"""

ORACLES = {
    "rejects_sink": sql("checked", "SELECT source_file, seq AS line_no, reason, id_raw AS raw FROM checked WHERE reason IS NOT NULL"),
    "reject_reasons": sql("checked", "SELECT reason, count(*) AS n FROM checked WHERE reason IS NOT NULL GROUP BY reason"),
    "id_filter": sql("checked", "SELECT seq, id, reason IS NULL AS valid FROM checked"),
    "alias_a_clean": sql("raw", rf"SELECT seq, CASE WHEN regexp_full_match({CLEAN_A}, '\+?[0-9]{{7,15}}') THEN {CLEAN_A} ELSE '' END AS alias_a, NOT regexp_full_match({CLEAN_A}, '\+?[0-9]{{7,15}}') AND alias_a_raw <> '' AS cleared FROM raw"),
    "alias_a_canonical": sql("raw", f"SELECT seq, CASE WHEN regexp_full_match({DIGITS}, '[0-9]{{7,15}}') THEN {DIGITS} ELSE '' END AS alias_a, CASE WHEN alias_a_raw = '' THEN 'required' WHEN NOT regexp_full_match({DIGITS}, '[0-9]{{7,15}}') THEN 'invalid' ELSE '' END AS reason FROM raw"),
    "alias_b_clean": sql("checked", "SELECT seq, alias_b, CASE WHEN length(alias_b) <= 32 THEN alias_b ELSE '' END AS strict FROM checked"),
    "validate_records": sql("checked", "SELECT seq, source_file, id, name, alias_a, alias_b, extras, coalesce(reason, '') AS reason FROM checked"),
    "name_combine": "SELECT c_custkey, concat_ws(' ', CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE trim(c_name) END, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE trim(n_name) END) AS full_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "extras_pack": """SELECT o_orderkey, '{"date":"' || strftime(o_orderdate, '%Y-%m-%d') || '","priority":"' || o_orderpriority || '"' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',"status":"' || o_orderstatus || '"' END || '}' AS extras FROM orders""",
    "record_unpack": """SELECT c_custkey, c_name AS alias_a, c_mktsegment AS alias_b, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS name, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '{"a":1}' END AS extras FROM customer""",
    "query_route": sql("routed0", "SELECT event_id, kind FROM routed0"),
    "probe_validate": sql("routed", "SELECT event_id, kind, coalesce(key, '') AS key, key IS NULL AS invalid FROM routed"),
    "text_sanitize": rf"""WITH t AS (SELECT 'documents' AS source, doc_id AS id, text FROM documents UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations),
r AS (SELECT *, {REASON_TEXT} AS reason FROM t)
SELECT source, id, CASE WHEN reason = '' THEN trim(regexp_replace(regexp_replace(regexp_replace(trim(text), '[\n\t\r]', ' ', 'g'), '\p{{Cf}}', '', 'g'), '\s+', ' ', 'g')) ELSE '' END AS clean, reason FROM r""",
    "injection_scan": "WITH t AS (SELECT text FROM documents UNION ALL SELECT html FROM pages) " + " UNION ALL ".join("SELECT CAST({} AS BIGINT) AS pattern, count(*) AS matches FROM t WHERE regexp_matches(text, '{}')".format(i, p.replace("'", "''")) for i, p in enumerate(INJECTION_PATTERNS)),
    "key_quality": r"""WITH k AS (SELECT c_name AS key FROM customer UNION ALL SELECT url FROM pages)
SELECT CASE WHEN coalesce(key, '') = '' THEN 'empty' WHEN strlen(key) > 511 THEN 'too long' WHEN regexp_matches(key, '\p{Cc}') THEN 'control characters' ELSE 'ok' END AS reason, count(*) AS n FROM k GROUP BY 1""",
    "path_hygiene": r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path FROM pages),
q AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '/en/../' || path WHEN page_id % 7 = 0 THEN '' ELSE path END AS path FROM p)
SELECT page_id, CASE WHEN path = '' THEN 'empty' WHEN list_contains(string_split(path, '/'), '..') THEN 'parent segment' WHEN NOT (path LIKE '/en/%' OR path LIKE '/de/%') THEN 'outside roots' ELSE '' END AS reason FROM q""",
    "constraint_check": sql(
        "ev",
        """SELECT 'amount_not_negative' AS rule, count(*) FILTER (WHERE NOT amount >= 0) AS violations FROM ev UNION ALL SELECT 'amount_at_most_3', count(*) FILTER (WHERE NOT amount <= 3) FROM ev
UNION ALL SELECT 'type_known', count(*) FILTER (WHERE NOT ledger_type IN ('credit', 'debit')) FROM ev UNION ALL SELECT 'latency_at_most_90', count(*) FILTER (WHERE NOT latency_ms <= 90) FROM ev
UNION ALL SELECT 'user_positive', count(*) FILTER (WHERE NOT user_id > 0) FROM ev""",
    ),
    "value_range_check": """SELECT 'size_1_40' AS rule, count(*) FILTER (WHERE NOT p_size BETWEEN 1 AND 40) AS violations FROM part UNION ALL SELECT 'price_1_1000000', count(*) FILTER (WHERE NOT p_retailprice BETWEEN 1 AND 1000000) FROM part
UNION ALL SELECT 'balance_not_negative', count(*) FILTER (WHERE NOT s_acctbal >= 0) FROM supplier UNION ALL SELECT 'distinct_names', count(*) FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)""",
    "key_lookup": "SELECT o_orderkey, o_custkey, coalesce(c_name, '') AS c_name, c_custkey IS NOT NULL AS found FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 <> 0",
    "alias_lookup": sql("ev aliases merged", rf"""SELECT e.event_id, e.alias, coalesce(a.id, '') AS id, coalesce(m.name, '') AS name, m.id IS NOT NULL AS found
FROM (SELECT event_id, {CLEAN_A.replace('alias_a_raw', 'probe')} AS alias FROM ev WHERE regexp_full_match({CLEAN_A.replace('alias_a_raw', 'probe')}, '\+?[0-9]{{7,15}}')) e
LEFT JOIN aliases a ON a.kind = 'alias_a' AND a.alias = e.alias LEFT JOIN merged m ON m.id = a.id"""),
    "routed_lookup": sql("looked", "SELECT event_id, kind, coalesce(key, '') AS key, coalesce(id, '') AS id, outcome FROM looked"),
    "new_vs_existing": sql("acc", "SELECT seq, id, id IN (SELECT id FROM acc WHERE source_file = '0') AS existing FROM acc WHERE source_file <> '0'"),
    "access_gate": sql("gate", "SELECT event_id, user_id, decision FROM gate"),
    "orphan_check": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 4 <> 0)",
    "cascade_delete": "SELECT 'orders' AS child, count(*) AS kept FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0))",
    "batch_delete": "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)",
    "first_wins_dedup": sql("acc", "SELECT id, seq, name, alias_a, alias_b FROM acc QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1"),
    "upsert_merge": sql("merged acc", """, x AS (SELECT id, seq, 'st' AS key, json_extract_string(extras, '$.st') AS v FROM acc UNION ALL SELECT id, seq, 'pr', json_extract_string(extras, '$.pr') FROM acc),
e AS (SELECT id, key, list_reduce(list('"' || v || '"' ORDER BY seq), lambda a, b: CASE WHEN a = b THEN b ELSE '[' || a || ',' || b || ']' END) AS v FROM x GROUP BY id, key)
SELECT merged.*, (SELECT '{' || string_agg('"' || key || '":' || v, ',' ORDER BY key) || '}' FROM e WHERE e.id = merged.id) AS extras FROM merged""").replace("\n, x", ", x"),
    "json_deep_merge": sql("acc", """, x AS (SELECT id, seq, 'st' AS key, '"' || json_extract_string(extras, '$.st') || '"' AS v FROM acc UNION ALL SELECT id, seq, 'pr', '"' || json_extract_string(extras, '$.pr') || '"' FROM acc)
SELECT id, key, list_reduce(list(v ORDER BY seq), lambda a, b: CASE WHEN a = b THEN b ELSE '[' || a || ',' || b || ']' END) AS merged FROM x GROUP BY id, key""").replace("\n, x", ", x"),
    "alias_index": sql("aliases", "SELECT * FROM aliases"),
    "batch_put": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' new' ELSE p_name END AS p_name, p_retailprice FROM part",
    "profile_upsert": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'New ' || c_name ELSE c_name END AS c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE 0.0 END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
    "keyed_update": """SELECT s_suppkey AS key, coalesce(p_retailprice, s_acctbal) AS balance, CASE WHEN p_partkey IS NULL THEN 'unchanged' ELSE 'updated' END AS status FROM supplier LEFT JOIN part ON p_partkey = s_suppkey AND p_partkey % 7 = 0
UNION ALL SELECT p_partkey, p_retailprice, 'not_found' FROM part WHERE p_partkey % 7 = 0 AND p_partkey NOT IN (SELECT s_suppkey FROM supplier)""",
    "insert_if_absent": "SELECT c_custkey AS user_id, c_acctbal AS points, false AS created FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT DISTINCT user_id, 0.0, true FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)",
    "ledger_append": sql("led", "SELECT row_number() OVER (ORDER BY event_id) AS id, event_id, user_id, amount, ledger_type AS type FROM led"),
    "index_tables": sql("idx", "SELECT kind, key, id FROM idx"),
    "ingest_stats": sql(
        "checked carried",
        """, n AS (SELECT seq, row_number() OVER (PARTITION BY id ORDER BY seq) AS nth FROM acc), w AS (SELECT seq, count(alias) AS writes FROM carried GROUP BY seq),
f AS (SELECT c.source_file, c.reason IS NULL AS ok, coalesce(n.nth = 1, false) AS ins, coalesce(w.writes, 0) AS writes, CAST(alias_a <> '' AS INT) + CAST(alias_b <> '' AS INT) AS own, extras NOT IN ('', '{}') AS x FROM checked c LEFT JOIN n ON n.seq = c.seq LEFT JOIN w ON w.seq = c.seq)
SELECT 'update' AS mode, coalesce(source_file, 'total') AS source_file, count(*) AS read, count(*) AS parsed, count(*) FILTER (WHERE NOT ok) AS invalid, count(*) FILTER (WHERE ins) AS inserts, count(*) FILTER (WHERE ok AND NOT ins) AS updates, 0::BIGINT AS duplicates,
  CAST(sum(writes) AS BIGINT) AS alias_writes, count(*) FILTER (WHERE ok AND x) AS extras_retained FROM f GROUP BY ROLLUP (source_file)
UNION ALL SELECT 'skip', coalesce(source_file, 'total'), count(*), count(*), count(*) FILTER (WHERE NOT ok), count(*) FILTER (WHERE ins), 0, count(*) FILTER (WHERE ok AND NOT ins), CAST(coalesce(sum(own) FILTER (WHERE ins), 0) AS BIGINT), count(*) FILTER (WHERE ins AND x) FROM f GROUP BY ROLLUP (source_file)""",
    ).replace("\n, n", ", n"),
    "convert_stats": sql("checked", """, f AS (SELECT c.source_file, count(*) AS input_rows, count(*) FILTER (WHERE reason IS NULL) AS output_rows, count(*) FILTER (WHERE reason IS NOT NULL) AS skipped_rows,
  CAST(sum(strlen(r.id_raw) + strlen(name_raw) + strlen(alias_a_raw) + strlen(alias_b_raw) + strlen(extras_raw) + 5) AS BIGINT) AS bytes, any_value(1.0::DOUBLE + CAST(c.source_file AS INT) * 0.25::DOUBLE) AS seconds FROM checked c JOIN raw r ON r.seq = c.seq GROUP BY c.source_file),
w AS (SELECT *, sum(bytes) OVER (ORDER BY source_file) AS done, sum(seconds) OVER (ORDER BY source_file) AS spent, sum(bytes) OVER () AS total FROM f)
SELECT source_file, input_rows, output_rows, skipped_rows, bytes, round(input_rows / seconds, 3) AS rows_per_second, round(100.0::DOUBLE * done / total, 4) AS percent, round(CASE WHEN done < total THEN (total - done) / (done / spent) ELSE 0 END, 4) AS seconds_left FROM w""").replace("\n, f", ", f"),
    "usage_stats": sql(
        "looked",
        """SELECT count(*) AS total, count(*) FILTER (WHERE day = (SELECT max(day) FROM ev)) AS today, count(*) FILTER (WHERE outcome = 'hit') AS success, count(*) FILTER (WHERE outcome <> 'hit') AS failed, CAST(floor(avg(latency_ms)) AS BIGINT) AS avg_latency,
count(*) FILTER (WHERE outcome = 'hit') AS points_spent, count(DISTINCT user_id) AS registered, count(DISTINCT CASE WHEN user_id % 5 = 0 THEN user_id END) AS banned FROM looked WHERE outcome <> 'invalid'""",
    ),
    "ops_metrics": sql("looked acc", """, m AS (SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'hit') AS successful, count(*) FILTER (WHERE outcome <> 'hit') AS failed, count(*) FILTER (WHERE day = (SELECT max(day) FROM ev)) AS today, count(DISTINCT user_id) AS users,
  round(avg(latency_ms) FILTER (WHERE latency_ms >= 0), 4) AS avg_latency, max(latency_ms) FILTER (WHERE latency_ms >= 0) AS peak_latency, count(*) FILTER (WHERE outcome = 'hit') AS hits, count(*) FILTER (WHERE outcome = 'miss') AS misses,
  round(count(*) FILTER (WHERE outcome = 'hit') / count(*) FILTER (WHERE outcome <> 'invalid'), 6) AS hit_rate, CAST(sum(amount) FILTER (WHERE amount > 0) AS BIGINT) AS point_usage, round((SELECT count(*) FROM acc) / 10.0::DOUBLE, 3) AS rows_per_second FROM looked)
SELECT m.*, CAST(to_json(m) AS VARCHAR) AS export FROM m""").replace("\n, m", ", m"),
    "daily_usage": sql("ev", "SELECT day, count(*) AS n, count(DISTINCT user_id) AS users FROM ev GROUP BY day"),
    "index_counts": sql("merged aliases", "SELECT 'records' AS name, count(*) AS entries FROM merged UNION ALL SELECT 'alias_a', count(*) FROM aliases WHERE kind = 'alias_a' UNION ALL SELECT 'alias_b', count(*) FROM aliases WHERE kind = 'alias_b'"),
    "balances": sql("led", "SELECT u.user_id, CAST(coalesce(sum(signed), 0) AS BIGINT) AS balance, coalesce(sum(signed), 0) >= 3 AS can_afford FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN led ON led.user_id = u.user_id GROUP BY u.user_id"),
    "known_users": "SELECT DISTINCT user_id FROM events",
    "history_count": sql("ev cleared", "SELECT ev.user_id, count(*) AS visible FROM ev LEFT JOIN cleared c ON c.user_id = ev.user_id WHERE c.cleared_us IS NULL OR ev.us > c.cleared_us GROUP BY ev.user_id"),
    "rate_limit": sql(
        "ev",
        """, l AS (SELECT user_id, list({'t': us, 'e': event_id} ORDER BY us, event_id) AS l FROM ev GROUP BY user_id),
a AS (SELECT user_id, list_reduce(l, lambda acc, x: CASE WHEN user_id = 1 OR len(acc) < 5 OR acc[len(acc) - 4].t <= x.t - 86400000000 THEN list_append(acc, x) ELSE acc END, []::STRUCT(t BIGINT, e BIGINT)[]) AS ok FROM l),
k AS (SELECT unnest(ok).e AS event_id FROM a)
SELECT ev.event_id, ev.user_id, k.event_id IS NOT NULL AND ev.user_id > 0 AS allowed FROM ev LEFT JOIN k ON k.event_id = ev.event_id""",
    ).replace("\n, l", ", l"),
    "running_balance": sql("led", "SELECT event_id, user_id, signed, CAST(sum(signed) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM led"),
    "guarded_debits": sql(
        "led",
        """, l AS (SELECT user_id, list({'e': event_id, 's': signed, 'b': 0::BIGINT, 'ok': false} ORDER BY event_id) AS l FROM led GROUP BY user_id),
a AS (SELECT user_id, list_reduce(l, lambda acc, x: list_append(acc, CASE WHEN x.s > 0 OR coalesce(acc[len(acc)].b, 0) + x.s >= 0 THEN {'e': x.e, 's': x.s, 'b': coalesce(acc[len(acc)].b, 0) + x.s, 'ok': true} ELSE {'e': x.e, 's': x.s, 'b': coalesce(acc[len(acc)].b, 0), 'ok': false} END), []::STRUCT(e BIGINT, s BIGINT, b BIGINT, ok BOOLEAN)[]) AS r FROM l),
u AS (SELECT user_id, unnest(r) AS r FROM a)
SELECT r.e AS event_id, user_id, r.ok AS applied, r.b AS balance FROM u""",
    ).replace("\n, l", ", l"),
    "metered_lookup": sql(
        "gate",
        """, l AS (SELECT user_id, list({'e': event_id, 't': us, 'd': decision, 'o': outcome, 's': CASE WHEN ledger_type = 'credit' THEN amount WHEN ledger_type = 'debit' THEN -amount ELSE 0 END} ORDER BY us, event_id) AS l FROM gate GROUP BY user_id),
s AS (SELECT user_id, list_reduce(l, lambda acc, x: list_transform([CASE WHEN x.s > 0 OR (x.s < 0 AND acc.b + x.s >= 0) THEN 'ledger' WHEN x.s < 0 THEN 'refused' WHEN x.d IN ('deny', 'unauthorized') THEN 'denied'
    WHEN x.d = 'allow' AND len(acc.w) >= 5 AND acc.w[len(acc.w) - 4] > x.t - 86400000000 THEN 'limited' WHEN x.o = 'invalid' THEN 'invalid' WHEN acc.b < 1 THEN 'no_credit' ELSE x.o END], lambda st:
    {'b': CASE WHEN st = 'ledger' THEN acc.b + x.s WHEN st = 'hit' THEN acc.b - 1 ELSE acc.b END,
    'w': CASE WHEN x.s = 0 AND x.d = 'allow' AND st <> 'limited' THEN list_append(acc.w, x.t) ELSE acc.w END,
    'r': list_append(acc.r, {'e': x.e, 'st': st, 'b': CASE WHEN st = 'ledger' THEN acc.b + x.s WHEN st = 'hit' THEN acc.b - 1 ELSE acc.b END})})[1],
  {'b': 0::BIGINT, 'w': []::BIGINT[], 'r': []::STRUCT(e BIGINT, st VARCHAR, b BIGINT)[]}) AS f FROM l),
u AS (SELECT user_id, unnest(f.r) AS r FROM s)
SELECT r.e AS event_id, user_id, r.st AS status, CAST(r.st = 'hit' AS BIGINT) AS charge, CAST(r.st = 'hit' AS BIGINT) AS result_count, r.b AS balance FROM u""",
    ).replace("\n, l", ", l"),
    "recent_per_user": sql("ev cleared", """, r AS (SELECT user_id, event_id, us, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM ev)
SELECT r.user_id, r.event_id, r.rank FROM r LEFT JOIN cleared c ON c.user_id = r.user_id WHERE r.rank <= 10 AND (c.cleared_us IS NULL OR r.us > c.cleared_us)""").replace("\n, r", ", r"),
    "ordered_sample": "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name FROM customer ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 20",
    "range_seek": "SELECT p_partkey, p_name FROM part WHERE p_partkey >= 100 ORDER BY p_partkey LIMIT 20",
    "page_scan": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey DESC LIMIT 5 OFFSET 2",
    "multi_source_union": sql("acc", "SELECT CAST(CASE source_file WHEN '2' THEN 0 WHEN '0' THEN 1 ELSE 2 END AS BIGINT) AS rank, source_file, seq, id FROM acc"),
}

_ROLES = "CASE WHEN {0} IN ('id','uid','telegramid','userid') THEN 'id' WHEN {0} IN ('username','user','login','nick','nickname','nik') THEN 'username' WHEN {0} IN ('phone','mobile','telephone','number','tel') THEN 'phone' WHEN {0} IN ('lastname','surname','family','fname') THEN 'lastname' WHEN {0} IN ('name','firstname','first') THEN 'name' END"
_HEADERS = """WITH h AS (SELECT c_custkey AS file, [['Telegram_ID','First Name','last_name','Mobile','NickName','city'],['user-id','name','phone','username'],['id','phone','username'],['uid','id','tel','foo bar'],['12345','abc','def'],['alpha','12','34','56'],['ID','Name','Phone','Username','Extras'],['first','fname','login','number','user']][c_custkey % 8 + 1] AS fields FROM customer),
u AS (SELECT file, fields, unnest(fields) AS header, unnest(range(len(fields))) AS idx FROM h),
n AS (SELECT *, regexp_replace(lower(trim(header)), '[\\s_-]', '', 'g') AS norm FROM u),
r AS (SELECT *, """ + _ROLES.format("norm") + " AS r FROM n)\n"
#: An empty id is a reject. The converter drops one @ in front of a handle.
_DELIMITED = sql("raw", """SELECT CASE source_file WHEN '0' THEN 'semi.csv' WHEN '1' THEN 'tab.txt' ELSE 'pipe.txt' END AS file, id_raw AS id,
 CASE WHEN source_file = '0' THEN trim(name_raw) ELSE '' END AS name, CASE WHEN source_file = '2' THEN '' ELSE alias_a_raw END AS phone, CASE WHEN source_file = '2' THEN '' ELSE regexp_replace(alias_b_raw, '^@', '') END AS username,
 CASE WHEN source_file = '0' THEN '{}' WHEN source_file = '1' THEN CASE WHEN trim(name_raw) = '' THEN '{}' ELSE '{"foo":"' || trim(name_raw) || '"}' END
   ELSE '{' || array_to_string(list_filter([CASE WHEN trim(name_raw) <> '' THEN '"col_1":"' || trim(name_raw) || '"' END, CASE WHEN alias_a_raw <> '' THEN '"col_2":"' || alias_a_raw || '"' END, CASE WHEN alias_b_raw <> '' THEN '"col_3":"' || alias_b_raw || '"' END], lambda x: x IS NOT NULL), ',') || '}' END AS extras FROM raw
UNION ALL SELECT 'cp1251.csv', id_raw, trim('ИмяФамилия ГородМосква ' || trim(name_raw)), '', '', '{}' FROM raw WHERE source_file = '0'
UNION ALL SELECT 'utf16.csv', id_raw, trim('ИмяФамилия ГородМосква ' || trim(name_raw)), alias_a_raw, regexp_replace(alias_b_raw, '^@', ''), '{}' FROM raw WHERE source_file = '0'
UNION ALL SELECT 'latin1.csv', id_raw, trim('Éléonore ' || trim(name_raw)), alias_a_raw, regexp_replace(alias_b_raw, '^@', ''), '{}' FROM raw WHERE source_file = '1'""")

ORACLES |= {
    "header_role_map": _HEADERS + "SELECT file, CAST(idx AS INTEGER) AS idx, header, CASE WHEN r IS NOT NULL AND row_number() OVER (PARTITION BY file, r ORDER BY idx) = 1 THEN r ELSE 'extras' END AS role FROM r",
    "header_profile": _HEADERS + "SELECT file, count(r) > 0 OR (NOT regexp_full_match(arg_min(header, idx), '[0-9]+') AND count(*) FILTER (WHERE regexp_matches(header, '[A-Za-z]')) >= (count(*) + 1) // 2) AS has_header, CAST(count(*) AS INTEGER) AS n_fields FROM r GROUP BY file",
    "header_layout_map": _HEADERS
    + """, m AS (SELECT file, min(idx) FILTER (WHERE norm = 'id') AS i, min(idx) FILTER (WHERE norm = 'name') AS n, min(idx) FILTER (WHERE norm = 'phone') AS p, min(idx) FILTER (WHERE norm = 'username') AS u, min(idx) FILTER (WHERE norm = 'extras') AS e FROM r GROUP BY file),
f AS (SELECT *, i IS NOT NULL AND (p IS NOT NULL OR u IS NOT NULL) AS fits FROM m)
SELECT file, CAST(CASE WHEN fits THEN i ELSE 0 END AS INTEGER) AS id, CAST(CASE WHEN fits THEN coalesce(p, -1) ELSE 1 END AS INTEGER) AS phone, CAST(CASE WHEN fits THEN coalesce(u, -1) ELSE 2 END AS INTEGER) AS username,
 CAST(CASE WHEN fits THEN coalesce(n, -1) ELSE -1 END AS INTEGER) AS name, CAST(CASE WHEN fits THEN coalesce(e, -1) ELSE -1 END AS INTEGER) AS extras,
 CASE WHEN NOT fits THEN 'config' WHEN p IS NOT NULL AND u IS NOT NULL AND n IS NOT NULL AND e IS NOT NULL THEN 'header:standard' WHEN p IS NOT NULL AND u IS NOT NULL AND n IS NULL AND e IS NULL THEN 'header:legacy' ELSE 'header:partial' END AS mapping_source FROM f""",
    "format_probe": r"""WITH t AS (SELECT doc_id, ['jsonl','json','txt','csv','xml'][doc_id % 5 + 1] AS ext, CASE WHEN doc_id % 3 = 0 THEN chr(10) || ' {' || text ELSE text END AS t FROM documents)
SELECT doc_id, ext, CASE WHEN ext = 'jsonl' THEN true WHEN ext = 'xml' THEN false ELSE starts_with(regexp_replace(t, '^\s+', ''), '{') END AS jsonl FROM t""",
    "delimiter_profile": r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda v: NOT regexp_full_match(v, '\s*'))[1:20] AS lines FROM documents),
d AS (SELECT * FROM (VALUES (0, ','), (1, ';'), (2, '|'), (3, chr(9))) AS d(rank, d)),
c AS (SELECT doc_id, rank, d, unnest(list_transform(lines, lambda v: length(v) - length(replace(v, d, '')))) AS c, unnest(range(len(lines))) AS i FROM l, d),
w AS (SELECT *, count(*) OVER (PARTITION BY doc_id, rank, c ORDER BY i) AS freq FROM c),
s AS (SELECT doc_id, rank, d, CASE WHEN arg_max(c, freq * 1000 - i) = 0 THEN -1 ELSE max(freq) / count(*) * 10 + sum(c) / count(*) END AS score FROM w GROUP BY doc_id, rank, d)
SELECT l.doc_id, coalesce(x.d, ',') AS delimiter FROM l LEFT JOIN (SELECT doc_id, d FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) = 1) x ON x.doc_id = l.doc_id""",
    "jsonl_scan": "SELECT event_id, event_id % 10 <> 0 AS parsed, CASE WHEN event_id % 10 <> 0 THEN json_extract_string(props, '$.k') ELSE '' END AS k FROM events WHERE event_id % 10 <> 1",
    "jsonl_record_map": sql("ev", """SELECT event_id AS line_no, CAST(user_id AS VARCHAR) AS id, 'A ' || CAST(k AS VARCHAR) AS name, '' AS phone, CASE WHEN k % 2 = 0 THEN 'nick_' || CAST(k AS VARCHAR) ELSE '' END AS username,
CASE WHEN k % 2 = 0 THEN '{"city":"x"}' ELSE '{"city":"x","nick":"no!"}' END AS extras FROM ev WHERE event_id % 4 <> 3"""),
    "delimited_scan": f"SELECT * FROM ({_DELIMITED}) q WHERE id <> ''",
    "canonical_sink": f"SELECT replace(replace(file, '.csv', ''), '.txt', '') || '.standard.csv' AS file, id, name, phone, username, extras FROM ({_DELIMITED}) q WHERE id <> ''",
    "file_rejects": sql("raw", f"""SELECT file, reason, count(*) AS n, 0::BIGINT AS unplaced, true AS unique FROM (
 SELECT file, 'missing id' AS reason FROM ({_DELIMITED}) WHERE id = '' UNION ALL SELECT 'x.standard.csv', 'missing id' FROM raw WHERE source_file = '2' AND id_raw = ''
 UNION ALL SELECT 'recs.jsonl', 'no record' FROM raw WHERE source_file = '0' AND NOT regexp_full_match(id_raw, '0|[1-9][0-9]{{0,31}}')) GROUP BY file, reason"""),
    "transcode_scan": sql("raw", """SELECT * FROM (SELECT 'semi.csv' AS file, concat_ws(';', id_raw, trim(name_raw), alias_a_raw, alias_b_raw) AS value FROM raw WHERE source_file = '0'
 UNION ALL SELECT 'tab.txt', concat_ws(chr(9), id_raw, trim(name_raw), alias_a_raw, alias_b_raw) FROM raw WHERE source_file = '1'
 UNION ALL SELECT 'pipe.txt', concat_ws('|', id_raw, trim(name_raw), alias_a_raw, alias_b_raw) FROM raw WHERE source_file = '2'
 UNION ALL SELECT 'cp1251.csv', concat_ws(',', trim('ИмяФамилия ГородМосква ' || trim(name_raw)), id_raw) FROM raw WHERE source_file = '0'
 UNION ALL SELECT 'utf16.csv', concat_ws(',', id_raw, trim('ИмяФамилия ГородМосква ' || trim(name_raw)), alias_a_raw, alias_b_raw) FROM raw WHERE source_file = '0'
 UNION ALL SELECT 'latin1.csv', concat_ws(',', id_raw, trim('Éléonore ' || trim(name_raw)), alias_a_raw, alias_b_raw) FROM raw WHERE source_file = '1'
 UNION ALL SELECT 'recs.jsonl', '{"telegram_id":"' || id_raw || '","name":"' || name_raw || '","nick":"' || alias_b_raw || '"}' FROM raw WHERE source_file = '0'
 UNION ALL SELECT 'x.standard.csv', array_to_string(list_transform([id_raw, trim(name_raw), alias_a_raw, alias_b_raw, '{}'], lambda v: CASE WHEN v = '' THEN '""' ELSE v END), ',') FROM raw WHERE source_file = '2')"""),
}

ORACLES |= {
    "incremental_ingest": sql("raw", "SELECT seq, source_file, id_raw FROM raw"),
    "resumed_ingest": sql("acc", "SELECT id, count(*) AS n_rows FROM acc GROUP BY id"),
    "stream_upsert": ORACLES["upsert_merge"],
    "stream_alias_index": ORACLES["alias_index"],
    "stream_counts": sql("checked acc", "SELECT count(*) AS read, count(*) FILTER (WHERE reason IS NULL) AS parsed, count(*) FILTER (WHERE reason IS NOT NULL) AS invalid, (SELECT count(DISTINCT id) FROM acc) AS inserts, (SELECT count(*) - count(DISTINCT id) FROM acc) AS updates FROM checked"),
    "stream_rate_limit": ORACLES["rate_limit"],
    "stream_progress_totals": sql("checked", "SELECT count(*) AS rows, count(*) AS done, count(*) FILTER (WHERE reason IS NULL) AS parsed, count(*) FILTER (WHERE reason IS NOT NULL) AS invalid, 100.0 AS percent, true AS every_batch, true AS timed FROM checked"),
    "stream_daily_usage": sql("ev", "SELECT day, count(*) AS n FROM ev GROUP BY day"),
    "lookup_stats": sql(
        "looked",
        """, keyed AS (SELECT event_id, us, coalesce('id:' || id, kind || ':' || key) AS entity, kind || ':' || key AS own, coalesce('id:' || id, '') AS id_key FROM looked WHERE outcome <> 'invalid'),
l AS (SELECT entity, list({'t': us, 'e': event_id, 'o': own, 'i': id_key} ORDER BY us, event_id) AS l FROM keyed GROUP BY entity),
a AS (SELECT entity, l, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda m: (m.o = x.o OR m.i = x.o) AND x.t <= m.t + 86400000000)) = 0 THEN list_append(acc, x) ELSE acc END,
  []::STRUCT(t BIGINT, e BIGINT, o VARCHAR, i VARCHAR)[]) AS opened FROM l),
m AS (SELECT unnest(opened).e AS event_id FROM a)
SELECT k.kind, count(*) AS queries, count(*) FILTER (WHERE outcome = 'hit') AS hits, count(*) FILTER (WHERE outcome = 'miss') AS misses, count(*) FILTER (WHERE outcome = 'invalid') AS invalid,
  count(*) FILTER (WHERE outcome <> 'invalid' AND m.event_id IS NULL) AS cache_hits, count(m.event_id) AS cache_misses, round(avg(latency_ms), 4) AS avg_latency
FROM looked k LEFT JOIN m ON m.event_id = k.event_id GROUP BY k.kind""",
    ).replace("\n, keyed", ", keyed"),
    "ttl_hits_all": sql(
        "looked",
        """, keyed AS (SELECT event_id, us, coalesce('id:' || id, kind || ':' || key) AS entity, kind || ':' || key AS own, coalesce('id:' || id, '') AS id_key FROM looked WHERE outcome <> 'invalid'),
l AS (SELECT entity, list({'t': us, 'e': event_id, 'o': own, 'i': id_key} ORDER BY us, event_id) AS l FROM keyed GROUP BY entity),
a AS (SELECT entity, l, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda m: (m.o = x.o OR m.i = x.o) AND x.t <= m.t + 86400000000)) = 0 THEN list_append(acc, x) ELSE acc END,
  []::STRUCT(t BIGINT, e BIGINT, o VARCHAR, i VARCHAR)[]) AS opened FROM l),
m AS (SELECT unnest(opened).e AS event_id FROM a)
SELECT k.event_id, k.own AS key, m.event_id IS NULL AS cache_hit FROM keyed k LEFT JOIN m ON m.event_id = k.event_id""",
    ).replace("\n, keyed", ", keyed"),
}

_NESTED = sql("merged acc", """, x AS (SELECT id, seq, 'st' AS key, '"' || json_extract_string(extras, '$.st') || '"' AS v FROM acc UNION ALL SELECT id, seq, 'pr', '"' || json_extract_string(extras, '$.pr') || '"' FROM acc
  UNION ALL SELECT id, seq, 'f', '"' || source_file || '"' FROM acc UNION ALL SELECT id, seq, 'q', CASE WHEN seq % 2 = 0 THEN 'null' ELSE source_file END FROM acc),
m AS (SELECT id, key, list_reduce(list(v ORDER BY seq), lambda a, b: CASE WHEN a = b THEN b ELSE '[' || a || ',' || b || ']' END) AS v FROM x GROUP BY id, key),
n AS (SELECT id, '{"a":{"n":{"pr":' || max(v) FILTER (WHERE key = 'pr') || ',"st":' || max(v) FILTER (WHERE key = 'st') || '},"q":' || max(v) FILTER (WHERE key = 'q') || ',"w":7.0},"f":' || max(v) FILTER (WHERE key = 'f') || ',"z":null}' AS merged FROM m GROUP BY id)
""").replace("\n, x", ", x")
ORACLES["json_nested_merge"] = _NESTED + "SELECT id, merged FROM n"
ORACLES["nested_upsert"] = _NESTED + "SELECT merged.*, n.merged AS extras FROM merged JOIN n ON n.id = merged.id"

#: What the files are, as the sample writer makes them.
ORACLES |= {
    "source_discovery": "SELECT * FROM (VALUES ('cp1251.csv', 'csv'), ('latin1.csv', 'csv'), ('pipe.txt', 'txt'), ('recs.jsonl', 'jsonl'), ('semi.csv', 'csv'), ('tab.txt', 'txt'), ('utf16.csv', 'csv')) t(file, extension)",
    "encoding_profile": "SELECT * FROM (VALUES ('cp1251.csv', 'windows-1251'), ('latin1.csv', 'iso-8859-1'), ('pipe.txt', 'utf-8'), ('recs.jsonl', 'utf-8'), ('semi.csv', 'utf-8'), ('tab.txt', 'utf-8'), ('utf16.csv', 'utf-16le'), ('x.standard.csv', 'utf-8')) t(file, encoding)",
    "schema_report": """SELECT * FROM (VALUES ('cp1251.csv', 'windows-1251', ',', true, false, 'name,id', 'name,id', ''),
 ('latin1.csv', 'iso-8859-1', ',', true, false, 'id,name,phone,username', 'id,name,phone,username', ''),
 ('pipe.txt', 'utf-8', '|', false, false, 'id,col_1,col_2,col_3', 'id,extras,extras,extras', 'col_1,col_2,col_3'),
 ('recs.jsonl', 'utf-8', ',', false, true, 'name,nick,telegram_id', 'name,username,id', ''),
 ('semi.csv', 'utf-8', ';', true, false, 'Telegram_ID,First Name,Mobile,NickName', 'id,name,phone,username', ''),
 ('tab.txt', 'utf-8', chr(9), true, false, 'id,foo,phone,username', 'id,extras,phone,username', 'foo'),
 ('utf16.csv', 'utf-16le', ',', true, false, 'id,name,phone,username', 'id,name,phone,username', ''),
 ('x.standard.csv', 'utf-8', ',', true, false, 'id,name,phone,username,extras', 'id,name,phone,username,extras', 'extras')) t(file, encoding, delimiter, has_header, jsonl, fields, roles, extras)""",
}

_OTHERS = sql("raw", """SELECT 'x.standard.csv' AS file, id_raw AS id, trim(name_raw) AS name, alias_a_raw AS phone, alias_b_raw AS username, '{}' AS extras FROM raw WHERE source_file = '2'
UNION ALL SELECT 'recs.jsonl', id_raw, CASE WHEN trim(name_raw) <> '' THEN trim(name_raw) ELSE alias_b_raw END, '',
 CASE WHEN alias_b_raw LIKE '@%' THEN lower(ltrim(alias_b_raw, '@')) ELSE '' END, CASE WHEN alias_b_raw LIKE '@%' THEN '{}' ELSE '{"nick":"' || alias_b_raw || '"}' END FROM raw WHERE source_file = '0'""")
ORACLES["convert_or_pass"] = f"SELECT * FROM (SELECT * FROM ({_DELIMITED}) UNION ALL SELECT * FROM ({_OTHERS})) WHERE regexp_full_match(id, '0|[1-9][0-9]{{0,31}}')"
ORACLES["ttl_hits"] = ORACLES["stream_ttl_hits"] = ORACLES["ttl_hits_all"]
ORACLES["record_lookup"] = sql("routed merged", "SELECT r.event_id, coalesce(r.key, '') AS key, coalesce(m.name, '') AS name, m.id IS NOT NULL AS found FROM routed r LEFT JOIN merged m ON m.id = r.key WHERE r.kind = 'id'")
ORACLES["record_seek"] = sql("merged", "SELECT id, name FROM merged WHERE id >= '11' ORDER BY id LIMIT 50")
