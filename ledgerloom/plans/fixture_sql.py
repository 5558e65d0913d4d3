"""The derived inputs of ``sources.fixtures`` in SQL, as common table expressions."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def with_ctes(sql: str) -> str:
    """Puts the CTEs that a query names, and those they name, in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    own = sql.strip()
    if not needed:
        return own
    head = "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed)
    if own[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head[5:]},\n{own[15:].lstrip()}"
    return f"{head},\n{own[4:].lstrip()}" if own[:5].upper() == "WITH " else f"{head}\n{own}"


cte("receiver_events", """
SELECT *, CASE WHEN day(ts) <= 10 THEN 'JRN9' WHEN day(ts) <= 20 THEN 'JRN2' ELSE 'JRN5' END AS receiver FROM events""")
cte("numbered_events", """
SELECT *, event_id - min(event_id) OVER (PARTITION BY receiver) + 1 AS sequence,
       lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM receiver_events""")
cte("operation_events", """
SELECT *, CASE WHEN nth = 1 OR previous = 'error' THEN 'c' WHEN event_type = 'error' THEN 'd'
               WHEN event_type = 'signup' AND event_id % 7 = 0 THEN 'u' ELSE 'u_after' END AS operation FROM numbered_events""")
cte("journal_events", """
SELECT sha256('ibmi|JRN|' || receiver || '|' || sequence) AS event_id, receiver, sequence, operation, ts AS commit_ts,
       ts + to_seconds(event_id % 300) + CASE WHEN event_id % 50 = 0 THEN INTERVAL 2 DAY ELSE INTERVAL 0 DAY END AS ingested_at,
       'raw/ORDERS/' || receiver || '/batch-' || lpad((sequence // 500)::VARCHAR, 5, '0') || '.jsonl' AS source_file, 0 AS attempt,
       CASE WHEN operation IN ('d', 'u') THEN user_id END AS before_key,
       CASE WHEN operation = 'u' THEN user_id + 100000 WHEN operation <> 'd' THEN user_id END AS after_key,
       CAST(round(value * 100) AS BIGINT) AS cents, event_type, event_id AS n FROM operation_events""")
cte("snapshot_events", """
SELECT sha256('ibmi|SNAPSHOT:ORDERS|SNAPSHOT:S1|' || c_custkey) AS event_id, 'SNAPSHOT:S1' AS receiver, c_custkey AS sequence, 'c' AS operation,
       TIMESTAMP '2023-12-31 00:00:00' AS commit_ts, TIMESTAMP '2023-12-31 00:10:00' AS ingested_at,
       'raw/ORDERS/SNAPSHOT/batch-' || lpad((c_custkey // 500)::VARCHAR, 5, '0') || '.jsonl' AS source_file, 0 AS attempt,
       NULL::BIGINT AS before_key, c_custkey AS after_key, CAST(round(c_acctbal * 100) AS BIGINT) AS cents, 'snapshot' AS event_type,
       -1 - c_custkey AS n FROM customer""")
cte("raw_events", """
SELECT * FROM journal_events UNION ALL
SELECT * REPLACE (1 AS attempt, ingested_at + INTERVAL 1 HOUR AS ingested_at, replace(source_file, 'batch-', 'replay-') AS source_file)
FROM journal_events WHERE n % 10 = 0 UNION ALL SELECT * FROM snapshot_events""")
cte("ledger", """
SELECT * EXCLUDE (copy_no) FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingested_at, source_file) AS copy_no FROM raw_events) WHERE copy_no = 1""")
cte("receiver_ranks", """
SELECT receiver, first_ts, dense_rank() OVER (ORDER BY first_ts) AS receiver_rank
FROM (SELECT receiver, min(commit_ts) AS first_ts FROM ledger WHERE receiver NOT LIKE 'SNAPSHOT:%' GROUP BY receiver)""")
cte("operations", """
SELECT *, after_key AS k, 'upsert' AS kind FROM ledger WHERE operation IN ('c', 'u', 'u_after') AND after_key IS NOT NULL UNION ALL
SELECT *, before_key AS k, 'delete' AS kind FROM ledger WHERE operation IN ('d', 'u_before') AND before_key IS NOT NULL UNION ALL
SELECT *, before_key AS k, 'delete' AS kind FROM ledger WHERE operation = 'u' AND before_key IS NOT NULL AND after_key IS DISTINCT FROM before_key""")
cte("winners", """
SELECT * EXCLUDE (place) FROM (
  SELECT o.*, r.receiver_rank, row_number() OVER (PARTITION BY k ORDER BY (o.receiver NOT LIKE 'SNAPSHOT:%') DESC, receiver_rank DESC NULLS LAST,
    sequence DESC, (kind = 'upsert') DESC, commit_ts DESC, event_id DESC, source_file DESC) AS place
  FROM operations o LEFT JOIN receiver_ranks r ON o.receiver = r.receiver) WHERE place = 1""")
cte("mirror", "SELECT k, cents, event_type, event_id, receiver, sequence, commit_ts FROM winners WHERE kind = 'upsert'")
cte("mirror_broken", """
SELECT k, CASE WHEN k % 89 = 0 THEN cents + 1 ELSE cents END AS cents, event_type, event_id, receiver, sequence, commit_ts FROM mirror WHERE k % 97 <> 0 UNION ALL
SELECT k, cents, event_type, event_id, receiver, sequence, commit_ts FROM mirror WHERE k % 83 = 0 AND k % 97 <> 0""")
cte("orders_source", "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders")
cte("orders_dest", """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 101 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 89 = 0 THEN cents + 1 WHEN o_orderkey % 103 = 0 THEN NULL ELSE cents END AS cents FROM orders_source WHERE o_orderkey % 97 <> 0 UNION ALL
SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, cents FROM orders_source WHERE o_orderkey % 113 = 0""")
cte("receipts", """
SELECT 'ORDERS' AS table_name, receiver, min(sequence) AS start_seq, max(sequence) AS end_seq, count(*) AS event_count FROM journal_events GROUP BY receiver, (sequence - 1) // 500""")
cte("receipts_broken", """
SELECT * FROM receipts WHERE NOT (receiver = 'JRN2' AND start_seq = 501) UNION ALL
SELECT * FROM receipts WHERE receiver = 'JRN9' AND start_seq = 1""")
cte("receiver_catalogue", """
SELECT receiver, min(sequence) AS first_seq, max(sequence) AS last_seq, min(commit_ts) AS first_ts, max(commit_ts) AS last_ts,
       row_number() OVER (ORDER BY min(commit_ts)) AS ordinal FROM journal_events GROUP BY receiver""")
cte("catalogue_chain", "SELECT *, lag(receiver) OVER (ORDER BY ordinal) AS previous FROM receiver_catalogue")
cte("file_rows", """
SELECT source_file, count(*) AS loaded FROM raw_events WHERE attempt = 0 AND source_file NOT LIKE '%JRN5/batch-00001%' GROUP BY source_file""")
cte("manifests", """
SELECT source_file, CASE WHEN source_file LIKE '%00000%' THEN count(*) + 3 WHEN source_file LIKE '%00002%' THEN NULL ELSE count(*) END AS declared
FROM raw_events WHERE attempt = 0 AND source_file NOT LIKE '%SNAPSHOT/batch-00001%' GROUP BY source_file""")
cte("lag_samples", """
SELECT 'user-' || user_id AS pipeline, epoch_us(ts) // 1000000 - min(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id) AS elapsed_s,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 5000 END AS lag, event_id AS n FROM events""")
cte("hourly", """
SELECT event_type AS pipeline, date_trunc('hour', ts) AS hour, count(*) AS n, max(epoch_us(ts)) AS last_us, sum(CAST(round(value * 100) AS BIGINT)) AS cents,
       max(event_id) AS top FROM events GROUP BY event_type, date_trunc('hour', ts)""")
cte("slo_telemetry", """
SELECT pipeline, hour, CASE WHEN n % 7 = 0 THEN NULL ELSE top % 200 END AS capture_age_s, CASE WHEN n % 5 = 0 THEN NULL ELSE top % 250 END AS raw_age_s,
       top % 400 AS destination_age_s, CASE WHEN n % 11 = 0 THEN NULL ELSE top % 1500 END AS lag, (top * 7) % 90 AS p95_s, (top * 11) % 250 AS p99_s,
       (n * 1000) AS requests_24h, n % 14 AS pending_files, cents AS credits_cents FROM hourly""")
cte("metering", "SELECT pipeline, hour, CASE WHEN n % 17 = 0 THEN NULL ELSE cents END AS credits FROM hourly")
cte("deliveries", """
SELECT event_type AS pipeline, epoch_us(ts) // 300000000 AS slot, count(*) AS n, max(epoch_us(ts)) AS at_us FROM events GROUP BY 1, 2""")
cte("benchmark_samples", """
SELECT l_returnflag AS solution, CAST(l_quantity AS BIGINT) AS elapsed_ms, CAST(round(l_extendedprice) AS BIGINT) AS bytes, l_linenumber AS lag, 'scope-1' AS scope, 'print-1' AS fingerprint, CAST(l_quantity AS BIGINT) AS cost_cents FROM lineitem""")
cte("capture_polls", """
SELECT user_id AS run, event_id AS n, epoch_us(ts) AS at_us, CAST(round(value) AS BIGINT) AS poll_ms, CASE WHEN event_type = 'view' THEN 0 ELSE event_id % 40 END AS events,
       event_id % 9000 AS bytes, count(CASE WHEN event_type = 'error' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS errors_total,
       event_type = 'signup' AND event_id % 7 = 0 AS rotated FROM events""")
cte("second_system", """
SELECT epoch_us(commit_ts) // 1000 + 3600000 AS at_ms, CASE operation WHEN 'c' THEN 'c' WHEN 'd' THEN 'd' ELSE 'u' END AS op, receiver, sequence, n FROM journal_events WHERE n % 100 <> 0 UNION ALL
SELECT epoch_us(commit_ts) // 1000 + 3600000, CASE operation WHEN 'c' THEN 'c' WHEN 'd' THEN 'd' ELSE 'u' END, receiver, sequence, n FROM journal_events WHERE n % 100 = 1""")
cte("first_system", """
SELECT epoch_us(commit_ts) // 1000 AS at_ms, CASE operation WHEN 'c' THEN 'c' WHEN 'd' THEN 'd' ELSE 'u' END AS op, receiver, sequence, n FROM journal_events""")
