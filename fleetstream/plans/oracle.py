"""DuckDB SQL for each registered query, written from the fixture recipes
alone (independent of the Spark operators).  The tables of the driver are
views of the same names."""

from __future__ import annotations

# One sample per event (see fixtures.samples).
SAMPLES = """
SELECT event_type AS run, CAST(user_id % 5 + 1 AS INTEGER) AS worker, event_id AS line_id,
       epoch_us(ts) // 1000 AS ts_ms, CAST(epoch_us(ts) // 1000 AS DOUBLE) / 1000 AS ts,
       event_id, user_id, value
FROM events"""

US = "CAST(event_id % 500 AS DOUBLE) / 10"
SY = "CAST(user_id % 300 AS DOUBLE) / 10"

CPU = f"""
SELECT run, 'worker' || CAST(worker AS VARCHAR) AS host, worker, line_id,
       {US} AS us, {SY} AS sy, 0.0::DOUBLE AS ni, 0.0::DOUBLE AS id, 0.0::DOUBLE AS wa,
       0.0::DOUBLE AS hi, 0.0::DOUBLE AS si, 0.0::DOUBLE AS st,
       ts_ms, ts, ({US} + {SY}) / 100 AS cpu, event_id, user_id
FROM ({SAMPLES})"""

CORES = f"""
SELECT run, 'master' AS host, line_id, ts_ms, ts,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 41 AS INTEGER) END AS cores
FROM ({SAMPLES})"""

CORE_LISTS = f"""
SELECT run, 'master' AS host, line_id, ts_ms, ts,
       CASE WHEN event_id % 13 = 0 THEN CAST([] AS INTEGER[])
            ELSE list_transform(range(0, 5), lambda i: CAST((event_id + i) % 9 AS INTEGER)) END AS cores,
       event_id
FROM ({SAMPLES})"""

_LAST = ("COALESCE(last_value(CASE WHEN worker = {k} THEN cpu END IGNORE NULLS) OVER win, 0.0)"
         " AS l{k}")

CLUSTER = f"""
SELECT run, worker, line_id, ts_ms, ts, cpu, l1 + l2 + l3 + l4 + l5 AS cluster_cpu
FROM (
  SELECT run, worker, line_id, ts_ms, ts, cpu,
         {", ".join(_LAST.format(k=k) for k in range(1, 6))}
  FROM ({CPU})
  WINDOW win AS (PARTITION BY run ORDER BY ts_ms, worker, line_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""

STAMP = "' -  ' || CAST(ts_ms AS VARCHAR) || 'mS since epoch'"
CPU_LINE = ("printf('%%Cpu(s):%5.1f us,%5.1f sy,%5.1f ni,%5.1f id,%5.1f wa,%5.1f hi,%5.1f si,"
            "%5.1f st', {us}, {sy}, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)")
CPU_LINE_STAMPED = CPU_LINE.format(us=US, sy=SY) + " || " + STAMP
CPU_LINE_FIRST = CPU_LINE.format(us=SY, sy=US)

REBASED_CLUSTER = f"""
WITH c AS ({CLUSTER}),
o AS (SELECT run, min(ts) AS origin FROM c GROUP BY run)
SELECT c.run, 'cpu' AS series, line_id, ts - origin AS t, cluster_cpu / 5 * 40 AS value
FROM c JOIN o USING (run)
UNION ALL
SELECT k.run, 'cores' AS series, line_id, ts - origin AS t, CAST(cores AS DOUBLE) AS value
FROM ({CORES}) k JOIN o USING (run)"""

LISTING = """
SELECT '/data/src/' || source || '/' || CASE WHEN doc_id % 7 = 0 THEN '.' ELSE '' END
       || 'd' || CAST(doc_id AS VARCHAR) || '.tif' AS path,
       (doc_id * 137) % 600000 AS mod_ms,
       (doc_id * 137) % 600000 + (doc_id * 7919) % 90000 AS visible_ms
FROM documents"""

SQL: dict[str, str] = {
    "cpu_log": f"SELECT run, host, line_id, us, sy, ni, id, wa, hi, si, st, ts_ms, ts, cpu FROM ({CPU})",
    "last_of_burst": f"""
        SELECT run, host, line_id, {CPU_LINE_STAMPED} AS line, TRUE AS ok, ts_ms, cpu
        FROM ({CPU})""",
    "core_log": CORES,
    "core_log_workers": f"SELECT run, host, line_id, ts_ms, ts, cores FROM ({CORE_LISTS})",
    "metric_lines": f"""
        SELECT run, 'cpu' AS kind, line_id, {CPU_LINE_STAMPED} AS line FROM ({CPU})
        UNION ALL
        SELECT run, 'cores' AS kind, line_id,
               COALESCE(CAST(cores AS VARCHAR), '') || {STAMP} AS line FROM ({CORES})
        UNION ALL
        SELECT run, 'cores_per_worker' AS kind, line_id,
               array_to_string(list_transform(cores, lambda x: CAST(x AS VARCHAR) || ','), '')
               || {STAMP} AS line FROM ({CORE_LISTS})""",
    "splice_workers": f"SELECT run, worker, line_id, ts_ms, ts, cpu FROM ({CPU})",
    "cluster_cpu": CLUSTER,
    "core_equivalents": f"SELECT run, line_id, ts_ms, cluster_cpu / 5 * 40 AS cores_used FROM ({CLUSTER})",
    "rebase_time": REBASED_CLUSTER,
    "trim_series": f"SELECT * FROM ({REBASED_CLUSTER}) WHERE t > 100000.0 AND t <= 1000000.0",
    "alloc_fraction": f"""
        SELECT run, line_id, ts_ms, ts, CAST(i + 1 AS INTEGER) AS worker,
               CAST((event_id + i) % 9 AS INTEGER) AS cores,
               CAST((event_id + i) % 9 AS DOUBLE) / 8 AS fraction
        FROM ({CORE_LISTS}), range(0, 5) r(i)
        WHERE event_id % 13 <> 0""",
    "overlay_series": f"""
        WITH l AS ({CORE_LISTS}),
        o AS (SELECT run, min(ts) AS origin FROM l GROUP BY run),
        a AS (SELECT l.run, CAST(i + 1 AS INTEGER) AS worker, line_id, ts - origin AS t,
                     CAST((event_id + i) % 9 AS DOUBLE) / 8 AS value, 'allocated' AS series
              FROM l JOIN o USING (run), range(0, 5) r(i) WHERE event_id % 13 <> 0),
        m AS (SELECT c.run, worker, line_id, ts - origin AS t, cpu AS value, 'measured' AS series
              FROM ({CPU}) c JOIN o USING (run))
        SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM m)
        WHERE t BETWEEN 1.0 AND 864000.0""",
    "executor_cores": f"""
        SELECT run, line_id, ts_ms,
               CAST(list_sum(list_transform(range(1, event_id % 6 + 2), lambda i: (user_id + i) % 9))
                    AS BIGINT) AS total_cores
        FROM ({SAMPLES})""",
    "makespan": f"""
        SELECT run, count(*) AS n_tasks, max(ts_ms // 1000) AS last_completed_s,
               min(ts_ms) AS start_ms,
               max(ts_ms // 1000) - CAST(min(ts_ms) AS DOUBLE) / 1000 AS makespan_s
        FROM ({SAMPLES}) GROUP BY run""",
    "load_rate": """
        WITH q AS (SELECT event_type AS series, event_id, epoch_us(ts) // 1000 AS ts_ms,
                          CAST((event_id * 31) % 25 AS INTEGER) AS queue FROM events),
        r AS (SELECT *, row_number() OVER w AS t, lag(queue) OVER w AS pq FROM q
              WINDOW w AS (PARTITION BY series ORDER BY ts_ms, event_id)),
        s AS (SELECT series, event_id, ts_ms, queue, t,
                     CASE WHEN pq IS NULL THEN NULL ELSE CAST(queue - pq AS DOUBLE) / 1.0 END AS rate
              FROM r),
        a AS (SELECT *, CASE WHEN rate IS NULL THEN (CASE WHEN queue > 10 THEN 'small' ELSE 'steady' END)
                             WHEN rate <= -2 THEN 'slowdown'
                             WHEN rate >= 5 THEN 'large'
                             WHEN rate >= 2 OR (queue > 10 AND rate > -2) THEN 'small'
                             ELSE 'steady' END AS action FROM s)
        SELECT *, CASE WHEN action = 'large' THEN 2 WHEN action = 'small' THEN 1 ELSE 0 END AS amount
        FROM a""",
    "default_share": """
        WITH r AS (SELECT p_partkey, 'img' || CAST(p_size AS VARCHAR) AS image FROM part),
        m AS (SELECT 'img' || CAST(l_linenumber AS VARCHAR) AS image,
                     CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE)
                       / count(*) / 100.0 AS mean
              FROM lineitem GROUP BY 1)
        SELECT p_partkey, image, COALESCE(mean, 0.125) AS share, mean IS NOT NULL AS profiled
        FROM r LEFT JOIN m USING (image)""",
    "page_counts": """
        SELECT page_id, CAST(len(a) AS BIGINT) AS n_matches,
               CASE WHEN len(a) = 0 THEN '' ELSE array_to_string(a, ',') || ',' END AS joined
        FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS a FROM pages)""",
    "uri_path": """
        SELECT doc_id, 'file:' || p AS uri, substr('file:' || p, 6) AS path
        FROM (SELECT doc_id, '/src/' || source || '/d' || CAST(doc_id AS VARCHAR) || '.tif' AS p
              FROM documents)""",
    "log_scan": f"""
        SELECT run, host, {CPU_LINE_FIRST} AS line FROM ({CPU})
        UNION ALL
        SELECT run, host, {CPU_LINE_STAMPED} AS line FROM ({CPU})""",
}

ENVELOPE = """'{"name":"d' || CAST(doc_id AS VARCHAR) || '.tif","size":' || CAST(strlen(text) AS VARCHAR)
    || '}' || '";"' || text"""

SELECTION = f"""
WITH l AS ({LISTING}),
b AS (SELECT *, ((greatest(mod_ms, visible_ms) + 4999) // 5000) * 5000 AS batch_ms FROM l),
t AS (SELECT *, greatest(30000, batch_ms - 60000) AS threshold_ms FROM b)
SELECT path, mod_ms, visible_ms, batch_ms, threshold_ms,
       CASE WHEN starts_with(regexp_extract(path, '[^/]*$'), '.') THEN 'filtered'
            WHEN mod_ms <= 30000 THEN 'before_start'
            WHEN mod_ms <= threshold_ms THEN 'late'
            WHEN mod_ms > batch_ms THEN 'future'
            ELSE 'selected' END AS reason
FROM t"""

SELECTED = f"SELECT path, mod_ms, batch_ms FROM ({SELECTION}) WHERE reason = 'selected'"

DOC_FILES = """
SELECT 'd' || CAST(doc_id AS VARCHAR) AS name, CAST(strlen(text) + 1 AS BIGINT) AS length, text
FROM documents"""

SQL.update({
    "message_encode": f"""
        SELECT 'd' || CAST(doc_id AS VARCHAR) || '.tif' AS name, lang AS type,
               CAST(strlen(env) AS BIGINT) AS n_bytes, md5(env) AS md5
        FROM (SELECT doc_id, lang, {ENVELOPE} AS env FROM documents)""",
    "message_decode": """
        SELECT 'd' || CAST(doc_id AS VARCHAR) || '.tif' AS name, CAST(strlen(text) AS BIGINT) AS size,
               CAST(strlen(text) AS BIGINT) AS n_data, md5(text) AS md5, TRUE AS size_ok
        FROM documents""",
    "route_lookup": """
        SELECT 'd' || CAST(doc_id AS VARCHAR) || '.tif' AS name, lang AS type,
               'fleet/' || lang || '-worker:1' AS image, 'ubuntu' AS os
        FROM documents""",
    "message_load": f"""
        SELECT 'd' || CAST(doc_id AS VARCHAR) || '.tif' AS name, CAST(c AS INTEGER) AS copy,
               lang AS type, 'fleet/' || lang || '-worker:1' AS image, 'ubuntu' AS os,
               CAST(strlen({ENVELOPE}) AS BIGINT) AS n_bytes
        FROM documents, range(1, 3) r(c)""",
    "new_file_selection": f"SELECT *, reason = 'selected' AS selected FROM ({SELECTION})",
    "late_files": f"""
        SELECT path, mod_ms, visible_ms, batch_ms, batch_ms - mod_ms AS lateness_ms
        FROM ({SELECTION}) WHERE reason = 'late'""",
    "batch_counts": f"SELECT batch_ms, count(*) AS n_files FROM ({SELECTED}) GROUP BY batch_ms",
    "balanced_slices": f"""
        SELECT batch_ms, path, n, p, CAST((r * p - 1) // n AS INTEGER) AS slice
        FROM (SELECT batch_ms, path, count(*) OVER (PARTITION BY batch_ms) AS n,
                     CAST(least(count(*) OVER (PARTITION BY batch_ms), 40) AS INTEGER) AS p,
                     row_number() OVER (PARTITION BY batch_ms ORDER BY mod_ms, path) AS r
              FROM ({SELECTED}))""",
    "batch_preview": f"""
        SELECT batch_ms, path, rank FROM (
          SELECT batch_ms, path, row_number() OVER (PARTITION BY batch_ms ORDER BY path) AS rank
          FROM ({SELECTED})) WHERE rank <= 5""",
    "file_listing": f"SELECT name, length FROM ({DOC_FILES})",
    "whole_file": f"SELECT name, length AS n_bytes, md5(text || chr(10)) AS md5 FROM ({DOC_FILES})",
    "file_sample": f"SELECT name, length FROM ({DOC_FILES}) ORDER BY name || '/' LIMIT 20",
    "named_lines": f"SELECT name, unnest(string_split(text, chr(10))) AS line FROM ({DOC_FILES})",
    "by_file_transform": f"""
        SELECT name, CAST(len(l) AS BIGINT) AS n_lines,
               CAST(len(list_filter(l, lambda x: x = '')) AS BIGINT) AS n_empty,
               CAST(strlen(COALESCE(list_filter(l, lambda x: x <> '')[-1], '')) AS BIGINT) AS last_bytes
        FROM (SELECT name, string_split(text, chr(10)) AS l FROM ({DOC_FILES}))""",
    "external_task": f"SELECT name, 0 AS status, length AS n_bytes, TRUE AS completion_ok, length AS n_written FROM ({DOC_FILES})",
    "external_task_recorded": """
        SELECT command, name, status, CASE WHEN status = 0 THEN 'success' ELSE 'failed' END AS outcome
        FROM (SELECT 'look' AS command, name,
                     CASE WHEN name LIKE '%00.tif' THEN 124 WHEN contains(text, 'the') THEN 0 ELSE 1 END AS status
              FROM (SELECT 'd' || CAST(doc_id AS VARCHAR) || '.tif' AS name, text FROM documents)
              UNION ALL
              SELECT 'missing', 'd' || CAST(doc_id AS VARCHAR) || '.tif', 127 FROM documents)""",
    "new_file_stream": f"SELECT name, length FROM ({DOC_FILES})",
    "restart_once": f"SELECT name, length, CAST(1 AS BIGINT) AS n_seen FROM ({DOC_FILES})",
})

SQL.update({
    "cluster_timeline": f"""
        SELECT run, series, CAST(NULL AS INTEGER) AS worker, t, value FROM ({REBASED_CLUSTER})""",
    "worker_timeline": f"""
        WITH l AS ({CORE_LISTS}),
        o AS (SELECT run, min(ts) AS origin FROM l GROUP BY run),
        a AS (SELECT l.run, 'allocated' AS series, CAST(i + 1 AS INTEGER) AS worker, ts - origin AS t,
                     CAST((event_id + i) % 9 AS DOUBLE) / 8 AS value
              FROM l JOIN o USING (run), range(0, 5) r(i) WHERE event_id % 13 <> 0),
        m AS (SELECT c.run, 'measured' AS series, worker, ts - origin AS t, cpu AS value
              FROM ({CPU}) c JOIN o USING (run))
        SELECT * FROM a UNION ALL SELECT * FROM m""",
    "timed_trigger": f"SELECT CAST(count(*) AS BIGINT) AS n_files FROM ({DOC_FILES})",
    "slow_listing": f"""
        SELECT CAST(b AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS num_input_rows, CAST(5000 AS BIGINT) AS trigger_ms
        FROM (SELECT (row_number() OVER () - 1) // 200 AS b FROM ({DOC_FILES})) GROUP BY b""",
    "binary_load": f"SELECT name, length, md5(text || chr(10)) AS md5, TRUE AS is_text FROM ({DOC_FILES})",
    "message_draw": """
        WITH c AS (SELECT 'd' || CAST(doc_id AS VARCHAR) || '.tif' AS name, lang AS type,
                          row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS k FROM documents)
        SELECT CAST(m AS BIGINT) AS message_id, name, type
        FROM (SELECT unnest(range(0, (SELECT 3 * count(*) // 2 FROM documents))) AS m) JOIN c ON m % k = i""",
})
SQL["named_line_stream"] = SQL["named_lines"]
SQL["executor_cores_sum"] = SQL["executor_cores"]
SQL["metric_line_files"] = f"SELECT run, kind, line FROM ({SQL['metric_lines']})"
# the run without CPU logs: its core counts on their own clock
SQL["sparse_timeline"] = f"""
    SELECT run || ' one' AS run, series, worker, t, value FROM (
      SELECT run, series, CAST(NULL AS INTEGER) AS worker, t, value FROM ({REBASED_CLUSTER}) WHERE run <> 'click'
      UNION ALL
      SELECT run, 'cores', CAST(NULL AS INTEGER), ts - min(ts) OVER (), CAST(cores AS DOUBLE)
      FROM ({CORES}) WHERE run = 'click')"""
_NULL_CPU = f"SELECT * REPLACE (CASE WHEN worker <> 3 THEN run END AS run) FROM ({CPU})"
SQL["null_runs"] = f"""
    SELECT 'total' AS kind, run, line_id, cluster_cpu AS value
    FROM ({CLUSTER.replace(CPU, _NULL_CPU)})
    UNION ALL
    SELECT 'rate', series, event_id, CAST(queue - lag(queue) OVER (PARTITION BY series ORDER BY ts_ms, event_id) AS DOUBLE)
    FROM (SELECT CASE WHEN event_id % 3 <> 0 THEN event_type END AS series, event_id,
                 epoch_us(ts) // 1000 AS ts_ms, CAST((event_id * 31) % 25 AS INTEGER) AS queue FROM events)"""

# Rewritten paths: the per-path recurrence as a recursive CTE over versions.
_LO = "greatest(w.from_b, COALESCE(r.s_last + 70000, w.from_b))"
_HI = "least(COALESCE(w.end_b, 9000000000000000000), w.mod_ms + 60000)"
SQL["rewritten_files"] = f"""
WITH RECURSIVE l AS (
  SELECT '/data/src/' || source || '/' || CASE WHEN source = 'src0' THEN '.' ELSE '' END
         || lang || '.tif' AS path,
         (doc_id * 137) % 600000 AS mod_ms,
         (doc_id * 137) % 600000 + (doc_id * 7919) % 90000 AS visible_ms
  FROM documents),
v AS (
  SELECT path, mod_ms, visible_ms,
         ((visible_ms + 4999) // 5000) * 5000 AS list_b,
         greatest(((visible_ms + 4999) // 5000) * 5000, ((mod_ms + 4999) // 5000) * 5000) AS from_b,
         (NOT starts_with(regexp_extract(path, '[^/]*$'), '.')) AND mod_ms > 30000 AS ok,
         row_number() OVER (PARTITION BY path ORDER BY visible_ms, mod_ms) AS k
  FROM l),
w AS (SELECT *, lead(list_b) OVER (PARTITION BY path ORDER BY k) AS end_b FROM v),
r AS (
  SELECT path, k, mod_ms, visible_ms,
         CASE WHEN ok AND from_b < least(COALESCE(end_b, 9000000000000000000), mod_ms + 60000)
              THEN from_b END AS sel,
         CASE WHEN ok AND from_b < least(COALESCE(end_b, 9000000000000000000), mod_ms + 60000)
              THEN from_b END AS s_last
  FROM w WHERE k = 1
  UNION ALL
  SELECT w.path, w.k, w.mod_ms, w.visible_ms,
         CASE WHEN w.ok AND {_LO} < {_HI} THEN {_LO} END AS sel,
         CASE WHEN w.ok AND {_LO} < {_HI} THEN {_LO} ELSE r.s_last END AS s_last
  FROM r JOIN w ON w.path = r.path AND w.k = r.k + 1
)
SELECT path, mod_ms, visible_ms, sel IS NOT NULL AS selected, sel AS batch_ms FROM r"""

SQL["series_sink"] = SQL["overlay_series"][:SQL["overlay_series"].rindex("WHERE t BETWEEN")]
SQL["message_table"] = f"""
    SELECT 'fleet/' || lang || '-worker:1' AS image, 'ubuntu' AS os,
           CAST(strlen(env) AS BIGINT) AS n_bytes, md5(env) AS md5
    FROM (SELECT lang, {ENVELOPE} AS env FROM documents)"""


# -- the directory stream, uneven steps, times that are missing, many workers --

SQL["directory_stream"] = """
    SELECT CASE WHEN lang = 'fr' THEN '_' ELSE '' END || 'd' || CAST(doc_id AS VARCHAR) AS name,
           CAST(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE strlen(COALESCE(text, '')) END AS BIGINT) AS length
    FROM documents WHERE doc_id % 10 <> 3"""
SQL["future_stream"] = """
    SELECT 'd' || CAST(doc_id AS VARCHAR) AS name, CAST(1 AS BIGINT) AS n_seen, FALSE AS ahead
    FROM documents WHERE doc_id % 4 <> 1"""
SQL["rewritten_stream"] = """
    SELECT 'd' || CAST(doc_id AS VARCHAR) AS name, CAST(CASE WHEN doc_id % 3 < 2 THEN 2 ELSE 1 END AS BIGINT) AS n_seen,
           doc_id % 3 < 2 AS apart
    FROM documents"""
SQL["listing_errors"] = """
    SELECT 'd' || CAST(doc_id AS VARCHAR) AS name, lang <> 'en' AS when_back FROM documents WHERE lang IS NOT NULL"""
SQL["load_rate_uneven"] = SQL["load_rate"].replace("lag(queue) OVER w AS pq", "lag(queue) OVER w AS pq, lag(ts_ms) OVER w AS pts").replace(
    "CASE WHEN pq IS NULL THEN NULL ELSE CAST(queue - pq AS DOUBLE) / 1.0 END",
    "CASE WHEN ts_ms > pts THEN CAST(queue - pq AS DOUBLE) / (CAST(ts_ms - pts AS DOUBLE) * CAST(0.001 AS DOUBLE)) END")
SQL["makespan_open"] = f"""
    SELECT run, n_tasks, last_completed_s, CASE WHEN run <> 'click' THEN start_ms END AS start_ms,
           CASE WHEN run <> 'click' THEN makespan_s END AS makespan_s FROM ({SQL['makespan']})"""
_EARLY_CPU = f"SELECT * REPLACE (CASE WHEN line_id % 7 <> 0 THEN ts_ms ELSE -1 END AS ts_ms) FROM ({CPU})"
SQL["null_times"] = f"""
    SELECT 'total' AS kind, run, line_id, cluster_cpu AS value
    FROM ({CLUSTER.replace(CPU, _EARLY_CPU)})
    UNION ALL
    SELECT 'rate', series, event_id, CAST(queue - lag(queue) OVER (PARTITION BY series ORDER BY ts_ms NULLS FIRST, event_id) AS DOUBLE)
    FROM (SELECT event_type AS series, event_id, CASE WHEN event_id % 7 <> 0 THEN epoch_us(ts) // 1000 END AS ts_ms,
                 CAST((event_id * 31) % 25 AS INTEGER) AS queue FROM events)"""
SQL["open_workers"] = """
    WITH s AS (SELECT event_type AS run, CAST((event_id * 7919) % 5000 AS INTEGER) AS worker, event_id AS line_id,
                      epoch_us(ts) // 1000 AS ts_ms,
                      CASE WHEN event_id % 11 <> 0 THEN CAST((event_id * 31) % 129 AS DOUBLE) / 64 END AS cpu FROM events),
    v AS (SELECT *, lag(cpu IGNORE NULLS) OVER (PARTITION BY run, worker ORDER BY ts_ms, line_id) AS before FROM s)
    SELECT run, worker, line_id,
           sum(CASE WHEN cpu IS NULL THEN 0 ELSE cpu - COALESCE(before, 0) END)
             OVER (PARTITION BY run ORDER BY ts_ms, worker, line_id ROWS UNBOUNDED PRECEDING) AS cluster_cpu
    FROM v"""
SQL["by_file_merge"] = """
    WITH l AS (SELECT COALESCE(lang, 'none') AS name, doc_id, unnest(string_split(COALESCE(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(COALESCE(text, ''), chr(10)), 1) AS pos FROM documents),
    p AS (SELECT *, lag(line) OVER w AS before, row_number() OVER w AS k, count(*) OVER (PARTITION BY name) AS n
          FROM l WINDOW w AS (PARTITION BY name ORDER BY doc_id, pos))
    SELECT name, count(*) AS n_lines, CAST(count(*) FILTER (k > 1 AND line <> before) AS BIGINT) AS n_changes,
           CAST(max(CASE WHEN k = 1 THEN strlen(line) END) AS BIGINT) AS first_bytes,
           CAST(max(CASE WHEN k = n THEN strlen(line) END) AS BIGINT) AS last_bytes
    FROM p GROUP BY name"""
SQL["bad_line_counts"] = f"""
    SELECT 'cpu' AS log, 2 * count(*) AS n_lines, count(*) AS n_bad FROM ({CPU})
    UNION ALL SELECT 'cores', count(*), CAST(0 AS BIGINT) FROM ({CORES})"""
