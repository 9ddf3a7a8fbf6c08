"""Change tracking, rate limit, audit lines and windowed KPIs on the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from portolan.operators import ratelimit, tracking
from portolan.plans.movements import table
from portolan.plans.registry import query
from portolan.session import work_folder
from portolan.sources import logs, versions
from portolan.streaming import jobs

COLUMNS = ("event_id", "user_id", "event_type", "props")


def _new_snapshot(events):
    """Events with changed properties in one type, one type shortened and one row doubled."""
    props = F.when((F.col("event_type") == "error") & (F.col("value") > 10), F.lit("{}")).otherwise(F.col("props"))
    changed = events.withColumn("props", props).where("NOT (event_type = 'view' AND value < 1)")
    doubled = changed.where("event_type = 'click' AND value > 20")
    return changed.unionByName(doubled)


NEW = """nv AS (SELECT event_id, user_id, event_type, CASE WHEN event_type = 'error' AND value > 10 THEN '{}' ELSE props END AS props, value FROM events
 WHERE NOT (event_type = 'view' AND value < 1)), nw AS (SELECT * FROM nv UNION ALL SELECT * FROM nv WHERE event_type = 'click' AND value > 20)"""


ROW_MD5 = "md5(" + " || ".join(f"coalesce('s' || length({c}::VARCHAR) || ':' || {c}, 'n')" for c in ("event_id", "user_id", "event_type", "props")) + ")"


def _hash_sql(source):
    return f"""SELECT event_type AS source, count(*) AS record_count,
 CAST(sum(CAST('0x' || substr({ROW_MD5}, 1, 15) AS BIGINT)) AS VARCHAR) AS soma FROM {source} GROUP BY 1"""


MD5_SQL = "md5(record_count || '_event_id,user_id,event_type,props_' || soma)"


@query("t1_fingerprint", f"""
SELECT count(*) AS record_count, CAST(sum(CAST('0x' || substr({ROW_MD5}, 1, 15) AS BIGINT)) AS VARCHAR) AS soma FROM events""")
def fingerprint(spark, d):
    return tracking.fingerprint(table(spark, d, "events"), COLUMNS)


@query("t1_source_hashes", f"WITH h AS ({_hash_sql('events')}) SELECT source, {MD5_SQL} AS hash, record_count FROM h")
def source_hashes(spark, d):
    events = table(spark, d, "events").withColumn("source", F.col("event_type"))
    return tracking.source_hashes(events, "source", COLUMNS)


@query("t2_check_for_updates", f"""
WITH {NEW}, o AS ({_hash_sql('events')}), n AS ({_hash_sql('nw')})
SELECT o.source, md5(o.record_count || '_event_id,user_id,event_type,props_' || o.soma) AS old_hash, md5(n.record_count || '_event_id,user_id,event_type,props_' || n.soma) AS new_hash,
 o.record_count AS old_count, n.record_count AS new_count FROM o JOIN n USING (source) WHERE o.source <> 'click' AND old_hash <> new_hash""")
def check_for_updates(spark, d):
    events = table(spark, d, "events").withColumn("source", F.col("event_type"))
    registry = tracking.source_hashes(events, "source", COLUMNS).select(
        "source", F.col("hash").alias("last_hash"), "record_count", (F.col("source") != "click").alias("enabled"))
    return tracking.check_for_updates(registry, tracking.source_hashes(_new_snapshot(events), "source", COLUMNS))


@query("t2_row_changes", f"""
WITH {NEW}, a AS (SELECT event_id, user_id, event_type, props, value, -1 AS s FROM events UNION ALL SELECT event_id, user_id, event_type, props, value, 1 FROM nw),
g AS (SELECT event_id, user_id, event_type, props, value, sum(s) AS n FROM a GROUP BY ALL HAVING sum(s) <> 0)
SELECT CASE WHEN n > 0 THEN 'novo' ELSE 'removido' END AS mudanca, CAST(abs(n) AS BIGINT) AS copias, event_id, user_id, event_type, props, value FROM g""")
def row_changes(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "props", "value")
    return tracking.row_changes(events, _new_snapshot(events))


KEY = ("event_id",)
CELLS = ("event_id", "user_id", "event_type", "props", "value")


def _versioned(spark, d):
    """A table of two batches, the second of which ran twice, a whole copy, and a batch that brings the first rows back."""
    path = work_folder(spark, "t3v")
    events = table(spark, d, "events").select(*CELLS)
    second = _new_snapshot(events).dropDuplicates(["event_id"])
    versions.commit(spark, path, "one", events, KEY)
    for _ in range(2):
        versions.commit(spark, path, "two", second, KEY)
    versions.compact(spark, path, events.schema, KEY)
    versions.commit(spark, path, "three", events.where("event_type <> 'click'"), KEY)
    return path, events.schema


V1 = "SELECT event_id, user_id, event_type, props, value FROM events"
V2 = "SELECT event_id, user_id, event_type, props, value FROM nv"


@query("t3_versions", f"""WITH {NEW} SELECT 1::BIGINT AS version, * FROM ({V1}) UNION ALL SELECT 2, * FROM ({V2}) UNION ALL SELECT 3, * FROM ({V2})
 UNION ALL SELECT 4, * FROM ({V1}) WHERE event_type <> 'click'""")
def table_versions(spark, d):
    path, schema = _versioned(spark, d)
    return versions.rows_as_of(spark, path, schema, KEY, (1, 2, 3, 4))


@query("t3_manifest", f"""WITH {NEW}, k AS (SELECT a.event_id AS x, b.event_id AS y, a.props IS DISTINCT FROM b.props AS diff, coalesce(a.event_type, b.event_type) AS t FROM events a FULL JOIN nv b ON a.event_id = b.event_id)
SELECT 1::BIGINT AS version, 'one' AS batch_id, 'changes' AS kind, count(*) AS inserted, 0::BIGINT AS updated, 0::BIGINT AS deleted FROM events
UNION ALL SELECT 2, 'two', 'changes', count(*) FILTER (x IS NULL), count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND diff), count(*) FILTER (y IS NULL) FROM k
UNION ALL SELECT 3, 'copy-3', 'copy', count(*), 0, 0 FROM nv
UNION ALL SELECT 4, 'three', 'changes', count(*) FILTER (y IS NULL AND t <> 'click'), count(*) FILTER (y IS NOT NULL AND diff AND t <> 'click'), count(*) FILTER (y IS NOT NULL AND t = 'click') FROM k""")
def manifest(spark, d):
    return versions.history(spark, _versioned(spark, d)[0])


@query("t2_keyed_changes", f"""WITH {NEW} SELECT coalesce(b.event_id, a.event_id) AS event_id, coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.event_type, a.event_type) AS event_type,
 CASE WHEN b.event_id IS NULL THEN a.props ELSE b.props END AS props, coalesce(b.value, a.value) AS value, CASE WHEN a.event_id IS NULL THEN 'insert' WHEN b.event_id IS NULL THEN 'delete' ELSE 'update' END AS operation
FROM events a FULL JOIN nv b ON a.event_id = b.event_id WHERE a.event_id IS NULL OR b.event_id IS NULL OR a.props IS DISTINCT FROM b.props""")
def keyed_changes(spark, d):
    events = table(spark, d, "events").select(*CELLS)
    return versions.changes(events, _new_snapshot(events), KEY)


def _registry(spark, d):
    pages = table(spark, d, "pages")
    return pages.select(
        F.md5("url").alias("id"), F.concat(F.lit("Planilha "), F.col("page_id")).alias("name"), "url", F.lit("url").alias("type"),
        F.md5("html").alias("last_hash"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("page_id").cast("int"))).alias("last_check"),
        F.length("html").cast("bigint").alias("record_count"), F.lit(True).alias("enabled"))


REGISTRY = """rg AS (SELECT md5(url) AS id, 'Planilha ' || page_id AS name, url, 'url' AS type, md5(html) AS last_hash, TIMESTAMP '2024-01-01' + to_hours(page_id) AS last_check,
 length(html) AS record_count, true AS enabled FROM pages)"""
LATEST = "lt AS (SELECT * FROM rg QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_check DESC) = 1)"


@query("t4_registry", f"""
WITH {REGISTRY}, {LATEST} SELECT id, CASE WHEN contains(url, '/fr/') THEN name || ' (nova)' ELSE name END AS name, url, last_check + CASE WHEN contains(url, '/fr/') THEN INTERVAL 365 DAY ELSE INTERVAL 0 DAY END AS last_check,
 CAST(record_count AS BIGINT) AS record_count, NOT contains(url, 'https') AS enabled FROM lt WHERE NOT contains(url, '/de/')""")
def registry(spark, d):
    first = _registry(spark, d)
    renewed = first.where(F.contains("url", F.lit("/fr/"))).withColumns({
        "name": F.concat("name", F.lit(" (nova)")), "last_check": F.col("last_check") + F.make_dt_interval(F.lit(365))})
    held = tracking.register(first, renewed)
    kept = tracking.unregister(held, first.where(F.contains("url", F.lit("/de/"))))
    flipped = tracking.toggle(kept, first.where(F.contains("url", F.lit("https"))))
    return flipped.select("id", "name", "url", "last_check", "record_count", "enabled")


@query("t5_monitoring_status", f"""
WITH {REGISTRY}, {LATEST} SELECT count(*) AS total_sources, count(*) FILTER (NOT contains(url, 'https')) AS enabled_sources, max(last_check) AS last_check,
 CAST(sum(record_count) AS BIGINT) AS record_count FROM lt""")
def monitoring_status(spark, d):
    first = _registry(spark, d)
    flipped = tracking.toggle(tracking.register(first, first), first.where(F.contains("url", F.lit("https"))))
    return tracking.monitoring_status(flipped)


RATE = """WITH RECURSIVE w(user_id, s) AS (SELECT user_id, min(ts) FROM events GROUP BY 1
 UNION ALL SELECT e.user_id, min(e.ts) FROM w JOIN events e ON e.user_id = w.user_id AND e.ts > w.s + INTERVAL 86400 SECOND GROUP BY e.user_id),
a AS (SELECT e.user_id, e.event_id, e.ts, max(w.s) AS s FROM events e JOIN w ON w.user_id = e.user_id AND w.s <= e.ts GROUP BY ALL)
SELECT user_id, event_id, ts, s AS window_start, row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) AS position,
 row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) <= 2 AS accepted FROM a"""


def _plain_times(frame):
    return frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "window_start")})


@query("t6_rate_limit", RATE)
def rate_limit(spark, d):
    decided = ratelimit.rate_limit(table(spark, d, "events"), "user_id", "ts", "event_id", limit=2, window=86400,
                                   slice_seconds=3 * 86400)
    return _plain_times(decided)


@query("t6_rate_limit_stream", RATE)
def rate_limit_stream(spark, d):
    """All events, one part per batch: parts follow the time, each event up to half a day out of its place.

    Lateness is two windows of a day, slices have three days, so no batch meets more than the days
    since the watermark. Each part is there before the stream goes on from its checkpoint and takes it
    whole. A last event far behind the others lets the last slices be decided.
    """
    folder, parts, day = work_folder(spark, "t6"), 3, 86400
    events = table(spark, d, "events")
    span = events.agg(F.struct(F.min(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("a"), F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("z"))).scalar()
    moment = F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(day // 2))
    part = F.least(F.floor((moment - span["a"]) * parts / F.greatest(span["z"] - span["a"] + 1, F.lit(1))), F.lit(parts - 1))
    after = events.orderBy(F.desc("ts"), "event_id").limit(1).withColumn("user_id", F.lit(-1).cast(events.schema["user_id"].dataType))
    batches = [events.where(part == number) for number in range(parts)] + [after.withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(30)))]
    for number, batch in enumerate(batches, 1):
        batch.write.mode("append").parquet(f"{folder}/in")
        stream = jobs.stream_table(spark, f"{folder}/in", events.schema, files_per_trigger=None)
        with jobs.keyed_state(spark, more=number < len(batches)):
            decided = jobs.rate_limit_stream(stream, "user_id", "ts", "event_id", limit=2, window=day, late="2 days", slice_seconds=3 * day)
            jobs.write_stream(decided, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return _plain_times(spark.read.schema(decided.schema).parquet(f"{folder}/out"))


def _stream(spark, d, name):
    return jobs.stream_table(spark, d, table(spark, d, name).schema, f"{name}.parquet")


KPIS = """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS inicio, CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) AS fim, event_type, count(*) AS eventos,
 CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY ALL"""


def _plain_windows(frame):
    return frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("inicio", "fim")})


@query("t7_window_kpis", KPIS)
def window_kpis(spark, d):
    return _plain_windows(jobs.window_kpis(table(spark, d, "events")))


@query("t7_window_kpis_stream", KPIS)
def window_kpis_stream(spark, d):
    folder = work_folder(spark, "t7")
    jobs.write_stream(jobs.window_kpis(_stream(spark, d, "events")), f"{folder}/out", f"{folder}/checkpoint",
                      mode="complete").awaitTermination()
    return _plain_windows(spark.read.parquet(f"{folder}/out"))


ROLLING = """SELECT CAST(date_trunc('day', ts) - to_days(k) AS TIMESTAMP) AS inicio, CAST(date_trunc('day', ts) - to_days(k) + INTERVAL 7 DAY AS TIMESTAMP) AS fim, event_type, count(*) AS eventos,
 CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total, true AS pessoas_perto FROM events, (SELECT CAST(unnest(range(7)) AS INTEGER) AS k) GROUP BY ALL"""


def _near_exact(spark, d, found):
    """The estimate of different users, held against their exact number in each window: within 5 percent."""
    days = F.sequence(F.lit(0), F.lit(6))
    exact = table(spark, d, "events").select("event_type", "user_id", F.explode(days).alias("k"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("dia")).withColumn(
        "inicio", F.expr("dia - make_dt_interval(k)")).groupBy("inicio", "event_type").agg(F.count_distinct("user_id").alias("exato"))
    near = F.abs(F.col("pessoas") - F.col("exato")) <= 0.05 * F.col("exato") + 0.5
    return _plain_windows(found.join(exact, ["inicio", "event_type"]).withColumn("pessoas_perto", near)).select("inicio", "fim", "event_type", "eventos", "total", "pessoas_perto")


@query("t7_rolling_kpis", ROLLING)
def rolling_kpis(spark, d):
    return _near_exact(spark, d, jobs.rolling_kpis(table(spark, d, "events")))


@query("t7_rolling_kpis_stream", ROLLING)
def rolling_kpis_stream(spark, d):
    """Every window comes out once; an event far behind the others lets the last ones close."""
    folder = work_folder(spark, "t7r")
    events = table(spark, d, "events")
    for part in range(2):  # in order of time, half each
        half = F.col("ts") < events.agg(F.expr("percentile_approx(ts, 0.5)")).scalar()
        events.where(half if part == 0 else ~half).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    for days in (60, 61):
        after = events.orderBy(F.desc("ts"), "event_id").limit(1).withColumns({"event_type": F.lit("depois"), "ts": F.col("ts") + F.make_dt_interval(F.lit(days))})
        after.write.mode("append").parquet(f"{folder}/in")
    stream = jobs.stream_table(spark, f"{folder}/in", events.schema, files_per_trigger=1)
    found = jobs.rolling_kpis(stream)
    jobs.write_stream(found, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return _near_exact(spark, d, spark.read.schema(found.schema).parquet(f"{folder}/out").where("event_type <> 'depois'"))


@query("t3_incremental_refresh", "SELECT event_id, user_id, event_type, props, value FROM events")
def incremental_refresh(spark, d):
    folder = work_folder(spark, "t3")
    for _ in range(2):  # the second run finds nothing new and adds nothing
        jobs.incremental_refresh(_stream(spark, d, "events"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "event_type", "props", "value")


def _log_lines(events):
    """Audit lines derived from the events; errors are denied accesses, and some lines are no accesses."""
    time = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    denied = F.col("event_type") == "error"
    access = F.concat(time, F.when(denied, " - WARNING - ACCESS_DENIED: user_").otherwise(" - INFO - ACCESS: user_"),
                      F.col("user_id"), F.lit(" - "), F.upper("event_type"), F.lit(" - evento/"), F.col("event_id"))
    return events.select(F.when(F.col("value") < 1, F.concat(time, F.lit(" - INFO - Dados anonimizados"))).otherwise(access).alias("value"))


LOG = """lg AS (SELECT date_trunc('second', ts) AS momento, CASE WHEN event_type = 'error' THEN 'WARNING' ELSE 'INFO' END AS nivel, 'user_' || user_id AS usuario,
 upper(event_type) AS acao, 'evento/' || event_id AS recurso, event_type <> 'error' AS permitido FROM events WHERE value >= 1)"""


@query("s10_audit_lines", f"WITH {LOG} SELECT CAST(momento AS TIMESTAMP) AS momento, nivel, usuario, acao, recurso, permitido FROM lg")
def audit_lines(spark, d):
    folder = work_folder(spark, "s10")
    _log_lines(table(spark, d, "events")).write.text(folder)
    return logs.read_log(spark, folder).withColumn("momento", F.col("momento").cast("timestamp_ntz"))


@query("f18_access_log", f"""
WITH {LOG} SELECT CAST(momento AS TIMESTAMP) AS momento, nivel, usuario, acao, recurso, permitido FROM lg WHERE usuario = 'user_7' AND momento >= (SELECT max(momento) FROM lg) - INTERVAL 7 DAY
ORDER BY momento DESC, usuario, acao, recurso LIMIT 100""")
def access_log(spark, d):
    lines = logs.parse_lines(_log_lines(table(spark, d, "events")))
    return logs.access_log(lines, "user_7", days=7).withColumn("momento", F.col("momento").cast("timestamp_ntz"))


AUDIT = f"WITH {LOG} SELECT usuario, count(*) FILTER (permitido) AS permitidos, count(*) FILTER (NOT permitido) AS negados FROM lg GROUP BY 1"


@query("t8_audit_counts", AUDIT)
def audit_counts(spark, d):
    return jobs.audit_counts(logs.parse_lines(_log_lines(table(spark, d, "events"))))


@query("t8_audit_stream", AUDIT)
def audit_stream(spark, d):
    folder = work_folder(spark, "t8")
    _log_lines(table(spark, d, "events")).write.text(f"{folder}/log")
    counts = jobs.audit_counts(logs.stream_log(spark, f"{folder}/log"))
    jobs.write_stream(counts, f"{folder}/out", f"{folder}/checkpoint", mode="complete").awaitTermination()
    return spark.read.parquet(f"{folder}/out")
