"""Dashboard queries over `events`: the type is the endpoint, the value a latency in milliseconds."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.catalog import table
from passagework.operators import metrics


def events(spark, folder):
    rows = table(spark, folder, "events")
    return rows.select(
        "ts", "event_type", "value", (F.col("value") / 1000.0).alias("seconds"), "props"
    )


def metric_counters(spark, folder):
    """Requests by endpoint and status, where an error event has status 500."""
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    return metrics.counter(events(spark, folder).withColumn("status", status), ["event_type", "status"])


def metric_histogram(spark, folder):
    rows = metrics.histogram(events(spark, folder), ["event_type"], "seconds", metrics.LATENCY_BOUNDS)
    return rows.withColumn("total", F.round("total", 6))


def request_rate(spark, folder):
    rows = metrics.sliding_rate(events(spark, folder), ["event_type"])
    return rows.select("event_type", "window_start", "window_end", "n", F.round("per_second", 6).alias("per_second"))


def error_rate(spark, folder):
    rows = metrics.sliding_rate(events(spark, folder).filter("event_type = 'error'"), [])
    return rows.select("window_start", "window_end", "n", F.round("per_second", 6).alias("per_second"))


def latency_p95(spark, folder):
    rows = metrics.sliding_quantile(
        events(spark, folder), ["event_type"], "seconds", metrics.LATENCY_BOUNDS, 0.95, 300, 60
    )
    return rows.select("event_type", "window_start", "samples", F.round("quantile", 6).alias("p95"))


def _chunk_counts(spark, folder):
    """The `k` property stands in for a count of retrieved chunks."""
    count = (F.get_json_object("props", "$.k").cast("int") % 25).cast("double")
    return events(spark, folder).withColumn("chunks", count)


def chunks_p50(spark, folder):
    rows = metrics.sliding_quantile(_chunk_counts(spark, folder), [], "chunks", metrics.CHUNK_BOUNDS, 0.5, 600, 60)
    return rows.select("window_start", "samples", F.round("quantile", 6).alias("p50"))


def chunk_histogram(spark, folder):
    return metrics.histogram(_chunk_counts(spark, folder), ["event_type"], "chunks", metrics.CHUNK_BOUNDS)


def avg_per_window(spark, folder):
    rows = metrics.sliding_mean(events(spark, folder), [], "value", 600, 60)
    return rows.select("window_start", "window_end", "samples", F.round("mean", 6).alias("mean"))


def outcomes_hourly(spark, folder):
    return metrics.tumbling_count(events(spark, folder), ["event_type"], "1 hour")


QUERIES = {
    "metric_counters": metric_counters,
    "metric_histogram": metric_histogram,
    "chunk_histogram": chunk_histogram,
    "request_rate": request_rate,
    "error_rate": error_rate,
    "latency_p95": latency_p95,
    "chunks_p50": chunks_p50,
    "avg_per_window": avg_per_window,
    "outcomes_hourly": outcomes_hourly,
}


def _windows(minutes: int, columns: str) -> str:
    """Events repeated for every window of that many minutes they fall into, one per minute."""
    return f"""wins as (
      select {columns}, date_trunc('minute', ts) - to_minutes(i::bigint) as window_start,
             date_trunc('minute', ts) - to_minutes(i::bigint) + interval {minutes} minute as window_end
      from ev, (select unnest(range(0, {minutes})) as i))"""


_EV = """ev as (select ts, event_type, value, value / 1000.0 as seconds,
  ((props->>'$.k')::int % 25)::double as chunks from events)"""


def _bounds(bounds) -> str:
    rows = ", ".join(f"({b}::double)" for b in bounds)
    return f"bounds(le) as (values {rows}, ('infinity'::double))"


def _histogram(value: str, bounds) -> str:
    return f"""with {_EV}, {_bounds(bounds)}
        select event_type, le, count(*) filter (where {value} <= le) as cumulative, count({value}) as samples,
               round(sum({value}), 6) as total
        from ev cross join bounds group by event_type, le"""


def _quantile(label: str, value: str, bounds, q: float, minutes: int, name: str) -> str:
    keys = f"{label}window_start"
    top = max(bounds)
    return f"""with {_EV}, {_bounds(bounds)}, {_windows(minutes, label + value)},
        cum as (select {keys}, le, count(*) filter (where {value} <= le) as c from wins cross join bounds group by all),
        tot as (select {keys}, max(c) as samples from cum group by all),
        pos as (
          select *, lag(le) over (partition by {keys} order by le) as low,
                 coalesce(lag(c) over (partition by {keys} order by le), 0) as below from cum),
        hit as (
          select p.*, t.samples from pos p join tot t using ({keys}) where p.c >= {q} * t.samples and t.samples > 0
          qualify row_number() over (partition by {keys} order by le) = 1)
        select {keys}, samples, round(case when le = 'infinity'::double then {top}::double
                 when low is null and le <= 0 then le
                 else coalesce(low, 0) + (le - coalesce(low, 0)) * ({q} * samples - below) / (c - below) end, 6) as {name}
        from hit"""


SQL = {
    "metric_counters": """select event_type, case when event_type = 'error' then '500' else '200' end as status,
        count(*) as total from events group by all""",
    "metric_histogram": _histogram("seconds", metrics.LATENCY_BOUNDS),
    "chunk_histogram": _histogram("chunks", metrics.CHUNK_BOUNDS),
    "request_rate": f"""with {_EV}, {_windows(5, "event_type")}
        select event_type, window_start, window_end, count(*) as n, round(count(*) / 300.0, 6)::double as per_second
        from wins group by all""",
    "error_rate": f"""with {_EV}, {_windows(5, "event_type")}
        select window_start, window_end, count(*) as n, round(count(*) / 300.0, 6)::double as per_second
        from wins where event_type = 'error' group by all""",
    "latency_p95": _quantile("event_type, ", "seconds", metrics.LATENCY_BOUNDS, 0.95, 5, "p95"),
    "chunks_p50": _quantile("", "chunks", metrics.CHUNK_BOUNDS, 0.5, 10, "p50"),
    "avg_per_window": f"""with {_EV}, {_windows(10, "value")}
        select window_start, window_end, count(value) as samples, round(avg(value), 6) as mean from wins group by all""",
    "outcomes_hourly": """select event_type, date_trunc('hour', ts) as window_start, count(*) as n
        from events group by all""",
}
