"""Request metrics (G15) and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request_metrics(log: DataFrame) -> DataFrame:
    """(method, path, status, duration_ms) -> counts and durations, by method, path and status."""
    return log.groupBy("method", "path", "status").agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("duration_ms"), 4).alias("duration_ms_sum"))


def blocked(log: DataFrame) -> DataFrame:
    """Rate-limited (429) and unauthorised (401) requests by path."""
    return log.groupBy("path").agg(F.count_if(F.col("status") == 429).alias("rate_limited"), F.count_if(F.col("status") == 401).alias("auth_failed")).filter("rate_limited + auth_failed > 0")


def exposition(metrics: DataFrame, name: str = "http_requests_total") -> DataFrame:
    """Counters as exposition text lines, sorted by key."""
    return metrics.orderBy("method", "path", "status").select(F.format_string(f'{name}{{method="%s",path="%s",status="%d"}} %d', "method", "path", "status", "requests").alias("line"))


def distinct_in_order(items: Column) -> Column:
    """The first of each, in order."""
    return F.array_distinct(items)


def label_counts(labels: DataFrame) -> DataFrame:
    """Blank labels count as unclassified."""
    return labels.groupBy(F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("unclassified")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def summary(rows: DataFrame, key: str, page_type: Column, columns: list[str]) -> DataFrame:
    """One sentence a job."""
    fields = ", ".join(columns[:8])
    return rows.groupBy(key, page_type.alias("page_type")).agg(F.count(F.lit(1)).alias("n")).select(key, F.format_string(f"Extracted %d %s rows with fields: {fields}.", "n", "page_type").alias("summary"))


def log_lines(log: DataFrame) -> DataFrame:
    """(request_id, method, path, status, duration_ms and, where they are known, trace_id, workspace_id, user_id) ->
    one compact JSON line a request; blank ids are left out."""
    others = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("trace_id", "workspace_id", "user_id") if c in log.columns]
    body = F.struct("request_id", "method", "path", F.col("status").alias("status_code"), F.round("duration_ms", 3).alias("duration_ms"), *others)
    return log.select("request_id", F.to_json(body).alias("line"))
