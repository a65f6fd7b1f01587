"""Exports (K1-K4)."""

from __future__ import annotations

import hashlib
import hmac
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..sources.writer import ExportSource


def canonical_rows(rows: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """K1: the selected columns (blank names dropped, missing ones null) or all; nested values as JSON text."""
    kinds = {f.name: f.dataType for f in rows.schema}
    names = [c for c in selected if c.strip()] if selected else rows.columns
    nested = lambda c: isinstance(kinds[c], (ArrayType, MapType, StructType))
    return rows.select(*((F.to_json(F.col(c)) if nested(c) else F.col(c)).alias(c) if c in kinds else F.lit(None).cast("string").alias(c) for c in names))


def columns_of(rows: DataFrame, order: str, data: str) -> DataFrame:
    """K1 for map rows: their keys in the order they are first seen."""
    return rows.select(order, F.posexplode(F.map_keys(data)).alias("pos", "name")).groupBy("name").agg(F.min(F.struct(order, "pos")).alias("at")).orderBy("at").select("name")

def discovered(rows: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """K1 for rows of JSON objects: (key, columns), each key's columns in the order its rows show them first.  Names are
    aggregated before they are shuffled; no key's rows meet."""
    each = rows.select(key, order, F.posexplode(F.json_object_keys(F.col(data))).alias("pos", "name"))
    first = each.groupBy(key, "name").agg(F.min(F.struct(order, "pos")).alias("at"))
    own = first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("columns"))
    bare = rows.select(key).distinct().join(own, key, "left")
    return bare.select(key, F.coalesce("columns", F.array().cast("array<string>")).alias("columns"))


def laid_out(rows: DataFrame, key: str, order: str, data: str, selected: DataFrame | None = None) -> DataFrame:
    """(key, order, columns, values): rows of JSON objects as arrays of text in their key's columns (or those that
    `selected` (key, columns) gives), null where a row has none; booleans and nested values as JSON has them."""
    columns = discovered(rows, key, order, data) if selected is None else selected.select(key, F.filter("columns", lambda c: F.trim(c) != "").alias("columns"))
    parsed = rows.select(key, order, F.from_json(F.col(data), "map<string,variant>").alias("_v")).join(columns, key)
    return parsed.select(key, order, "columns", F.transform("columns", lambda c: F.try_element_at("_v", c).cast("string")).alias("values"))


def _quoted(values: Column) -> Column:
    """A CSV line with minimal quoting; a lone blank is quoted, else its line would be empty."""
    cells = F.transform(values, lambda v: F.when(v.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(v, F.lit(""))))
    line = F.array_join(cells, ",")
    return F.when((F.size(values) == 1) & (line == ""), '""').otherwise(line)


def csv_lines(rows: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """K2: (key, order, line): the lines of each key's file, its header under a null order."""
    laid = laid_out(rows, key, order, data)
    heads = discovered(rows, key, order, data).filter(F.size("columns") > 0).select(key, F.lit(None).cast(dict(rows.dtypes)[order]).alias(order), _quoted(F.col("columns")).alias("line"))
    return laid.select(key, order, _quoted(F.col("values")).alias("line")).unionByName(heads)


def json_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """K2: one JSON object a row with nulls written out, in row order within the key; array_of joins them."""
    body = F.to_json(F.struct(*(c for c in rows.columns if c not in (key, order))), {"ignoreNullFields": "false"})
    return rows.select(key, order, body.alias("json"))


def array_of(lines: DataFrame, key: str, order: str) -> DataFrame:
    """A key's rows as one JSON array; a key is one job of a bounded number of rows."""
    sorted_lines = F.transform(F.sort_array(F.collect_list(F.struct(order, "json"))), lambda x: x["json"])
    return lines.groupBy(key).agg(F.concat(F.lit("["), F.array_join(sorted_lines, ","), F.lit("]")).alias("json"))


def write_csv(rows: DataFrame, path: str, selected: list[str] | None = None, key: str | None = None) -> None:
    """K2, K3: CSV with a header, CRLF and minimal quoting, null as nothing; a folder for each key."""
    out = canonical_rows(rows, selected)
    writer = out.write.option("header", True).option("lineSep", "\r\n").option("nullValue", "").option("emptyValue", "").option("escape", '"')
    (writer.partitionBy(key) if key else writer).csv(path)


def sign(export_id: str, expires: int, secret: str) -> str:
    """K3: the token of a download link."""
    return hmac.new(secret.encode(), f"{export_id}:{expires}".encode(), hashlib.sha256).hexdigest()


def export_path(root: str, job_id: str, export_id: str, kind: str) -> str:
    """K3: where an export lies."""
    kind = kind.strip().lower()
    if kind not in ("csv", "json"):
        raise ValueError(f"unsupported export format: {kind}")
    return f"{root.rstrip('/')}/{job_id}/{export_id}.{kind}"


def signed_url(base: str, export_id: str, secret: str, now: int, ttl: int) -> str:
    """K3: a download link that holds for `ttl` seconds, a minute at least."""
    expires = now + max(60, int(ttl))
    return f"{base.rstrip('/')}/api/v1/exports/{quote(export_id)}/download?expires={expires}&token={sign(export_id, expires, secret)}"


def verify(export_id: str, expires: int, token: str, secret: str, now: int) -> bool:
    return expires >= now and hmac.compare_digest(sign(export_id, expires, secret), token)


def export_jobs(rows: DataFrame, exports: DataFrame, root: str, kind: str) -> None:
    """K2, K3, K5: exports (job_id, export_id; columns where some are selected) of rows (job_id, row_index, data JSON
    object) as files.  A job without rows isn't exported."""
    rows = rows.select(F.col("job_id").cast("string").alias("job_id"), F.col("row_index").cast("long").alias("row_index"), "data")
    wanted = exports.select(F.col("job_id").cast("string").alias("job_id"), F.col("export_id").cast("string").alias("export_id"), *([F.filter("columns", lambda c: F.trim(c) != "").alias("asked")] if "columns" in exports.columns else []))
    found = wanted.join(discovered(rows, "job_id", "row_index", "data"), "job_id")
    if "asked" in wanted.columns:
        found = found.withColumn("columns", F.when(F.size("asked") > 0, F.col("asked")).otherwise(F.col("columns"))).drop("asked")
    rows.sparkSession.dataSource.register(ExportSource)
    out = rows.join(found, "job_id").select("job_id", "export_id", "columns", "row_index", "data")
    out.repartition("job_id", "export_id").sortWithinPartitions("job_id", "export_id", "row_index").write.format("catalog_export").option("root", root).option("kind", kind).mode("append").save()
