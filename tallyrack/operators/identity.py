"""Catalog rows: merge offers of a variant, give ids across listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import identity as I
from ..functions.dialect import DUCK, SPARK

VARIANT = ("brand", "category", "model", "ram", "storage", "processor")
# A category's least and greatest price.
BOUNDS = {"laptop": (15_000, 700_000), "smartphone": (3_000, 300_000), "audio": (300, 200_000)}
ANY_BOUNDS = (100, 2_000_000)


def sku_overrides(parts: DataFrame, order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Sku -> (o_family, o_model) of the row that says most, the first of equals.  Aggregated before the shuffle."""
    best = F.max_by(F.struct("k_product_family", "k_model"), F.struct(F.expr(I.override_score()), -F.col(order))).alias("best")
    return parts.filter("k_strong").groupBy(*within, "k_sku").agg(best).select(*within, "k_sku", F.col("best.k_product_family").alias("o_family"), F.col("best.k_model").alias("o_model"))


def catalog_entities(df: DataFrame, order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Rows with their ids and confidences, each job (`within`) by itself where there are several.  The overrides
    are joined by key; the planner broadcasts them only when their size allows it."""
    parts = df.select("*", *(F.expr(sql).alias(c) for c, sql in I.parts(SPARK).items()))
    out = parts.join(sku_overrides(parts, order, within), [*within, "k_sku"], "left")
    out = out.withColumn("o_family", F.when(F.col("k_strong"), F.col("o_family"))).withColumn("o_model", F.when(F.col("k_strong"), F.col("o_model")))
    for step in I.key_steps(SPARK):
        out = out.select("*", *(F.expr(sql).alias(c) for c, sql in step.items()))
    return out.select(*df.columns, "cluster_confidence", "match_confidence", *(F.expr(sql).alias(c) for c, sql in I.ids(SPARK).items()))


def catalog_oracle(source: str, order: str, columns: list[str]) -> str:
    ctes = [f"s AS ({source})", "p AS (SELECT *, " + ", ".join(f"{sql} AS {c}" for c, sql in I.parts(DUCK).items()) + " FROM s)"]
    ctes.append(f"o AS (SELECT k_sku, k_product_family AS o_family, k_model AS o_model FROM (SELECT *, row_number() OVER (PARTITION BY k_sku ORDER BY {I.override_score()} DESC, {order}) AS k FROM p WHERE k_strong) WHERE k = 1)")
    ctes.append("j0 AS (SELECT p.*, CASE WHEN k_strong THEN o_family END AS o_family, CASE WHEN k_strong THEN o_model END AS o_model FROM p LEFT JOIN o USING (k_sku))")
    for k, step in enumerate(I.key_steps(DUCK), 1):
        ctes.append(f"j{k} AS (SELECT *, " + ", ".join(f"{sql} AS {c}" for c, sql in step.items()) + f" FROM j{k - 1})")
    return f"WITH {', '.join(ctes)} SELECT {', '.join(columns)}, cluster_confidence, match_confidence, " + ", ".join(f"{sql} AS {c}" for c, sql in I.ids(DUCK).items()) + f" FROM j{len(I.key_steps(DUCK))}"


def price_in_bounds(category: Column, price: Column) -> Column:
    out = price.between(*ANY_BOUNDS)
    for name, bounds in BOUNDS.items():
        out = F.when(category == name, price.between(*bounds)).otherwise(out)
    return F.when(out, price)


def discount(list_price: Column, effective: Column) -> Column:
    """Percent off, null unless above 0 and 95 at most."""
    percent = (list_price - effective) * 100.0 / list_price
    return F.when((list_price > effective) & (percent > 0) & (percent <= 95), F.round(percent, 2))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value made once: in a lambda each mention of an expression is evaluated by itself."""
    return F.element_at(F.transform(F.array(value), then), 1)


def reconciled(row: Column, names: list[str]) -> Column:
    """List, effective and plain price fill each other, within the category's bounds; the discount anew."""

    def filled(x: Column) -> Column:
        first = F.coalesce(x["effective_price_inr"], x["price_inr"], x["list_price_inr"])
        return F.struct(F.coalesce(x["category"], F.lit("product")).alias("category"), x["list_price_inr"].alias("listed"), first.alias("first"), F.coalesce(x["price_inr"], first).alias("plain"))

    def bounded(p: Column) -> Column:
        return F.struct(price_in_bounds(p["category"], p["first"]).alias("low"), price_in_bounds(p["category"], p["listed"]).alias("high"), p["plain"].alias("plain"))

    def agreed(p: Column) -> Column:
        high = F.when(p["low"].isNull() | ((p["high"] >= p["low"]) & (p["high"] <= p["low"] * 5)), p["high"])
        return F.struct(F.coalesce(p["low"], p["plain"]).alias("low"), high.alias("high"), p["plain"].alias("plain"))

    def whole(x: Column, p: Column) -> Column:
        new = {"list_price_inr": p["high"], "effective_price_inr": p["low"], "price_inr": p["plain"], "discount_percent": discount(p["high"], p["low"])}
        return F.struct(*((new[c] if c in new else x[c]).alias(c) for c in names))

    return _let(row, lambda x: _let(_let(_let(filled(x), bounded), agreed), lambda p: whole(x, p)))


def merge_variants(df: DataFrame, order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one variant (of one job, where `within` names it) folded in their order: first values that aren't blank, the greatest sku confidence,
    canonical if any is; prices reconciled after every merge (rows on their own are left as they are).

    The fold depends on its order, so a variant's rows meet in one array.  Repeats of equal rows are merged beforehand,
    which changes nothing in a fold that takes first values, and bounds the array by a variant's different rows.
    """
    names = [c for c in df.columns if c != order]
    kinds = dict(df.dtypes)
    once = df.groupBy(*names).agg(F.min(order).alias(order), F.max(order).alias("_last"), F.count(F.lit(1)).alias("_n"))
    key = [*within, *(F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).alias(f"_{c}") for c in VARIANT)]
    row = F.struct(F.col(order).alias("at"), F.struct(*names).alias("row"))
    groups = once.groupBy(*key).agg(F.sort_array(F.collect_list(row)).alias("rows"), F.sum("_n").alias("_n"), F.min(order).alias(order))

    def pick(a: Column, b: Column, c: str) -> Column:
        if c == "sku_confidence":
            return F.greatest(a[c], b[c])
        if c == "is_canonical_name":
            return F.when(a[c] | b[c], F.lit(True)).otherwise(F.coalesce(a[c], b[c]))
        return F.coalesce(F.nullif(F.trim(a[c]), F.lit("")) if kinds[c] == "string" else a[c], b[c])

    def fold(acc: Column, x: Column) -> Column:
        return reconciled(F.struct(*(pick(acc, x["row"], c).alias(c) for c in names)), names).cast(kind)

    kind = StructType([StructField(f.name, f.dataType) for f in df.schema if f.name != order])
    first = F.col("rows")[0]["row"].cast(kind)
    # a variant that only repeats one row is still merged with itself once
    rest = F.when(F.size("rows") > 1, F.slice("rows", 2, F.size("rows"))).when(F.col("_n") > 1, F.col("rows")).otherwise(F.slice("rows", 1, 0))
    merged = groups.select(order, F.aggregate(rest, first, fold).alias("m"))
    return merged.select(order, *(F.col(f"m.{c}").alias(c) for c in names))


def merge_oracle(source: str, order: str, columns: dict[str, str]) -> str:
    """merge_variants() as DuckDB SQL over a query: the rows of a variant folded one after another.  columns: names but
    for `order`, and whether each is text, flag, sure or other."""
    key = ", ".join(f"lower(trim(coalesce({c}, ''))) AS k_{c}" for c in VARIANT)
    keys = [f"k_{c}" for c in VARIANT]
    first = {"text": "coalesce(nullif(trim(f.{0}), ''), k.{0})", "flag": "CASE WHEN f.{0} OR k.{0} THEN true ELSE coalesce(f.{0}, k.{0}) END", "sure": "greatest(f.{0}, k.{0})", "other": "coalesce(f.{0}, k.{0})"}
    merged = ", ".join(f"{first[kind].format(c)} AS {c}" for c, kind in columns.items())
    bounds = lambda price: "CASE " + " ".join(f"WHEN category_ = '{name}' AND {price} BETWEEN {low} AND {high} THEN {price} WHEN category_ = '{name}' THEN null" for name, (low, high) in BOUNDS.items()) + f" WHEN {price} BETWEEN {ANY_BOUNDS[0]} AND {ANY_BOUNDS[1]} THEN {price} END"
    new = {"list_price_inr": "high", "effective_price_inr": "low", "price_inr": "plain", "discount_percent": "CASE WHEN high > low AND (high - low) * 100.0 / high > 0 AND (high - low) * 100.0 / high <= 95 THEN round((high - low) * 100.0::DOUBLE / high, 2) END"}
    out = ", ".join(f"{new.get(c, c)} AS {c}" for c in columns)
    names = ", ".join(columns)
    return f"""WITH RECURSIVE s AS ({source}), k AS (SELECT *, row_number() OVER (PARTITION BY {", ".join(keys)} ORDER BY {order}) AS n, min({order}) OVER (PARTITION BY {", ".join(keys)}) AS first_ FROM (SELECT *, {key} FROM s)),
    f AS (SELECT {", ".join(keys)}, n, first_, {names} FROM k WHERE n = 1 UNION ALL SELECT {", ".join(keys)}, n, first_, {out} FROM (
        SELECT * REPLACE (coalesce(low, plain) AS low, CASE WHEN low IS NULL OR (high >= low AND high <= low * 5) THEN high END AS high) FROM (
            SELECT *, {bounds("first__")} AS low, {bounds("list_price_inr")} AS high FROM (
                SELECT *, coalesce(category, 'product') AS category_, coalesce(effective_price_inr, price_inr, list_price_inr) AS first__, coalesce(price_inr, effective_price_inr, list_price_inr) AS plain FROM (
                    SELECT {", ".join(f"k.{c}" for c in keys)}, k.n, k.first_, {merged} FROM f JOIN k ON {" AND ".join(f"f.{c} = k.{c}" for c in keys)} AND k.n = f.n + 1)))))
    SELECT first_ AS {order}, {names} FROM (SELECT *, row_number() OVER (PARTITION BY {", ".join(keys)} ORDER BY n DESC) AS last_ FROM f) WHERE last_ = 1"""


def normalized_value(column: Column, kind: str) -> Column:
    """Null as '', fractions with four places, else trimmed lower text."""
    if kind in ("double", "float"):
        return F.coalesce(F.format_string("%.4f", column), F.lit(""))
    return F.coalesce(F.lower(F.trim(column.cast("string"))), F.lit(""))


def signature(df: DataFrame, columns: list[str]) -> Column:
    kinds = dict(df.dtypes)
    return F.array(*(normalized_value(F.col(c), kinds[c]) for c in columns))


def _sign(df: DataFrame, columns: list[str]) -> Column:
    return F.sha2(F.to_json(signature(df, columns)), 256)


def dedupe_rows(df: DataFrame, order: str, columns: list[str] | None = None) -> DataFrame:
    """The first row of each signature of all columns but `order`.  A row is carried to its signature's least
    place by an aggregate, which tasks combine before the exchange, so that a frequent row is no hot key."""
    columns = columns or [c for c in df.columns if c != order]
    first = F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.struct(F.col(order).isNull(), order))
    return df.groupBy(_sign(df, columns).alias("_s")).agg(first.alias("_r")).select("_r.*")


def duplicate_ratio(df: DataFrame, page: str, order: str, columns: list[str]) -> DataFrame:
    """Per page, rows seen on an earlier page or before on the same one, over all its rows: each signature has one
    row that isn't, on the first page that it is on."""
    counts = df.groupBy(_sign(df, columns).alias("_s"), F.col(page)).agg(F.count(F.lit(1)).alias("_n"))
    firsts = counts.groupBy("_s").agg(F.min(F.struct(F.col(page).isNotNull().alias("_there"), page)).alias("_first"))
    own = counts.groupBy(page).agg(F.sum("_n").alias("rows"))
    new = firsts.groupBy(F.col(f"_first.{page}").alias("_page")).agg(F.count(F.lit(1)).alias("_new"))
    both = own.join(new, F.col(page).eqNullSafe(F.col("_page")), "left").withColumn("duplicates", F.col("rows") - F.coalesce("_new", F.lit(0)))
    return both.select(page, "rows", "duplicates", (F.col("duplicates") / F.col("rows")).alias("ratio"))
