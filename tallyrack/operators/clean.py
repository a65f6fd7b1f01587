"""Raw product records to clean ones: normalise, validate against the source, keep the fullest of each key.

Projections only until the one exchange of the duplicate removal; every function is native.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from ..functions import records as R
from ..functions import urls as U
from ..functions.dialect import SPARK, Dialect

#: Columns of a raw record; missing ones are read as null.
RAW = ("title", "description", "specs", "details", "subtitle", "breadcrumbs", "brand", "category", "model", "variant", "ram", "storage", "processor", "display", "os", "availability", "rating_text", "review_text", "product_url", "url", "link", "price", "price_inr", "rating", "review_count")
#: A record needs one of these columns.
IDENTITY = ("title", "model", "product_url", "url", "link")
KEY = ("brand", "model", "ram", "storage", "processor")


def blank_to_null(column: Column, kind: DataType) -> Column:
    """Trims texts and makes blank ones null, within structs and arrays too."""
    if isinstance(kind, StringType):
        return F.nullif(F.trim(column), F.lit(""))
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: blank_to_null(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(column.isNotNull(), F.struct(*(blank_to_null(column[f.name], f.dataType).alias(f.name) for f in kind)))
    return column


def replace_empty(df: DataFrame) -> DataFrame:
    return df.select(*(blank_to_null(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def load_records(spark, path: str) -> DataFrame:
    """A JSON file with an array of objects.  An identity column must be there; scalar columns must be scalar."""
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    if not set(IDENTITY) & set(df.columns):
        raise ValueError("records have no title, model or link")
    nested = [f.name for f in df.schema if f.name in RAW and isinstance(f.dataType, (ArrayType, StructType))]
    if nested:
        raise ValueError(f"not scalar: {', '.join(nested)}")
    return replace_empty(df)


def steps(d: Dialect) -> list[dict[str, str]]:
    """C17 as projections one on another: each step's new columns, as SQL over the columns before."""
    details = "concat_ws(' ', description, specs, details, subtitle)"
    first = {"clean": R.title(d, "title"), "details_text": details, "link_raw": U.with_scheme(d, "coalesce(nullif(product_url, ''), nullif(url, ''), nullif(link, ''))")}
    second = {"link_": U.product_link(d, "link_raw"), "heard": "concat_ws(' ', title, details_text)", "blob": "concat_ws(' ', title, description, specs, details, breadcrumbs, price, product_url, url, link)"}
    slugged = {"slug": f"coalesce({U.slug(d, 'link_')}, '')"}
    branded = {"brand_raw": R.brand_text(d, "brand", "clean", "slug"), "model_raw": R.model_text(d, "model", "clean")}
    third = {
        "n_brand": R.brand(d, "brand_raw"), "n_category": R.category(d, "category", "clean", "slug", "breadcrumbs"), "n_variant": R.variant(d, "variant", "clean"),
        "n_processor": R.processor(d, "concat_ws(' ', processor, clean, details_text, slug)"), "own_ram": R.own_ram(d, "ram"), "own_storage": R.own_storage(d, "storage"),
        "m_ram": R.memory_text(d, "trim(ram)", "clean", "details_text", "slug"), "m_storage": R.memory_text(d, "trim(storage)", "clean", "details_text", "slug"),
        "n_display": R.display(d, "display", "concat_ws(' ', clean, details_text)"), "n_os": R.system(d, "os", "concat_ws(' ', clean, details_text)"),
        "n_availability": R.availability(d, "availability", "heard"), "n_price": f"CASE WHEN price_inr IS NOT NULL THEN {R.price(d, 'price_inr')} ELSE {R.price(d, 'price')} END",
        "n_rating": d.either(f"nullif({R.rating(d, 'rating')}, 0)", R.rating_in(d, "concat_ws(' ', title, details_text, rating_text)")),
        "n_reviews": d.either(f"nullif({R.review_count(d, 'review_count')}, 0)", R.reviews_in(d, "concat_ws(' ', title, details_text, review_text)")),
    }
    fourth = {"sizes_ram": R.memory_list(d, "m_ram"), "sizes_storage": R.memory_list(d, "m_storage"), "n_model": R.model(d, "model_raw", "n_brand")}
    fifth = {"any_ram": R.memory_specs(d, "m_ram", "sizes_ram")[0], "any_storage": R.memory_specs(d, "m_storage", "sizes_storage")[1]}
    sixth = {"any_storage2": R.with_medium(d, "any_storage", "m_storage")}
    return [first, second, slugged, branded, third, fourth, fifth, sixth]


def projection(d: Dialect) -> dict[str, str]:
    model = "CASE WHEN n_model <> '' AND NOT contains(lower(n_model), 'http') THEN n_model END"
    return {"brand": "n_brand", "category": "n_category", "model": model, "variant": "n_variant", "ram": "coalesce(own_ram, any_ram)", "storage": "coalesce(own_storage, any_storage2)", "processor": "n_processor", "display": "n_display", "os": "n_os", "price_inr": "n_price", "rating": "n_rating", "review_count": "n_reviews", "availability": "n_availability", "product_url": "link_"}


def validity(d: Dialect) -> str:
    """F9 over the projection and the source's blob."""
    memory = f"({R.memory_signal(d, 'blob')} AND ((ram IS NULL AND {d.match('blob', r'\bram\b')}) OR (storage IS NULL AND {d.match('blob', r'\b(ssd|hdd|rom|ufs|emmc|storage)\b')})))"
    return f"NOT {R.placeholder(d, 'brand')} AND NOT {R.placeholder(d, 'model')} AND NOT {d.match('model', 'https?://|pid=|lid=')} AND {U.is_product_page(d, 'product_url')} AND {R.realistic_price(d, 'category', 'price_inr')} AND NOT {memory}"


def normalize(df: DataFrame, *keep: str) -> DataFrame:
    """Raw records -> the 14 columns, the kept ones and `blob`."""
    df = df.select(*(F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in RAW), *keep)
    for step in steps(SPARK):
        df = df.select("*", *(F.expr(sql).alias(name) for name, sql in step.items()))
    return df.select(*keep, *(F.expr(sql).alias(name) for name, sql in projection(SPARK).items()), "blob")


def valid(df: DataFrame) -> DataFrame:
    """The normalised records that F9 lets pass.

    The row number keeps the predicate above the projections: pushed below them, each of the columns it reads would be
    written out again in it, with all that they are made of; and a plain column keeps constraint inference small.
    """
    held = df.withColumn("_valid", F.expr(validity(SPARK))).withColumn("_row", F.monotonically_increasing_id())
    return held.filter("_row >= 0 AND _valid").drop("_row", "_valid", "blob")


def completeness() -> str:
    """C18, in either dialect."""
    return " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in R.OUTPUT)


def dedupe(df: DataFrame, order: str) -> DataFrame:
    """Of each key the fullest record, the earliest of equals; `order` becomes the key's first place."""
    key = [F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).alias(f"_{c}") for c in KEY]
    others = [c for c in df.columns if c != order]
    best = F.max_by(F.struct(*others), F.struct(F.expr(completeness()).alias("full"), (-F.col(order)).alias("early")))
    return df.groupBy(*key).agg(F.min(order).alias(order), best.alias("_r")).select(order, *(F.col(f"_r.{c}").alias(c) for c in others)).select(*df.columns)


def clean(df: DataFrame, order: str) -> DataFrame:
    """C20: `order` is the records' place in the source; the result is one row a key, its first place kept."""
    return dedupe(valid(normalize(df, order)), order)


def to_json(df: DataFrame, path: str, order: str) -> None:
    """The result as JSON lines with nulls written out, one directory."""
    df.orderBy(order).drop(order).write.option("ignoreNullFields", False).json(path)


def oracle(source: str, order: str, unique: bool) -> str:
    """The same as DuckDB SQL over a query with the raw columns that it has named."""
    from ..functions.dialect import DUCK as d

    ctes, last = [f"s0 AS ({source})"], "s0"
    for k, step in enumerate(steps(d), 1):
        ctes.append(f"s{k} AS (SELECT *, " + ", ".join(f"{sql} AS {name}" for name, sql in step.items()) + f" FROM {last})")
        last = f"s{k}"
    ctes.append(f"n AS (SELECT {order}, " + ", ".join(f"{sql} AS {name}" for name, sql in projection(d).items()) + f", blob FROM {last})")
    ctes.append(f"v AS (SELECT * EXCLUDE (blob) FROM n WHERE {validity(d)})")
    if not unique:
        return f"WITH {', '.join(ctes)} SELECT * FROM v"
    key = ", ".join(f"lower(trim(coalesce({c}, '')))" for c in KEY)
    ctes.append(f"r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {completeness()} DESC, {order}) AS k, min({order}) OVER (PARTITION BY {key}) AS f FROM v)")
    return f"WITH {', '.join(ctes)} SELECT * EXCLUDE ({order}, k, f), f AS {order} FROM r WHERE k = 1"
