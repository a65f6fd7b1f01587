"""Labels from a table in place of a model's call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of a field.
KINDS = ("text", "money", "rating", "url", "number", "date", "email", "phone", "boolean")

# Words in a field's name that tell its kind, in order.
KIND_WORDS = {
    "url": ("url", "link", "href", "website"), "money": ("price", "amount", "cost", "mrp"), "rating": ("rating", "score", "stars", "review"),
    "date": ("date", "time", "published", "created"), "email": ("email", "mail"), "phone": ("phone", "mobile", "contact"),
}


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def field_score(stability: Column, proximity: Column, validity: Column, reliability: Column, agreement: Column) -> Column:
    """X41."""
    return F.round(clamp(0.35 * clamp(stability) + 0.2 * clamp(proximity) + 0.2 * clamp(validity) + 0.15 * clamp(reliability) + 0.1 * clamp(agreement)), 2)


def combined_confidence(base: Column, label: Column) -> Column:
    """X42."""
    return F.round(clamp(0.45 * base + 0.55 * label), 2)


def estimated_tokens(text: Column) -> Column:
    """X43."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4))


def field_name(name: Column) -> Column:
    """Snake case, 64 characters at most, `field` if nothing is left."""
    snake = F.btrim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(F.substring(snake, 1, 64), F.lit("")), F.lit("field"))


def kind_of(name: Column) -> Column:
    """A field's kind by its name."""
    n, out = F.lower(name), F.lit("text")
    for kind, words in reversed(KIND_WORDS.items()):
        for w in words:
            out = F.when(F.contains(n, F.lit(w)), kind).otherwise(out)
    return out


def sample_rows(rows: DataFrame, columns: list[str], most: int = 5, width: int = 80) -> DataFrame:
    """A2: the first rows, white space collapsed, values cut."""
    return rows.limit(most).select(*(F.substring(F.trim(F.regexp_replace(F.col(c).cast("string"), r"(?U)\s+", " ")), 1, width).alias(c) for c in columns))


def fit_budget(rows: DataFrame, key: str, order: str, budget: int) -> DataFrame:
    """A2: per key the longest prefix of rows whose JSON stays within the budget."""
    size = F.length(F.to_json(F.struct(*(c for c in rows.columns if c not in (key, order))))) + 1
    return rows.withColumn("_s", F.sum(size).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_s") <= budget).drop("_s")


def validate_labels(fields: DataFrame, labels: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """A3: fields (source, position) and labels (source, position, name, kind, confidence), each of a job where `key`
    names it: of each known source the first label, its kind whitelisted or inferred, confidence .75 by default; sources
    without one at .65."""
    first = labels.filter("trim(name) <> ''").groupBy(*key, "source").agg(F.min_by(F.struct("name", "kind", "confidence"), F.struct("position", "name", "kind", "confidence")).alias("l"))
    out = fields.join(first, [*key, "source"], "left")
    # The name is a column of its own before its kind is told: else each word looked for works it out again.
    out = out.select(*key, "source", "position", "l", field_name(F.coalesce(F.col("l.name"), F.col("source"))).alias("name"))
    name = F.col("name")
    kind = F.when(F.lower("l.kind").isin(*KINDS), F.lower("l.kind")).otherwise(kind_of(name))
    confidence = F.when(F.col("l").isNull(), F.lit(0.65)).otherwise(clamp(F.coalesce("l.confidence", F.lit(0.75))))
    return out.select(*key, "source", "position", "name", kind.alias("kind"), confidence.alias("confidence"))


def rename_target(key: tuple[str, ...] = ()) -> Column:
    """A4: a source's target; later sources of one target get _2, _3 and so on, within a job."""
    k = F.row_number().over(Window.partitionBy(*key, "name").orderBy("position", "source"))
    return F.when(k == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), k))


def rename_map(validated: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """A4: source -> target."""
    return validated.select(*key, "source", "position", rename_target(key).alias("target"))


def apply_rename(rows: DataFrame, targets: dict[str, str]) -> DataFrame:
    return rows.select(*(F.col(c).alias(targets.get(c, c)) for c in rows.columns))


def row_labels(labels: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """A5: per key labels whose row_index lies in 1..n, the first of each, confidence .7 by default."""
    ranged = labels.join(counts, key).filter("row_index BETWEEN 1 AND n AND trim(label) <> ''")
    first = ranged.groupBy(key, "row_index").agg(F.min_by(F.struct("label", "confidence"), "position").alias("l"))
    return first.select(key, "row_index", F.trim("l.label").alias("label"), clamp(F.coalesce("l.confidence", F.lit(0.7))).alias("confidence"))


def label_plan(jobs: DataFrame, cache: DataFrame, model: str, most_tokens: int, prefix: str = "ai_planner", has_key: bool = True, supported: bool = True) -> DataFrame:
    """A1, A5: jobs (job_id, context) and known answers (cache_key) -> (job_id, cache_key, hit, warnings): whose labels are
    known already, and why a job gets none: no key, another provider, a context over the budget."""
    known = cache.select("cache_key").distinct().withColumn("_hit", F.lit(True))
    keyed = jobs.select("job_id", "context", F.sha1(F.concat(F.lit(f"{model}|"), "context")).alias("cache_key")).join(known, "cache_key", "left")
    why = F.lit("skipped_no_api_key") if not has_key else F.lit("provider_unsupported") if not supported else F.when(estimated_tokens(F.col("context")) > most_tokens, "skipped_input_budget").when(F.col("_hit"), "cache_hit")
    said = F.when(why.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit(f"{prefix}_"), why)))
    return keyed.select("job_id", "cache_key", F.coalesce(why == "cache_hit", F.lit(False)).alias("hit"), said.alias("warnings"))


def insight_summary(given: Column, heuristic: Column) -> Column:
    """A5: the summary that was given, unless it is blank; else the heuristic one (G16), or that there is nothing."""
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), heuristic, F.lit("No rows available for summarization/classification."))


def recover_json(text: Column, schema: str) -> Column:
    """The object between the outermost braces of a reply; null if there is none."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)
