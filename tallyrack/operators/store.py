"""Jobs, rows, templates, exports and usage as tables: paging, lookups, versions, health, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import settle

EXPORTABLE = ("success", "partial_success")
TERMINAL = ("success", "partial_success", "failed", "cancelled")


def visible(df: DataFrame, grants: DataFrame | None, project: str = "project_id") -> DataFrame:
    """all rows for an admin (no grants given), else those of granted projects; '*' grants all."""
    if grants is None or not grants.filter("project_id = '*'").isEmpty():
        return df
    return df.join(grants.select(F.col("project_id").alias(project)).distinct(), project, "left_semi")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> tuple[int, DataFrame]:
    """L1, L2: the total and one page; the page is a bounded top-k and no global sort."""
    return df.count(), df.orderBy(*order).offset(offset).limit(limit)


def job_status(jobs: DataFrame) -> DataFrame:
    """L3: progress, and an error only where the job failed."""
    error = F.when(F.col("status") == "failed", F.struct(F.lit("run_failed").alias("code"), F.coalesce(F.element_at("warnings", -1), F.lit("")).alias("message")))
    return jobs.select("job_id", "status", "progress", error.alias("error"))


def job_with_rows(jobs: DataFrame, rows: DataFrame, job_id) -> DataFrame:
    """One job and its rows in order."""
    own = rows.filter(F.col("job_id") == job_id).groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("row_index", "row"))).alias("rows"))
    return jobs.filter(F.col("job_id") == job_id).join(own, "job_id", "left")


def status_bucket(status: Column) -> Column:
    return F.when(status.isin(*TERMINAL), "terminal").otherwise("active")


def transition(status: Column, action: str) -> Column:
    """U4: retry starts failed or cancelled jobs again, cancel stops those that aren't over; null where refused."""
    if action == "retry":
        return F.when(status.isin("failed", "cancelled"), F.lit("queued"))
    if action == "cancel":
        return F.when(~status.isin(*TERMINAL), F.lit("cancelled"))
    raise ValueError(action)


def list_templates(templates: DataFrame, domain: str | None = None, page_type: str | None = None) -> DataFrame:
    """L4."""
    if domain:
        templates = templates.filter(F.col("domain") == domain)
    if page_type:
        templates = templates.filter(F.col("page_type") == page_type)
    return templates.orderBy(F.desc("success_rate"), F.desc("version"), F.desc("updated_at"))


def match_templates(pages: DataFrame, templates: DataFrame, page_type: str | None = None) -> DataFrame:
    """For each page (page_id, domain, fingerprint; template_id if one was asked for) the template: the one asked
    for or none, else an exact fingerprint beats another, then the better success rate, version and update.  Templates
    that are invalidated, or of another page type where one is given, never match.  Best templates are reduced to one
    for each fingerprint and one for each domain first, so that a page meets two rows and not all its domain's
    templates."""
    good = templates.filter("NOT invalidated")
    typed = good.filter(F.col("page_type") == page_type) if page_type else good
    best = F.max_by("template_id", F.struct("success_rate", "version", "updated_at", "template_id"))
    exact = typed.filter("page_fingerprint IS NOT NULL").groupBy("domain", F.col("page_fingerprint").alias("fingerprint")).agg(best.alias("exact_id"))
    other = typed.groupBy("domain").agg(best.alias("domain_id"))
    out = pages.join(exact, ["domain", "fingerprint"], "left").join(other, "domain", "left")
    found, sure = F.coalesce("exact_id", "domain_id"), F.col("exact_id").isNotNull()
    if "template_id" in pages.columns:
        out = out.withColumnRenamed("template_id", "_asked").join(good.select(F.col("template_id").alias("_own")), F.col("_asked") == F.col("_own"), "left")
        found, sure = F.when(F.col("_asked").isNotNull(), F.col("_own")).otherwise(found), F.col("_asked").isNull() & sure
    return out.select("page_id", "domain", found.alias("template_id"), sure.alias("exact"))


def template_candidates(templates: DataFrame) -> DataFrame:
    """(domain, template_id) of the templates that match_templates() can give a page it isn't asked one for: the best of
    each fingerprint and of each domain."""
    good = templates.filter("NOT invalidated")
    best = F.max_by("template_id", F.struct("success_rate", "version", "updated_at", "template_id")).alias("template_id")
    exact = good.filter("page_fingerprint IS NOT NULL").groupBy("domain", "page_fingerprint").agg(best).select("domain", "template_id")
    return exact.unionByName(good.groupBy("domain").agg(best)).distinct()


def due(jobs: DataFrame) -> DataFrame:
    """Jobs to run.  One that has succeeded or was cancelled is delivered again in vain, unless it is forced; a job
    that was delivered several times runs once."""
    known = set(jobs.columns)
    over = F.coalesce(F.col("status").isin("success", "partial_success", "cancelled"), F.lit(False)) if "status" in known else F.lit(False)
    forced = F.coalesce("force", F.lit(False)) if "force" in known else F.lit(False)
    return jobs.filter(~over | forced).dropDuplicates(["job_id"])


def version_templates(templates: DataFrame, order: str) -> DataFrame:
    """Version and parent within (domain, page_type, fingerprint), nulls equal, in the order saved.  A version that
    was given is kept if it is above the next one: v(k) = max(given(k), v(k-1) + 1), in closed form the running maximum
    of given(k) - k, plus k."""
    lineage = Window.partitionBy("domain", "page_type", "page_fingerprint").orderBy(order)
    k = F.row_number().over(lineage)
    numbered = templates.withColumn("_k", k)
    if "version" in templates.columns:
        numbered = numbered.withColumn("version", (F.greatest(F.max(F.col("version") - F.col("_k")).over(lineage), F.lit(0)) + F.col("_k")).cast("int"))
    else:
        numbered = numbered.withColumn("version", F.col("_k"))
    return numbered.withColumn("parent_template_id", F.lag("template_id").over(lineage)).drop("_k")


def template_health(events: DataFrame, key: str, order: str) -> DataFrame:
    """(key, success, order) -> counts, rate and whether three failures have invalidated it since the last success.

    Closed form of the fold: invalidated if the last event is a failure and there are three or more in all."""
    out = events.groupBy(key).agg(F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("failure_count"), F.max_by("success", order).alias("_last"))
    rate = F.col("success_count") / (F.col("success_count") + F.col("failure_count"))
    return out.select(key, "success_count", "failure_count", F.round(rate, 4).alias("success_rate"), (~F.col("_last") & (F.col("failure_count") >= 3)).alias("invalidated"))


def visible_exports(exports: DataFrame, jobs: DataFrame, grants: DataFrame | None = None) -> DataFrame:
    """Exports of visible jobs by one semi join."""
    return exports.join(visible(jobs, grants).select("job_id"), "job_id", "left_semi")


def exportable(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """K5: finished jobs with a row or more."""
    return jobs.filter(F.col("status").isin(*EXPORTABLE)).join(rows.select("job_id"), "job_id", "left_semi")


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last version of each key of an append log."""
    return log.groupBy(key).agg(F.max_by(F.struct(*(c for c in log.columns if c != key)), order).alias("_r")).select(key, "_r.*")


def with_ids(events: DataFrame, order: list[str], start: int = 1, key: str = "id") -> DataFrame:
    """Increasing ids in the given order without gathering it in one task: ranges, their counts, then ranks within.
    The ranges are written, so that counts and rows agree."""
    ranged = settle(events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(counts.select("_p", "_first", before.alias("_before"))), "_p").withColumn(key, F.col("_i") - F.col("_first") + F.col("_before") + start).drop("_p", "_i", "_first", "_before")


def cleanup(jobs: DataFrame, rows: DataFrame, exports: DataFrame, events: DataFrame, templates: DataFrame, cutoff: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """What stays after retention, and one row of counts.  Rows and exports go with their jobs."""
    old = jobs.filter(F.col("created_at") < cutoff).select("job_id")
    stale = (F.col("updated_at") < cutoff) & F.col("invalidated")
    kept = {
        "jobs": jobs.filter(~(F.col("created_at") < cutoff)), "rows": rows.join(old, "job_id", "left_anti"), "exports": exports.join(old, "job_id", "left_anti"),
        "events": events.filter(~(F.col("created_at") < cutoff)), "templates": templates.filter(~stale),
    }
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = one(old, "jobs_deleted").crossJoin(one(rows.join(old, "job_id", "left_semi"), "rows_deleted")).crossJoin(one(exports.join(old, "job_id", "left_semi"), "exports_deleted"))
    return kept, counts.crossJoin(one(events.filter(F.col("created_at") < cutoff), "events_deleted")).crossJoin(one(templates.filter(stale), "templates_deleted"))


def valid_email(email: Column) -> Column:
    """something before the first @, and a dot after it."""
    return F.coalesce(email.rlike(r"(?s)^[^@]+@.*\."), F.lit(False))


def accounts(users: DataFrame, credentials: DataFrame, workspaces: DataFrame, projects: DataFrame) -> DataFrame:
    """User, credential, earliest workspace and its earliest project.  Of users with one email, however written, the
    first counts; malformed emails have no account (F13)."""
    users = users.withColumn("email", F.lower(F.trim("email"))).filter(valid_email(F.col("email")))
    users = users.groupBy("email").agg(F.min_by(F.struct(*(c for c in users.columns if c != "email")), "user_id").alias("_u")).select("email", "_u.*")
    space = workspaces.groupBy("user_id").agg(F.min_by("workspace_id", F.struct("created_at", "workspace_id")).alias("workspace_id"))
    project = projects.groupBy("workspace_id").agg(F.min_by("project_id", F.struct("created_at", "project_id")).alias("project_id"))
    return users.join(credentials, "user_id").join(space, "user_id", "left").join(project, "workspace_id", "left")
