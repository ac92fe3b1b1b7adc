"""What a reviewer enters at a checkpoint, applied to the run's tables: names, comments, ticks, decisions on findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import runs

#: How long a file's comment and a finding's note may be, and the names that a review file usually has.
COMMENT, NOTE = 4000, 2000
REVIEW_FILES = ("07-gate2-review.md", "07-code-review.md", "07-review.md")
REVIEW_SHAPE = r"(?i)^0?7[-_].*review.*\.md$"
#: Seconds for which a built artifact counts as fresh.
FRESH_S = 7200
ENTRY = "array<struct<id: string, object: string, type: string, created_in: string, name: string>>"


def last_entries(entries: DataFrame, *keys: str) -> DataFrame:
    """Of entries (the keys, n and values) the last per key, by n."""
    rest = [c for c in entries.columns if c not in keys]
    order = F.struct("n", *[c for c in rest if c != "n"])
    return entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_e")).select(*keys, *[F.col(f"_e.{c}").alias(c) for c in rest if c != "n"])


def edited_names(names: DataFrame, edits: DataFrame, swaps: DataFrame) -> DataFrame:
    """Naming contracts (run, id, object, type, created_in, name) after `swaps` (run, contract, n) replaced some wholesale (by nothing, where
    the list is empty) and `edits` (run, id, name, n) gave single names, trimmed; the last of each counts. An edit of an id that the contract lacks
    does nothing."""
    swapped = last_entries(swaps.select("run", F.col("contract").cast(ENTRY).alias("contract"), "n").where("contract IS NOT NULL"), "run")
    given = swapped.select("run", F.explode("contract").alias("e")).select("run", *[F.coalesce(F.col(f"e.{c}"), F.lit("")).alias(c) for c in ("id", "object", "type", "created_in")], F.trim(F.coalesce("e.name", F.lit(""))).alias("name"))
    kept = names.join(swapped.select("run"), "run", "left_anti").select(*given.columns)
    wanted = last_entries(edits.select("run", "id", F.trim(F.coalesce("name", F.lit(""))).alias("_name"), "n"), "run", "id")
    return kept.unionByName(given).join(wanted, ["run", "id"], "left").withColumn("name", F.coalesce("_name", "name")).select(*given.columns)


def name_counts(names: DataFrame) -> DataFrame:
    """run, valid and total names."""
    return names.groupBy("run").agg(F.count_if(F.coalesce(runs.name_ok(F.col("name"), F.col("created_in")), F.lit(False))).alias("valid"), F.count(F.lit(1)).alias("total"))


def commented_files(files: DataFrame, comments: DataFrame) -> DataFrame:
    """Files (run, id, comment and more) with the last comment (run, id, text, n) on each, cut to 4,000 characters; others keep theirs."""
    said = last_entries(comments.select("run", "id", F.left(F.coalesce("text", F.lit("")), F.lit(COMMENT)).alias("_text"), "n"), "run", "id")
    return files.join(said, ["run", "id"], "left").select(*[F.coalesce("_text", "comment").alias(c) if c == "comment" else F.col(c) for c in files.columns])


def comment_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("run").agg(F.count_if(F.trim(F.coalesce("comment", F.lit(""))) != "").alias("commented"), F.count(F.lit(1)).alias("total"))


def ticked(checklist: Column, checked: Column) -> Column:
    """A tick for each item of a checklist: missing and null ones are false, ticks beyond the list are dropped."""
    return F.transform(F.sequence(F.lit(0), F.size(checklist) - 1), lambda k: F.coalesce(F.get(checked, k), F.lit(False)))


def checklist_state(lists: DataFrame, ticks: DataFrame) -> DataFrame:
    """run, state (a tick per item), checked and total of runs (run, checklist) with the last ticks (run, checked, n). Runs without items go."""
    last = last_entries(ticks.select("run", F.col("checked").alias("_ticks"), "n"), "run")
    j = lists.where(F.size(F.coalesce("checklist", F.array())) > 0).join(last, "run", "left")
    state = j.select("run", ticked(F.col("checklist"), F.coalesce("_ticks", F.array().cast("array<boolean>"))).alias("state"))
    return state.withColumn("checked", F.size(F.filter("state", lambda s: s)).cast("long")).withColumn("total", F.size("state").cast("long"))


def decided(review: DataFrame, actions: DataFrame) -> DataFrame:
    """Findings under review (run, id, action, notes) after the last action on each (run, id, action, notes, n): another action than fix or
    accept, and empty notes, change nothing; notes are cut to 2,000 characters."""
    last = last_entries(actions.where(F.col("id").cast("string") != "").select("run", "id", F.col("action").alias("_action"), F.col("notes").alias("_notes"), "n"), "run", "id")
    action = F.coalesce(F.when(F.col("_action").isin("fix", "accept"), F.col("_action")), "action")
    notes = F.coalesce(F.left(F.nullif("_notes", F.lit("")), F.lit(NOTE)), "notes")
    return review.join(last, ["run", "id"], "left").withColumns({"action": action, "notes": notes}).select(*review.columns)


def synced_findings(findings: DataFrame, review: DataFrame) -> DataFrame:
    """Findings (run, id, severity, status) with the status that the review's actions mean."""
    acted = review.where("action IN ('fix', 'accept')").groupBy("run", "id").agg(F.max("action").alias("_action"))
    status = F.when(F.col("_action") == "accept", "Accepted").when(F.col("_action") == "fix", "Pending Fix").otherwise(F.col("status"))
    return findings.join(acted, ["run", "id"], "left").withColumn("status", status).select(*findings.columns)


def review_result(findings: DataFrame, review: DataFrame) -> DataFrame:
    """run, score (severities in any case, no status counts as open), actioned and total of the findings under review."""
    synced = synced_findings(findings, review)
    score = runs.quality_scores(synced, "run", F.initcap(F.trim(F.coalesce("severity", F.lit("")))), F.coalesce("status", F.lit("Open")).isin("Resolved", "Accepted"))
    counts = review.groupBy("run").agg(F.count_if(F.coalesce("action", F.lit("")) != "").alias("actioned"), F.count(F.lit(1)).alias("total"))
    return score.select("run", "score").join(counts, "run", "full_outer").select("run", F.coalesce("score", F.lit(100)).alias("score"), F.coalesce("actioned", F.lit(0)).alias("actioned"), F.coalesce("total", F.lit(0)).alias("total"))


def review_file(files: DataFrame) -> DataFrame:
    """folder and file of each folder's review: a usual name by their order, else the first name of that shape."""
    usual = F.array_position(F.array(*map(F.lit, REVIEW_FILES)), F.col("file"))
    rank = F.when(usual > 0, usual).when(F.col("file").rlike(REVIEW_SHAPE), len(REVIEW_FILES) + 1)
    return files.withColumn("_rank", rank).where("_rank IS NOT NULL").groupBy("folder").agg(F.min_by("file", F.struct("_rank", "file")).alias("file"))


def fresh_artifact(files: DataFrame, now: Column, ending: str = ".mtar", seconds: int = FRESH_S) -> DataFrame:
    """folder and the last artifact (by name) of each folder (folder, file, modified), where it is younger than `seconds`."""
    last = files.where(F.col("file").endswith(ending)).groupBy("folder").agg(F.max_by(F.struct("file", "modified"), "file").alias("f")).select("folder", "f.*")
    return last.where(F.unix_timestamp(now) - F.unix_timestamp("modified") < seconds)


def usage_dashboard(usage: DataFrame, known: DataFrame) -> DataFrame:
    """Usage (run, fd, last_updated, input, output, est_cost, jobs) with runs (run, title, status, created): all usage, the last updated first,
    then runs without usage, the last created first. A title that the run lacks is the usage's document, an unknown status `unknown`;
    jobs have their fields under the names of the view."""
    u, r = usage.withColumn("_u", F.lit(True)), known.withColumn("_r", F.lit(True))
    job = F.transform("jobs", lambda j: F.struct(j["job"].alias("job_id"), j["kind"].alias("kind"), F.coalesce(j["input"], F.lit(0)).alias("input_tokens"), F.coalesce(j["output"], F.lit(0)).alias("output_tokens"), F.coalesce(j["cost_usd"], F.lit(0.0)).alias("cost_usd")))
    used, has = F.col("_u").isNotNull(), F.col("_r").isNotNull()
    rows = u.join(r, "run", "full_outer").select(
        "run", F.coalesce(F.nullif("title", F.lit("")), F.when(used, F.col("fd")), F.lit("")).alias("title"), F.when(has, F.coalesce("status", F.when(used, "unknown").otherwise(""))).otherwise("unknown").alias("status"),
        F.coalesce(job, F.array().cast("array<struct<job_id:string,kind:string,input_tokens:bigint,output_tokens:bigint,cost_usd:double>>")).alias("phases"),
        *[F.coalesce(c, F.lit(z)).alias(n) for c, z, n in (("input", 0, "total_input"), ("output", 0, "total_output"), ("est_cost", 0.0, "total_cost"))],
        used.alias("used"), F.when(used, F.col("last_updated")).otherwise(F.col("created")).alias("at"),
    )
    return rows.orderBy(F.desc("used"), F.desc_nulls_last("at"), "run")


def admin_totals(metrics: DataFrame, usage: DataFrame) -> DataFrame:
    """One row: tool calls and errors (of tool, count, errors), and runs, tokens and costs of the usage, costs rounded after the sum."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input", "output", "cache_read", "cache_write", "total_tokens")]
    u = usage.agg(F.count(F.lit(1)).alias("runs"), *sums, F.round(F.coalesce(F.sum("est_cost"), F.lit(0.0)), 4).alias("est_cost"))
    m = metrics.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("calls"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"))
    both = m.unionByName(u, allowMissingColumns=True)  # one row each: no join is needed
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
