"""Run history, usage and audit logs, review state and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as T

#: Points that a finding takes off the score, by severity and whether it is resolved.
DEDUCTIONS = {("Critical", True): 5, ("Major", False): 8, ("Major", True): 2, ("Minor", False): 3, ("Minor", True): 1}
#: Price of a million tokens: input, output, cache read, cache write.
RATES = (3.0, 15.0, 0.30, 3.75)
MASK = "***REDACTED***"


def tool_metrics(calls: DataFrame, tool: str, ms: str, failed: Column) -> DataFrame:
    """tool, count, errors, total_ms; each duration is cut to whole milliseconds before the sum."""
    return calls.groupBy(F.col(tool).alias("tool")).agg(F.count(F.lit(1)).alias("count"), F.count_if(failed).alias("errors"), F.sum(F.col(ms).cast("long")).alias("total_ms"))


def metrics_total(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.sum("count").alias("calls"), F.sum("errors").alias("errors"))


def latest_jobs(jobs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of repeated job records the last one, by `order`."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return jobs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def estimated_cost(inp: Column, out: Column, cache_read: Column, cache_write: Column) -> Column:
    n = [F.coalesce(c, F.lit(0)) for c in (inp, out, cache_read, cache_write)]
    return F.round(sum((c / 1e6 * r for c, r in zip(n, RATES)), F.lit(0.0)), 4)


def usage_by_run(jobs: DataFrame, run: str, inp: str, out: str, cache_read: str, cache_write: str) -> DataFrame:
    """run, jobs, token sums, total_tokens and est_cost (missing token counts are 0)."""
    s = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long")
    g = jobs.groupBy(F.col(run).alias("run")).agg(F.count(F.lit(1)).alias("jobs"), s(inp).alias("input"), s(out).alias("output"), s(cache_read).alias("cache_read"), s(cache_write).alias("cache_write"))
    total = F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")
    return g.withColumn("total_tokens", total).withColumn("est_cost", estimated_cost(*map(F.col, ("input", "output", "cache_read", "cache_write"))))


def usage_total(by_run: DataFrame) -> DataFrame:
    """One row; costs are summed after rounding, then rounded again."""
    return by_run.agg(F.count(F.lit(1)).alias("runs"), F.sum("jobs").alias("jobs"), F.sum("total_tokens").alias("total_tokens"), F.round(F.sum("est_cost"), 4).alias("est_cost"))


def usage_with_runs(usage: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Full outer: usage without a run and runs without usage stay; matched tells which rows have both."""
    u, r = usage.withColumn("_u", F.lit(True)), runs.withColumn("_r", F.lit(True))
    return u.join(r, key, "full_outer").withColumn("matched", F.col("_u").isNotNull() & F.col("_r").isNotNull()).withColumn("has_usage", F.col("_u").isNotNull()).drop("_u", "_r")


def version_of(run_id: Column) -> Column:
    """Number after a final -R, 1 without it."""
    return F.coalesce(F.nullif(F.regexp_extract(run_id, r"-R(\d+)$", 1), F.lit("")).cast("int"), F.lit(1))


def run_history(runs: DataFrame, run_id: str, source: str) -> DataFrame:
    """Adds version, previous_run and run_count within each source."""
    w = Window.partitionBy(source)
    v = runs.withColumn("version", version_of(F.col(run_id)))
    return v.withColumn("previous_run", F.lag(run_id).over(w.orderBy("version", run_id))).withColumn("run_count", F.count(F.lit(1)).over(w))


def next_run(runs: DataFrame, run_id: str, source: str) -> DataFrame:
    """source, base id, next version, next id and previous id."""
    v = runs.withColumn("version", version_of(F.col(run_id)))
    g = v.groupBy(source).agg(F.min(F.regexp_replace(run_id, r"-R\d+$", "")).alias("base"), (F.max("version") + 1).alias("version"), F.max_by(run_id, F.struct("version", run_id)).alias("previous_run"))
    return g.withColumn("next_run", F.concat("base", F.lit("-R"), F.col("version").cast("string")))


def deduction(severity: Column, resolved: Column) -> Column:
    out = F.lit(0)
    for (sev, done), points in DEDUCTIONS.items():
        out = F.when((severity == sev) & (resolved if done else ~resolved), points).otherwise(out)
    return out


def quality_scores(findings: DataFrame, run: str, severity: Column, resolved: Column) -> DataFrame:
    """run, score: 100 less the deductions, 0 at least. An open critical finding deducts nothing: it blocks."""
    return findings.groupBy(run).agg(
        F.greatest(F.lit(0), 100 - F.sum(deduction(severity, resolved))).cast("long").alias("score"),
        F.count_if((severity == "Critical") & ~resolved).alias("blockers"),
    )


def review_state(findings: DataFrame, run: str, severity: Column, status: Column, least: int = 70) -> DataFrame:
    """run, score, open_critical, open_major, total and needs_review: an open critical or major finding, or a low score."""
    resolved = status.isin("Resolved", "Accepted")
    n = lambda s: F.count_if((severity == s) & (status == "Open"))
    g = findings.groupBy(run).agg(
        F.greatest(F.lit(0), 100 - F.sum(deduction(severity, resolved))).cast("long").alias("score"),
        n("Critical").alias("open_critical"), n("Major").alias("open_major"), F.count(F.lit(1)).alias("total"),
    )
    return g.withColumn("needs_review", (F.col("open_critical") > 0) | (F.col("open_major") > 0) | (F.col("score") < least))


def apply_actions(findings: DataFrame, actions: DataFrame) -> DataFrame:
    """Findings (id, status) with the status that the last action on each (id, action, n) asks for; other actions change nothing."""
    last = actions.groupBy("id").agg(F.max(F.struct("n", "action")).alias("_last"))
    wanted = F.when(F.col("_last.action") == "accept", "Accepted").when(F.col("_last.action") == "fix", "Pending Fix")
    joined = findings.join(last, "id", "left")
    return joined.select(*[F.coalesce(wanted, F.col(c)).alias(c) if c == "status" else F.col(c) for c in findings.columns], wanted.isNotNull().alias("actioned"))


def picked_option(options: Column, selected: Column) -> Column:
    """Of an array of (id, mandated, feasible, recommended, names) the id of: the selected option, else the first mandated
    one that is not infeasible, else the first recommended one, else the first that has names; null for none."""
    first = lambda test: F.get(F.filter(options, test), F.lit(0))["id"]
    return F.coalesce(
        first(lambda o: o["id"] == selected), first(lambda o: o["mandated"] & F.coalesce(o["feasible"], F.lit(True))),
        first(lambda o: o["recommended"]), first(lambda o: F.size(F.coalesce(o["names"], F.array().cast("array<string>"))) > 0),
    )


def visible_steps(steps: Column, side: Column, hidden: tuple[str, ...] = ("13", "14")) -> Column:
    """Steps (an array of structs with n) without those that only the side-by-side variant has."""
    return F.when(side, steps).otherwise(F.filter(steps, lambda s: ~s["n"].cast("string").isin(*hidden)))


def same_ids(a: Column, b: Column) -> Column:
    """True if two arrays hold the same ids, whatever their order and repeats; null is empty."""
    ids = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    return ids(a) == ids(b)


def approval_errors(runs: DataFrame) -> DataFrame:
    """Adds `gate_error`, the first unmet condition: runs has checklist_open, bad_names, unactioned, unjustified,
    unverified, open_majors (counts) and comment."""
    col = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    return runs.withColumn(
        "gate_error",
        F.when(col("checklist_open"), "checklist").when(col("bad_names"), "names").when(col("unactioned"), "findings without action")
        .when(col("unjustified"), "action without reason").when(col("unverified"), "unverified objects")
        .when(col("open_majors") & (F.trim(F.coalesce("comment", F.lit(""))) == ""), "open majors need a comment"),
    )


def name_ok(name: Column, created_in: Column) -> Column:
    """Validity of a custom name by where it is created."""
    n = F.trim(F.coalesce(name, F.lit("")))
    side = F.lower(F.trim(F.coalesce(created_in, F.lit("")))).isin("side_by_side", "side-by-side", "btp", "cap")
    return F.when(side, n.rlike(r"^[A-Za-z][A-Za-z0-9_./-]{1,}$")).otherwise(n.rlike(r"^(YY1_|Z|Y)[A-Za-z0-9_]{2,}$"))


def is_side_by_side(selected: Column, components: Column, mode: Column) -> Column:
    """An explicit choice decides; else any filled component but the excepted one; else the mode's name."""
    other = F.exists(F.coalesce(components, F.array().cast("array<string>")), lambda c: (F.trim(c) != "") & (F.upper(F.trim(c)) != "SBPA"))
    return F.coalesce(selected, other | F.contains(F.lower(F.coalesce(mode, F.lit(""))), F.lit("side")))


def workflow_label(label: Column, side: Column) -> Column:
    """One canonical label per variant; other workflows keep theirs."""
    s = F.trim(F.coalesce(label, F.lit("")))
    short = "RICEFW Pipeline (12 steps)"
    return F.when(s == "", short).when(F.lower(s).rlike("ricefw|pipeline"), F.when(side, "RICEFW Pipeline (14 steps, incl. BTP deploy)").otherwise(short)).otherwise(s)


def except_sorted(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of `a` that `b` lacks, sorted."""
    return a.subtract(b).orderBy(*a.columns)


def stalled(runs: DataFrame, jobs: DataFrame, now: Column, idle_s: int = 600) -> DataFrame:
    """Active runs without a live job that have a dead job or no activity for `idle_s` seconds. jobs: run, alive."""
    state = jobs.groupBy("run").agg(F.max(F.col("alive").cast("int")).alias("live"))
    j = runs.where(F.col("status").isin("running", "in_progress")).join(state, "run", "left")
    idle = F.unix_timestamp(now) - F.unix_timestamp("last_activity") > idle_s
    return j.where((F.coalesce("live", F.lit(0)) == 0) & (F.col("live").isNotNull() | idle)).drop("live")


def failure_class(log: Column, patterns: dict[str, str], last: int = 2000) -> Column:
    """Label of the first phrase that the end of a log contains, ignoring case; null for none."""
    end, out = F.lower(F.right(log, F.lit(last))), F.lit(None).cast("string")
    for phrase, label in reversed(patterns.items()):
        out = F.when(F.contains(end, F.lit(phrase.lower())), label).otherwise(out)
    return out


def redact(json: Column, keys: list[str], depth: int = 16) -> Column:
    """JSON text with the values of secret keys masked: strings, numbers, literals, and objects and lists with all
    that is in them. A value nested deeper than `depth` masks the rest of the text, so that nothing secret stays."""
    names = "|".join(k.replace(".", r"\.") for k in keys)
    string = r'"(?:[^"\\]|\\.)*+"'
    nested = r"[\[{](?:" + string + r'|[^"\[\]{}])*+[\]}]'
    for _ in range(depth):
        nested = r"[\[{](?:" + string + r'|[^"\[\]{}]|' + nested + r")*+[\]}]"
    value = rf"{string}|-?[0-9][0-9.eE+-]*|true|false|null|{nested}|[\[{{](?s:.*)"
    return F.regexp_replace(json, rf'(?i)("(?:{names})"\s*:\s*)(?:{value})', f'$1"{MASK}"')


def apply_comments(findings: DataFrame, comments: DataFrame) -> DataFrame:
    """Findings with the last comment (by its order) on their id or their file. comments: target, text, n; findings
    have an id each. Two joins on equal keys, each with one comment per target."""
    last = comments.groupBy("target").agg(F.max(F.struct("n", "text")).alias("said"))
    on = lambda c: last.select(F.col("target").alias(f"_on_{c}"), F.col("said").alias(f"_by_{c}"))
    both = findings
    for c in ("id", "file"):
        both = both.join(on(c), F.col(c) == F.col(f"_on_{c}"), "left")
    return both.select(*findings.columns, F.greatest("_by_id", "_by_file")["text"].alias("comment"))


def tail(events: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The last n rows in ascending order; 0 means 10."""
    return events.orderBy(F.desc(order)).limit(n or 10).orderBy(order)


def inputs_with_runs(inputs: DataFrame, runs: DataFrame, path: str, run_id: str) -> DataFrame:
    """Inputs with the list of runs made from each, empty for none."""
    made = runs.groupBy(path).agg(F.array_sort(F.collect_list(run_id)).alias("runs"))
    return inputs.join(made, path, "left").withColumn("runs", F.coalesce("runs", F.array().cast("array<string>")))


def titled(text: Column) -> Column:
    """First markdown heading of a text, trimmed; null without one."""
    return T.filled(F.regexp_extract(text, r"(?m)^#+\s*(.+)$", 1))
