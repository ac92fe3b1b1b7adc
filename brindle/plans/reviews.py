"""Registered queries over checkpoint entries, made from the lines of the driver's orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import checkpoints
from brindle.plans import catalog
from brindle.plans.catalog import registered
from brindle.session import table


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        F.col("l_quantity").cast("int").alias("q"), F.concat("l_returnflag", "l_linestatus").alias("t"),
    )


@registered("""WITH l AS (SELECT l_orderkey AS run, l_linenumber AS k, max(l_partkey) AS p FROM lineitem GROUP BY ALL),
n AS (SELECT run, k::VARCHAR AS id, CASE WHEN p % 3 = 0 THEN 'btp' ELSE 'tenant' END AS created_in, CASE WHEN p % 4 = 0 THEN 'ZZ_new' || p ELSE 'bad name ' || k END AS name FROM l WHERE run % 5 > 1),
g AS (SELECT run, '1' AS id, 'tenant' AS created_in, CASE WHEN max(p) FILTER (k = 1) % 4 = 0 THEN 'ZZ_new' || max(p) FILTER (k = 1) ELSE 'YY1_SWAP' END AS name FROM l WHERE run % 5 = 0 GROUP BY run)
SELECT run, count(*) FILTER (CASE WHEN created_in = 'btp' THEN regexp_matches(name, '^[A-Za-z][A-Za-z0-9_./-]{1,}$') ELSE regexp_matches(name, '^(YY1_|Z|Y)[A-Za-z0-9_]{2,}$') END) AS valid, count(*) AS total
FROM (SELECT * FROM n UNION ALL SELECT * FROM g) GROUP BY run""")
def naming_edits(spark, sf_dir):
    """Valid and all names of each run after edits, whole replacements and a clearing of contracts."""
    lines = _lines(spark, sf_dir).groupBy("run", "k").agg(F.max("p").alias("p"))
    text = lambda c: F.col(c).cast("string")
    none = F.lit("")
    names = lines.select("run", text("k").alias("id"), none.alias("object"), none.alias("type"), F.when(F.col("p") % 3 == 0, "btp").otherwise("tenant").alias("created_in"), F.concat(F.lit("bad name "), text("k")).alias("name"))
    edits = lines.where("p % 4 = 0").select("run", text("k").alias("id"), F.concat(F.lit(" ZZ_new"), text("p"), F.lit(" ")).alias("name"), F.lit(2).alias("n"))
    first = edits.withColumns({"name": F.lit("overwritten"), "n": F.lit(1)})
    entry = F.struct(F.lit("1").alias("id"), none.alias("object"), none.alias("type"), F.lit("tenant").alias("created_in"), F.lit(" YY1_SWAP").alias("name"))
    each = lines.select("run").distinct()
    swaps = each.where("run % 5 < 2").select("run", F.when(F.col("run") % 5 == 0, F.array(entry)).otherwise(F.array().cast(checkpoints.ENTRY)).alias("contract"), F.lit(1).alias("n"))
    return checkpoints.name_counts(checkpoints.edited_names(names, edits.union(first), swaps))


@registered("""WITH f AS (SELECT DISTINCT l_orderkey AS run, l_linenumber AS id FROM lineitem),
c AS (SELECT l_orderkey AS run, l_linenumber AS id, arg_max(CASE WHEN l_partkey % 3 = 0 THEN ' ' ELSE l_returnflag END, l_partkey * 100000 + l_suppkey) AS text FROM lineitem WHERE l_quantity > 25 GROUP BY ALL)
SELECT run, count(*) FILTER (trim(coalesce(text, CASE WHEN id = 2 THEN 'old' ELSE '' END)) <> '') AS commented, count(*) AS total FROM f LEFT JOIN c USING (run, id) GROUP BY run""")
def file_comments(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    files = lines.select("run", F.col("k").alias("id"), F.when(F.col("k") == 2, "old").alias("comment")).distinct()
    said = lines.where("q > 25").select("run", F.col("k").alias("id"), F.when(F.col("p") % 3 == 0, " ").otherwise(F.left("t", F.lit(1))).alias("text"), (F.col("p") * 100000 + F.col("s")).alias("n"))
    return checkpoints.comment_counts(checkpoints.commented_files(files, said))


@registered("""SELECT o_orderkey AS run, 1 + o_orderkey % 4 AS total,
  CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE least(1 + o_orderkey % 4, 2) - CASE WHEN o_orderkey % 4 > 0 AND o_custkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 4 > 2 THEN 1 ELSE 0 END END AS checked FROM orders""")
def checklist_progress(spark, sf_dir):
    """Ticks for lists of one to four items, some too short, some too long, some missing."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    lists = o.select(k.alias("run"), F.sequence(F.lit(0), (k % 4).cast("int")).alias("checklist"))
    given = F.array(F.lit(True), F.when(F.col("o_custkey") % 2 > 0, True), F.lit(False), F.lit(True), F.lit(True))
    ticks = o.where("o_custkey % 3 > 0").select(k.alias("run"), given.alias("checked"), F.lit(2).alias("n"))
    early = ticks.withColumns({"checked": F.array(F.lit(False)), "n": F.lit(1)})
    return checkpoints.checklist_state(lists, ticks.union(early)).select("run", "total", "checked")


@registered("""WITH l AS (SELECT l_orderkey AS run, l_linenumber AS id, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY ALL),
f AS (SELECT run, id, CASE id % 3 WHEN 0 THEN 'Critical' WHEN 1 THEN 'Major' ELSE 'Minor' END AS sev, CASE p % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'fix' WHEN 2 THEN CASE WHEN s % 2 = 0 THEN 'fix' END END AS action, s % 2 = 1 AS resolved FROM l),
g AS (SELECT *, CASE action WHEN 'accept' THEN true WHEN 'fix' THEN false ELSE resolved END AS done FROM f)
SELECT run, greatest(0, 100 - sum(CASE WHEN sev = 'Critical' THEN CASE WHEN done THEN 5 ELSE 0 END WHEN sev = 'Major' THEN CASE WHEN done THEN 2 ELSE 8 END ELSE CASE WHEN done THEN 1 ELSE 3 END END))::BIGINT AS score,
  count(action) AS actioned, count(*) AS total FROM g GROUP BY run""")
def findings_review(spark, sf_dir):
    """Score and counts after the reviewer's last decision on each finding."""
    lines = _lines(spark, sf_dir).groupBy("run", F.col("k").alias("id")).agg(F.max("p").alias("p"), F.max("s").alias("s"))
    p, odd, none = F.col("p") % 4, F.col("s") % 2 == 1, F.lit(None).cast("string")
    severity = F.when(F.col("id") % 3 == 0, "critical ").when(F.col("id") % 3 == 1, "MAJOR").otherwise("Minor")
    findings = lines.select("run", "id", severity.alias("severity"), F.when(odd, "Resolved").otherwise(none).alias("status"))
    review = lines.select("run", "id", F.when((p == 2) & ~odd, "fix").alias("action"), none.alias("notes"))
    last = lines.select("run", "id", F.when(p == 0, "accept").when(p == 1, "fix").otherwise("skip").alias("action"), F.lit("why").alias("notes"), F.lit(9).alias("n"))
    acts = last.union(last.withColumns({"action": F.lit("accept"), "n": F.lit(1)}))
    return checkpoints.review_result(findings, checkpoints.decided(review, acts))


@registered(f"""WITH {catalog.USAGE_SQL}
SELECT coalesce(c.run, k.c_custkey)::BIGINT AS run, coalesce(nullif(k.c_name, ''), 'fd') AS title, CASE WHEN k.c_custkey IS NULL THEN 'unknown' ELSE k.c_mktsegment END AS status,
  coalesce(c.input, 0) AS total_input, coalesce(c.output, 0) AS total_output, coalesce(c.est_cost, 0) AS total_cost, c.run IS NOT NULL AS used
FROM c FULL JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) k ON k.c_custkey = c.run""")
def usage_dashboard(spark, sf_dir):
    used = catalog.usage_rollup(spark, sf_dir).select("run", F.lit("fd").alias("fd"), F.col("run").alias("last_updated"), "input", "output", "est_cost", F.lit(None).cast("array<struct<job:string,kind:string,input:bigint,output:bigint,cost_usd:double>>").alias("jobs"))
    known = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("run"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("status"), F.col("c_custkey").alias("created"))
    return checkpoints.usage_dashboard(used, known).select("run", "title", "status", "total_input", "total_output", "total_cost", "used")


@registered(f"""WITH {catalog.USAGE_SQL} SELECT (SELECT count(*) FROM events) AS calls, (SELECT count(*) FILTER (event_type = 'error') FROM events) AS errors, count(*) AS runs,
  sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write, sum(total_tokens)::BIGINT AS total_tokens, round(sum(est_cost), 4) AS est_cost FROM c""")
def admin_totals(spark, sf_dir):
    return checkpoints.admin_totals(catalog.tool_metrics(spark, sf_dir), catalog.usage_rollup(spark, sf_dir))


@registered("""WITH f AS (SELECT o_custkey AS folder, CASE o_orderkey % 6 WHEN 0 THEN '07-review.md' WHEN 1 THEN '07-code-review.md' WHEN 2 THEN '7_My-REVIEW-' || o_orderkey || '.md' WHEN 3 THEN '08-review.md' ELSE 'x' || o_orderkey || '.md' END AS file FROM orders)
SELECT folder, coalesce(min(file) FILTER (file = '07-code-review.md'), min(file) FILTER (file = '07-review.md'), min(file) FILTER (file LIKE '7\\_%' ESCAPE '\\')) AS file FROM f WHERE file LIKE '07-%review.md' OR file LIKE '7\\_%' ESCAPE '\\' GROUP BY folder""")
def review_files(spark, sf_dir):
    k = F.col("o_orderkey")
    number = k.cast("string")
    file = F.when(k % 6 == 0, "07-review.md").when(k % 6 == 1, "07-code-review.md").when(k % 6 == 2, F.concat(F.lit("7_My-REVIEW-"), number, F.lit(".md"))).when(k % 6 == 3, "08-review.md").otherwise(F.concat(F.lit("x"), number, F.lit(".md")))
    return checkpoints.review_file(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("folder"), file.alias("file")))


@registered("""WITH f AS (SELECT user_id AS folder, lpad(event_id::VARCHAR, 9, '0') || '.mtar' AS file, ts FROM events WHERE event_type <> 'click')
SELECT folder, max(file) AS file FROM f GROUP BY folder HAVING epoch(TIMESTAMP '2024-01-30') - floor(epoch(arg_max(ts, file))) < 172800""")
def fresh_artifacts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ending", F.when(F.col("event_type") == "click", ".zip").otherwise(".mtar"))
    files = e.select(F.col("user_id").alias("folder"), F.concat(F.lpad(F.col("event_id").cast("string"), 9, "0"), "ending").alias("file"), F.col("ts").alias("modified"))
    return checkpoints.fresh_artifact(files, F.lit("2024-01-30").cast("timestamp_ntz"), seconds=172800).select("folder", "file")
