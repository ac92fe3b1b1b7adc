"""Registered queries over documents, archives, logs and artifacts that Spark derives from the driver tables."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import tables
from brindle.operators import artifacts, manifests
from brindle.plans import catalog
from brindle.plans.catalog import registered
from brindle.session import bound_batches, table
from brindle.sources import archives, documents, files, remote

# ---------------------------------------------------------------- damaged archives


def damaged(raw: bytes, kind: int) -> bytes:
    """0: whole; 1: the end record states a wrong directory offset; 2: also no local signature; 3: cut before the directory."""
    if kind == 0:
        return raw
    end, first = raw.rfind(archives.END), raw.find(archives.DIRECTORY)
    if kind == 3:
        return raw[:first]
    out = bytearray(raw)
    struct.pack_into("<I", out, end + 16, first + 9)
    if kind == 2:
        out[: len(archives.LOCAL)] = b"\0\0\0\0"
    return bytes(out)


def word_files(docs: DataFrame) -> DataFrame:
    """doc_id, path, content: every document as a word-processing file, damaged in one of four ways by its id. Characters that XML can't hold become spaces."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def build(ids: pd.Series, texts: pd.Series) -> pd.Series:
        plain = (re.sub(r"[^\t\n\x20-퟿-�\U00010000-\U0010ffff]", " ", t or "") for t in texts)
        return pd.Series([damaged(documents.word_document(t), int(i) % 4) for i, t in zip(ids, plain, strict=True)])

    return docs.select("doc_id", F.lit("x.docx").alias("path"), build("doc_id", "text").alias("content"))


@registered(r"""
SELECT doc_id, ['zip', 'directory', 'directory', 'scan'][1 + doc_id % 4] AS note,
  sha256(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B-\x1F]', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))) AS text_sha256
FROM documents WHERE regexp_matches(coalesce(text, ''), '[^\s]')
UNION ALL SELECT doc_id, 'no document part', sha256('') FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[^\s]')""")
def damaged_word_text(spark, sf_dir):
    """Texts come back out of damaged archives, with the way in which they were found."""
    read = documents.extract_text(word_files(table(spark, sf_dir, "documents")))
    return read.select("doc_id", "note", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@registered("SELECT ['ok', 'displaced', 'displaced', 'no end record'][1 + doc_id % 4] AS state, count(*) AS n, count(*) * CASE WHEN doc_id % 4 < 3 THEN 1 ELSE 0 END AS entries FROM documents GROUP BY doc_id % 4")
def archive_states(spark, sf_dir):
    """What the ends of these archives look like, counted by kind of damage."""
    seen = archives.tail_analysis(word_files(table(spark, sf_dir, "documents")))
    return seen.groupBy((F.col("doc_id") % 4).alias("k"), "state").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("entries"), F.lit(0)).alias("entries")).drop("k")


# ---------------------------------------------------------------- service metadata


@registered("""
SELECT p_partkey, p_brand AS namespace, e.entity, e.property, e.type, e.nullable, e.is_key FROM part, unnest([
  {'entity': p_type, 'property': 'Key', 'type': 'Edm.Int64', 'nullable': false, 'is_key': true},
  {'entity': p_type, 'property': 'Size' || p_size, 'type': 'Edm.Int32', 'nullable': p_size % 2 = 0, 'is_key': false},
  {'entity': p_type, 'property': 'Name', 'type': 'Edm.String', 'nullable': true, 'is_key': p_size > 25}]) AS u(e)""")
def part_service_model(spark, sf_dir):
    """Properties and keys read back from a metadata document for each part."""
    text = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    xml = F.concat(
        F.lit('<edmx:Edmx xmlns:edmx="urn:e"><edmx:DataServices><Schema Namespace="'), text("p_brand"), F.lit('"><EntityType Name="'), text("p_type"),
        F.lit('"><Key><PropertyRef Name="Key"/>'), F.when(F.col("p_size") > 25, '<PropertyRef Name="Name"/>').otherwise(""),
        F.lit('</Key><Property Name="Key" Type="Edm.Int64" Nullable="false"/><Property Name="Size'), F.col("p_size").cast("string"),
        F.lit('" Type="Edm.Int32" Nullable="'), (F.col("p_size") % 2 == 0).cast("string"),
        F.lit('"/><Property Name="Name" Type="Edm.String"/></EntityType></Schema></edmx:DataServices></edmx:Edmx>'),
    )
    return remote.metadata_properties(table(spark, sf_dir, "part").select("p_partkey", xml.alias("body")), "p_partkey").withColumnRenamed("service", "p_partkey")


# ---------------------------------------------------------------- artifacts

RAW_SQL = """raw AS (SELECT c_custkey AS k, ['API', 'Event', 'CDSVIEW', 'BADI', 'Package'][1 + c_custkey % 5] AS type, upper('n_' || (c_custkey // 10)) AS name,
  CASE WHEN c_custkey % 4 > 0 THEN c_name END AS shown,
  CASE c_custkey % 3 WHEN 0 THEN 'N_' || (c_custkey // 10) || 'View (Basic)' WHEN 1 THEN c_mktsegment ELSE ' ' END AS told,
  CASE c_custkey % 7 WHEN 0 THEN 'SOAP' WHEN 1 THEN 'odatav4' WHEN 2 THEN '' WHEN 3 THEN 'EVENT' ELSE 'other' END AS sub,
  CASE WHEN c_custkey % 6 = 0 THEN 'https://x/' || c_custkey ELSE '' END AS url FROM customer WHERE c_custkey % 11 > 0),
rows AS (SELECT k, lower(CASE type WHEN 'CDSVIEW' THEN 'view' ELSE type END) AS kind,
  CASE WHEN type = 'CDSVIEW' AND told LIKE '% (%' THEN split_part(told, ' (', 1) ELSE name END AS name,
  CASE WHEN type <> 'CDSVIEW' THEN coalesce(shown, name) END AS title,
  CASE type WHEN 'Event' THEN 'Event' WHEN 'API' THEN CASE upper(sub) WHEN 'SOAP' THEN 'SOAP' WHEN 'ODATAV4' THEN 'OData V4' WHEN 'EVENT' THEN 'Event' ELSE 'OData V2' END END AS protocol,
  CASE WHEN type IN ('API', 'Event') THEN CASE WHEN url <> '' THEN url ELSE 'https://hub/' || name || '/overview' END END AS hub_url,
  CASE type WHEN 'CDSVIEW' THEN shown WHEN 'BADI' THEN NULL ELSE nullif(trim(told), '') END AS notes,
  CASE WHEN type = 'BADI' THEN nullif(trim(told), '') END AS use_case, CASE WHEN type = 'BADI' THEN false END AS verified_in_tenant FROM raw WHERE type <> 'Package')"""


def raw_artifacts(spark, sf_dir) -> DataFrame:
    """Artifacts of every kind, some unreleased or of another type, derived from the customers."""
    k, tens = F.col("c_custkey"), F.expr("CAST(c_custkey DIV 10 AS STRING)")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("N_"), tens).alias("Name"), F.when(k % 4 > 0, F.col("c_name")).alias("DisplayName"),
        F.when(k % 3 == 0, F.concat(F.lit("N_"), tens, F.lit("View (Basic)"))).when(k % 3 == 1, F.col("c_mktsegment")).otherwise(" ").alias("Description"),
        F.get(F.array(*map(F.lit, ("API", "Event", "CDSVIEW", "BADI", "Package"))), (k % 5).cast("int")).alias("Type"),
        F.get(F.array(*map(F.lit, ("SOAP", "odatav4", "", "EVENT", "other", "other", "other"))), (k % 7).cast("int")).alias("SubType"),
        F.when(k % 11 > 0, "Released").otherwise("DRAFT").alias("State"), F.when(k % 6 == 0, F.concat(F.lit("https://x/"), k)).otherwise("").alias("Url"),
    )


@registered(f"WITH {RAW_SQL} SELECT kind, name, title, protocol, hub_url, notes, use_case, verified_in_tenant, count(*) AS n FROM rows GROUP BY ALL")
def catalog_artifacts(spark, sf_dir):
    """APIs, events, views and extension points in one union."""
    rows = artifacts.catalog_rows(raw_artifacts(spark, sf_dir), "https://hub")
    return rows.groupBy("kind", "name", "title", "protocol", "hub_url", "notes", "use_case", "verified_in_tenant").agg(F.count(F.lit(1)).alias("n"))


@registered(f"""WITH {RAW_SQL},
old AS (SELECT 'N_' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS title, CASE WHEN s_suppkey % 3 = 0 THEN '' END AS notes FROM supplier),
new AS (SELECT * FROM rows WHERE kind IN ('api', 'event') QUALIFY row_number() OVER (PARTITION BY name ORDER BY kind, title NULLS FIRST, protocol, hub_url, notes NULLS FIRST) = 1)
SELECT coalesce(o.name, n.name) AS name, coalesce(o.title, n.title) AS title, n.protocol, n.hub_url, coalesce(o.notes, n.notes) AS notes,
  CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'existing' ELSE 'backfilled' END AS status FROM old o FULL JOIN new n ON o.name = n.name""")
def synced_apis(spark, sf_dir):
    """The API catalog after APIs and events are merged in."""
    old = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("N_"), F.col("s_suppkey").cast("string")).alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("title"),
        *[F.lit(None).cast("string").alias(c) for c in ("protocol", "area", "communication_scenario", "hub_url")], F.when(F.col("s_suppkey") % 3 == 0, "").alias("notes"), F.lit("seed").alias("source"),
    )
    merged = artifacts.synced(old, artifacts.catalog_rows(raw_artifacts(spark, sf_dir), "https://hub"), "api")
    return merged.select("name", "title", "protocol", "hub_url", "notes", F.col("_status").alias("status"))


# ---------------------------------------------------------------- runs, skills, workflows

STEP_CONTRACT = {n: {"name": f"step {n}", "agent": "builder", "gate": f"G{n}", "detail": "waits"} for n in manifests.SIDE_STEPS}


@registered("""
WITH r AS (SELECT o_orderkey AS k, o_custkey % 50 AS fd, o_orderkey % 3 = 0 AS side, o_orderkey % 10 + 1 AS v, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey % 10, 'run' || o_orderkey || CASE WHEN o_orderkey % 10 > 0 THEN '-R' || (o_orderkey % 10 + 1) ELSE '' END) AS n FROM orders),
i AS (SELECT *, 'run' || k || CASE WHEN k % 10 > 0 THEN '-R' || v ELSE '' END AS id FROM r)
SELECT id, side, CASE WHEN side THEN 'RICEFW Pipeline (14 steps, incl. BTP deploy)' ELSE 'RICEFW Pipeline (12 steps)' END AS workflow,
  CASE WHEN side THEN '12:PASS:own,13:' || CASE WHEN k % 2 = 0 THEN 'RUNNING' ELSE 'PENDING' END || ':waits' ELSE '12:PASS:own' END AS steps,
  CASE k % 4 WHEN 0 THEN 'TOP' WHEN 1 THEN 'MANDATED' WHEN 2 THEN 'SELECTED' ELSE 'RECOMMENDED' END AS first_name, v::INT AS version,
  lag(id) OVER (PARTITION BY fd ORDER BY v, id) AS previous_run, count(*) OVER (PARTITION BY fd) AS run_count FROM i""")
def run_manifests(spark, sf_dir):
    """Runs from JSON manifests, one for each order, with variant, steps, names and version chain."""
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    names = lambda n: F.concat(F.lit('[{"name": "'), F.lit(n), F.lit('"}]'))
    option = lambda i, flags, n: F.concat(F.lit(f'{{"id": "{i}", '), flags, F.lit('"naming_contract": '), names(n), F.lit("}"))
    body = F.concat(
        F.lit('{"id": "run'), text(k), F.when(k % 10 > 0, F.concat(F.lit("-R"), text(k % 10 + 1))).otherwise(""), F.lit('", "fd_source": "'), text(F.col("o_custkey") % 50),
        F.lit('", "workflow": "my pipeline", "steps": [{"n": 12, "name": "x", "status": "PASS", "detail": "own"}, {"n": "13", "name": "other", "status": "'),
        F.when(k % 2 == 0, "RUNNING").otherwise("N/A"), F.lit('", "detail": " "}], "btp_components": ["sbpa"'), F.when(k % 3 == 0, ', "CAP_APP"').otherwise(""),
        F.lit('], "checkpoint_request": {"approach_options": ['), option("a", F.when(k % 4 == 1, '"mandated": true, ').otherwise('"mandated": true, "feasible": false, '), "MANDATED"), F.lit(", "),
        option("b", F.lit('"recommended": true, '), "RECOMMENDED"), F.lit(", "), option("c", F.lit(""), "SELECTED"), F.lit("]"),
        F.when(k % 4 == 0, F.concat(F.lit(', "naming_contract": '), names("TOP"))).otherwise(""), F.when(k % 4 == 2, ', "selected_approach": "c"').otherwise(""), F.lit("}}"),
    )
    rows = manifests.run_rows(table(spark, sf_dir, "orders").select(text(k).alias("folder"), body.alias("body")), STEP_CONTRACT)
    steps = F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["n"], s["status"], s["detail"])), ",")
    return rows.select("id", "side", "workflow", steps.alias("steps"), F.get("names", F.lit(0))["name"].alias("first_name"), "version", "previous_run", "run_count")


@registered(r"""SELECT 'skill' || doc_id AS name, CASE WHEN doc_id % 3 > 0 THEN source || '-' || lang ELSE '' END AS description,
  round(length(CASE WHEN doc_id % 3 > 0 THEN '---' || chr(10) || 'description:  ' || source || '-' || lang || ' ' || chr(10) ELSE '' END || coalesce(text, '')) / 1024.0, 1)::DOUBLE AS size_kb
FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '(?m)^description:')""")
def skill_files(spark, sf_dir):
    """Name, description and size of skill files made from the documents."""
    head = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("---\ndescription:  "), "source", F.lit("-"), "lang", F.lit(" \n"))).otherwise("")
    docs = table(spark, sf_dir, "documents").where(~F.coalesce("text", F.lit("")).rlike("(?m)^description:"))
    made = docs.select(F.concat(F.lit("skills/skill"), F.col("doc_id").cast("string"), F.lit("/SKILL.md")).alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).alias("value"))
    return files.skill_rows(made).select("name", "description", "size_kb")


# ---------------------------------------------------------------- table functions


@registered(catalog.SQL["regex_lint_findings"])
def lint_function_rows(spark, sf_dir):
    """The lint's rows through SQL: a table function over a table, with rules from a table."""
    rules = spark.createDataFrame([(r.id, r.severity, r.pattern, r.message) for r in catalog.RULES], "id string, severity string, pattern string, message string")
    tables.register(spark, tables.rules_of(rules))
    return spark.sql("SELECT * FROM lint(TABLE(SELECT doc_id, text FROM {docs}))", docs=table(spark, sf_dir, "documents"))


@registered(f"WITH tok AS ({catalog.TERMS_SQL}) SELECT t AS term, count(*) AS n, count(DISTINCT doc_id) AS df FROM tok GROUP BY t")
def term_function_counts(spark, sf_dir):
    """Terms, their occurrences and documents, by the tokenising table function."""
    tables.register(spark, [])
    return spark.sql("SELECT term, sum(tf) AS n, count(*) AS df FROM terms(TABLE(SELECT doc_id, text FROM {docs})) GROUP BY term", docs=table(spark, sf_dir, "documents"))
