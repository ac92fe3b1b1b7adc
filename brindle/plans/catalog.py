"""Registered queries: the operators of this package over the driver tables, each with equivalent SQL.

The driver tables hold no object catalog, so one is derived from parts: APIs, views and extension
points named after them (`objects`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import catalog, graph, lint, runs, search
from brindle.session import TABLES, checkpointed, table
from brindle.streaming import limits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- search

QUERY_WORDS = "they erst"
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
TERMS_SQL = f"SELECT doc_id, t FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{T.TERM}')) AS t FROM documents) WHERE t NOT IN {STOP_SQL}"
TFIDF_SQL = """
WITH tok AS (@),
len AS (SELECT doc_id, count(*) AS n_terms FROM tok GROUP BY doc_id),
tf AS (SELECT doc_id, t, count(*) AS tf FROM tok GROUP BY doc_id, t),
idf AS (SELECT t, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY t),
w AS (SELECT tf.doc_id, tf.t, tf.tf / len.n_terms::DOUBLE * idf.idf AS w FROM tf JOIN len USING (doc_id) JOIN idf USING (t)),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
q AS (SELECT t, 1.0 * idf AS qw FROM idf WHERE t IN (?)),
s AS (SELECT w.doc_id, sum(w.w / n.norm * q.qw) / (SELECT sqrt(sum(qw * qw)) FROM q) AS exact FROM w JOIN n USING (doc_id) JOIN q USING (t) GROUP BY w.doc_id)
"""


def _tfidf_sql(query: str) -> str:
    return TFIDF_SQL.replace("@", TERMS_SQL).replace("?", ", ".join(f"'{w}'" for w in query.split()) or "''")


@registered("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'red') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1') AND contains(lower(p_type), 'eco')")
def keyword_all_parts(spark, sf_dir):
    found = search.keyword_search(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], "Red BRAND#1", area="eco", area_col="p_type")
    return found.select("p_partkey", "p_name", "p_type")


@registered("SELECT doc_id, source FROM documents WHERE contains(lower(coalesce(text, '') || ' ' || coalesce(source, '')), 'license') OR contains(lower(coalesce(text, '') || ' ' || coalesce(source, '')), 'akia')")
def keyword_any_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return search.keyword_search(docs, ["text", "source"], "license akia", mode="any").select("doc_id", "source")


@registered("""
SELECT CAST(p_partkey AS VARCHAR) AS id, 'part' AS type, concat_ws(' ', nullif(p_name, ''), nullif(p_brand, ''), nullif(p_type, '')) AS text FROM part
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'supplier', s_name FROM supplier
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'document', concat_ws(' ', nullif(source, ''), nullif(lang, ''), nullif(text, '')) FROM documents""")
def doc_union_search_text(spark, sf_dir):
    return search.search_documents(
        part=(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand", "p_type"]),
        supplier=(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_name"]),
        document=(table(spark, sf_dir, "documents"), "doc_id", ["source", "lang", "text"]),
    )


@registered("SELECT 'part' AS type, count(*) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'document', count(*) FROM documents")
def document_type_counts(spark, sf_dir):
    return search.type_counts(doc_union_search_text(spark, sf_dir))


@registered(f"WITH tok AS ({TERMS_SQL}) SELECT t AS term, count(DISTINCT doc_id) AS df, round(ln(((SELECT count(*) FROM documents) + 1.0) / (count(DISTINCT doc_id) + 1)) + 1, 6) AS idf FROM tok GROUP BY t")
def term_df_idf(spark, sf_dir):
    return search.term_idf(table(spark, sf_dir, "documents")).select("term", "df", F.round("idf", 6).alias("idf"))


@registered(_tfidf_sql(QUERY_WORDS) + "SELECT doc_id, round(exact, 4) AS score FROM s WHERE exact >= 0.04 ORDER BY score DESC, doc_id LIMIT 10")
def tfidf_topk(spark, sf_dir):
    return search.tfidf_search(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_WORDS, 10, "doc_id")


@registered(_tfidf_sql("que est") + "SELECT doc_id, round(exact, 4) AS score FROM s JOIN documents USING (doc_id) WHERE exact >= 0.04 AND lang = 'fr' ORDER BY score DESC, doc_id LIMIT 3")
def typed_tfidf_topk(spark, sf_dir):
    return search.tfidf_search(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "que est", 3, "doc_id", type_col="lang", type_is="fr")


@registered(_tfidf_sql("") + "SELECT w.doc_id, count(*) AS n_terms, round(sum((w.w / n.norm) ** 2), 6) AS norm FROM w JOIN n USING (doc_id) GROUP BY w.doc_id")
def tfidf_index_norms(spark, sf_dir):
    postings, _ = search.tfidf_index(table(spark, sf_dir, "documents"), "doc_id")
    return postings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("norm"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf_topk(spark, sf_dir)


DENSE_QUERY = [((i * 7) % 13 - 6) / 10 for i in range(64)]
DENSE_SQL = "list_dot_product(embedding::DOUBLE[], {q}) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product({q}, {q}))".format(q=f"{DENSE_QUERY}::DOUBLE[]")


@registered(f"SELECT vec_id, round(exact, 4) AS score FROM (SELECT vec_id, {DENSE_SQL} AS exact FROM embeddings) WHERE exact >= 0.1 ORDER BY score DESC, vec_id LIMIT 10")
def dense_cosine_topk(spark, sf_dir):
    return search.dense_search(table(spark, sf_dir, "embeddings"), DENSE_QUERY, 10, least=0.1)


@registered(f"SELECT vec_id, round(exact, 4) AS score FROM (SELECT vec_id, {DENSE_SQL} AS exact FROM embeddings WHERE label = 1) WHERE exact >= 0.05 ORDER BY score DESC, vec_id LIMIT 5")
def dense_typed_topk(spark, sf_dir):
    return search.dense_search(table(spark, sf_dir, "embeddings"), DENSE_QUERY, 5, least=0.05, where=F.col("label") == 1)


ADVICE = [("report", ["list", "analytics", "ing"]), ("form", ["form", "print"]), ("event", ["event", "notify", "ent"]), ("batch", ["job", "background"])]
_advice_sql = " UNION ALL ".join(f"SELECT doc_id, {n} AS rule_no, '{m}' AS mode, (" + " + ".join(f"contains(lower(coalesce(text, '')), '{k}')::BIGINT" for k in ks) + ") AS score FROM documents" for n, (m, ks) in enumerate(ADVICE))


@registered(f"SELECT * FROM ({_advice_sql}) WHERE score > 0")
def advisor_scores(spark, sf_dir):
    return search.advise(table(spark, sf_dir, "documents"), ADVICE)


# ---------------------------------------------------------------- lint

RULES = [
    lint.Rule("R1", "error", r"(?i)password|secret", "credential"),
    lint.Rule("R2", "warning", r"[A-Z]{5,}!!", "shouting"),
    lint.Rule("R3", "warning", r"&&&|%%%", "markup"),
    lint.Rule("R4", "error", r"\bAKIA[A-Z0-9]{12,}", "access key"),
    lint.Rule("BAD", "error", r"(unclosed", "never used"),
]
_lines_sql = r"SELECT doc_id, n, raw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS k FROM documents WHERE text <> '') WHERE n < k OR raw <> ''"
_hits_sql = " UNION ALL ".join(f"SELECT doc_id, '{r.id}' AS rule, '{r.severity}' AS severity, '{r.message}' AS message, n::BIGINT AS line, trim(raw, ' ')[:160] AS code FROM l WHERE regexp_matches(raw, '{r.pattern}')" for r in RULES[:-1])


@registered(f"WITH l AS ({_lines_sql}) {_hits_sql}")
def regex_lint_findings(spark, sf_dir):
    return lint.lint(table(spark, sf_dir, "documents"), RULES)


@registered(f"""
WITH l AS ({_lines_sql}), h AS ({_hits_sql}),
c AS (SELECT doc_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity <> 'error') AS w FROM h GROUP BY doc_id)
SELECT doc_id, coalesce(e, 0) AS error_count, coalesce(w, 0) AS warning_count, CASE WHEN e > 0 THEN 'FAIL' WHEN w > 0 THEN 'WARN' ELSE 'PASS' END AS verdict
FROM documents LEFT JOIN c USING (doc_id)""")
def lint_verdict(spark, sf_dir):
    return lint.verdicts(table(spark, sf_dir, "documents"), RULES)


GUARD = {"shout": r"!!\s", "license": "mit license", "mail": r"[a-z0-9.]+@[a-z0-9]+", "again mail": "@"}


@registered("SELECT doc_id, labels FROM (SELECT doc_id, list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '(?i){p}') THEN '{k}' END" for k, p in GUARD.items()) + "], lambda x: x IS NOT NULL)) AS labels FROM documents WHERE regexp_matches(text, '(?i)the|der')) WHERE len(labels) > 0")
def guard_labels(spark, sf_dir):
    return lint.guard(table(spark, sf_dir, "documents"), GUARD, "(?i)the|der")


# ---------------------------------------------------------------- catalog and graph

OBJECTS_SQL = """
p AS (SELECT DISTINCT p_name, upper(split_part(p_name, ' ', 1)) AS a, upper(split_part(p_name, ' ', 2)) AS b, min(p_type) OVER (PARTITION BY p_name) AS area FROM part),
api AS (SELECT 'API_' || a || b || '_SRV' AS name, area, p_name AS title FROM p),
view AS (SELECT 'I_' || a[1] || lower(a[2:]) || b[1] || lower(b[2:]) || 'Item' AS name, area, '' AS title, 'T' || a AS replaced FROM p),
badi AS (SELECT 'MM_' || b || '_CHECK' AS name, min(area) AS area, 'extends ' || b AS title FROM p GROUP BY b)"""


def objects(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A small object catalog named after the parts: api, view (with replaces) and badi."""
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_type").alias("area"))
    p = p.select("p_name", "area", F.upper(F.split("p_name", " ")[0]).alias("a"), F.upper(F.split("p_name", " ")[1]).alias("b"))
    return {
        "api": p.select(F.concat(F.lit("API_"), "a", "b", F.lit("_SRV")).alias("name"), "area", F.col("p_name").alias("title")),
        "view": p.select(F.concat(F.lit("I_"), F.initcap("a"), F.initcap("b"), F.lit("Item")).alias("name"), "area", F.lit("").alias("title"), F.array(F.concat(F.lit("T"), "a")).alias("replaces")),
        "badi": p.groupBy("b").agg(F.min("area").alias("area")).select(F.concat(F.lit("MM_"), "b", F.lit("_CHECK")).alias("name"), "area", F.concat(F.lit("extends "), "b").alias("title")),
    }


NAMES_SQL = """n AS (SELECT upper(trim(name)) AS object_name, kind FROM (
  SELECT name, 'auto' AS kind FROM api UNION ALL SELECT lower(name), 'auto' FROM view UNION ALL SELECT name, 'auto' FROM badi UNION ALL SELECT DISTINCT replaced, 'auto' FROM view
  UNION ALL SELECT 'P_' || s_name, 'auto' FROM supplier UNION ALL SELECT 'BAPI_' || s_suppkey, 'auto' FROM supplier UNION ALL SELECT 'I_ITEM' || s_suppkey, 'auto' FROM supplier
  UNION ALL SELECT 'FOO' || s_suppkey || '_SRV', 'auto' FROM supplier UNION ALL SELECT 'ABC_' || s_suppkey || '_CHECK', 'auto' FROM supplier UNION ALL SELECT 'zz1_' || s_suppkey, 'auto' FROM supplier
  UNION ALL SELECT s_name, 'odata' FROM supplier UNION ALL SELECT n_name, 'bapi' FROM nation))"""


@registered(f"""
WITH {OBJECTS_SQL}, {NAMES_SQL},
r AS (SELECT upper(replaced) AS t, string_agg(name, ', ' ORDER BY name) AS alt FROM view GROUP BY 1),
x AS (SELECT n.*, r.alt, CASE
  WHEN starts_with(object_name, 'BAPI_') OR kind = 'bapi' THEN 1 WHEN r.t IS NOT NULL THEN 2
  WHEN object_name IN (SELECT upper(name) FROM api) THEN 3 WHEN object_name IN (SELECT upper(name) FROM badi) THEN 4 WHEN object_name IN (SELECT upper(name) FROM view) THEN 5
  WHEN starts_with(object_name, 'P_') THEN 6 WHEN kind IN ('cds', 'cds_view', 'view') OR regexp_matches(object_name, '^[ICARE]_[A-Z0-9][A-Z0-9_]{{2,}}$') THEN 7
  WHEN kind IN ('api', 'odata', 'soap', 'service', 'event') OR regexp_matches(object_name, '^(API_|CE_)|(_SRV|_IN|_OUT)$') THEN 8
  WHEN kind = 'badi' OR regexp_matches(object_name, '^[A-Z]{{2,}}_[A-Z0-9_]{{3,}}$') THEN 9 ELSE 10 END AS rule FROM n LEFT JOIN r ON r.t = n.object_name)
SELECT object_name, kind, CASE WHEN rule <= 2 THEN 'NOT_AVAILABLE' WHEN rule IN (3, 4, 5, 7, 8) THEN 'LIKELY_RELEASED' ELSE 'NOT_VERIFIED' END AS verdict,
  rule <= 2 AS verified, rule, CASE WHEN rule = 2 THEN alt END AS alternatives FROM x""")
def release_verdict(spark, sf_dir):
    o, sup = objects(spark, sf_dir), table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    auto = [
        o["api"].select("name"), o["view"].select(F.lower("name").alias("name")), o["badi"].select("name"), o["view"].select(F.col("replaces")[0].alias("name")).distinct(),
        *[sup.select(e.alias("name")) for e in (F.concat(F.lit("P_"), "s_name"), F.concat(F.lit("BAPI_"), key), F.concat(F.lit("I_ITEM"), key), F.concat(F.lit("FOO"), key, F.lit("_SRV")), F.concat(F.lit("ABC_"), key, F.lit("_CHECK")), F.concat(F.lit("zz1_"), key))],
    ]
    names = auto[0]
    for part in auto[1:]:
        names = names.unionByName(part)
    names = names.withColumn("type", F.lit("auto")).unionByName(sup.select(F.col("s_name").alias("name"), F.lit("odata").alias("type"))).unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("bapi").alias("type")))
    return catalog.release_verdicts(names, o["api"], o["badi"], o["view"])


@registered(f"WITH {OBJECTS_SQL} SELECT upper(replaced) AS \"table\", list_sort(list(DISTINCT name)) AS views FROM view GROUP BY 1")
def table_replacements(spark, sf_dir):
    return catalog.replacements(objects(spark, sf_dir)["view"])


TOKENS_SQL = f"""{OBJECTS_SQL},
n AS (SELECT name, 'api' AS type, area, title FROM api UNION ALL SELECT name, 'view', area, title FROM view UNION ALL SELECT name, 'badi', area, title FROM badi),
frag AS (SELECT name, type, area, title, unnest(string_split(regexp_replace(regexp_replace(name, '^(API_|I_|MM_)', ''), '(_SRV|_CHECK)$', ''), '_')) AS f FROM n),
tok AS (SELECT DISTINCT name, type, lower(unnest(regexp_extract_all(f, '[A-Z][a-z0-9]+|[A-Z]+$|[a-z][a-z0-9]*'))) AS tok FROM frag WHERE f <> ''),
t AS (SELECT * FROM tok WHERE length(tok) >= 3 AND tok NOT IN ({", ".join(f"'{w}'" for w in T.NAME_NOISE)})),
one AS (SELECT a.name AS src, b.name AS dst FROM t a JOIN t b ON a.type <> b.type AND length(b.tok) >= 6 AND length(a.tok) <= length(b.tok) AND starts_with(b.tok, a.tok)),
e AS (SELECT src, dst FROM one UNION SELECT dst, src FROM one)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = checkpointed(graph.nodes(**{k: df.drop("replaces") for k, df in objects(spark, sf_dir).items()}))
    return n, checkpointed(graph.edges(n))  # each hop and each fallback reads them again


@registered(f"WITH {TOKENS_SQL} SELECT name, type, list_sort(list(tok)) AS tokens FROM t GROUP BY name, type")
def name_tokens(spark, sf_dir):
    return _graph(spark, sf_dir)[0].where(F.size("tokens") > 0).select("name", "type", "tokens")


@registered(f"WITH {TOKENS_SQL} SELECT * FROM e")
def name_token_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


@registered(f"""WITH {TOKENS_SQL}, h1 AS (SELECT src AS root, dst AS name FROM e WHERE starts_with(src, 'MM_')),
h2 AS (SELECT h1.root, e.dst AS name FROM h1 JOIN e ON h1.name = e.src WHERE e.dst <> h1.root AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.root = h1.root AND x.name = e.dst))
SELECT DISTINCT root, name, 1 AS hop FROM h1 UNION ALL SELECT DISTINCT root, name, 2 FROM h2""")
def graph_bfs_depth2(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return graph.neighbourhood(e, n.where("name LIKE 'MM\\_%'").select("name"), 2)


@registered(f"""WITH {TOKENS_SQL},
f AS (SELECT e.src AS root, 'name_match' AS mode, e.dst AS name FROM e UNION ALL
  SELECT a.name, 'area_fallback', b.name FROM n a JOIN n b ON a.area = b.area AND a.name <> b.name WHERE a.area <> '' AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = a.name))
SELECT root, mode, type, f.name, area, title FROM f JOIN n ON f.name = n.name""")
def object_graph(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    return graph.object_graph(n, e, n.select("name"), 1)


@registered(f"""WITH {TOKENS_SQL},
f AS (SELECT e.src AS root, 'name_match' AS mode, e.dst AS name FROM e UNION ALL
  SELECT a.name, 'area_fallback', b.name FROM n a JOIN n b ON a.area = b.area AND a.name <> b.name WHERE a.area <> '' AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = a.name)),
g AS (SELECT root, mode, type, count(*) AS n FROM f JOIN n ON f.name = n.name GROUP BY root, mode, type)
SELECT *, (sum(n) OVER (PARTITION BY root))::BIGINT AS total FROM g""")
def connection_counts(spark, sf_dir):
    return graph.connection_counts(object_graph(spark, sf_dir))


@registered(f"""WITH {TOKENS_SQL},
ent AS (SELECT 'API_' || upper(split_part(p_name, ' ', 1)) || upper(split_part(p_name, ' ', 2)) AS service, list_sort(list(DISTINCT p_brand)) AS ents FROM part GROUP BY 1)
SELECT n.name, n.type, ents AS live_entities FROM n LEFT JOIN ent ON n.type = 'api' AND ent.service = replace(replace(n.name, '_SRV', ''), '_PROCESS', '') AND (n.name < 'API_M' OR n.name > 'API_S')""")
def live_entities(spark, sf_dir):
    n = _graph(spark, sf_dir)[0]
    words = F.split(F.upper("p_name"), " ")
    entities = table(spark, sf_dir, "part").select(F.concat(F.lit("API_"), words[0], words[1]).alias("service"), F.col("p_brand").alias("entity"))
    short = n.where("name < 'API_M'").select(F.replace("name", F.lit("_SRV"), F.lit("")).alias("service"))
    allowed = short.union(n.where("name > 'API_S'").select("name"))
    return graph.enriched(n, entities, allowed).select("name", "type", "live_entities")


@registered(f"WITH {TOKENS_SQL} SELECT name, type FROM n WHERE contains(lower(name), 'item') ORDER BY name, type LIMIT 10")
def name_hints(spark, sf_dir):
    return graph.hints(_graph(spark, sf_dir)[0], "ITEM")


@registered(f"WITH {TOKENS_SQL} SELECT area, type, count(*) AS n FROM n WHERE area <> '' GROUP BY area, type")
def area_type_counts(spark, sf_dir):
    return graph.area_counts(_graph(spark, sf_dir)[0])


@registered(f"WITH {TOKENS_SQL} SELECT area, type, name, title FROM n WHERE area = (SELECT min(area) FROM n WHERE contains(lower(area), 'o'))")
def area_map(spark, sf_dir):
    return graph.area_map(_graph(spark, sf_dir)[0], "O")


@registered(f"WITH {TOKENS_SQL} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(DISTINCT nullif(area, '')) FROM n) AS areas, (SELECT count(*) FROM e WHERE src < dst) AS edges")
def graph_stats(spark, sf_dir):
    return graph.stats(*_graph(spark, sf_dir))


@registered(f"WITH {TOKENS_SQL} SELECT name, type, area FROM n WHERE name = (SELECT min(name) FROM n WHERE starts_with(lower(name), 'i_'))")
def resolve_name(spark, sf_dir):
    return graph.resolve(_graph(spark, sf_dir)[0], "i_").select("name", "type", "area")


@registered("SELECT r_name AS area, list_sort(list(n_name)) AS members, count(*)::INT AS total FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def area_members(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return graph.area_members(nations.select(F.col("n_name").alias("name"), F.col("r_name").alias("area")))


@registered(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in TABLES))
def table_counts(spark, sf_dir):
    return catalog.table_counts(**{t: table(spark, sf_dir, t) for t in TABLES})


OLD_SQL = "old AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment ELSE '' END AS c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 4 > 0)"
NEW_SQL = "new AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)"


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    old = c.where(k % 4 > 0).select("c_custkey", F.when(k % 3 > 0, F.col("c_name")).alias("c_name"), F.when(k % 5 > 0, F.col("c_mktsegment")).otherwise("").alias("c_mktsegment"), "c_acctbal")
    return old, c.where(k % 2 == 0).select("c_custkey", "c_name", "c_mktsegment", (F.col("c_acctbal") + 1).alias("c_acctbal"))


@registered(f"""WITH {OLD_SQL}, {NEW_SQL}
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.c_name, n.c_name) AS c_name, CASE WHEN o.c_custkey IS NULL THEN n.c_mktsegment ELSE o.c_mktsegment END AS c_mktsegment,
  CASE WHEN o.c_custkey IS NULL THEN n.c_acctbal ELSE o.c_acctbal END AS c_acctbal,
  CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NOT NULL AND o.c_name IS NULL AND n.c_name IS NOT NULL THEN 'backfilled' ELSE 'existing' END AS _status
FROM old o FULL JOIN new n ON o.c_custkey = n.c_custkey""")
def merge_backfill(spark, sf_dir):
    return catalog.merge_backfill(*_old_new(spark, sf_dir), "c_custkey", ["c_name"])


@registered(f"""WITH {OLD_SQL}, {NEW_SQL}, s AS (SELECT CASE WHEN o.c_custkey IS NULL THEN 'added'
  WHEN n.c_custkey IS NOT NULL AND ((o.c_name IS NULL) OR (nullif(o.c_mktsegment, '') IS NULL)) THEN 'backfilled' ELSE 'existing' END AS status
  FROM old o FULL JOIN new n ON o.c_custkey = n.c_custkey) SELECT status, count(*) AS n FROM s GROUP BY status""")
def merge_dry_run_counts(spark, sf_dir):
    merged = catalog.merge_backfill(*_old_new(spark, sf_dir), "c_custkey", ["c_name", "c_mktsegment"], empty_too=True)
    return merged.groupBy(F.col("_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@registered(f"WITH {OLD_SQL}, {NEW_SQL} SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new) UNION ALL SELECT * FROM new")
def upsert_rows(spark, sf_dir):
    return catalog.upsert(*_old_new(spark, sf_dir), "c_custkey")


@registered("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_custkey % 7 <> 0) WHERE n = 1
UNION ALL SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey % 7 = 0""")
def insert_or_ignore(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return catalog.insert_or_ignore(o.where("o_custkey % 7 = 0"), o, "o_custkey", ["o_orderkey"])


@registered("SELECT d.doc_id, d.n_chars, CASE WHEN source = 'src0' THEN source ELSE sha256(source)[:8] END AS source FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_export(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    out = rows.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return out.withColumn("source", catalog.anonymous_source(F.col("source"), ("src0",)))


@registered("SELECT printf('EXP-%03d', max(p_partkey) + 1) AS next_id FROM part")
def next_lesson_id(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select(F.format_string("EXP-%03d", "p_partkey").alias("id"))
    return catalog.next_number(ids.union(spark.range(1).select(F.lit("EXP-x9"))), "id")


ARTIFACTS_SQL = "SELECT c_custkey, c_name, c_mktsegment, CASE c_custkey % 4 WHEN 0 THEN 'ODATA' WHEN 1 THEN 'SOAP' WHEN 2 THEN '' ELSE 'ODATAV4' END AS sub, CASE WHEN c_custkey % 3 = 0 THEN 'https://x/' || c_custkey ELSE '' END AS url, CASE WHEN c_custkey % 5 = 0 THEN 'DRAFT' ELSE 'RELEASED' END AS state FROM customer"


@registered(f"SELECT c_name AS name, c_mktsegment || ' (' || c_custkey || ')' AS title, CASE sub WHEN 'SOAP' THEN 'SOAP' WHEN 'ODATAV4' THEN 'OData V4' ELSE 'OData V2' END AS protocol, CASE WHEN url <> '' THEN url ELSE 'https://hub/' || c_name || '/overview' END AS hub_url, NULL::VARCHAR AS notes FROM ({ARTIFACTS_SQL}) WHERE state = 'RELEASED'")
def artifact_rows(spark, sf_dir):
    k = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("Name"), F.concat("c_mktsegment", F.lit(" ("), k, F.lit(")")).alias("DisplayName"), F.lit(" ").alias("Description"), F.lit("API").alias("Type"),
        F.when(k % 4 == 0, "ODATA").when(k % 4 == 1, "SOAP").when(k % 4 == 2, "").otherwise("ODATAV4").alias("SubType"),
        F.when(k % 5 == 0, "DRAFT").otherwise("RELEASED").alias("State"), F.when(k % 3 == 0, F.concat(F.lit("https://x/"), k)).otherwise("").alias("Url"),
    )
    return catalog.artifact_rows(raw, "https://hub")


@registered("SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-06-01')::INT AS age_days, date_diff('day', o_orderdate::DATE, DATE '1998-06-01') > 90 AS stale FROM orders")
def stale_rows(spark, sf_dir):
    return catalog.stale(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", F.lit("1998-06-01").cast("date")).select("o_orderkey", "age_days", "stale")


# ---------------------------------------------------------------- logs, usage, runs


@registered("SELECT event_type AS tool, count(*) AS count, count(*) FILTER (event_type = 'error') AS errors, sum(trunc(value * 10)::BIGINT)::BIGINT AS total_ms FROM events GROUP BY event_type")
def tool_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ms", F.col("value") * 10)
    return runs.tool_metrics(e, "event_type", "ms", F.col("event_type") == "error")


@registered("SELECT count(*)::BIGINT AS calls, count(*) FILTER (event_type = 'error')::BIGINT AS errors FROM events")
def metrics_total(spark, sf_dir):
    return runs.metrics_total(tool_metrics(spark, sf_dir))


USAGE_SQL = """u AS (SELECT user_id AS run, count(*) AS jobs, sum(event_id % 1000)::BIGINT AS input, sum(event_id % 77)::BIGINT AS output, sum(CASE WHEN event_id % 2 = 0 THEN event_id % 500 ELSE 0 END)::BIGINT AS cache_read, 0::BIGINT AS cache_write FROM events GROUP BY user_id),
c AS (SELECT *, input + output + cache_read + cache_write AS total_tokens, round(input / 1e6 * 3.0 + output / 1e6 * 15.0 + cache_read / 1e6 * 0.3 + cache_write / 1e6 * 3.75, 4) AS est_cost FROM u)"""


@registered(f"WITH {USAGE_SQL} SELECT * FROM c")
def usage_rollup(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("user_id", (k % 1000).alias("i"), (k % 77).alias("o"), F.when(k % 2 == 0, k % 500).alias("r"), F.lit(None).cast("long").alias("w"))
    return runs.usage_by_run(e, "user_id", "i", "o", "r", "w")


@registered(f"WITH {USAGE_SQL} SELECT count(*) AS runs, sum(jobs)::BIGINT AS jobs, sum(total_tokens)::BIGINT AS total_tokens, round(sum(est_cost), 4) AS est_cost FROM c")
def usage_total(spark, sf_dir):
    return runs.usage_total(usage_rollup(spark, sf_dir))


@registered("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_jobs(spark, sf_dir):
    return runs.latest_jobs(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@registered("""SELECT coalesce(u.k, c.c_custkey) AS k, u.n, c.c_name, u.k IS NOT NULL AND c.c_custkey IS NOT NULL AS matched, u.k IS NOT NULL AS has_usage
FROM (SELECT user_id * 3 AS k, count(*) AS n FROM events GROUP BY 1) u FULL JOIN customer c ON u.k = c.c_custkey""")
def usage_full_outer(spark, sf_dir):
    u = table(spark, sf_dir, "events").groupBy((F.col("user_id") * 3).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return runs.usage_with_runs(u, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name"), "k")


RUNS_SQL = "r AS (SELECT o_custkey AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'X' || o_custkey ELSE 'X' || o_custkey || '-R' || (o_orderkey % 40) END AS id FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)), v AS (SELECT DISTINCT source, id, coalesce(nullif(regexp_extract(id, '-R(\\d+)$', 1), '')::INT, 1) AS version FROM r)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("k")).distinct()
    base = F.concat(F.lit("X"), F.col("o_custkey").cast("string"))
    return o.select(F.col("o_custkey").alias("source"), F.when(F.col("k") % 3 == 0, base).otherwise(F.concat(base, F.lit("-R"), (F.col("k") % 40).cast("string"))).alias("id")).distinct()


@registered(f"WITH {RUNS_SQL} SELECT source, id, version, lag(id) OVER (PARTITION BY source ORDER BY version, id) AS previous_run, count(*) OVER (PARTITION BY source) AS run_count FROM v")
def run_lag_versions(spark, sf_dir):
    return runs.run_history(_runs(spark, sf_dir), "id", "source")


@registered(f"WITH {RUNS_SQL} SELECT source, min(regexp_replace(id, '-R\\d+$', '')) AS base, max(version) + 1 AS version, (list(id ORDER BY version DESC, id DESC))[1] AS previous_run, min(regexp_replace(id, '-R\\d+$', '')) || '-R' || (max(version) + 1) AS next_run FROM v GROUP BY source")
def next_run(spark, sf_dir):
    return runs.next_run(_runs(spark, sf_dir), "id", "source")


FINDINGS_SQL = "f AS (SELECT l_orderkey AS run, CASE l_linenumber % 3 WHEN 0 THEN 'Critical' WHEN 1 THEN 'Major' ELSE 'Minor' END AS sev, l_linestatus = 'F' AS done FROM lineitem)"


@registered(f"WITH {FINDINGS_SQL} SELECT run, greatest(0, 100 - sum(CASE WHEN sev = 'Critical' AND done THEN 5 WHEN sev = 'Major' AND NOT done THEN 8 WHEN sev = 'Major' THEN 2 WHEN sev = 'Minor' AND NOT done THEN 3 WHEN sev = 'Minor' THEN 1 ELSE 0 END))::BIGINT AS score, count(*) FILTER (sev = 'Critical' AND NOT done) AS blockers FROM f GROUP BY run")
def quality_score(spark, sf_dir):
    n = F.col("l_linenumber") % 3
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.when(n == 0, "Critical").when(n == 1, "Major").otherwise("Minor").alias("sev"), (F.col("l_linestatus") == "F").alias("done"))
    return runs.quality_scores(f, "run", F.col("sev"), F.col("done"))


@registered(f"""WITH {FINDINGS_SQL}, s AS (SELECT run,
  greatest(0, 100 - sum(CASE WHEN sev = 'Critical' AND done THEN 5 WHEN sev = 'Major' AND NOT done THEN 8 WHEN sev = 'Major' THEN 2 WHEN sev = 'Minor' AND NOT done THEN 3 WHEN sev = 'Minor' THEN 1 ELSE 0 END))::BIGINT AS score,
  count(*) FILTER (sev = 'Critical' AND NOT done) AS open_critical, count(*) FILTER (sev = 'Major' AND NOT done) AS open_major, count(*) AS total FROM f GROUP BY run)
SELECT *, open_critical > 0 OR open_major > 0 OR score < 70 AS needs_review FROM s""")
def review_state(spark, sf_dir):
    n = F.col("l_linenumber") % 3
    status = F.when(F.col("l_linestatus") == "F", "Resolved").otherwise("Open")
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.when(n == 0, "Critical").when(n == 1, "Major").otherwise("Minor").alias("sev"), status.alias("status"))
    return runs.review_state(f, "run", F.col("sev"), F.col("status"))


@registered("""WITH a AS (SELECT l_orderkey AS id, CASE l_linenumber % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'fix' ELSE 'skip' END AS action FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber::BIGINT * 1000000000 + l_partkey DESC) = 1)
SELECT o_orderkey AS id, CASE action WHEN 'accept' THEN 'Accepted' WHEN 'fix' THEN 'Pending Fix' ELSE 'Open' END AS status, coalesce(action IN ('accept', 'fix'), false) AS actioned FROM orders LEFT JOIN a ON id = o_orderkey""")
def finding_actions(spark, sf_dir):
    n = F.col("l_linenumber")
    actions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(n % 3 == 0, "accept").when(n % 3 == 1, "fix").otherwise("skip").alias("action"), (n.cast("long") * 1000000000 + F.col("l_partkey")).alias("n"))
    return runs.apply_actions(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("Open").alias("status")), actions)


@registered("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'B' WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0 THEN 'A' WHEN o_orderkey % 3 = 0 THEN 'B' WHEN o_orderkey % 5 = 0 THEN 'C' END AS picked FROM orders""")
def picked_options(spark, sf_dir):
    k, no = F.col("o_orderkey"), F.lit(False)
    option = lambda i, m, f, r, n: F.struct(F.lit(i).alias("id"), m.alias("mandated"), f.alias("feasible"), r.alias("recommended"), n.alias("names"))
    none = F.lit(None).cast("array<string>")
    options = F.array(
        option("A", k % 2 == 0, F.when(k % 4 == 0, False).when(k % 8 == 6, True), no, none), option("B", no, F.lit(True), k % 3 == 0, none),
        option("C", no, F.lit(True), no, F.when(k % 5 == 0, F.array(F.lit("ZC")))),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", runs.picked_option(options, F.when(k % 7 == 0, "B").when(k % 11 == 0, "Z")).alias("picked"))


@registered("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN [11, 12, 13, 14] ELSE [11, 12] END AS steps, c_custkey % 3 <> 2 AS same FROM customer")
def visible_steps(spark, sf_dir):
    k = F.col("c_custkey")
    steps = F.array(*[F.struct(F.lit(n).alias("n")) for n in (11, 12, 13, 14)])
    ids = F.when(k % 3 == 0, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).when(k % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.transform(runs.visible_steps(steps, k % 2 == 0), lambda s: s["n"]).alias("steps"), runs.same_ids(ids, F.array(F.lit("a"), F.lit("b"))).alias("same"))


@registered("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'checklist' WHEN o_orderkey % 7 = 0 THEN 'names' WHEN o_orderkey % 5 = 0 THEN 'findings without action' WHEN o_orderkey % 3 = 0 AND o_orderstatus <> 'F' THEN 'open majors need a comment' END AS gate_error FROM orders")
def approval_gates(spark, sf_dir):
    k, one = F.col("o_orderkey"), lambda c: c.cast("int")
    o = table(spark, sf_dir, "orders").select("o_orderkey", one(k % 11 == 0).alias("checklist_open"), one(k % 7 == 0).alias("bad_names"), one(k % 5 == 0).alias("unactioned"), F.lit(None).cast("int").alias("unjustified"), F.lit(0).alias("unverified"), one(k % 3 == 0).alias("open_majors"), F.when(F.col("o_orderstatus") == "F", "fine").alias("comment"))
    return runs.approval_errors(o).select("o_orderkey", "gate_error")


@registered("SELECT * FROM (SELECT DISTINCT lower(p_type) AS w FROM part EXCEPT SELECT unnest(string_split(lower(p_name), ' ')) FROM part)")
def except_objects(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return runs.except_sorted(p.select(F.lower("p_type").alias("w")), p.select(F.explode(T.words(F.col("p_name"))).alias("w")))


@registered(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), ' ') AS text FROM pages")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@registered("""SELECT event_id, regexp_replace(props, '("k"\\s*:\\s*)[0-9]+', '\\1"***REDACTED***"') AS props FROM events""")
def redact_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", runs.redact(F.col("props"), ["k", "password"]).alias("props"))


@registered("""WITH c AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'o' || l_orderkey ELSE 'c' || l_suppkey END AS target, l_returnflag || l_linestatus AS text, l_orderkey * 10 + l_linenumber AS n FROM lineitem),
l AS (SELECT target, max(n) AS n, max(text) AS text FROM c JOIN (SELECT target, max(n) AS n FROM c GROUP BY target) m USING (target, n) GROUP BY target)
SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS file, CASE WHEN coalesce(a.n, -1) >= coalesce(b.n, -1) THEN a.text ELSE b.text END AS comment
FROM orders LEFT JOIN l a ON a.target = 'o' || o_orderkey LEFT JOIN l b ON b.target = 'c' || o_custkey""")
def last_comments(spark, sf_dir):
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    target = F.when(F.col("l_linenumber") % 2 == 0, key("o", "l_orderkey")).otherwise(key("c", "l_suppkey"))
    comments = table(spark, sf_dir, "lineitem").select(target.alias("target"), F.concat("l_returnflag", "l_linestatus").alias("text"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"))
    findings = table(spark, sf_dir, "orders").select(key("o", "o_orderkey").alias("id"), key("c", "o_custkey").alias("file"))
    return runs.apply_comments(findings, comments)


@registered("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def upsert_last_of_batch(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return catalog.upsert(o.where("o_custkey % 2 = 0").dropDuplicates(["o_custkey"]), o, "o_custkey", order=["o_orderkey"])


@registered("SELECT CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE upper(c_name) END AS name, c_name AS title, c_name AS notes, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' (Basic)' END AS description, 'hub_sync' AS source FROM customer")
def view_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = c.select(F.upper("c_name").alias("Name"), F.col("c_name").alias("DisplayName"), F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" (Basic)"))).alias("Description"), F.lit("Released").alias("State"))
    return catalog.view_rows(raw)


@registered("SELECT event_id, ts, event_type FROM events ORDER BY event_id DESC LIMIT 10")
def audit_tail(spark, sf_dir):
    return runs.tail(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), "event_id", 0)


@registered("SELECT r_name, coalesce(list_sort(list(n_name) FILTER (n_name IS NOT NULL)), []) AS runs FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def inputs_with_runs(spark, sf_dir):
    r = table(spark, sf_dir, "region").select("r_name", F.col("r_regionkey").alias("path"))
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("path"), "n_name")
    return runs.inputs_with_runs(r, n, "path", "n_name").select("r_name", "runs")


@registered("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN regexp_matches(c_name, '^[A-Za-z][A-Za-z0-9_./-]{1,}$') ELSE regexp_matches('Z' || replace(c_name, '#', ''), '^(YY1_|Z|Y)[A-Za-z0-9_]{2,}$') END AS ok FROM customer")
def name_validity(spark, sf_dir):
    side = F.col("c_mktsegment") == "BUILDING"
    name = F.when(side, F.col("c_name")).otherwise(F.concat(F.lit("Z"), F.replace("c_name", F.lit("#"), F.lit(""))))
    return table(spark, sf_dir, "customer").select("c_custkey", runs.name_ok(name, F.when(side, "BTP")).alias("ok"))


@registered("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND (c_mktsegment LIKE 'B%' OR c_custkey % 3 = 1) THEN 'RICEFW Pipeline (14 steps, incl. BTP deploy)' ELSE 'RICEFW Pipeline (12 steps)' END AS label FROM customer""")
def workflow_labels(spark, sf_dir):
    k = F.col("c_custkey")
    side = runs.is_side_by_side(F.when(F.col("c_mktsegment").startswith("B"), True), F.array(F.lit("sbpa"), F.when(k % 3 == 1, "CAP").otherwise(" ")), F.lit("key user"))
    return table(spark, sf_dir, "customer").select("c_custkey", runs.workflow_label(F.when(k % 2 == 0, "my pipeline").otherwise(""), side).alias("label"))


@registered("SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type LIKE '%sign%' THEN 'login' END AS class FROM events")
def failure_classes(spark, sf_dir):
    log = F.concat(F.lit("start "), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", runs.failure_class(log, {"ERROR": "failed", "sign": "login"}).alias("class"))


@registered("""WITH j AS (SELECT user_id AS run, max((event_type = 'view' AND event_id % 97 = 0)::INT) AS live, max(ts) AS last FROM events GROUP BY user_id)
SELECT run FROM j WHERE live = 0 AND run % 2 = 0""")
def stalled_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    jobs = e.select(F.col("user_id").alias("run"), ((F.col("event_type") == "view") & (F.col("event_id") % 97 == 0)).alias("alive"))
    r = e.groupBy(F.col("user_id").alias("run")).agg(F.max("ts").alias("last_activity")).withColumn("status", F.when(F.col("run") % 2 == 0, "running").otherwise("done"))
    return runs.stalled(r, jobs, F.lit("2024-02-01").cast("timestamp_ntz")).select("run")


@registered("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, count(*) AS n, epoch_us(max(ts))::BIGINT AS last_us FROM s GROUP BY user_id, s.n""")
def idle_sessions(spark, sf_dir):
    s = limits.idle_sessions(table(spark, sf_dir, "events"), "user_id", "ts", "12 hours")
    return s.select("user_id", "n", F.unix_micros("last_activity").alias("last_us"))


@registered("""WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, event_id, n, [sec] AS w, true AS accepted FROM r WHERE n = 1 UNION ALL
  SELECT user_id, event_id, n, CASE WHEN len(k) < 2 THEN list_append(k, sec) ELSE k END, len(k) < 2
  FROM (SELECT r.*, list_filter(s.w, lambda x: r.sec - x <= 86400) AS k FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1))
SELECT user_id, event_id, accepted FROM s""")
def rate_limited_events(spark, sf_dir):
    return limits.rate_limited(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", limit=2, span=86400.0)
