"""Catalog tables: verdicts, merges, upserts, exports, mapping of remote artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as T

#: Sources of lessons that say nothing about a customer and are kept as they are; others become a digest.
GENERIC_SOURCES = ("pipeline run", "seed")
#: Protocol by artifact subtype.
PROTOCOLS = {"ODATA": "OData V2", "ODATAV4": "OData V4", "SOAP": "SOAP", "REST": "REST", "EVENT": "Event"}


#: Shapes of object names by which a verdict is guessed.
VIEW_SHAPE, SERVICE_END, EXIT_SHAPE = "^[ICARE]_[A-Z0-9][A-Z0-9_]{2,}$", "(?:_SRV|_IN|_OUT)$", "^[A-Z]{2,}_[A-Z0-9_]{3,}$"


def replacements(views: DataFrame) -> DataFrame:
    """table (upper case) and the views that replace it, in order of name; `views` has name and replaces."""
    rows = views.select("name", F.explode("replaces").alias("t")).where("t IS NOT NULL AND t <> ''")
    return rows.groupBy(F.upper("t").alias("table")).agg(F.array_sort(F.collect_set("name")).alias("views"))


def release_verdicts(names: DataFrame, apis: DataFrame, badis: DataFrame, views: DataFrame) -> DataFrame:
    """object_name, verdict, verified, rule (1 to 10), alternatives. `names` has name and type (may be null).

    The first rule that holds decides. Catalogs are joined on the upper-cased name; with sides of unknown
    size Spark picks the join, and each catalog is reduced to one row per name first.
    """
    n = names.select(F.upper(F.trim(F.coalesce("name", F.lit("")))).alias("object_name"), F.lower(F.coalesce("type", F.lit("auto"))).alias("kind"))
    known = lambda df, flag: df.where("name IS NOT NULL").select(F.upper("name").alias("object_name")).distinct().withColumn(flag, F.lit(True))
    j = n.join(replacements(views).withColumnRenamed("table", "object_name"), "object_name", "left")
    for df, flag in ((apis, "in_api"), (badis, "in_badi"), (views, "in_view")):
        j = j.join(known(df, flag), "object_name", "left")
    name, kind = F.col("object_name"), F.col("kind")
    rule = (
        F.when(name.startswith("BAPI_") | (kind == "bapi"), 1)
        .when(F.col("views").isNotNull(), 2)
        .when(F.col("in_api"), 3).when(F.col("in_badi"), 4).when(F.col("in_view"), 5)
        .when(name.startswith("P_"), 6)
        .when(kind.isin("cds", "cds_view", "view") | name.rlike(VIEW_SHAPE), 7)
        .when(kind.isin("api", "odata", "soap", "service", "event") | name.startswith("API_") | name.startswith("CE_") | name.rlike(SERVICE_END), 8)
        .when((kind == "badi") | name.rlike(EXIT_SHAPE), 9)
        .otherwise(10)
    )
    j = j.withColumn("rule", rule)
    verdict = F.when(F.col("rule") <= 2, "NOT_AVAILABLE").when(F.col("rule").isin(3, 4, 5, 7, 8), "LIKELY_RELEASED").otherwise("NOT_VERIFIED")
    return j.select("object_name", "kind", verdict.alias("verdict"), (F.col("rule") <= 2).alias("verified"), "rule", F.when(F.col("rule") == 2, F.array_join("views", ", ")).alias("alternatives"))


def insert_or_ignore(target: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Target plus the batch rows whose key is new; the first row (by `order`) of a repeated key wins; null and empty keys go."""
    first = Window.partitionBy(key).orderBy(*order)
    fresh = batch.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).join(target.select(key), key, "left_anti")
    return target.unionByName(fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(target.columns))


def last_rows(batch: DataFrame, key: str, order: list[str] | None = None, first: bool = False) -> DataFrame:
    """Of each key the last (or first) row by `order`; rows that it does not tell apart, or without one, by all their columns."""
    by = [F.col(c).asc() if first else F.col(c).desc() for c in [*(order or []), *batch.columns]]
    return batch.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where("_n = 1").drop("_n")


def upsert(target: DataFrame, batch: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Target with whole rows replaced or added; of batch rows that repeat a key the last by `order` counts."""
    return target.join(batch.select(key), key, "left_anti").unionByName(last_rows(batch, key, order).select(target.columns))


def merge_backfill(target: DataFrame, batch: DataFrame, key: str, fill: list[str], empty_too: bool = False, order: list[str] | None = None) -> DataFrame:
    """Full outer merge: new keys are added; on a match only the `fill` columns that are null take the batch's value.

    Adds _status (existing, added, backfilled). With `empty_too`, empty strings count as missing, as in a dry run.
    Of batch rows that repeat a key the first by `order` counts.
    """
    gone = (lambda c: F.nullif(c, F.lit(""))) if empty_too else (lambda c: c)
    b = last_rows(batch.where(F.col(key).isNotNull()), key, order, first=True).select([F.col(c).alias(f"_{c}") for c in target.columns])
    j = target.withColumn("_old", F.lit(True)).join(b.withColumn("_new", F.lit(True)), F.col(key) == F.col(f"_{key}"), "full_outer")
    filled = F.lit(False)
    for c in fill:
        filled = filled | (gone(F.col(c)).isNull() & gone(F.col(f"_{c}")).isNotNull())
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNotNull() & filled, "backfilled").otherwise("existing")
    value = lambda c: F.when(F.col("_old").isNull(), F.col(f"_{c}")).otherwise(F.coalesce(gone(F.col(c)), F.col(f"_{c}"), F.col(c)) if c in fill else F.col(c))
    return j.select(*[value(c).alias(c) for c in target.columns], status.alias("_status"))


def anonymous_source(source: Column, generic: tuple[str, ...] = GENERIC_SOURCES) -> Column:
    """Generic sources as they are, others as the first 8 hex digits of their SHA-256."""
    s = F.trim(F.coalesce(source, F.lit("")))
    return F.when(F.lower(s).isin(*generic, ""), s).otherwise(F.left(F.sha2(s, 256), F.lit(8)))


def export_missing(rows: DataFrame, seed: DataFrame, key: str, source_col: str) -> DataFrame:
    """Rows whose key the seed lacks, with anonymous sources."""
    return rows.join(seed.select(key), key, "left_anti").withColumn(source_col, anonymous_source(F.col(source_col)))


def next_number(ids: DataFrame, id_col: str, prefix: str = "EXP-") -> DataFrame:
    """One row: the id after the largest numbered one, three digits at least."""
    n = F.max(F.when(F.col(id_col).rlike(rf"^{prefix}\d+$"), F.regexp_extract(id_col, r"(\d+)$", 1).cast("int")))
    return ids.agg((F.coalesce(n, F.lit(0)) + 1).alias("n")).select(F.format_string(prefix + "%03d", "n").alias("next_id"))


def lesson_errors(rows: DataFrame, categories: list[str]) -> DataFrame:
    """Adds `error` (null if acceptable): required fields, lengths, category, and traces of the customer in the text."""
    topic, lesson = F.trim(F.coalesce("topic", F.lit(""))), F.trim(F.coalesce("lesson", F.lit("")))
    category = F.lower(F.trim(F.coalesce(T.filled(F.col("category")), F.lit("general"))))
    error = (
        F.when((topic == "") | (lesson == ""), "topic and lesson are needed")
        .when((F.length(topic) > 160) | (F.length(lesson) > 1200), "too long")
        .when(~category.isin(*categories), "unknown category")
        .when(names_customer(F.concat_ws(" ", topic, lesson, "impact", F.array_join("tags", " ")), F.col("source")), "names the customer")
    )
    return rows.withColumn("error", error)


def names_customer(hay: Column, source: Column) -> Column:
    """True if a text names its source: the whole source without punctuation, or one of its parts of four or more characters with a digit."""
    squeeze = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    s = F.trim(F.coalesce(source, F.lit("")))
    parts = F.filter(F.split(s, "[^A-Za-z0-9]+"), lambda p: (F.length(p) >= 4) & p.rlike("[0-9]"))
    whole = (squeeze(s) != "") & F.contains(squeeze(hay), squeeze(s))
    return ~F.lower(s).isin(*GENERIC_SOURCES, "") & (whole | F.exists(parts, lambda p: F.contains(F.lower(hay), F.lower(p))))


def technical_name(description: Column, name: Column) -> Column:
    """A view's name as its description spells it (the text before ` (`), else the name."""
    return F.when(F.instr(description, " (") > 0, F.trim(F.substring_index(description, " (", 1))).otherwise(name)


def view_rows(raw: DataFrame) -> DataFrame:
    """Remote views (Name, DisplayName, Description, State) as catalog rows, released ones only: name, notes (the display name) and source.
    The stored catalog has no title and no description; both are given beside them, so that nothing that a view tells is lost."""
    name = technical_name(F.col("Description"), T.filled(F.col("Name")))
    return raw.where(F.upper("State") == "RELEASED").select(
        name.alias("name"), T.first_filled(F.col("DisplayName"), F.col("Name")).alias("title"), T.filled(F.col("DisplayName")).alias("notes"),
        T.filled(F.col("Description")).alias("description"), F.lit("hub_sync").alias("source"),
    )


def artifact_rows(raw: DataFrame, url_base: str) -> DataFrame:
    """Remote artifacts (Name, DisplayName, Description, Type, SubType, State, Url) as catalog rows, released ones only."""
    m = F.create_map(*[F.lit(x) for kv in PROTOCOLS.items() for x in kv])
    name = T.first_filled(F.col("Name"), F.col("DisplayName"))
    url = F.when(F.col("Url").rlike("(?i)^https?://"), F.col("Url")).otherwise(F.format_string(url_base + "/%s/overview", name))
    protocol = F.coalesce(F.element_at(m, F.upper(T.filled(F.col("SubType")))), F.lit("OData V2"))
    rows = raw.where(F.upper("State") == "RELEASED")
    return rows.select(name.alias("name"), T.first_filled(F.col("DisplayName"), F.col("Name")).alias("title"), protocol.alias("protocol"), url.alias("hub_url"), T.filled(F.col("Description")).alias("notes"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """table, n of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def stale(rows: DataFrame, date_col: str, as_of: Column, days: int = 90) -> DataFrame:
    """Adds age_days and stale: older than `days`, or without a readable date."""
    age = F.datediff(as_of, F.try_to_date(F.col(date_col).cast("string").substr(1, 10)))
    return rows.withColumn("age_days", age).withColumn("stale", F.coalesce(age > days, F.lit(True)))
