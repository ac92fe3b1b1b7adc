"""Remote artifacts of all kinds as catalog rows, and their merge into the stored catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import catalog

#: The kinds of artifacts, the columns that a merge fills in by catalog, and what a synced extension point is.
KINDS = {"API": "api", "EVENT": "event", "CDSVIEW": "view", "BADI": "badi"}
FILLED = {
    "api": ["hub_url", "title", "communication_scenario", "notes", "protocol", "area"],
    "view": ["notes"],
    "badi": ["title", "use_case", "business_context", "area"],
}
EXTENSIBILITY, SOURCE = "key_user_custom_logic", "hub_sync"
#: Columns of each stored catalog.
COLUMNS = {
    "api": ["name", "title", "protocol", "area", "communication_scenario", "hub_url", "notes", "source"],
    "view": ["name", "area", "notes", "source"],
    "badi": ["name", "title", "area", "extensibility_type", "business_context", "use_case", "verified_in_tenant", "source"],
}


def catalog_rows(raw: DataFrame, url_base: str) -> DataFrame:
    """Released artifacts (Name, DisplayName, Description, Type, SubType, State, Url) as rows of one shape, with their kind.

    APIs and events have title, protocol, URL and notes (the description); an event's protocol is Event. A view is named as its description
    spells it and noted by its display name; it has no title. An extension point has the description as its use case. What
    a remote artifact does not tell (area, replaces and so on) is null. Artifacts of other types and rows without a name go.
    """
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    kind = F.element_at(kinds, F.upper(F.trim("Type")))
    name, shown, told = (T.filled(F.col(c)) for c in ("Name", "DisplayName", "Description"))
    view, badi, api = kind == "view", kind == "badi", kind.isin("api", "event")
    technical = catalog.technical_name(told, name)
    protocols = F.create_map(*[F.lit(x) for kv in catalog.PROTOCOLS.items() for x in kv])
    protocol = F.when(kind == "event", "Event").otherwise(F.coalesce(F.element_at(protocols, F.upper(T.filled(F.col("SubType")))), F.lit("OData V2")))
    url = T.filled(F.col("Url"))
    hub = F.when(url.startswith("http"), url).otherwise(F.format_string(url_base + "/%s/overview", name))
    none = F.lit(None).cast("string")
    rows = raw.where((F.upper("State") == "RELEASED") & kind.isNotNull()).select(
        kind.alias("kind"), F.when(view, technical).otherwise(name).alias("name"), F.when(~view, F.coalesce(shown, name)).alias("title"), F.when(api, protocol).alias("protocol"),
        none.alias("area"), none.alias("communication_scenario"), F.when(api, hub).alias("hub_url"), F.when(view, shown).when(api, told).alias("notes"),
        F.lit(None).cast("array<string>").alias("replaces"), F.when(badi, EXTENSIBILITY).alias("extensibility_type"), none.alias("business_context"),
        F.when(badi, told).alias("use_case"), F.when(badi, F.lit(False)).alias("verified_in_tenant"), F.lit(SOURCE).alias("source"),
    )
    return rows.where("name IS NOT NULL")


def synced(target: DataFrame, rows: DataFrame, kind: str, dry_run: bool = False) -> DataFrame:
    """A stored catalog (`api`, `view` or `badi`; its columns are in COLUMNS) with catalog_rows merged in, and _status.

    Events are APIs; of a name that both have the API counts. New names are added; on a match the catalog's columns in FILLED take
    the artifact's value where they are null (in a dry run: or empty).
    """
    order = {"api": ["api", "event"]}.get(kind, [kind])
    batch = rows.where(F.col("kind").isin(*order)).withColumn("_rank", F.array_position(F.array(*map(F.lit, order)), F.col("kind")))
    batch = catalog.last_rows(batch, "name", ["_rank"], first=True).select(*COLUMNS[kind])
    return catalog.merge_backfill(target.select(*COLUMNS[kind]), batch, "name", FILLED[kind], empty_too=dry_run)


def sync_counts(merged: dict[str, DataFrame]) -> DataFrame:
    """catalog, existing (before the merge), added, backfilled and total of each synced catalog."""
    out = None
    for kind, df in merged.items():
        n = lambda s: F.count_if(F.col("_status") == s)
        part = df.agg(F.count_if(F.col("_status") != "added").alias("existing"), n("added").alias("added"), n("backfilled").alias("backfilled"), F.count(F.lit(1)).alias("total"))
        part = part.select(F.lit(kind).alias("catalog"), "existing", "added", "backfilled", "total")
        out = part if out is None else out.unionByName(part)
    return out
