"""Remote collections as Python data sources, offline unless a transport is given.

`transport` is a picklable function (path, params) -> parsed JSON (or text, for XML); `guarded`
makes one for HTTPS, and test fakes plug in alike. Artifacts are read in planned ranges: the driver asks for the
total of each type once, and every range is a partition of its own. Entities take the DataFrame's
columns and filters as request parameters.
"""

from __future__ import annotations

import base64
import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from datetime import date
from urllib.parse import quote

import pandas as pd
from pyspark.cloudpickle import dumps, loads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as ty

PAGE, ROW_CAP, WAITS = 200, 50, (2.0, 4.0, 6.0)
#: Rows that one partition fetches, where the total is known.
RANGE_ROWS = 1000
#: Characters of service metadata that are shown.
METADATA_CAP = 60_000
ARTIFACT = "Name string, DisplayName string, Description string, Type string, SubType string, State string, Url string"
FIELDS = [c.split()[0] for c in ARTIFACT.split(", ")]
#: The envelopes that hold rows, and the fields that hold their total.
ENVELOPES = ("value", "content", "results", "items", "artifacts", "d")
TOTALS = ("@odata.count", "totalCount", "total", "count", "__count")
IDENTIFIER = re.compile(r"[A-Za-z0-9_]+")
SUSPICIOUS = re.compile(r"[;#]|--")


class Blocked(ValueError):
    """A request that the guards refuse."""


class Refused(RuntimeError):
    """An answer that no retry mends."""


# ---------------------------------------------------------------- requests


def check_url(url: str, blocked: tuple[str, ...] = ()) -> str:
    if not url.lower().startswith("https://"):
        raise Blocked("https only")
    if hit := next((b for b in blocked if b.lower() in url.lower()), None):
        raise Blocked(f"blocked: {hit}")
    return url


def check_service(service: str, allowed: tuple[str, ...]) -> str:
    if service not in allowed:
        raise Blocked(f"service not allowed: {service}")
    return service


def check_query(service: str, allowed: tuple[str, ...], entity_set: str, filter_: str = "", top: int = ROW_CAP) -> dict[str, str]:
    """Parameters of an entity query: the service is allowed, names and filters are harmless, rows are capped."""
    check_service(service, allowed)
    if not IDENTIFIER.fullmatch(entity_set):
        raise Blocked("bad entity set")
    if SUSPICIOUS.search(filter_):
        raise Blocked("bad filter")
    return {"$top": str(min(int(top) or ROW_CAP, ROW_CAP)), **({"$filter": filter_} if filter_ else {})}


def query_string(params: dict[str, str]) -> str:
    """URL parameters with literal dollar names."""
    return "&".join(f"{'$' if k.startswith('$') else ''}{quote(k.removeprefix('$'), safe='')}={quote(str(v), safe='')}" for k, v in params.items())


def basic_auth(user_variable: str, password_variable: str) -> Callable[[], dict[str, str]]:
    """Headers made from environment variables of the process that sends the request; no secret is part of a plan."""

    def headers() -> dict[str, str]:
        pair = f"{os.environ[user_variable]}:{os.environ[password_variable]}"
        return {"Authorization": "Basic " + base64.b64encode(pair.encode()).decode()}

    return headers


def fetch(url: str, headers: dict[str, str], timeout: float) -> tuple[int, str]:
    """Status and text of a GET over verified TLS."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json", **headers}), timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")[:2000]


def parsed(text: str | None):
    """JSON of a body; None for an empty one or a page of HTML."""
    text = (text or "").strip()
    if not text or text.startswith("<"):
        return None
    try:
        return json.loads(text)
    except ValueError as e:
        raise Refused(f"not JSON: {e}") from e


def guarded(base: str, blocked: tuple[str, ...] = (), headers: Callable[[], dict[str, str]] = dict, timeout: float = 30.0, opener: Callable = fetch, raw: bool = False) -> Callable:
    """A transport: GET only, HTTPS only, no blocked part in the URL. A missing page is FileNotFoundError, another refusal is final;
    failures of the connection are OSError, which is tried again. `raw` gives the text, for XML."""
    check_url(base, blocked)

    def get(path: str, params: dict[str, str]):
        url = f"{base.rstrip('/')}/{path.lstrip('/')}"
        url = check_url(f"{url}{'&' if '?' in url else '?'}{query_string(params)}" if params else url, blocked)
        status, text = opener(url, headers(), timeout)
        if status == 404:
            raise FileNotFoundError(url)
        if status >= 400:
            raise Refused(f"HTTP {status}: {text[:200]}")
        return text if raw else parsed(text)

    return get


def with_retries(get: Callable, path: str, params: dict, waits: tuple[float, ...] = WAITS, sleep: Callable = time.sleep):
    """A missing page is None; other failures are tried again after growing waits."""
    for wait in (*waits, None):
        try:
            return get(path, params)
        except FileNotFoundError:
            return None
        except OSError:
            if wait is None:
                raise
            sleep(wait)


def items(body) -> list[dict]:
    """Rows of a response, whatever envelope it has."""
    if isinstance(body, list):
        return body
    for key in ENVELOPES:
        if isinstance(body, dict) and key in body:
            return items(body[key])
    return []


def total(body) -> int | None:
    """The number of all rows that a response states, at any level of its envelopes."""
    if not isinstance(body, dict):
        return None
    for key in TOTALS:
        if isinstance(n := body.get(key), str) and n.isdigit():
            n = int(n)
        if isinstance(n, int) and not isinstance(n, bool) and n >= 0:
            return n
    return next((n for key in ENVELOPES if (n := total(body.get(key))) is not None), None)


# ---------------------------------------------------------------- artifacts


class Range(ds.InputPartition):
    """Rows start to end of one type; without end, all from start on."""

    def __init__(self, kind: str, start: int, end: int | None, known: int | None):
        super().__init__(kind)
        self.kind, self.start, self.end, self.known = kind, start, end, known


def ranges(kind: str, known: int | None, rows: int, limit: int = 0) -> list[Range]:
    """Partitions of a type with `known` rows (None: unknown). The last has no end, for rows that come meanwhile."""
    if limit:
        return [Range(kind, 0, limit, known)]
    starts = list(range(0, known or 1, rows)) or [0]
    return [Range(kind, s, e, known) for s, e in zip(starts, [*starts[1:], None])]


def pages(part: Range, get: Callable[[dict], object]) -> Iterator[dict]:
    """Rows of one range. A page may be shorter than asked for: reading goes on until the range, or what is known to exist, is through;
    of a page that is longer the rest belongs to the next range."""
    at = part.start
    while part.end is None or at < part.end:
        asked = PAGE if part.end is None else min(PAGE, part.end - at)
        page = items(get({"$filter": f"Type eq '{part.kind}'", "$top": str(asked), "$skip": str(at)}))[:asked]
        yield from page
        at += len(page)
        if not page or (len(page) < asked and at >= (part.known or 0)):
            return


class _Artifacts(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.kinds, self.transport = options["kinds"].split(","), bytes.fromhex(options["transport"])
        self.limit, self.rows, self.path = int(options.get("limit", 0)), int(options.get("range_rows", RANGE_ROWS)), options.get("collection", "artifacts")
        self.released = options.get("released", "true") == "true"
        self.waits = tuple(float(x) for x in options.get("waits", "2,4,6").split(",") if x)

    def partitions(self) -> list[Range]:
        get, out = loads(self.transport), []
        for kind in self.kinds:
            known = None if self.limit else total(with_retries(get, self.path, {"$filter": f"Type eq '{kind}'", "$top": "1", "$skip": "0", "$count": "true"}, self.waits))
            out += ranges(kind, known, self.rows, self.limit)
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        get = loads(self.transport)
        for row in pages(partition, lambda params: with_retries(get, self.path, params, self.waits)):
            if not self.released or (row.get("State") or "").upper() == "RELEASED":
                yield tuple(row.get(c) for c in FIELDS)


class ArtifactSource(ds.DataSource):
    """format("artifacts") with options kinds (comma-separated), transport (hex of a pickled function), limit, range_rows, released, waits, collection."""

    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return ARTIFACT

    def reader(self, schema) -> ds.DataSourceReader:
        if "transport" not in self.options:
            raise Blocked("offline: no transport given")
        return _Artifacts(dict(self.options))


def read_artifacts(spark: SparkSession, kinds: list[str], transport: Callable, limit: int = 0, waits: str = "2,4,6", range_rows: int = RANGE_ROWS, released: bool = True) -> DataFrame:
    """Artifacts of several types, released ones or all. Where the service states a total, each `range_rows` rows are a partition;
    else a type is one. `limit`: so many rows of each type are asked for, in one request if they fit in a page."""
    spark.dataSource.register(ArtifactSource)
    options = {"kinds": ",".join(kinds), "transport": dumps(transport).hex(), "limit": str(limit), "waits": waits, "range_rows": str(range_rows), "released": str(released).lower()}
    return spark.read.format("artifacts").options(**options).load()


def sample_artifacts(spark: SparkSession, kinds: list[str], transport: Callable, asked: int = 3, shown: int = 2, waits: str = "2,4,6") -> DataFrame:
    """type, received (rows, at most `asked`), and names with their states of the first `shown` of them; a type without rows has a row of 0."""
    rows = read_artifacts(spark, kinds, transport, asked, waits, released=False)
    few = rows.groupBy(F.col("Type").alias("type")).agg(F.count(F.lit(1)).alias("received"), F.collect_list(F.struct("Name", "State")).alias("all"))
    every = spark.createDataFrame([(k,) for k in kinds], "type string")
    return every.join(F.broadcast(few), "type", "left").select("type", F.coalesce("received", F.lit(0)).alias("received"), F.slice(F.coalesce("all", F.array()), 1, shown).alias("shown"))


# ---------------------------------------------------------------- entities

_COMPARED = {ds.EqualTo: "eq", ds.GreaterThan: "gt", ds.GreaterThanOrEqual: "ge", ds.LessThan: "lt", ds.LessThanOrEqual: "le"}
_TEXT_TESTS = {ds.StringStartsWith: "startswith", ds.StringEndsWith: "endswith", ds.StringContains: "contains"}


def literal(value) -> str | None:
    """A value as the service writes it; None for kinds that are not passed on."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return repr(value)
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return value.isoformat() if type(value) is date else None


def condition(f: ds.Filter) -> str | None:
    """A filter as the service's text, where it means the same there and passes the guard; else None, and Spark applies it.

    Negations stay with Spark: for nulls they differ.
    """
    if not hasattr(f, "attribute") or len(f.attribute) != 1 or not IDENTIFIER.fullmatch(f.attribute[0]):
        return None
    name, found = f.attribute[0], None
    if isinstance(f, ds.IsNotNull):
        found = f"{name} ne null"
    elif isinstance(f, ds.IsNull):
        found = f"{name} eq null"
    elif isinstance(f, ds.In):
        values = [literal(v) for v in f.value]
        found = "(" + " or ".join(f"{name} eq {v}" for v in values) + ")" if values and None not in values else None
    elif (value := literal(f.value)) is not None and type(f) in _COMPARED:
        found = f"{name} {_COMPARED[type(f)]} {value}"
    elif type(f) in _TEXT_TESTS:
        found = f"{_TEXT_TESTS[type(f)]}({name},{value})"
    return None if found is None or SUSPICIOUS.search(found) else found


def converted(value, kind: ty.DataType):
    """A JSON value as the declared type; nested values under a string column as JSON text."""
    if value is None:
        return None
    if isinstance(kind, ty.StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, (ty.DoubleType, ty.FloatType)):
        return float(value)
    if isinstance(kind, ty.IntegralType):
        return int(value)
    if isinstance(kind, ty.BooleanType):
        return value if isinstance(value, bool) else str(value).lower() == "true"
    return date.fromisoformat(value[:10]) if isinstance(kind, ty.DateType) else value


class _Entities(ds.DataSourceReader):
    def __init__(self, schema: ty.StructType, options: dict[str, str]):
        self.schema, self.options, self.pushed = schema, options, []
        self.params = check_query(options["service"], tuple(options["allowed"].split(",")), options["entity_set"], options.get("filter", ""), int(options.get("top", ROW_CAP)))
        if bad := [c for c in schema.names if not IDENTIFIER.fullmatch(c)]:
            raise Blocked(f"bad column: {bad[0]}")

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if (text := condition(f)) is None:
                yield f
            else:
                self.pushed.append(text)

    def partitions(self) -> list[ds.InputPartition]:
        return [ds.InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        given = [f"({self.params['$filter']})"] if "$filter" in self.params else []
        both = " and ".join([*given, *self.pushed])
        params = self.params | {"$select": ",".join(self.schema.names), "$format": "json"} | ({"$filter": both} if both else {})
        waits = tuple(float(x) for x in self.options.get("waits", "2,4,6").split(",") if x)
        found = items(with_retries(loads(bytes.fromhex(self.options["transport"])), f"{self.options['service']}/{self.options['entity_set']}", params, waits))
        for row in found[: int(self.params["$top"])]:
            yield tuple(converted(row.get(f.name), f.dataType) for f in self.schema)


class EntitySource(ds.DataSource):
    """format("entities") with a schema, whose columns are asked for, and options service, entity_set, allowed, transport, filter, top, waits."""

    @classmethod
    def name(cls) -> str:
        return "entities"

    def schema(self) -> str:
        raise Blocked("name the columns: entities are read with a schema")

    def reader(self, schema: ty.StructType) -> ds.DataSourceReader:
        if "transport" not in self.options:
            raise Blocked("offline: no transport given")
        return _Entities(schema, dict(self.options))


def read_entities(
    spark: SparkSession, transport: Callable, service: str, entity_set: str, columns: str, allowed: tuple[str, ...], filter_: str = "", top: int = ROW_CAP, waits: str = "2,4,6"
) -> DataFrame:
    """At most `top` (never over 50) rows of an entity set with the columns named (a DDL schema). Filters of the DataFrame become part of the
    request where the service understands them, so the cap counts matching rows; the others are applied to what comes."""
    spark.dataSource.register(EntitySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"service": service, "entity_set": entity_set, "allowed": ",".join(allowed), "transport": dumps(transport).hex(), "filter": filter_, "top": str(top), "waits": waits}
    return spark.read.format("entities").schema(columns).options(**options).load()


# ---------------------------------------------------------------- metadata

_MODEL = (
    "DataServices struct<Schema: array<struct<_Namespace: string, EntityType: array<struct<_Name: string, "
    "Key: struct<PropertyRef: array<struct<_Name: string>>>, Property: array<struct<_Name: string, _Type: string, _Nullable: string>>>>>>>"
)


def read_metadata(spark: SparkSession, transport: Callable, services: list[str], allowed: tuple[str, ...], waits: tuple[float, ...] = WAITS) -> DataFrame:
    """service, body (null where the service has none), metadata_xml (its first 60,000 characters) and truncated; one request per service, in tasks."""
    for s in services:
        check_service(s, allowed)
    blob = dumps(transport)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = loads(blob)
        for b in batches:
            yield pd.DataFrame({"service": b["service"], "body": [with_retries(get, f"{s}/$metadata", {}, waits) for s in b["service"]]})

    names = spark.createDataFrame([(s,) for s in services], "service string").repartition(max(1, len(services)))
    body = names.mapInPandas(run, "service string, body string")
    return body.withColumn("metadata_xml", F.substring("body", 1, METADATA_CAP)).withColumn("truncated", F.coalesce(F.length("body") > METADATA_CAP, F.lit(False)))


def metadata_properties(metadata: DataFrame, service_col: str = "service", xml_col: str = "body") -> DataFrame:
    """service, namespace, entity, property, type, nullable (true unless stated) and is_key of each property; XML that can't be read gives none."""
    model = F.from_xml(F.col(xml_col), _MODEL, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    part = metadata.select(F.col(service_col).alias("service"), F.explode(model["DataServices"]["Schema"]).alias("s"))
    entity = part.select("service", F.col("s._Namespace").alias("namespace"), F.explode("s.EntityType").alias("e"))
    keys = F.coalesce(F.col("e.Key.PropertyRef._Name"), F.array().cast("array<string>"))
    each = entity.select("service", "namespace", F.col("e._Name").alias("entity"), keys.alias("keys"), F.explode("e.Property").alias("p"))
    return each.select(
        "service", "namespace", "entity", F.col("p._Name").alias("property"), F.col("p._Type").alias("type"),
        F.coalesce(F.lower("p._Nullable") != "false", F.lit(True)).alias("nullable"), F.array_contains("keys", F.col("p._Name")).alias("is_key"),
    )
