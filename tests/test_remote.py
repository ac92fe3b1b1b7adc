"""Remote sources against fake services: planned ranges, pushed filters and columns, guards, metadata."""

import json

import pytest
from pyspark.sql import functions as F

from brindle.sources import remote


def service(n, states=("RELEASED", "DRAFT", "released"), cap=10**9, total=True, log=None):
    """A paged service of n rows for each type; `log` is a folder that gets a file per request."""

    def get(path, params):
        kind, skip, top = params["$filter"].split("'")[1], int(params["$skip"]), int(params["$top"])
        if log:
            import uuid

            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                json.dump(params, f)
        rows = [{"Name": f"{kind}{i}", "Type": kind, "State": states[i % len(states)]} for i in range(skip, min(skip + min(top, cap), n.get(kind, 0)))]
        return {"d": {"results": rows} | ({"__count": str(n.get(kind, 0))} if total else {})}

    return get


def names(df):
    return sorted(r.Name for r in df.collect())


def test_ranges_equal_the_sequential_scan(spark, tmp_path):
    get = service({"API": 10_000, "BADI": 3}, log=str(tmp_path))
    ranged = remote.read_artifacts(spark, ["API", "BADI", "Event"], get, range_rows=200)
    assert ranged.rdd.getNumPartitions() == 50 + 1 + 1
    want = sorted(f"{k}{i}" for k, n in (("API", 10_000), ("BADI", 3)) for i in range(n) if i % 3 != 1)
    assert names(ranged) == want
    assert names(remote.read_artifacts(spark, ["API", "BADI"], service({"API": 10_000, "BADI": 3}, total=False))) == want
    asked = [json.loads(f.read_text()) for f in tmp_path.iterdir()]
    assert max(int(a["$top"]) for a in asked) == 200 and sum(a.get("$count") == "true" for a in asked) <= 9


@pytest.mark.parametrize("cap", [1, 7, 150, 199])
def test_short_pages_lose_nothing(cap):
    """A service that gives fewer rows than asked for, within every range and beyond the known total."""
    get = service({"API": 431}, cap=cap)
    for rows in (100, 200, 431, 1000):
        parts = remote.ranges("API", 431, rows)
        assert [r["Name"] for p in parts for r in remote.pages(p, lambda params: get("x", params))] == [f"API{i}" for i in range(431)]


def test_rows_that_come_meanwhile_are_read():
    parts = remote.ranges("API", 400, 150)
    get = service({"API": 700})
    assert [r["Name"] for p in parts for r in remote.pages(p, lambda params: get("x", params))] == [f"API{i}" for i in range(700)]
    ignorant = lambda params: {"value": [{"Name": str(i)} for i in range(int(params["$skip"]), min(400, int(params["$skip"]) + 200))]}  # noqa: E731  always whole pages
    assert [r["Name"] for p in parts for r in remote.pages(p, ignorant)] == [str(i) for i in range(400)]


def test_samples(spark, tmp_path):
    got = {r.type: (r.received, [x.Name for x in r.shown]) for r in remote.sample_artifacts(spark, ["API", "Event"], service({"API": 900}, log=str(tmp_path))).collect()}
    assert got == {"API": (3, ["API0", "API1"]), "Event": (0, [])}
    assert {json.loads(f.read_text())["$top"] for f in tmp_path.iterdir()} == {"3"}


@pytest.mark.parametrize("body, n", [({"@odata.count": 5, "value": []}, 5), ({"d": {"__count": "12", "results": []}}, 12), ({"count": True}, None), ([], None), (None, None), ({"total": "x"}, None), ({"value": [{"total": 3}]}, None)])
def test_totals(body, n):
    assert remote.total(body) == n


# ---------------------------------------------------------------- entities

ROWS = [{"Id": i, "Name": f"n{i % 10}", "Price": i / 2, "Extra": {"deep": i}, "Open": i % 2 == 0, "Day": f"2024-01-{i % 28 + 1:02}T00:00:00" if i % 5 else None} for i in range(300)]


def entities(log):
    """A service that understands `and`, eq and ge on Id and Name, and no more."""

    def get(path, params):
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            json.dump({"path": path, **params}, f)
        rows = ROWS
        for part in filter(None, params.get("$filter", "").replace("(", "").replace(")", "").split(" and ")):
            name, op, value = part.split(" ")
            value = None if value == "null" else value.strip("'") if value.startswith("'") else float(value)
            test = {"eq": lambda a, v=value: a == v, "ge": lambda a, v=value: a >= v, "ne": lambda a, v=value: a != v}[op]
            rows = [r for r in rows if test(r[name])]
        return {"value": [{k: r[k] for k in params["$select"].split(",")} for r in rows[: int(params["$top"])]]}

    return get


def requests(log):
    return [json.loads(f.read_text()) for f in log.iterdir()]


def test_columns_and_filters_reach_the_request(spark, tmp_path):
    df = remote.read_entities(spark, entities(str(tmp_path)), "S", "Things", "Id long, Name string", ("S",))
    found = df.where("Id >= 270 AND Name = 'n3'").where(F.col("Id") != 283)
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "PushedFilters" in plan and "GreaterThanOrEqual(Id,270)" in plan
    assert [(r.Id, r.Name) for r in found.collect()] == [(273, "n3"), (293, "n3")]
    (one,) = requests(tmp_path)
    assert one["path"] == "S/Things" and one["$select"] == "Id,Name" and one["$top"] == "50" and one["$format"] == "json"
    assert set(one["$filter"].split(" and ")) >= {"Id ge 270", "Name eq 'n3'"} and "283" not in one["$filter"]


def test_types_cap_and_given_filter(spark, tmp_path):
    df = remote.read_entities(spark, entities(str(tmp_path)), "S", "Things", "Id int, Price double, Extra string, Open boolean, Day date", ("S",), "Id ge 200", top=500)
    rows = df.collect()
    assert len(rows) == 50 and rows[1].Id == 201 and rows[1].Price == 100.5 and json.loads(rows[1].Extra) == {"deep": 201} and not rows[1].Open
    assert str(rows[1].Day) == "2024-01-06" and rows[0].Day is None
    assert requests(tmp_path)[0]["$filter"] == "(Id ge 200)"


def test_unsafe_values_stay_with_spark(spark, tmp_path):
    df = remote.read_entities(spark, entities(str(tmp_path)), "S", "Things", "Id long, Name string", ("S",))
    assert df.where("Name = 'a;b'").count() == 0 and df.where("Name = 'n1--'").count() == 0
    assert all("eq 'a;b'" not in r.get("$filter", "") and "--" not in r.get("$filter", "") for r in requests(tmp_path))


def test_conditions():
    from pyspark.sql import datasource as ds

    c = remote.condition
    assert c(ds.EqualTo(("A",), "it's")) == "A eq 'it''s'" and c(ds.In(("A",), (1, 2))) == "(A eq 1 or A eq 2)"
    assert c(ds.IsNull(("A",))) == "A eq null" and c(ds.StringContains(("A",), "x")) == "contains(A,'x')" and c(ds.LessThan(("A",), True)) == "A lt true"
    for f in (ds.EqualTo(("A", "b"), 1), ds.EqualTo(("A b",), 1), ds.EqualTo(("A",), float("nan")), ds.Not(ds.EqualTo(("A",), 1)), ds.EqualTo(("A",), None), ds.In(("A",), ()), ds.In(("A",), (1, None)), ds.StringContains(("A",), "#")):
        assert c(f) is None


@pytest.mark.parametrize("change", [{"service": "T"}, {"entity_set": "x/y"}, {"filter_": "a -- b"}, {"columns": "`a b` string"}])
def test_guards_block(spark, tmp_path, change):
    given = {"service": "S", "entity_set": "Things", "columns": "Id long", "allowed": ("S",), "filter_": ""} | change
    with pytest.raises(Exception, match="not allowed|bad"):
        remote.read_entities(spark, entities(str(tmp_path)), **given).collect()
    assert not requests(tmp_path)


def test_guarded_transport(monkeypatch):
    seen = []

    def opener(url, headers, timeout):
        seen.append((url, headers))
        return {"miss": (404, ""), "no": (403, "denied"), "page": (200, " <html>"), "none": (200, ""), "bad": (200, "{")}.get(url.rsplit("/", 1)[1].split("?")[0], (200, '{"value": [1]}'))

    monkeypatch.setenv("B_USER", "u")
    monkeypatch.setenv("B_PASS", "p")
    get = remote.guarded("https://host/base/", ("/admin",), remote.basic_auth("B_USER", "B_PASS"), opener=opener)
    assert get("set", {"$top": "1", "a b": "c&d"}) == {"value": [1]}
    assert seen[0] == ("https://host/base/set?$top=1&a%20b=c%26d", {"Authorization": "Basic dTpw"})
    assert get("page", {}) is None and get("none", {}) is None
    with pytest.raises(remote.Refused, match="403"):
        get("no", {})
    with pytest.raises(remote.Refused, match="JSON"):
        get("bad", {})
    assert remote.with_retries(get, "miss", {}, (), None) is None
    n = len(seen)
    with pytest.raises(remote.Blocked):
        get("x/ADMIN/y", {})
    with pytest.raises(remote.Blocked):
        remote.guarded("http://host")
    assert len(seen) == n


# ---------------------------------------------------------------- metadata

EDMX = """<?xml version="1.0"?><edmx:Edmx xmlns:edmx="urn:e"><edmx:DataServices m:V="1" xmlns:m="urn:m"><Schema Namespace="NS" xmlns="urn:s">
<EntityType Name="Order"><Key><PropertyRef Name="Id"/><PropertyRef Name="Item"/></Key><Property Name="Id" Type="Edm.String" Nullable="false"/>
<Property Name="Item" Type="Edm.Int32" Nullable="false"/><Property Name="Note" Type="Edm.String" m:label="x"/></EntityType>
<EntityType Name="Loose"><Property Name="A" Type="Edm.Boolean" Nullable="true"/></EntityType></Schema></edmx:DataServices></edmx:Edmx>"""


def test_metadata(spark):
    bodies = {"A": EDMX, "B": "<broken", "C": EDMX.replace("<EntityType Name=\"Loose\">", " " * 60_000 + "<EntityType Name=\"Loose\">")}

    def get(path, params):
        if path.startswith("D/"):
            raise FileNotFoundError
        return bodies[path.split("/")[0]]

    meta = remote.read_metadata(spark, get, list("ABCD"), tuple("ABCD"), ())
    assert {r.service: (r.truncated, len(r.metadata_xml or "")) for r in meta.collect()} == {"A": (False, len(EDMX)), "B": (False, 7), "C": (True, 60_000), "D": (False, 0)}
    rows = {s: [tuple(r)[1:] for r in remote.metadata_properties(meta.where(F.col("service") == s)).collect()] for s in "ABCD"}
    want = [("NS", "Order", "Id", "Edm.String", False, True), ("NS", "Order", "Item", "Edm.Int32", False, True), ("NS", "Order", "Note", "Edm.String", True, False), ("NS", "Loose", "A", "Edm.Boolean", True, False)]
    assert rows == {"A": want, "B": [], "C": want, "D": []}
    with pytest.raises(remote.Blocked):
        remote.read_metadata(spark, get, ["X"], ("A",))
