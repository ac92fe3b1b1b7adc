"""All kinds of remote artifacts as catalog rows, and their merges."""

from brindle.operators import artifacts, catalog

RAW = "Name string, DisplayName string, Description string, Type string, SubType string, State string, Url string"


def rows(spark, *given):
    return artifacts.catalog_rows(spark.createDataFrame(given, RAW), "https://hub")


def test_shapes(spark):
    got = {(r.kind, r.name): r for r in rows(
        spark,
        ("A", "Shown", "Told", "API", "odatav4", "RELEASED", None), ("B", " ", "", "API", "??", "released", "http://own"), ("E", None, "x", "Event", "SOAP", "Released", "ftp://x"),
        ("I_VIEW", "Label", "I_View (Basic)", "CDSVIEW", None, "RELEASED", None), ("I_PLAIN", "", "no bracket", "cdsview", None, "RELEASED", None), ("I_ODD", "L", " (Basic)", "CDSVIEW", None, "RELEASED", None),
        ("X", "Exit", "does it", "BADI", None, "RELEASED", None), ("D", "d", "d", "API", "", "DRAFT", ""), ("P", "p", "p", "Package", "", "RELEASED", ""), (None, "t", "t", "API", "", "RELEASED", ""), ("S", "s", "s", "API", "", None, ""),
    ).collect()}
    assert set(got) == {("api", "A"), ("api", "B"), ("event", "E"), ("view", "I_View"), ("view", "I_PLAIN"), ("view", "I_ODD"), ("badi", "X")}
    a, b, e, v, x = got["api", "A"], got["api", "B"], got["event", "E"], got["view", "I_View"], got["badi", "X"]
    assert (a.title, a.protocol, a.hub_url, a.notes) == ("Shown", "OData V4", "https://hub/A/overview", "Told")
    assert (b.title, b.protocol, b.hub_url, b.notes) == ("B", "OData V2", "http://own", None)
    assert (e.protocol, e.title, e.hub_url) == ("Event", "E", "https://hub/E/overview")
    assert (v.notes, v.title, v.protocol, v.hub_url, v.replaces) == ("Label", None, None, None, None) and got["view", "I_PLAIN"].notes is None
    assert (x.title, x.use_case, x.notes, x.extensibility_type, x.verified_in_tenant) == ("Exit", "does it", None, artifacts.EXTENSIBILITY, False)
    assert {r.source for r in got.values()} == {artifacts.SOURCE} and all(r.area is None for r in got.values())


def test_sync(spark):
    api = "name string, title string, protocol string, area string, communication_scenario string, hub_url string, notes string, source string"
    old = spark.createDataFrame([("A", None, "SOAP", None, None, None, "", "seed"), ("Z", "z", "z", None, None, "z", "z", "seed")], api)
    remote = rows(spark, ("A", "Event title", "from event", "Event", "", "RELEASED", ""), ("A", "Api title", "from api", "API", "", "RELEASED", ""), ("N", "n", "n", "Event", "", "RELEASED", ""))
    got = {r.name: r for r in artifacts.synced(old, remote, "api").collect()}
    assert (got["A"].title, got["A"].protocol, got["A"].notes, got["A"].source, got["A"]["_status"]) == ("Api title", "SOAP", "", "seed", "backfilled")
    assert (got["N"].protocol, got["N"]["_status"]) == ("Event", "added") and got["Z"]["_status"] == "existing"
    dry = {r.name: r for r in artifacts.synced(old, remote, "api", dry_run=True).collect()}
    assert dry["A"].notes == "from api"
    counts = artifacts.sync_counts({"api": artifacts.synced(old, remote, "api")}).collect()
    assert [tuple(r) for r in counts] == [("api", 2, 1, 1, 3)]
    views = spark.createDataFrame([("I_A", "FI", None, "seed"), ("I_B", None, "own", "seed")], "name string, area string, notes string, source string")
    merged = {r.name: r for r in artifacts.synced(views, rows(spark, ("I_A", "Label", "I_A (Basic)", "CDSVIEW", None, "RELEASED", None), ("I_B", "other", None, "CDSVIEW", None, "RELEASED", None)), "view").collect()}
    assert (merged["I_A"].notes, merged["I_A"].area, merged["I_B"].notes) == ("Label", "FI", "own")


def test_view_rows_lose_nothing_that_a_view_tells(spark):
    raw = spark.createDataFrame([("I_VIEW", "Label", "I_View (Basic)", "RELEASED"), ("I_PLAIN", " ", "no bracket", "released"), ("D", "d", "d", "DRAFT")], "Name string, DisplayName string, Description string, State string")
    got = [r.asDict() for r in catalog.view_rows(raw).orderBy("title").collect()]
    assert got == [
        {"name": "I_PLAIN", "title": "I_PLAIN", "notes": None, "description": "no bracket", "source": "hub_sync"},
        {"name": "I_View", "title": "Label", "notes": "Label", "description": "I_View (Basic)", "source": "hub_sync"},
    ]
