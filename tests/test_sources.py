"""Documents, files and remote pages."""

import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from brindle.sources import documents, files, remote

DOC = '<w:document><w:p><w:r><w:t>Café &amp; co</w:t></w:r><w:tab/><w:t>x</w:t></w:p><w:p><w:delText>gone</w:delText><w:instrText> PAGE </w:instrText><w:t>last</w:t></w:p></w:document>'


def docx(compression=zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compression) as z:
        z.writestr("word/document.xml", DOC)
        z.writestr("word/header1.xml", "<w:p><w:t>head</w:t></w:p>")
    return out.getvalue()


def pdf() -> bytes:
    body = rb"BT (Hello \(PDF\)) Tj [(Wor) -20 (ld\041)] TJ ET"
    return b"%PDF-1.4\nstream\n" + zlib.compress(body) + b"\nendstream\nstream\nBT (plain) Tj ET\nendstream"


def test_extract_documents(spark):
    damaged = docx()[: docx().rfind(b"PK\x01\x02")]
    rows = [("a.docx", docx()), ("b.docx", damaged), ("c.pdf", pdf()), ("d.doc", b"\xd0\xcf\x11\xe0\x00\x01printable run\x00abc\x00"), ("e.txt", "größe".encode("utf-16")), ("f.md", b"\xef\xbb\xbfmark"), ("g.txt", b"caf\xe9!"), ("h.docx", b"junk"), ("i.txt", None), (None, pdf())]
    got = [(r.text, r.note) for r in documents.extract_text(spark.createDataFrame(rows, "path string, content binary")).collect()]
    word = "Café & co\tx\nlast\n\nhead"
    assert got[0] == (word, "zip") and got[1] == (word, "scan")
    assert got[2] == ("Hello (PDF)\nWorld!\nplain", "pdf") == got[9]
    assert [g[0] for g in got[3:9]] == ["printable run", "größe", "mark", "café!", "", ""]


def test_probe_and_upload(spark):
    df = spark.createDataFrame([("x", docx(zipfile.ZIP_STORED))], "path string, content binary")
    r = documents.probe(df).first()
    assert r.header.startswith("504B0304") and r.n_zip == 2 and r.n_zip_directory == 2 and r.n_zip_end == 1 and r.n_pdf == 0
    up = spark.createDataFrame([("../A b.docx", "aGk="), ("x.exe", "aGk="), ("y.md", "***"), ("z.txt", "")], "name string, b64 string")
    assert [(r.clean_name, r.error) for r in documents.accept_upload(up).collect()] == [("A_b.docx", None), ("x.exe", "unsupported type"), ("y.md", "not base64"), ("z.txt", "empty")]


def test_files(spark, tmp_path):
    for name, body in (("a", '{"id": "A"} trailing }'), ("b/c", '{"id": "B"}'), ("d", "no json")):
        (tmp_path / "out" / name).mkdir(parents=True)
        (tmp_path / "out" / name / "run.json").write_text(body)
    got = {r.folder: r.id for r in files.read_manifests(spark, str(tmp_path / "out")).select("folder", F.get_json_object("body", "$.id").alias("id")).collect()}
    assert got == {"a": "A", "c": "B", "d": None}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.md").write_text("text\n# Title \nmore")
    (tmp_path / "in" / "y.txt").write_text("plain")
    (tmp_path / "in" / "z.bin").write_text("no")
    assert sorted((r.title, r.size) for r in files.read_inputs(spark, str(tmp_path / "in")).collect()) == [("Title", 18), ("y.txt", 5)]
    (tmp_path / "log.jsonl").write_text('{"ts": "1", "event": "a"}\nbad\n{"ts": "2", "event": "b"}\n')
    log = files.read_log(spark, str(tmp_path / "log.jsonl"), "ts string, event string")
    assert sorted(r.event for r in log.collect()) == ["a", "b"]
    files.write_snapshot(lines_1 := spark.range(3), str(tmp_path / "snap"), "001")
    files.write_snapshot(files.read_snapshot(spark, str(tmp_path / "snap")).union(lines_1), str(tmp_path / "snap"), "002")
    assert files.read_snapshot(spark, str(tmp_path / "snap")).count() == 6
    lines = spark.createDataFrame([("j", 1, '{"type": "result", "n": 1}'), ("j", 2, '{"type": "result", "n": 2}'), ("j", 3, "junk"), ("k", 1, "{}")], "job string, n int, value string")
    assert [json.loads(r.result)["n"] for r in files.last_result(lines, "job", "n").collect()] == [2]


def test_remote_pages(spark):
    def fake(path, params):
        skip, kind = int(params["$skip"]), params["$filter"]
        n = 250 if "API" in kind else 3
        return {"value": [{"Name": f"{kind[-4:-1]}{i}", "State": "RELEASED" if i % 2 else "DRAFT"} for i in range(skip, min(skip + 200, n))]}

    got = remote.read_artifacts(spark, ["API", "BADI"], fake)
    assert got.count() == 126 and got.where("State <> 'RELEASED'").count() == 0
    with pytest.raises(Exception, match="offline"):
        spark.read.format("artifacts").options(kinds="API").load().count()


def test_guards_and_retries():
    assert remote.check_query("s", ("s",), "Set_1", "A eq 1", 500) == {"$top": "50", "$filter": "A eq 1"}
    for bad in (("t", ("s",), "E"), ("s", ("s",), "E;x"), ("s", ("s",), "E", "a;b")):
        with pytest.raises(remote.Blocked):
            remote.check_query(*bad)
    for url in ("http://x", "https://x/Admin/"):
        with pytest.raises(remote.Blocked):
            remote.check_url(url, ("/admin",))
    assert remote.query_string({"$top": "5", "$filter": "a b"}) == "$top=5&$filter=a%20b"
    waited, calls = [], iter([OSError, OSError, {"d": {"results": [{"x": 1}]}}])

    def get(path, params):
        x = next(calls)
        if isinstance(x, type):
            raise x
        return x

    assert remote.items(remote.with_retries(get, "p", {}, (2, 4, 6), waited.append)) == [{"x": 1}] and waited == [2, 4]
