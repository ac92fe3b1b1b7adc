"""Damaged archives: what the directory still gives, and what the end of a file says."""

import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from brindle.sources import archives, documents

PARTS = {"word/document.xml": b"<w:p><w:t>one &lt; two</w:t></w:p>", "word/header1.xml": b"<w:p><w:t>head</w:t></w:p>", "media/x.bin": b"PK\x03\x04 not a header PK\x01\x02"}
TEXT = "one < two\n\nhead"


def archive(compression=zipfile.ZIP_DEFLATED) -> bytearray:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compression) as z:
        for name, data in PARTS.items():
            z.writestr(name, data)
    return bytearray(out.getvalue())


def wrong_end(raw: bytearray) -> bytearray:
    struct.pack_into("<I", raw, raw.rfind(archives.END) + 16, 3)
    return raw


def no_signatures():
    raw = wrong_end(archive())
    for name in PARTS:
        head = raw.find(name.encode()) - 30
        raw[head : head + 4] = b"\0\0\0\0"
    return raw


def stored_without_size():
    """The local header leaves the size to the directory, and the data looks like a header."""
    raw = wrong_end(archive(zipfile.ZIP_STORED))
    for name in PARTS:
        struct.pack_into("<I", raw, raw.find(name.encode()) - 30 + 18, 0)
    return raw


def other_local_names():
    raw = wrong_end(archive())
    for name in PARTS:
        at = raw.find(name.encode())
        raw[at : at + len(name)] = b"?" * len(name)
    return raw


def wrong_offsets():
    """Every offset in the directory is off, as after a change of line ends before it."""
    raw = wrong_end(archive())
    at = raw.find(archives.DIRECTORY)
    while at >= 0:
        struct.pack_into("<I", raw, at + 42, 10**6)
        at = raw.find(archives.DIRECTORY, at + 4)
    return raw


@pytest.mark.parametrize("make", [no_signatures, stored_without_size, other_local_names])
def test_directory_gives_what_a_scan_does_not(make):
    raw = bytes(make())
    assert archives.directory_members(raw) == PARTS
    assert documents.scan_members(raw) != PARTS
    assert documents.docx_text(raw) == (TEXT, "directory")


def test_offsets_names_and_prefixes():
    assert archives.directory_members(bytes(wrong_offsets())) == PARTS
    assert archives.directory_members(b"prefix of a mail" + bytes(archive())) == PARTS
    raw = wrong_end(archive())
    raw[raw.find(archives.DIRECTORY)] ^= 1  # the first entry's signature is gone: the others are found
    found = archives.directory_members(bytes(raw))
    assert found.items() < PARTS.items() and len(found) == 2
    assert documents.docx_text(bytes(raw)) == (TEXT, "scan")  # which fills in what is missing


def test_checksums_hold():
    raw = wrong_end(archive(zipfile.ZIP_STORED))
    raw[raw.find(b"one")] ^= 1
    assert set(archives.directory_members(bytes(raw))) == set(PARTS) - {"word/document.xml"}


def test_any_bytes_are_survived():
    rng = random.Random(1)
    for _ in range(300):
        raw = archive(rng.choice([zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED]))
        for _ in range(rng.randint(1, 30)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        raw = bytes(raw[: rng.randrange(len(raw))] if rng.random() < 0.3 else raw)
        assert archives.directory_members(raw).items() <= PARTS.items() or set(archives.directory_members(raw).values()) <= set(PARTS.values())
        documents.extract("a.docx", raw)
    for raw in (b"", b"PK", archives.END, archives.DIRECTORY + b"\0" * 45, archives.END + b"\xff" * 30):
        assert archives.directory_members(raw) == {}


def test_tail_analysis(spark):
    ok = bytes(archive(zipfile.ZIP_DEFLATED))
    directory, end = struct.unpack_from("<I", ok, len(ok) - 6)[0], ok.rfind(archives.END)
    far = bytearray(ok)
    struct.pack_into("<I", far, end + 16, 10**6)
    rows = [("ok", ok), ("displaced", b"xy" + ok), ("far", bytes(far)), ("cut", ok[:-3]), ("none", ok[:directory]), ("only", ok[end:]), ("empty", b""), ("null", None)]
    got = {r.name: r for r in archives.tail_analysis(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert {k: r.state for k, r in got.items()} == {"ok": "ok", "displaced": "displaced", "far": "displaced", "cut": "cut off", "none": "no end record", "only": "no directory", "empty": "no end record", "null": "no end record"}
    r = got["ok"]
    assert (r.end_at, r.entries, r.directory_size, r.directory_at, r.bytes_there) == (end, 3, end - directory, directory, "504B0102")
    assert got["far"].bytes_there is None and got["displaced"].bytes_there != "504B0102"


def test_uploads_without_text_get_a_stub(spark):
    rows = [("a b.docx", "anVuaw=="), ("n.txt", "aGk="), ("x.exe", "aGk="), ("p.pdf", "JVBERi0x")]
    got = {r.name: (r.md_name, r.text, r.note, r.error) for r in documents.uploaded_markdown(spark.createDataFrame(rows, "name string, b64 string")).collect()}
    assert got["n.txt"] == ("n.md", "hi", "text", None) and got["x.exe"] == (None, None, None, "unsupported type")
    assert got["a b.docx"][0] == "a_b.md" and got["a b.docx"][1].startswith("# a_b\n") and got["a b.docx"][2] == "stub" == got["p.pdf"][2]


def test_salvage_keeps_tabs_and_drops_noise():
    assert documents.salvage(b"\xd0\xcf\x11\xe0\xe9\xe8\xe7\xe6\xe5\xe4\xe3 col\tumn one \x00abc\x01second run\xff") == "col\tumn one\nsecond run"


def test_batches_of_documents_are_small(spark):
    from brindle.plans import intake
    from brindle.sources import documents

    for made in (lambda d: documents.extract_text(d.select("doc_id", F.lit("x.txt").alias("path"), F.col("text").cast("binary").alias("content"))), intake.word_files):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert made(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))).count() == 3
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
