"""Text of uploaded documents (docx, pdf, doc, txt, md) from their bytes, and probes of damaged files."""

from __future__ import annotations

import html
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import occurrences
from brindle.session import bound_batches
from brindle.sources import archives

EXTRACTED = "struct<text:string,note:string>"
#: The first bytes of known formats.
SIGNATURES = {"zip": b"PK\x03\x04", "zip_directory": b"PK\x01\x02", "zip_end": b"PK\x05\x06", "pdf": b"%PDF", "ole": b"\xd0\xcf\x11\xe0", "gzip": b"\x1f\x8b", "png": b"\x89PNG", "jpeg": b"\xff\xd8\xff"}
#: How a part of an archive is found, the surest way first.
WAYS = ["zip", "directory", "scan"]
UPLOAD_LIMIT = 15 << 20


def decode_text(raw: bytes) -> str:
    """UTF-8 (with or without mark), then UTF-16, then Latin-1."""
    for encoding in ("utf-8-sig", "utf-16"):
        try:
            return raw.decode(encoding)
        except UnicodeError:
            continue
    return raw.decode("latin-1")


def word_xml_text(xml: str) -> str:
    """Paragraphs of a word-processing part; field codes and deleted text go, tabs and breaks stay."""
    xml = re.sub(r"(?s)<w:(instrText|delText)\b[^>]*>.*?</w:\1>", "", xml)
    xml = re.sub(r"<w:tab\b[^>]*/>", "\t", xml)
    xml = re.sub(r"<w:(?:br|cr)\b[^>]*/>|</w:p>", "\n", xml)
    return html.unescape(re.sub(r"<[^>]+>", "", xml))


def members(raw: bytes) -> tuple[dict[str, bytes], dict[str, str]]:
    """Parts of a zip archive and how each was found: by the zip library; of a damaged one by a walk of its directory (checksums
    hold), and what that does not give by a scan of local headers (not checked)."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            parts = {n: z.read(n) for n in z.namelist()}
            return parts, dict.fromkeys(parts, "zip")
    except (zipfile.BadZipFile, NotImplementedError, zlib.error, EOFError, OSError, RuntimeError, ValueError):
        sure, loose = archives.directory_members(raw), scan_members(raw)
        return loose | sure, dict.fromkeys(loose, "scan") | dict.fromkeys(sure, "directory")


def scan_members(raw: bytes) -> dict[str, bytes]:
    """Parts found by their local headers; the size field is not trusted, deflated data ends where its stream does."""
    out, at = {}, raw.find(SIGNATURES["zip"])
    while 0 <= at and at + 30 <= len(raw):
        method, size = struct.unpack_from("<H", raw, at + 8)[0], struct.unpack_from("<I", raw, at + 18)[0]
        n, extra = struct.unpack_from("<HH", raw, at + 26)
        name, begin = raw[at + 30 : at + 30 + n].decode("utf-8", "replace"), at + 30 + n + extra
        try:
            if method == 8:
                d = zlib.decompressobj(-15)
                out[name] = d.decompress(raw[begin:])
            elif method == 0:
                end = begin + size if size else raw.find(b"PK", begin)
                out[name] = raw[begin : end if end >= 0 else len(raw)]
        except zlib.error:
            pass
        at = raw.find(SIGNATURES["zip"], at + 4)
    return out


def docx_text(raw: bytes) -> tuple[str, str]:
    """Text of the document, headers and footers; the note is the least certain way in which one of them was found."""
    parts, found = members(raw)
    order = ["word/document.xml", *sorted(n for n in parts if re.fullmatch(r"word/(?:header|footer)\d*\.xml", n))]
    order = [n for n in order if n in parts]
    text = "\n".join(word_xml_text(decode_text(parts[n])) for n in order)
    return re.sub(r"\n{3,}", "\n\n", text).strip(), max((found[n] for n in order), key=WAYS.index) if text.strip() else "no document part"


def inflate(data: bytes) -> bytes | None:
    for bits in (15, -15, 47):
        try:
            return zlib.decompressobj(bits).decompress(data)
        except zlib.error:
            continue
    return None


_PDF_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def pdf_unescape(s: str) -> str:
    r"""Escapes of a string operand: \n and the like, octal codes, anything else as it is."""
    return re.sub(r"\\([0-7]{1,3}|.)", lambda m: chr(int(m[1], 8) & 255) if m[1][0] in "01234567" else _PDF_ESCAPES.get(m[1], m[1]), s, flags=re.DOTALL)


def pdf_text(raw: bytes) -> str:
    """String operands of the show-text operators, one line per operator."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)endstream", raw, re.DOTALL):
        body = (inflate(m[1]) or m[1]).decode("latin-1")
        for shown in re.finditer(r"\[((?:[^\[\]\\]|\\.)*+)\]\s*TJ|\(((?:[^()\\]|\\.)*+)\)\s*(?:Tj|'|\")", body, re.DOTALL):
            pieces = re.findall(r"\(((?:[^()\\]|\\.)*+)\)", shown[1], re.DOTALL) if shown[1] is not None else [shown[2]]
            out.append("".join(map(pdf_unescape, pieces)))
    return "\n".join(x for x in out if x.strip())


def salvage(raw: bytes) -> str:
    """Runs of six or more printable ASCII characters or tabs."""
    return "\n".join(x.decode("ascii").strip() for x in re.findall(rb"[\x20-\x7e\t]{6,}", raw)).strip()


def word_document(text: str) -> bytes:
    """A word-processing archive with one paragraph per line."""
    paragraphs = "".join(f"<w:p><w:r><w:t>{html.escape(line, quote=False)}</w:t></w:r></w:p>" for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document><w:body>{paragraphs}</w:body></w:document>")
    return out.getvalue()


def extract(name: str | None, raw: bytes | None) -> tuple[str, str]:
    """Text and a note of how it was got, by file ending, then by first bytes. Never raises."""
    raw, ending = raw or b"", (name or "").lower().rpartition(".")[2]
    try:
        if ending in ("txt", "md"):
            return decode_text(raw), "text"
        if ending == "docx" or (ending not in ("pdf", "doc") and raw[:4] == SIGNATURES["zip"]):
            return docx_text(raw)
        if ending == "pdf" or raw[:4] == SIGNATURES["pdf"]:
            text = pdf_text(raw)
            return text, "pdf" if text else "no text layer"
        if ending == "doc" or raw[:4] == SIGNATURES["ole"]:
            return salvage(raw), "salvaged"
        return decode_text(raw), "text"
    except Exception as e:  # one unreadable document must not end the job; its note says why
        return "", f"unreadable: {type(e).__name__}"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, content of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def extract_text(docs: DataFrame, name_col: str = "path", bytes_col: str = "content") -> DataFrame:
    """Adds text and note; small Arrow batches, one row at a time in memory beyond the batch."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf(EXTRACTED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, raws in batches:
            yield pd.DataFrame([extract(n, r) for n, r in zip(names, raws, strict=True)], columns=["text", "note"])

    return docs.withColumn("_x", run(name_col, bytes_col)).select(*docs.columns, "_x.text", "_x.note")


def probe(docs: DataFrame, bytes_col: str = "content") -> DataFrame:
    """Adds size, header (hex of 16 bytes), and per known signature how often it occurs."""
    text = F.decode(F.col(bytes_col), "ISO-8859-1")  # a character per byte
    count = lambda s: occurrences(text, s.decode("latin-1"))
    return docs.select(*docs.columns, F.length(bytes_col).alias("size"), F.hex(F.substring(bytes_col, 1, 16)).alias("header"), *[count(s).alias(f"n_{k}") for k, s in SIGNATURES.items()])


def uploaded_markdown(uploads: DataFrame) -> DataFrame:
    """accept_upload's rows with md_name, text and note. A file without readable text gets a stub that names it, so that what follows
    is not held up; a refused upload (error) has neither text nor note."""
    checked = accept_upload(uploads)
    read = extract_text(checked.withColumn("content", F.when(F.col("error").isNull(), F.col("content"))), "clean_name", "content")
    base = F.regexp_replace("clean_name", r"\.[^.]*$", "")
    blank = F.regexp_replace("text", r"\s+", "") == ""
    stub = F.concat(F.lit("# "), base, F.lit("\n\n_No readable text in this file ("), F.col("note"), F.lit("). Its content can be pasted here._\n"))
    fine = F.col("error").isNull()
    return read.withColumns({
        "md_name": F.when(fine, F.concat(base, F.lit(".md"))),
        "text": F.when(fine, F.when(blank, stub).otherwise(F.col("text"))),
        "note": F.when(fine, F.when(blank, F.lit("stub")).otherwise(F.col("note"))),
    })


def accept_upload(uploads: DataFrame) -> DataFrame:
    """Adds content, clean name and error: base64 that decodes, within the size limit, named by safe characters."""
    raw = F.try_to_binary("b64", F.lit("base64"))
    name = F.regexp_replace(F.element_at(F.split("name", r"[/\\]"), -1), r"[^A-Za-z0-9._-]+", "_")
    error = F.when(raw.isNull(), "not base64").when(F.length(raw) == 0, "empty").when(F.length(raw) > UPLOAD_LIMIT, "too large").when(~name.rlike(r"(?i)\.(docx|pdf|doc|txt|md)$"), "unsupported type")
    return uploads.select("*", name.alias("clean_name"), raw.alias("content"), error.alias("error"))
