"""Places and masks of texts with very many findings: right across blocks, and in time near linear."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from brindle.llm import pii, secrets, spans


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_spans_match_finditer(spark):
    rng = random.Random(6)
    texts = ["", "x", "ab", "a1b"] + ["".join(rng.choices("a1é😀 ", k=rng.randint(1, 900))) for _ in range(30)] + ["a1" * n for n in (63, 64, 65, 128, 1000)]
    got = rows(spark, texts).select("doc_id", spans.match_spans(F.col("text"), "[a-z][0-9]+", F.col("text") != "x").alias("s"))
    for r in got.collect():
        assert [tuple(s) for s in r.s] == [(m.start(), m.end(), m[0]) for m in re.finditer("[a-z][0-9]+", texts[r.doc_id])]


def test_parts(spark):
    text = "".join(random.Random(2).choices("aé😀\n", k=5000))
    places = [(0, 0), (0, 1), (0, 5000), (1023, 1025), (1024, 2048), (2047, 4999), (4999, 5000), (3000, 2000)]
    df = spark.createDataFrame([(text, a, b) for a, b in places], "t string, a int, b int")
    assert [r[0] for r in df.select(spans.part_of(spans.pieces(F.col("t")), F.col("a"), F.col("b"))).collect()] == [text[a:b] for a, b in places]


def test_masks_match_a_plain_pass(spark):
    rng = random.Random(9)
    bits = ["mail a@b.cd", "10.0.0.1", "+49 30 123456789", "4111 1111 1111 1111", "DE89370400440532013000", "x@1.2.3.4", "word", "\n", "é😀"]
    texts = [" ".join(rng.choices(bits, k=rng.randint(0, 300))) for _ in range(12)] + [None, "", "a@b.cd", "x" * 3000 + " a@b.cd"]
    df = rows(spark, texts)
    found = {r.doc_id: r.findings for r in pii.find_pii(df).collect()}
    for r in pii.mask_pii(df).collect():
        text, out, at = texts[r.doc_id] or "", "", 0
        for f in sorted(found[r.doc_id], key=lambda f: (f.start, f.end, f.kind)):
            assert text[f.start : f.end] == f.value
            if f.start >= at:
                out, at = out + text[at : f.start] + f"[{f.kind.upper()}]", f.end
        assert r.text == out + text[at:]


def seconds(make, spark, n, line):
    df = spark.createDataFrame([(1, ", ".join(line.format(i=i, j=i % 250) for i in range(n)))], "doc_id long, text string")
    began = time.perf_counter()
    assert make(df).first()[0] >= n
    return time.perf_counter() - began


@pytest.mark.parametrize("make, line", [
    (lambda df: pii.find_pii(df).select(F.size("findings")), "mail user{i}@example.com or 10.0.{j}.1"),
    (lambda df: pii.mask_pii(df).select(F.length("text")), "mail user{i}@example.com"),
    (lambda df: secrets.find_secrets(df).select(F.size("findings")), "password=abcdefgh{i}"),
])
def test_time_is_near_linear_in_matches(spark, make, line):
    seconds(make, spark, 100, line)
    few, many = (min(seconds(make, spark, n, line) for _ in range(2)) for n in (30_000, 120_000))
    assert many < 4 * few + 4, (few, many)
