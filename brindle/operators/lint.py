"""Regex rules over lines of text, verdicts per text, and a whole-text guard."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    id: str
    severity: str  # "error" or "warning"
    pattern: str
    message: str = ""


def valid(rules: list[Rule]) -> list[Rule]:
    """Rules with an invalid pattern are left out."""
    out = []
    for r in rules:
        try:
            re.compile(r.pattern)
            out.append(r)
        except re.error:
            continue
    return out


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end makes no further line, an empty text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", -1)
    last = F.element_at(parts, -1)
    return F.when(last == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lint(texts: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, rule, severity, line (from 1), code (trimmed, 160 characters) of each line that a rule's pattern occurs in.

    All rules test a line in one pass: literal patterns in an array, no join.
    """
    rows = texts.select(id_col, F.posexplode(lines(F.col(text_col))).alias("n", "raw"))
    hit = [F.when(F.col("raw").rlike(r.pattern), F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"))) for r in valid(rules)]
    found = rows.select(id_col, "n", "raw", F.explode(F.filter(F.array(*hit), lambda h: h.isNotNull())).alias("h"))
    return found.select(id_col, "h.rule", "h.severity", "h.message", (F.col("n") + 1).cast("long").alias("line"), F.substring(F.trim("raw"), 1, 160).alias("code"))


def verdicts(texts: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, error_count, warning_count, verdict (FAIL, WARN, PASS) of every text, counted inside the row in one pass over its lines."""
    known = valid(rules)
    n = lambda line, kind: sum((line.rlike(r.pattern).cast("long") for r in known if (r.severity == "error") == kind), F.lit(0).cast("long"))
    pair = lambda e, w: F.struct(e.alias("e"), w.alias("w"))
    none = F.lit(0).cast("long")
    found = texts.select(id_col, lines(F.col(text_col)).alias("_lines"))
    found = found.select(id_col, F.aggregate("_lines", pair(none, none), lambda c, line: pair(c["e"] + n(line, True), c["w"] + n(line, False))).alias("_n"))
    rows = found.select(id_col, F.col("_n.e").alias("error_count"), F.col("_n.w").alias("warning_count"))
    return rows.withColumn("verdict", F.when(F.col("error_count") > 0, "FAIL").when(F.col("warning_count") > 0, "WARN").otherwise("PASS"))


def guard(texts: DataFrame, patterns: dict[str, str], looks_like: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the sorted labels of patterns found, for texts that look like code and have any."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    labels = F.array(*[F.when(text.rlike("(?i)" + p), F.lit(label)) for label, p in patterns.items()])
    rows = texts.where(text.rlike(looks_like)).select(id_col, F.array_sort(F.array_distinct(F.array_compact(labels))).alias("labels"))
    return rows.where(F.size("labels") > 0)
