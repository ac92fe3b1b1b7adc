"""Table functions for SQL: lint and tokenise a table of (id, text, ...), with rules that may be rows of a table.

    tables.register(spark, tables.rules_of(spark.table("rules")))
    spark.sql("SELECT * FROM lint(TABLE(SELECT doc_id, text FROM documents))")
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult

from brindle.functions import text as T
from brindle.operators.lint import Rule, valid

#: A set of rules goes to every task; more than so many are refused.
RULES = 1000
CODE = 160


def rules_of(table: DataFrame, most: int = RULES) -> list[Rule]:
    """Rules from a table with id, severity, pattern and, where present, message; in order of id, invalid patterns left out.

    The number is checked: a table of more than `most` rows is an error, not a silent cut.
    """
    message = F.col("message") if "message" in table.columns else F.lit("")
    rows = table.where("pattern IS NOT NULL").select("id", "severity", "pattern", F.coalesce(message, F.lit(""))).orderBy("id", "pattern").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return valid([Rule(*r) for r in rows])


def _first_two(table: AnalyzeArgument) -> ty.StructField:
    if not table.isTable or len(table.dataType.fields) < 2:
        raise ValueError("give a table of (id, text, ...)")
    return table.dataType.fields[0]


def split_lines(text: str | None) -> list[str]:
    """As lint.lines: an end of line at the end makes no further line, an empty text has none."""
    parts = re.split(r"\r\n|\r|\n", text or "")
    return parts[:-1] if parts[-1] == "" else parts


def lint_function(rules: list[Rule]):
    """A table function with lint's rows (id, rule, severity, message, line, code). Its patterns are read as Python's, with ASCII classes: beside
    letters beyond ASCII a word boundary differs from that of the column expressions."""
    known = valid(rules)

    class Lint:
        def __init__(self):
            self.tests = [(r, re.compile(r.pattern, re.ASCII)) for r in known]

        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            schema = ty.StructType([_first_two(table)])
            for name, kind in (("rule", ty.StringType()), ("severity", ty.StringType()), ("message", ty.StringType()), ("line", ty.LongType()), ("code", ty.StringType())):
                schema = schema.add(name, kind)
            return AnalyzeResult(schema)

        def eval(self, row: ty.Row):
            for n, line in enumerate(split_lines(row[1]), 1):
                for rule, pattern in self.tests:
                    if pattern.search(line):
                        yield row[0], rule.id, rule.severity, rule.message, n, line.strip(" ")[:CODE]

    return F.udtf(Lint)


class Terms:
    """Table function: (id, term, tf, n_terms) of each text, as search.term_counts."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        schema = ty.StructType([_first_two(table)])
        return AnalyzeResult(schema.add("term", ty.StringType()).add("tf", ty.LongType()).add("n_terms", ty.IntegerType()))

    def eval(self, row: ty.Row):
        # only A-Z can become part of a term by lowering, but for the two capitals whose lower case is ASCII
        found = [t for t in re.findall(T.TERM, (row[1] or "").lower()) if t not in T.STOP_WORDS]
        for term, n in Counter(found).items():
            yield row[0], term, n, len(found)


def register(spark: SparkSession, rules: list[Rule]) -> None:
    """lint(TABLE(...)) and terms(TABLE(...)) for this session's SQL."""
    spark.udtf.register("lint", lint_function(rules))
    spark.udtf.register("terms", F.udtf(Terms))
