"""Secret scan through a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived: what every match must contain. Each
Arrow block of documents gets an inverted index of the trigrams that occur in the queries (posting:
row numbers in the block); intersecting and uniting postings yields the candidates of a rule, and
only those are verified with the regex over the whole text. A rule without mandatory trigrams scans
every text. Blocks are independent: no shuffle, memory bounded by the block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _parser as regex_parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import bound_batches, table, texts


class Rule(NamedTuple):
    kind: str
    pattern: str
    ignore_case: bool = False
    #: a match counts if its `group` has `least` characters at least
    group: int = 0
    least: int = 1


#: The rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
)
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: A class or alternation of at most so many strings is spelled out; a longer one ends a literal.
SPELL_OUT = 16


def trigram_query(pattern: str, ignore_case: bool = False):
    """What each match must contain, over lower-cased text: a trigram, ("and" | "or", [...]), or None if nothing is mandatory."""
    exact, query = _walk(regex_parser.parse(pattern, re.IGNORECASE if ignore_case else 0))
    return _both(query, _of_strings(exact))


def _both(a, b):
    parts = [x for x in (a, b) if x is not None]
    return ("and", parts) if len(parts) == 2 else parts[0] if parts else None


def _of_strings(strings: set[str] | None):
    """Each alternative needs all its trigrams; one without any makes the whole unbounded."""
    if not strings or any(len(s) < 3 for s in strings):
        return None
    each = [("and", sorted({s[i : i + 3] for i in range(len(s) - 2)})) for s in sorted(strings)]
    return each[0] if len(each) == 1 else ("or", each)


def _members(items) -> set[str] | None:
    """Lower-cased characters of a class, None if there are too many."""
    out: set[str] = set()
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            out.add(chr(arg).lower())
        elif name == "RANGE" and arg[1] - arg[0] < SPELL_OUT:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= SPELL_OUT else None


def _walk(tree) -> tuple[set[str] | None, object]:
    """(all strings that the tree matches, or None; what else each match must contain)."""
    tails: set[str] = {""}  # what may stand at the end of the part read so far, exactly
    whole, query = True, None

    def end_literal() -> None:
        nonlocal tails, whole, query
        query, tails, whole = _both(query, _of_strings(tails)), {""}, False

    def add(strings: set[str]) -> None:
        nonlocal tails
        if len(tails) * len(strings) > SPELL_OUT:
            end_literal()
        tails = {a + b for a in tails for b in strings}

    for op, arg in tree:
        name = str(op)
        strings, inner = None, None
        if name == "LITERAL":
            strings = {chr(arg).lower()}
        elif name == "IN":
            strings = _members(arg)
        elif name == "SUBPATTERN":
            strings, inner = _walk(arg[-1])
        elif name == "ATOMIC_GROUP":
            strings, inner = _walk(arg)
        elif name == "BRANCH":
            each = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in each):
                strings = set().union(*(s for s, _ in each))
            else:
                needs = [_both(q, _of_strings(s)) for s, q in each]
                inner = None if None in needs else ("or", needs)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = arg
            one, inside = _walk(body)
            if low == 0 and int(high) == 1 and one is not None and len(one) < SPELL_OUT:
                strings = one | {""}
            elif low >= 1:
                inner = inside
                if one is not None:
                    add(one)  # the first round; what follows is open
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if strings is not None:
            add(strings)
        else:
            end_literal()
            query = _both(query, inner)
    if whole:
        return tails, query
    return None, _both(query, _of_strings(tails))


def trigrams_of(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def block_index(texts_: list[str], trigrams: list[str]) -> dict[str, np.ndarray]:
    """Postings of one block: trigram -> sorted row numbers."""
    low = [t.lower() for t in texts_]
    return {g: np.array([i for i, t in enumerate(low) if g in t], dtype=np.int64) for g in trigrams}


def candidates(query, index: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Rows of a block that meet a Boolean query."""
    if query is None:
        return np.arange(n)
    if isinstance(query, str):
        return index[query]
    found = None
    for part in query[1]:
        rows = candidates(part, index, n)
        found = rows if found is None else (np.intersect1d if query[0] == "and" else np.union1d)(found, rows)
        if query[0] == "and" and not len(found):
            break
    return found


def compiled(rules: tuple[Rule, ...]) -> list[tuple[Rule, re.Pattern, object]]:
    return [(r, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.ignore_case else 0)), trigram_query(r.pattern, r.ignore_case)) for r in rules]


def scan_block(block: list[str], ready: list) -> list[list[tuple[int, int, int]]]:
    """Findings of each text as (start, rule number, end), sorted."""
    index = block_index(block, sorted(set().union(*(trigrams_of(q) for _, _, q in ready))))
    found: list[list[tuple[int, int, int]]] = [[] for _ in block]
    for k, (rule, regex, query) in enumerate(ready):
        for i in candidates(query, index, len(block)):
            found[i] += [(m.start(), k, m.end()) for m in regex.finditer(block[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    for f in found:
        f.sort()
    return found


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `findings`: array of (kind, start, end, value), by start, then rule order.

    Null and empty texts have none. Repeated rows each give their own row; no other column is read.
    Positions are code points, ends exclusive.
    """
    df = texts(docs, id_col, text_col)
    id_type = df.schema["doc_id"].dataType.simpleString()
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = compiled(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
        for batch in batches:
            block = batch.column("text").to_pylist()
            rows = [[{"kind": rules[k].kind, "start": s, "end": e, "value": block[i][s:e]} for s, k, e in f] for i, f in enumerate(scan_block(block, ready))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "findings"])

    return df.mapInArrow(run, f"doc_id {id_type}, findings array<struct<kind:string,start:int,end:int,value:string>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    of = lambda k: F.filter("findings", lambda f: f["kind"] == k)
    place = lambda col: F.array_join(F.transform(col, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    base = F.filter("findings", lambda f: f["kind"].isin(*[r.kind for r in BASE]))
    return found.select("doc_id", *[F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE], F.sha2(place(base), 256).alias("base_sha256"), place(F.col("findings")).alias("spans"))


def _sql() -> str:
    """The same rules in DuckDB, over every text; positions from the matches and the text between them."""
    raw, lists = [], []
    for k, r in enumerate(RULES):
        # runs of hex digits: asking for the least length at once finds the same ones, without listing every letter
        p = ("(?i)" * r.ignore_case + (f"[0-9a-f]{{{r.least},}}" if r.kind == "hex" else r.pattern)).replace("'", "''")
        raw.append(f"regexp_extract_all(t, '{p}') AS m{k}, string_split_regex(t, '{p}') AS g{k}")
        total = lambda col, end: f"coalesce(list_sum(list_transform({col}[:{end}], lambda x: length(x))), 0)"
        size = f"length(regexp_extract(v, '{p}', {r.group}))" if r.group else "length(v)"
        lists.append(f"list_filter(list_transform(m{k}, lambda v, i: {{'k': {k}, 'kind': '{r.kind}', 's': ({total(f'g{k}', 'i')} + {total(f'm{k}', 'i - 1')})::BIGINT, 'n': length(v)::BIGINT, 'size': {size}::BIGINT}}), lambda f: f.size >= {r.least}) AS {r.kind}")
    names = [r.kind for r in RULES]
    order = lambda ks: f"list_transform(list_sort(list_transform({' || '.join(ks)}, lambda f: {{'s': f.s, 'k': f.k, 'kind': f.kind, 'e': f.s + f.n}})), lambda f: f.kind || ':' || f.s || ':' || f.e)"
    join = lambda ks: f"array_to_string({order(ks)}, ',')"
    base = names[: len(BASE)]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS MATERIALIZED (SELECT doc_id, {", ".join(raw)} FROM d),
f AS MATERIALIZED (SELECT doc_id, {", ".join(lists)} FROM r)
SELECT doc_id, {", ".join(f"len({k})::BIGINT AS n_{k}" for k in base)}, sha256({join(base)}) AS base_sha256, {join(names)} AS spans
FROM f
"""


SQL = _sql()
