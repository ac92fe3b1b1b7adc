"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Everything is a column expression; a document is one row from the scan to the result, with no shuffle.
The patterns are written with possessive quantifiers and start guards, so that each is linear in the
text; they match exactly what the plain forms beside them match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import table, texts
from brindle.llm.spans import let, match_spans, part_of, pieces, places, scanned

#: Plain pattern of each kind, in the order in which kinds are listed.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z][A-Z][0-9][0-9][A-Z0-9]{11,30}",
}
#: The same without backtracking: a run is entered at its start only (or where the last match ended).
LINEAR = PLAIN | {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:[0-9]{2,}+|[0-9][\x20-][0-9]++)(?:[\x20-][0-9]++)*+",
}
BASE = ("email", "ip", "card", "phone")
#: Words that make a kind likelier when they stand in the WINDOW characters before a span.
CONTEXT = {
    "email": ["mail", "contact", "address"],
    "ip": ["ip", "host", "server", "address"],
    "card": ["card", "visa", "credit", "payment"],
    "phone": ["phone", "tel", "call", "fax", "mobile"],
    "iban": ["iban", "bank", "account", "transfer"],
}
WINDOW = 40
#: Score of a confirmed span without context, and what a context word adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT_GAIN = 0.3
CONFIDENT = 0.85


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the check digit of a digit string holds."""
    places_ = F.sequence(F.lit(1), F.length(number))
    doubled = F.transform(places_, lambda i: F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(doubled, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """True if an account number's check digits hold (remainder 1)."""
    turned = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))
    codes = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.ascii(F.substring(turned, i, F.lit(1))))
    step = lambda s, c: F.when(c <= 57, (s * 10 + c - 48) % 97).otherwise((s * 100 + c - 55) % 97)
    return F.aggregate(codes, F.lit(0), step) == 1


def confirmed(kind: str, spans: Column) -> Column:
    """The spans whose value passes the kind's check."""

    def keep(span: Column) -> Column:
        value = span["value"]
        if kind == "ip":
            return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"))
        if kind == "card":
            number = digits(value)
            return F.when(F.length(number).between(13, 19), luhn(number)).otherwise(False)
        if kind == "phone":
            return F.length(digits(value)).between(9, 15)
        return mod97(value) if kind == "iban" else F.lit(True)

    return spans if kind == "email" else F.filter(spans, keep)


def scored(kind: str, cut: Column, spans: Column) -> Column:
    """kind, start, end, value and score of each span; `cut`: the text's pieces."""

    def one(span: Column) -> Column:
        before = F.lower(part_of(cut, F.greatest(span["start"] - WINDOW, F.lit(0)), span["start"]))
        near = before.rlike(r"(?<![a-z])(?:" + "|".join(CONTEXT[kind]) + r")")
        score = F.lit(PRIOR[kind]) + F.when(near, CONTEXT_GAIN).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), span["value"].alias("value"), F.least(score, F.lit(1.0)).alias("score"))

    return F.transform(spans, one)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, one span list per kind, and `findings` (kind, start, end, value, score).

    Null and empty texts have no findings. Repeated rows each give their own row; other columns of
    the input are not read, so their names don't matter.
    """
    df = texts(docs, id_col, text_col)
    text = F.col("text")
    number = F.col("has_digit")
    guards = {"email": F.contains(text, F.lit("@")), "ip": number, "card": number, "phone": number & F.contains(text, F.lit("+")), "iban": number & text.rlike("[A-Z][A-Z][0-9][0-9]")}
    df = df.withColumn("has_digit", text.rlike("[0-9]"))
    df = df.select("doc_id", "text", *[match_spans(text, LINEAR[k], guards[k]).alias(k) for k in LINEAR])
    df = df.select("doc_id", "text", *[confirmed(k, F.col(k)).alias(k) for k in LINEAR])
    any_span = sum((F.size(k) for k in LINEAR), F.lit(0)) > 0
    cut = F.when(any_span, pieces(text)).otherwise(F.array().cast("array<string>"))
    return df.withColumn("findings", let(cut, lambda c: F.concat(*[scored(k, c, F.col(k)) for k in LINEAR])))


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """doc_id and the text with every finding replaced by [KIND], left to right; of findings that overlap the one that starts first, then ends
    first, then by name of its kind. Null texts become empty, repeated rows give a row each, an empty table stays empty."""
    found = find_pii(docs, id_col, text_col)
    spans = F.array_sort(F.transform(F.filter("findings", lambda f: f["score"] >= least_score), lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["kind"].alias("kind"))))
    free = lambda at, f: f["start"] >= at
    after = lambda at, f: F.when(free(at, f), f["end"]).otherwise(at)
    kept = scanned(spans, "struct<from:int,start:int,end:int,kind:string>", after, lambda at, f: F.struct(at.alias("from"), f["start"].alias("start"), f["end"].alias("end"), f["kind"].alias("kind")), free)

    def masked(cut: Column, kept: Column) -> Column:
        parts = F.transform(kept, lambda k: F.concat(part_of(cut, k["from"], k["start"]), F.lit("["), F.upper(k["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), part_of(cut, F.coalesce(F.get(kept, F.size(kept) - 1)["end"], F.lit(0)), F.length("text")))

    return found.select("doc_id", let(pieces(F.col("text")), lambda cut: let(kept, lambda k: masked(cut, k))).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    listed = {k: places(k, F.col(k)) for k in LINEAR}
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.concat(*[listed[k] for k in BASE]), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*listed.values()), ",").alias("spans"),
        F.size(F.filter("findings", lambda f: f["score"] >= CONFIDENT)).cast("long").alias("n_confident"),
    )


def _sql() -> str:
    """The plain patterns in DuckDB; positions from the same two lists."""
    lists, tests = [], {
        "email": "true",
        "ip": r"len(list_filter(string_split(s.v, '.'), lambda p: NOT regexp_full_match(p, '0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])'))) = 0",
        "card": r"length(regexp_replace(s.v, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse(regexp_replace(s.v, '[^0-9]', '', 'g')), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0",
        "phone": r"length(regexp_replace(s.v, '[^0-9]', '', 'g')) BETWEEN 9 AND 15",
        "iban": r"list_reduce(list_prepend(0, list_transform(string_split(s.v[5:] || s.v[:4], ''), lambda c: CASE WHEN ascii(c) <= 57 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, c: CASE WHEN c < 10 THEN (a * 10 + c) % 97 ELSE (a * 100 + c) % 97 END) = 1",
    }
    for k, p in PLAIN.items():
        m, g = f"regexp_extract_all(t, '{p}')", f"string_split_regex(t, '{p}')"
        lists.append(f"list_transform({m}, lambda v, i: {{'v': v, 's': coalesce(list_sum(list_transform({g}[:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform({m}[:i - 1], lambda x: length(x))), 0)::BIGINT}}) AS {k}")
    place = lambda k: f"list_transform({k}, lambda s: '{k}:' || s.s || ':' || (s.s + length(s.v)))"
    near = lambda k: f"CASE WHEN regexp_matches(lower(t[greatest(s.s - {WINDOW}, 0) + 1 : s.s]), '(^|[^a-z])({'|'.join(CONTEXT[k])})') THEN {CONTEXT_GAIN} ELSE 0 END"
    high = " + ".join(f"len(list_filter({k}, lambda s: least({PRIOR[k]} + {near(k)}, 1.0) >= {CONFIDENT}))" for k in PLAIN)
    join = lambda kinds: "array_to_string(" + " || ".join(place(k) for k in kinds) + ", ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS (SELECT doc_id, t, {", ".join(lists)} FROM d),
ok AS (SELECT doc_id, t, {", ".join(f"list_filter({k}, lambda s: {tests[k]}) AS {k}" for k in PLAIN)} FROM raw)
SELECT doc_id, {", ".join(f"len({k})::BIGINT AS n_{k}" for k in BASE)}, sha256({join(BASE)}) AS base_sha256, {join(PLAIN)} AS spans, ({high})::BIGINT AS n_confident
FROM ok
"""


SQL = _sql()
