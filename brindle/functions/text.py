"""Column functions on text: tokens, names, emptiness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never become search terms.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might can shall of in on at to "
    "for with by from as into and or not this that these those it its use used using sap cloud public edition s4hana api view"
).split()
TERM = "[a-z][a-z0-9]{1,}"

#: Parts of object names without business meaning.
NAME_PREFIX = r"(?i)^(?:(?:API|CE|YY1|Z)_|[ICARE]_|[A-Z]{2,4}_)"
NAME_SUFFIX = (
    r"(?i)(?:_PROCESS_SRV|_SRV_\d+|_SRV|_IN|_OUT|_0001|_0002|_0003|_CHECK|_MODIFY(?:_HDR|_ITEM|_HEAD|_LINE)?"
    r"|_CREATE|_SAVE|_CHANGE|_VALIDATE|_ENRICH|_HDR|_HEAD|_HEADER|_ITEM|_ITM|_LINE)$"
)
NAME_NOISE = "doc item itm hdr head line data info basic query read entry list set".split()
NAME_PART = "[A-Z][a-z0-9]+|[A-Z]+(?=[A-Z][a-z]|$)|[a-z][a-z0-9]*"


def filled(col: Column) -> Column:
    """Null for a null or blank string, else the trimmed string."""
    return F.nullif(F.trim(col), F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First non-blank value, trimmed, of several spellings of a field."""
    return F.coalesce(*[filled(c.cast("string")) for c in cols])


def join_filled(*cols: Column, sep: str = " ") -> Column:
    """Non-empty values joined; null and empty ones leave no separator."""
    return F.array_join(F.filter(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), lambda x: x != ""), sep)


def words(text: Column) -> Column:
    """Tokens between white space, lower case; empty for blank or null text."""
    parts = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), " ")
    return F.filter(parts, lambda x: x != "")


def terms(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Search terms with repeats: ASCII words of two or more characters that start with a letter, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def counted(items: Column) -> Column:
    """Array of term and tf, in order of term, of an array of strings; counted in place, by runs of the sorted array.

    (Arrays are bound to lambda variables, since an expression would be computed anew for each element.)
    """
    bound = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return bound(starts, lambda p: F.transform(p, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(p, k + 1), F.size(s)) - i).alias("tf"))))

    none = F.array().cast("array<struct<term:string,tf:int>>")
    return bound(F.sort_array(items), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(none))


def name_tokens(name: Column) -> Column:
    """Distinct business tokens of an object name, sorted: affixes off, split at underscores and camel case."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), NAME_PREFIX, ""), NAME_SUFFIX, "")
    pieces = F.filter(F.split(bare, "_"), lambda p: p != "")

    def cut(piece: Column) -> Column:
        camel = F.regexp_extract_all(piece, F.lit(NAME_PART), F.lit(0))
        return F.when(F.size(camel) > 0, camel).otherwise(F.array(piece))

    low = F.transform(F.flatten(F.transform(pieces, cut)), F.lower)
    return F.array_sort(F.array_distinct(F.filter(low, lambda t: (F.length(t) >= 3) & ~t.isin(*NAME_NOISE))))


def decoded(col: Column) -> Column:
    """VARIANT of a string that starts like JSON and parses, null otherwise (the string itself stays beside it)."""
    return F.when(col.rlike(r"^\s*[\[{]"), F.try_parse_json(col))


def text_list(col: Column) -> Column:
    """ARRAY<STRING> from a value that may be null, one string, or a JSON list of strings; never null."""
    as_list = F.from_json(col, "array<string>")
    return F.when(col.isNull() | (col == ""), F.array().cast("array<string>")).when(col.startswith("["), F.coalesce(as_list, F.array(col))).otherwise(F.array(col))


def strip_tags(html: Column) -> Column:
    """Tags to spaces, runs of blanks to one, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"[ \t]+", " "))


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a plain substring."""
    return F.coalesce(F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)), F.lit(0)).cast("long")
