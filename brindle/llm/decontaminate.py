"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all test items, over normalised words, is built once per worker process from a bounded
block of items. Each document's words are streamed through it: the current state and matched length
tell the longest run of words, ending here, that occurs in an item. Where that run covers a window
(`window` consecutive item words, or the whole of a shorter item), its words are hit. Documents lose
the hit spans, and those with too large a hit share go altogether. No shuffle of documents; a larger
benchmark is scanned in several blocks of items whose hits are united per document.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import bound_batches, checkpointed, table

WINDOW = 10
#: A document with a larger share of hit words is contaminated as a whole.
MAX_COVERAGE = 0.5
#: Item words per automaton: bounds what is broadcast (some 4 MB) and a worker's memory (some 120 MB).
BLOCK_WORDS = 200_000

#: ASCII letters to lower case, all that is neither letter, digit nor beyond ASCII to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes | None) -> list[bytes]:
    """Normalised words of a UTF-8 text; null has none."""
    return text.translate(FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton over word numbers, with the windows that end in each state."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for item, ws in items if ws]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        #: state of a window -> items that have it; (state, words) of items shorter than a window
        self.long: dict[int, set] = {}
        self.short: dict[int, dict[int, set]] = {}
        for item, seq in coded:
            state, matched = 0, 0
            for c in seq:
                state, matched = self.next[state][c], matched + 1
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                    matched = self.length[state]
                if matched >= window:
                    self.long.setdefault(state, set()).add(item)
            if len(seq) < window:
                self.short.setdefault(state, {}).setdefault(len(seq), set()).add(item)
        #: whether a short item ends in the state or in one that its suffixes lead to
        self.ends_short = bytearray(len(self.next))
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__) if self.short else ():
            self.ends_short[s] = s in self.short or self.ends_short[self.link[s]]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = self._state(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.length[p] + 1)
        self.next[new] = dict(self.next[q])
        self.link[new] = self.link[q]
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans of word numbers (end exclusive, disjoint, ascending) and the items with occurring windows."""
        nxt, link, length, window, ends_short = self.next, self.link, self.length, self.window, self.ends_short
        spans: list[list[int]] = []
        items: set = set()
        state = matched = 0
        for i, c in enumerate(map(self.ids.get, ws)):
            if c is None:
                state = matched = 0
                continue
            to = nxt[state].get(c)
            if to is None:
                state = link[state] if state else 0
                while state and c not in nxt[state]:
                    state = link[state]
                matched = length[state]
                to = nxt[state][c]  # at the latest from the root, which every known word leaves
            state, matched = to, matched + 1
            if matched < window and not ends_short[state]:
                continue
            hit, s = 0, state
            if matched >= window:
                hit = window
                while length[link[s]] >= window:
                    s = link[s]
                items |= self.long[s]
            if ends_short[state]:
                s, m = state, matched
                while s:
                    for n, found in self.short.get(s, {}).items():
                        if n <= m:
                            items |= found
                            hit = max(hit, n)
                    s = link[s]
                    m = length[s]
            if hit:
                start = i + 1 - hit
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = i + 1
                else:
                    spans.append([start, i + 1])
        return [tuple(s) for s in spans], items


#: The automaton that this worker process last built.
_built: dict[str, Automaton] = {}


def automaton_of(name: str, shared, window: int) -> Automaton:
    """One per worker process, kept for its next tasks; another block of items (known by name) replaces it."""
    if name not in _built:
        _built.clear()
        _built[name] = Automaton(shared.value, window)
    return _built[name]


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS, window: int = WINDOW) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items in blocks of bounded size; the driver holds one block at a time. An item of more words than a block is
    cut into parts that overlap, so that each of its windows lies in one of them."""
    block, size, most = [], 0, max(block_words, 2 * window)
    parts = (
        (item, ws[k : k + most])
        for item, text in benchmark.select(F.col(id_col), F.col(text_col).cast("binary")).toLocalIterator()
        for ws in [words(bytes(text)) if text else []]
        for k in range(0, max(len(ws) - window + 1, 1), most - window + 1)
    )
    for item, ws in parts:
        if block and size + len(ws) > block_words:
            yield block
            block, size = [], 0
        block.append((item, ws))
        size += len(ws)
    yield block


def _leaks(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, block_words: int) -> DataFrame:
    """row (the input's columns as a struct, so that no name can clash), text, n_words, spans and items of each input row."""
    bound_batches(docs.sparkSession)
    found = docs.select(
        F.struct("*").alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    before = None
    for block in item_blocks(benchmark, block_words=block_words, window=window):
        if before:  # one scan at a time: the earlier one is finished and its items are released
            found = checkpointed(found)
            before.unpersist()
        before = docs.sparkSession.sparkContext.broadcast([(str(i), ws) for i, ws in block if ws])
        found = _scan(found, before, window)
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The input's columns plus _n_words, _spans (hit word spans, end exclusive, disjoint) and _items (ids as strings, sorted).

    Null and empty texts have no words; an item without words has no window, and items may repeat. Repeated rows each give
    their own row; an empty table stays empty, and without items nothing is hit. The input's columns pass through whatever
    their names, but columns named as the three added ones are replaced by them.
    """
    found = _leaks(docs, benchmark, window, text_col, block_words)
    added = {"_n_words": "n_words", "_spans": "spans", "_items": "items"}
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in added], *[F.col(c).alias(name) for name, c in added.items()])


def _scan(found: DataFrame, shared, window: int) -> DataFrame:
    """Adds the hits of one block of items to those found so far, row by row."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton_of(name, shared, window)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            n, spans, items = [], [], []
            before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
            for text, (old_spans, old_items) in zip(batch.column("text").cast(pa.binary()), before, strict=True):
                ws = words(text.as_py())
                new, hit = auto.scan(ws)
                n.append(len(ws))
                spans.append([{"start": a, "end": b} for a, b in (united([(s["start"], s["end"]) for s in old_spans], new) if old_spans else new)])
                items.append(sorted({*old_items, *hit}))
            columns = [batch.column("row"), batch.column("text"), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "n_words", "spans", "items"])

    return found.mapInArrow(run, found.schema)


def united(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def cut_spans(text: str, spans: list) -> str:
    """The text without the hit words and what stands between them; `spans` are disjoint, in order."""
    data = text.encode()
    places = [m.span() for m in WORD.finditer(data)]
    out, at = [], 0
    for s in spans:
        first, last = places[s["start"]][0], places[s["end"] - 1][1]
        out.append(data[at:first])
        at = last
    return b"".join([*out, data[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, text_col: str = "text") -> DataFrame:
    """The input's columns (any names, their own values), texts without their hit spans; documents with a larger hit share are dropped.

    Null and empty texts stay as they are. Repeated rows each stay or go for themselves; an empty table stays empty, and without items nothing changes.
    """
    found = _leaks(docs, benchmark, window, text_col, BLOCK_WORDS)
    cut = F.udf(lambda text, spans: cut_spans(text, spans) if spans else text, "string", useArrow=True)
    hit = F.aggregate("spans", F.lit(0), lambda s, x: s + x["end"] - x["start"])
    kept = found.where(hit <= max_coverage * F.col("n_words"))
    text = F.when(F.size("spans") > 0, cut(F.col("text"), "spans")).otherwise(F.col("row").getField(text_col))
    return kept.select(*[(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"),
    )


SQL = r"""
WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, fold),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, fold),
lens AS (SELECT DISTINCT least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, win FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: w[i:i + 9])) AS win FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, w[i:i + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
