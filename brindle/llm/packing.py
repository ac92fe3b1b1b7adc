"""Order-preserving packing into windows by dynamic programming.

Each partition is a stream of documents, kept in its order. Window cuts may fall on document ends,
sentence ends, or (dearer) between words; a window costs its padding plus the penalty of its cut.
best(j) = penalty(j) + min over i of best(i) + padding(j - i) is a sliding-window minimum of
best(i) + i, so a monotone queue makes it linear; windows whose length is a power of two need no
padding and are looked up directly. Nothing is shuffled: a partition packs what it reads, in blocks
of bounded size, and carries its last, unfinished window over to the next block.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import bound_batches, table, texts

WINDOW = 2048
END_ID = 1
#: Penalties, in padding ids: a cut at a sentence end inside a document, between words, and inside an unbroken run.
SENTENCE, WORD, RUN = 8, 24, 256
#: Cuts between words are offered every so many ids; unbroken runs are cut there too.
EVERY = 64
#: Ids that are packed at once; bounds the memory of a task whatever the partition holds.
BLOCK = 1 << 19
#: Fixed value: how the byte-level pre-tokenizer splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer runs of white space are too deep for the fast encoder's pattern engine.
LONG_SPACE = re.compile(r"\s{2000}")
#: Ends of tokens after which a sentence may end: Latin, then full-width marks.
STOPS = (b".", b"!", b"?", "\u3002".encode(), "\uFF01".encode(), "\uFF1F".encode())


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters stand for
    themselves, the other bytes have characters from U+0100 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Ids of texts. A byte-level BPE file whose ids are in merge order is a table of ranks, which tiktoken applies
    several times faster than the library of the file; texts with special tokens or very long runs of white space
    go to that library."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, place = spec["model"]["vocab"], spec["model"]["merges"], byte_of()
        token = {i: bytes(place[c] for c in t) for t, i in vocab.items()}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        split = spec["pre_tokenizer"]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or made != sorted(made) or spec["model"].get("ignore_merges"):
            raise ValueError(f"{path}: not a byte-level BPE file with ids in merge order")
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks={t: i for i, t in token.items()}, special_tokens={})
        size = max(token) + 1 + len(self.special)
        self.space, self.stop, self.newline = (np.zeros(size, dtype=bool) for _ in range(3))
        for i, t in token.items():
            self.space[i], self.stop[i], self.newline[i] = t[:1] in (b" ", b"\n"), t.endswith(STOPS), t.endswith(b"\n")

    def whole(self, text: str) -> list[int]:
        """Ids by the library of the file."""
        return self.lib.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special) or LONG_SPACE.search(text):
            return self.whole(text)
        return self.fast.encode_ordinary(text)

    def encode(self, text: str) -> tuple[array, list[int], list[int]]:
        """Ids, then the places of sentence ends and of other cuts between words (ascending, 0 < place < len)."""
        ids = array("I", self.ids(text))
        if len(ids) < 2:
            return ids, [], []
        row = np.frombuffer(ids, dtype="<u4")
        word, before = self.space[row[1:]], row[:-1]
        end = self.newline[before] | (word & self.stop[before])
        ends, cuts = np.flatnonzero(end) + 1, np.flatnonzero(word & ~end) + 1
        first = np.ones(len(cuts), dtype=bool)  # of each EVERY ids, the first cut between words is offered
        first[1:] = cuts[1:] // EVERY != cuts[:-1] // EVERY
        return ids, ends.tolist(), cuts[first].tolist()


@cache
def encoder_of(path: str) -> Encoder:
    """One per worker process, for all its tasks; its size does not depend on the texts."""
    return Encoder(path)


def best_cuts(places: list[int], penalties: list[int], window: int = WINDOW) -> list[int]:
    """The cheapest cuts of a stream: `places` ascend from 0 to its end, neighbours at most a window apart.

    Returns the chosen places, the first (0) and last included.
    """
    n = len(places)
    best, back = [0] * n, [0] * n
    at = {p: i for i, p in enumerate(places)}
    powers = [1 << k for k in range(window.bit_length() - 1)]
    queue = deque([(0, 0)])  # (best(i) + place(i), i), values ascending
    for j in range(1, n):
        p = places[j]
        while places[queue[0][1]] < p - window:
            queue.popleft()
        # padding(i, j) = window - p + place(i)
        value, i = queue[0]
        cost = value + window - p
        for q in powers:
            k = at.get(p - q)
            if k is not None and best[k] < cost:
                cost, i = best[k], k
        best[j] = cost = cost + penalties[j]
        back[j] = i
        value = cost + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return [places[i] for i in reversed(chosen)]


class Packer:
    """Packs a stream of documents; add() and close() return finished pieces as
    (document number, start, length, crc32, sequence, offset)."""

    def __init__(self, window: int = WINDOW, block: int = BLOCK):
        self.window, self.block = window, block
        self.docs: list[tuple[int, array, int, list[int], list[int]]] = []  # number, ids, ids packed before, sentence ends, word cuts
        self.size, self.sequence = 0, 0

    def add(self, number: int, ids: array, ends: list[int], cuts: list[int]) -> list[tuple]:
        self.docs.append((number, ids, 0, ends, cuts))
        self.size += len(ids)
        return self._pack(False) if self.size >= self.block else []

    def close(self) -> list[tuple]:
        return self._pack(True) if self.docs else []

    def _pack(self, last: bool) -> list[tuple]:
        places, penalties, at, step = [0], [0], 0, min(4 * EVERY, self.window)
        for _, ids, start, ends, cuts in self.docs:
            inner = [(e, SENTENCE) for e in ends if e > start] + [(c, WORD) for c in cuts if c > start]
            inner.sort()
            inner.append((len(ids), 0))
            prior = start
            for place, penalty in inner:
                for run in range(prior + step, place, step):
                    places.append(at + run - start)
                    penalties.append(RUN)
                places.append(at + place - start)
                penalties.append(penalty)
                prior = place
            at += len(ids) - start
        cut = best_cuts(places, penalties, self.window)
        if not last and len(cut) > 2:
            cut.pop()  # the last window may still grow
        out, rest, d, used = [], [], 0, 0
        docs = self.docs
        for begin, end in zip(cut, cut[1:]):
            offset = 0
            while begin + offset < end:
                number, ids, start, ends, cuts = docs[d]
                start += used
                length = min(len(ids) - start, end - begin - offset)
                piece = np.frombuffer(ids, dtype="<u4", count=length, offset=4 * start)
                out.append((number, start, length, zlib.crc32(piece), self.sequence, offset))
                offset += length
                used += length
                if start + length == len(ids):
                    d, used = d + 1, 0
            self.sequence += 1
        for k, (number, ids, start, ends, cuts) in enumerate(docs[d:]):
            rest.append((number, ids, start + used * (k == 0), ends, cuts))
        self.docs, self.size = rest, sum(len(x[1]) - x[2] for x in rest)
        return out


PIECES = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; with `with_ids` also its token ids.

    Every document, empty or null ones too, ends with `end_id`. Sequence ids are unique over all
    partitions (partition number, then a running count) and offsets in a sequence have no gaps.
    Documents keep the order in which their partition is read. Repeated rows are packed each; an
    empty table gives no rows; other columns are not read.
    """
    path = path or tokenizer_path()
    df = texts(docs, id_col, text_col)
    bound_batches(docs.sparkSession, rows=500, size=4 << 20)
    schema = PIECES.format(id=df.schema["doc_id"].dataType.simpleString()) + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, packer = encoder_of(path), Packer(window)
        base = TaskContext.get().partitionId() << 33
        waiting: dict[int, tuple] = {}  # documents with pieces to come: id and ids
        number, kind = 0, None

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            names = [waiting[p[0]][0] for p in pieces]
            columns = [pa.array(names, kind), *[pa.array([p[k] for p in pieces], pa.int64()) for k in (1, 2, 3)]]
            columns += [pa.array([len(waiting[p[0]][1]) for p in pieces], pa.int64()), pa.array([base + p[4] for p in pieces], pa.int64()), pa.array([p[5] for p in pieces], pa.int64())]
            labels = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([waiting[p[0]][1][p[1] : p[1] + p[2]].tolist() for p in pieces], pa.list_(pa.int32())))
                labels.append("ids")
            for p in pieces:
                if p[1] + p[2] == len(waiting[p[0]][1]):
                    del waiting[p[0]]
            return pa.RecordBatch.from_arrays(columns, names=labels)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids, ends, cuts = encoder.encode(text)
                ids.append(end_id)
                waiting[number] = (doc_id, ids)
                if pieces := packer.add(number, ids, ends, cuts):
                    yield rows(pieces)
                number += 1
        if pieces := packer.close():
            yield rows(pieces)

    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
