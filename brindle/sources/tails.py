"""The ends of log files, read without the rest of them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import runs

TAIL = 3000
#: Characters at the end of a log that tell why a job failed.
TELLING = 2000


def open_file(path: str):
    """A file that can be sought in, in any store that Arrow knows, by its URI (or local path)."""
    from pyarrow import fs

    uri = path if "://" in path else re.sub(r"^(?:file:)?/+", "file:///", path)
    store, inside = fs.FileSystem.from_uri(quote(uri, safe=":/@?=&"))
    return store.open_input_file(inside)


def last_characters(read: Callable[[int, int], bytes], length: int, chars: int) -> tuple[str, int]:
    """The last `chars` characters of UTF-8 text and the bytes that were read for them: four for each character and one more, at most."""
    start = max(0, length - 4 * (chars + 1))
    raw = read(start, length - start)
    cut = 0
    while start and cut < min(3, len(raw)) and raw[cut] & 0xC0 == 0x80:  # within a character
        cut += 1
    return raw[cut:].decode("utf-8", "replace")[-chars:] if chars else "", len(raw)


def read_tails(spark: SparkSession, path: str, chars: int = TAIL, opener: Callable = open_file) -> DataFrame:
    """path, length (bytes), modified, tail (last `chars` characters), bytes_read and error of every file below a folder, each task reading the ends of its files only.

    An empty file has no row: Spark's file sources leave it out. Bytes that are no UTF-8 become replacement characters. A file that has gone or can't be read has an empty tail, and error says why.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = found.select("path", "length", F.col("modificationTime").alias("modified"))  # without content: no file is opened for this

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, length in zip(b["path"], b["length"], strict=True):
                try:
                    with opener(name) as f:

                        def read(start: int, size: int, f=f) -> bytes:
                            f.seek(start)
                            return f.read(size)

                        out.append((*last_characters(read, int(length), chars), None))
                except OSError as e:
                    out.append(("", 0, f"{type(e).__name__}: {e}"))
            yield b.assign(**{c: [x[k] for x in out] for k, c in enumerate(("tail", "bytes_read", "error"))})

    return listed.mapInPandas(run, "path string, length bigint, modified timestamp, tail string, bytes_read bigint, error string")


def job_logs(tails: DataFrame, causes: dict[str, str]) -> DataFrame:
    """path, modified, tail and cause (by what its last 2,000 characters contain; see runs.failure_class), the newest first."""
    return tails.select("path", "modified", "tail", runs.failure_class(F.col("tail"), causes, TELLING).alias("cause")).orderBy(F.desc("modified"), "path")
