"""Damaged zip archives: members by a walk of the central directory, and an analysis of the archive's end.

The directory at the end of an archive repeats name, method, sizes and checksum of each member, so members
are found even where the offsets are displaced or the local headers are damaged. What it yields is
checked by its CRC-32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signatures of a zip archive's records.
LOCAL, DIRECTORY, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
#: Members may grow to so many bytes.
MEMBER_LIMIT = 64 << 20


class Entry(NamedTuple):
    name: bytes
    method: int
    crc: int
    packed: int
    offset: int


def directory_start(raw: bytes) -> int:
    """Where the directory begins: just before the end record, by the size that this states, else at the first entry's signature."""
    end = raw.rfind(END)
    if 0 <= end <= len(raw) - 22:
        begin = end - struct.unpack_from("<I", raw, end + 12)[0]
        if begin >= 0 and raw.startswith(DIRECTORY, begin):
            return begin
    return raw.find(DIRECTORY)


def directory_entries(raw: bytes) -> Iterator[Entry]:
    """Entries in order; after a damaged one the walk goes on at the next signature."""
    at = directory_start(raw)
    while 0 <= at <= len(raw) - 46:
        method, crc, packed = (*struct.unpack_from("<H", raw, at + 10), *struct.unpack_from("<II", raw, at + 16))
        sizes = struct.unpack_from("<HHH", raw, at + 28)
        name = raw[at + 46 : at + 46 + sizes[0]]
        if len(name) == sizes[0] > 0:
            yield Entry(name, method, crc, packed, struct.unpack_from("<I", raw, at + 42)[0])
            at += 46 + sum(sizes)
            if raw.startswith(DIRECTORY, at):
                continue
        at = raw.find(DIRECTORY, at + 4 if raw.startswith(DIRECTORY, at) else at)


def data_places(raw: bytes, entry: Entry, shift: int) -> Iterator[int]:
    """Where the data of an entry may begin: behind the header at its offset, moved as the directory was or not, then behind any
    header with its name. A header needs its signature or its name, not both."""
    tried = set()

    def behind(head: int) -> int | None:
        if head in tried or not 0 <= head <= len(raw) - 30:
            return None
        tried.add(head)
        n, extra = struct.unpack_from("<HH", raw, head + 26)
        named = raw.startswith(entry.name, head + 30)
        if not named and not raw.startswith(LOCAL, head):
            return None
        return head + 30 + (len(entry.name) if named else n) + extra

    for head in (entry.offset + shift, entry.offset):
        if (begin := behind(head)) is not None:
            yield begin
    at = raw.find(entry.name)
    while at >= 0:
        if (begin := behind(at - 30)) is not None:
            yield begin
        at = raw.find(entry.name, at + 1)


def unpacked(raw: bytes, begin: int, entry: Entry) -> bytes | None:
    """The member's bytes, if they have the entry's checksum."""
    data = raw[begin : begin + entry.packed]
    if entry.method == 8:
        try:
            data = zlib.decompressobj(-15).decompress(data, MEMBER_LIMIT)
        except zlib.error:
            return None
    elif entry.method:
        return None
    return data if zlib.crc32(data) == entry.crc else None


def directory_members(raw: bytes) -> dict[str, bytes]:
    """Members that the directory names and whose data has the checksum it gives."""
    out: dict[str, bytes] = {}
    end, start = raw.rfind(END), directory_start(raw)
    shift = start - struct.unpack_from("<I", raw, end + 16)[0] if 0 <= end <= len(raw) - 22 else 0
    for entry in directory_entries(raw):
        name = entry.name.decode("utf-8", "replace")
        for begin in data_places(raw, entry, shift):
            if (data := unpacked(raw, begin, entry)) is not None:
                out[name] = data
                break
    return out


def _number(raw: Column, at: Column, size: int) -> Column:
    """Little-endian number of `size` bytes from a zero-based place."""
    digits = F.concat(*[F.hex(F.substring(raw, (at + k + 1).cast("int"), F.lit(1))) for k in reversed(range(size))])
    return F.conv(digits, 16, 10).cast("long")


def _first(text: Column, mark: bytes) -> Column:
    return F.instr(text, mark.decode("latin-1")).cast("long") - 1


def tail_analysis(docs: DataFrame, bytes_col: str = "content") -> DataFrame:
    """Adds what an archive's end says and what is there: end_at (place of the last end record), entries, directory_size and directory_at as it
    states them, directory_found (first entry's signature), bytes_there (hex of four bytes at the stated place, null beyond the file),
    state: no end record, no directory, cut off, displaced, or ok. Places count from 0; null where there is none.

    Bytes are read as characters of Latin-1, so all of it is column expressions.
    """
    raw = F.col(bytes_col)
    text = F.decode(raw, "ISO-8859-1")
    found = _first(F.reverse(text), END[::-1])
    end = F.when(found >= 0, F.length(raw) - found - len(END))
    whole = F.when(end + 22 <= F.length(raw), end)
    first = F.nullif(_first(text, DIRECTORY), F.lit(-1).cast("long"))
    out = docs.withColumns({"end_at": end.cast("long"), "directory_found": first, "_whole": whole.cast("long")})
    out = out.withColumns({"entries": _number(raw, F.col("_whole") + 10, 2), "directory_size": _number(raw, F.col("_whole") + 12, 4), "directory_at": _number(raw, F.col("_whole") + 16, 4)})
    there = F.when(F.col("directory_at") + 4 <= F.length(raw), F.hex(F.substring(raw, (F.col("directory_at") + 1).cast("int"), F.lit(4))))
    state = (
        F.when(raw.isNull() | F.col("end_at").isNull(), "no end record").when(F.col("_whole").isNull(), "cut off")
        .when(F.col("directory_found").isNull(), "no directory").when(F.col("directory_at") != F.col("directory_found"), "displaced").otherwise("ok")
    )
    return out.withColumn("bytes_there", there).withColumn("state", state).drop("_whole")
