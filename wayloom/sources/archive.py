"""Tile archives: directories of run-length entries, and lookups."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ENTRIES = 1 << 24


def varints(raw: bytes, at: int, n: int) -> tuple[list[int], int]:
    """n little-endian base-128 numbers from a position, and where they end."""
    out = []
    for _ in range(n):
        value = shift = 0
        while True:
            if at >= len(raw) or shift > 63:
                raise ValueError("a number runs over")
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                break
        out.append(value)
    return out, at


def directory(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(tile_id, run, length, offset) of each entry; an offset of 0 is the end of the entry before."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    (n,), at = varints(raw, 0, 1)
    if n > MAX_ENTRIES:
        raise ValueError("too many entries")
    gaps, at = varints(raw, at, n)
    runs, at = varints(raw, at, n)
    lengths, at = varints(raw, at, n)
    offsets, at = varints(raw, at, n)
    out, tile, end = [], 0, 0
    for g, r, size, o in zip(gaps, runs, lengths, offsets, strict=True):
        tile += g
        start = end if o == 0 and out else o - 1
        out.append((tile, r, size, start))
        end = start + size
    return out


def pack_directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """The inverse of `directory`, without compression."""

    def put(v: int) -> bytes:
        out = bytearray()
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        return bytes(out + bytes([v]))

    parts, tile = [put(len(entries))], 0
    gaps = []
    for e in entries:
        gaps.append(e[0] - tile)
        tile = e[0]
    parts += map(put, gaps)
    parts += [put(e[1]) for e in entries] + [put(e[2]) for e in entries] + [put(e[3] + 1) for e in entries]
    return b"".join(parts)


def read_directories(files: DataFrame) -> DataFrame:
    """path, tile_id, run, length, offset of binary files (path, content) that hold one directory each."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *e) for p, c in zip(b["path"], b["content"], strict=True) for e in directory(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "tile_id", "run", "length", "offset"])

    return files.select("path", "content").mapInPandas(decode, "path string, tile_id long, run long, length long, offset long")


def lookup(tiles: DataFrame, entries: DataFrame, block: int = 4096) -> DataFrame:
    """Entries (tile_id, run, ...) that hold each tile (tile); tiles without one have nulls.

    A range join by blocks of ids: an entry is repeated for each block its run
    touches, so both sides meet in an equi-join.
    """
    spans = entries.filter("run > 0").withColumn("block", F.explode(F.expr(f"sequence(tile_id div {block}, (tile_id + run - 1) div {block})")))
    asked = tiles.withColumn("block", F.expr(f"tile div {block}"))
    return asked.join(spans, (asked["block"] == spans["block"]) & F.expr("tile >= tile_id and tile < tile_id + run"), "left").drop("block")
