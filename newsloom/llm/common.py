"""Helpers that the operators of this subpackage share.

Text is handled as arrays of code points: a batch of texts becomes one uint32 array, character classes come
from lookup tables, and runs, hashes and counts are computed for the whole batch at once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.storage import folder, one_of_each, remove, with_numbers, written

__all__ = ["folder", "one_of_each", "remove", "with_numbers", "written"]

#: Characters handled at once; bounds the memory of one Python worker (about 60 bytes a character).
CHUNK_CHARS = 1_000_000
#: Fixed odd multiplier of the rolling polynomial and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def distinct_articles(articles: DataFrame, columns: tuple[str, ...] = ("headline", "paragraphs")) -> DataFrame:
    """One row (id, *columns) for each non-null id; extra columns are dropped before anything is moved.

    An id that is delivered again has the same text, so any row of it serves; rows with a null id are left out.
    """
    return one_of_each(articles, "id", list(columns))


def bitmap(marks: DataFrame, bits: int) -> np.ndarray | None:
    """Bytes of a bitmap of `bits` bits with those set that marks has in its column bit, None where it has none. The
    executors put it together in pieces of 4 KB; its size is the caller's bound."""
    at = F.col("bit") + 1
    parts = marks.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("b")).collect()
    if not parts:
        return None
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in parts:
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.b, np.uint8)
    return out


def bits_set(marks: np.ndarray | None, bits: int, key: np.ndarray) -> np.ndarray:
    """Is the bit of each key set?"""
    if marks is None:
        return np.zeros(len(key), bool)
    at = (key & np.uint64(bits - 1)).astype(np.int64)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


@functools.cache
def char_table(pattern: str) -> np.ndarray:
    """Boolean array over all code points: is it matched by the character class?"""
    out = np.zeros(0x110000, dtype=bool)
    rx = regex.compile(pattern, regex.V1)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        text = "".join(map(chr, range(lo, hi)))
        for m in rx.finditer(text):
            out[lo + m.start() : lo + m.end()] = True
    return out


def word_chars() -> np.ndarray:
    return char_table(r"[\p{L}\p{M}\p{N}]+")


def white_chars() -> np.ndarray:
    return char_table(r"[ \t\r\n]+")


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


@functools.lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    return powers(n, base)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n + 1 of them."""
    size = 1 << max(16, int(n).bit_length())
    return _powers(size, BASE)[: n + 1], _powers(size, BASE_INV)[: n + 1]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """pre[i] = sum of mix(values[j]) * BASE**j for j < i, modulo 2**64."""
    up, _ = power_tables(len(values))
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(mix(values) * up[:-1], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever it stands; the length is mixed in."""
    _, down = power_tables(len(pre) - 1)
    return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(np.uint64))


def chunks(lengths: Sequence[int], limit: int = CHUNK_CHARS) -> Iterator[slice]:
    """Slices of consecutive texts of about limit characters together; a longer text stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield slice(start, len(lengths))
