"""Evaluation texts inside a corpus, by greedy string tiling.

Seeds (runs of SEED words, or all words of a shorter item) that a document shares with an item make a candidate.
For a candidate, the longest common runs of words are marked as tiles again and again, none overlapping another,
found by running Karp-Rabin hashes; the share of the item that tiles cover finds passages in another order, too.

Defined results: null and empty texts, and items without words, are in no pair; null ids are left out; repeated
rows give one pair; an item in several rows counts with each of its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import bitmap, bits_set, chunks, codes, prefix_hash, runs, span_hash, table, word_chars, written

SEED = 13
#: Characters of items that are sent to all tasks; with more of them, documents meet items by a join of their seeds.
SENT_CHARS = 8_000_000
#: Bits for each seed of the items in the bitmap by which documents pick their seeds for the join; at most MOST_BITS.
BITS_A_SEED = 16
MOST_BITS = 1 << 30

PAIRS = "doc_id long, item_id long, tiles int, longest int, covered int, words int"


class Words:
    """Words of a block of texts as hashes, with the number of each one's text."""

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        self.joined = "\n".join(low)
        cp = codes(self.joined)
        self.starts, self.ends = runs(word_chars()[cp])
        bounds = np.cumsum([len(t) + 1 for t in low])
        self.text = np.searchsorted(bounds, self.starts, side="right")
        self.hash = span_hash(prefix_hash(cp), self.starts, self.ends)
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.pre = prefix_hash(self.hash)

    def seeds(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of length words inside one text, and their places."""
        at = np.arange(max(0, len(self.hash) - length + 1))
        at = at[self.text[at] == self.text[at + length - 1]] if len(at) else at
        return span_hash(self.pre, at, at + length), at

    def of(self, i: int) -> slice:
        return slice(self.first[i], self.first[i + 1])

    def strings(self, a: int, b: int) -> list[str]:
        return [self.joined[s:e] for s, e in zip(self.starts[a:b], self.ends[a:b])]


def tile(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: tiles (place in a, place in b, length >= least)."""
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    pre_a, pre_b = prefix_hash(a), prefix_hash(b)
    out: list[tuple[int, int, int]] = []
    size = min(len(a), len(b))

    def matches(n: int) -> list[tuple[int, int]]:
        """Unmarked common runs of n words, by running hashes."""
        if n > len(a) or n > len(b) or n < 1:
            return []
        ok_a = np.flatnonzero(np.convolve(free_a, np.ones(n, int), "valid") == n)
        ok_b = np.flatnonzero(np.convolve(free_b, np.ones(n, int), "valid") == n)
        if not len(ok_a) or not len(ok_b):
            return []
        ha, hb = span_hash(pre_a, ok_a, ok_a + n), span_hash(pre_b, ok_b, ok_b + n)
        order = np.argsort(hb, kind="stable")
        place = np.searchsorted(hb[order], ha)
        place[place == len(hb)] = 0
        hit = hb[order][place] == ha
        return [(int(i), int(ok_b[order[j]])) for i, j in zip(ok_a[hit], place[hit])]

    while size >= least:
        lo, hi, best = least, size, []  # the longest length that still matches; matching is monotone in it
        while lo <= hi:
            mid = (lo + hi) // 2
            if got := matches(mid):
                best, size, lo = got, mid, mid + 1
            else:
                hi = mid - 1
        if not best:
            break
        for i, j in best:
            if free_a[i : i + size].all() and free_b[j : j + size].all():
                free_a[i : i + size] = free_b[j : j + size] = False
                out.append((i, j, size))
    return out


class Items:
    """Items of a block with their seeds."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.words = Words(texts)
        self.ids = ids
        count = np.diff(self.words.first)
        self.least = np.minimum(count, SEED)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in sorted({int(n) for n in self.least if n}):
            h, at = self.words.seeds(length)
            item = self.words.text[at]
            keep = self.least[item] == length
            keys = np.unique(np.array([h[keep], item[keep].astype(np.uint64)]), axis=1) if keep.any() else np.zeros((2, 0), np.uint64)
            self.seeds[length] = (keys[0], keys[1].astype(np.int64))

    def candidates(self, words: Words) -> list[tuple[int, int]]:
        """(text, item) that share a seed."""
        out: set[tuple[int, int]] = set()
        for length, (keys, item) in self.seeds.items():
            h, at = words.seeds(length)
            lo = np.searchsorted(keys, h)
            hit = np.flatnonzero((lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == h)) if len(keys) else []
            for p in hit:
                k, text = lo[p], int(words.text[at[p]])
                while k < len(keys) and keys[k] == h[p]:
                    out.add((text, int(item[k])))
                    k += 1
        return sorted(out)


def _row(words: Words, d: int, items: Items, i: int) -> tuple[int, int, int, int] | None:
    """Tiles, longest, covered and words of an item in a text, None without a tile; tiles are compared word by word."""
    here, there = words.of(d), items.words.of(i)
    tiles = tile(words.hash[here], items.words.hash[there], int(items.least[i]))
    tiles = [(a, b, n) for a, b, n in tiles if words.strings(here.start + a, here.start + a + n) == items.words.strings(there.start + b, there.start + b + n)]
    return (len(tiles), max(n for *_, n in tiles), sum(n for *_, n in tiles), there.stop - there.start) if tiles else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.int32()) for k, c in enumerate(cols)], names=[x.split()[0] for x in PAIRS.split(", ")])


def _find(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()]
            rows = []
            for s in chunks([len(t) for t in texts]):
                words = Words(texts[s])
                for d, i in items.candidates(words):
                    if got := _row(words, d, items, i):
                        rows.append((ids[s.start + d], items.ids[i], *got))
            yield _batch(rows)

    return run


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, length, item): the seeds of each item."""
    for batch in batches:
        items = Items(batch["item"].to_pylist(), batch["text"].to_pylist())
        for length, (h, i) in items.seeds.items():
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), length, np.int32)), batch["item"].take(pa.array(i))], names=["h", "length", "item"])


def _document_seeds(lengths: list[int], marks: np.ndarray, bits: int):
    """(h, doc_id): the seeds of each document that an item may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            for s in chunks([len(t) for t in texts]):
                words = Words(texts[s])
                for length in lengths:
                    h, at = words.seeds(length)
                    hit = bits_set(marks, bits, h)
                    if not hit.any():
                        continue
                    pairs = np.unique(np.array([h[hit], words.text[at[hit]].astype(np.uint64)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), batch["doc_id"].take(pa.array(pairs[1].astype(np.int64) + s.start))], names=["h", "doc_id"])

    return run


def _tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
        ids, passages = batch["item_id"].to_pylist(), batch["passage"].to_pylist()
        rows = []
        for s in chunks([len(t) + len(p) for t, p in zip(texts, passages)]):
            words, items = Words(texts[s]), Items(ids[s], passages[s])
            for k in range(s.stop - s.start):
                if got := _row(words, k, items, k):
                    rows.append((docs[s.start + k], ids[s.start + k], *got))
        yield _batch(rows)


def _by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs where items are too many to be sent: seeds of documents, picked by a bitmap of the items' seeds, are
    joined to them; only candidate pairs meet with their texts. The corpus is read twice, whatever the items' number."""
    spark = docs.sparkSession
    items = written(items.withColumn("item", F.concat_ws(":", "item_id", F.md5("text"))), "items")
    seeds = written(items.mapInArrow(_item_seeds, "h long, length int, item string"), "seeds")
    bits = 1 << 16
    while bits < min(BITS_A_SEED * seeds.count(), MOST_BITS):
        bits *= 2
    marks = bitmap(seeds.select(F.col("h").bitwiseAND(bits - 1).alias("bit")), bits)
    lengths = sorted(r.length for r in seeds.select("length").distinct().collect())
    shared = spark.sparkContext.broadcast((lengths, marks, bits))
    found = docs.mapInArrow(lambda batches: _document_seeds(*shared.value)(batches), "h long, doc_id long")
    pairs = written(found.join(seeds, "h").select("doc_id", "item").distinct(), "candidates")
    both = pairs.join(docs, "doc_id").join(items.select("item", "item_id", F.col("text").alias("passage")), "item")
    return both.select("doc_id", "text", "item_id", "passage").mapInArrow(_tile_pairs, PAIRS)


def leaked_items(documents: DataFrame, benchmark: DataFrame, sent_chars: int = SENT_CHARS) -> DataFrame:
    """(doc_id, item_id, tiles, longest, covered, words): documents that hold at least SEED consecutive words of an
    item, or all words of a shorter one; covered: words of the item under tiles. Items of up to sent_chars characters
    together are sent to all tasks, more are joined; the pairs are the same."""
    spark: SparkSession = documents.sparkSession
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) > sent_chars:
        return _by_join(docs, items)
    rows = items.orderBy("item_id", "text").collect()
    shared = spark.sparkContext.broadcast(Items([r.item_id for r in rows], [r.text for r in rows]))
    return docs.mapInArrow(lambda batches: _find(shared.value)(batches), PAIRS)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id").distinct()


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each item a document covers; mostly: at least half of it, in whatever order."""
    pairs = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("covered") / F.col("words"), "tiles", "longest", "covered", "words")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.tiles").cast("long").alias("tiles"), F.col("b.longest").cast("long").alias("longest"), F.col("b.covered").cast("long").alias("covered"), F.col("b.words").cast("long").alias("words"), (2 * F.col("b.covered") >= F.col("b.words")).alias("mostly"))


QUERIES = {"p8_found": p8_found, "p8_coverage": p8_coverage}

SQL = {
    "p8_found": r"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS ws FROM benchmark WHERE text IS NOT NULL),
 d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
 bn AS (SELECT item_id, ws, least(len(ws), 13) AS k FROM b WHERE len(ws) > 0),
 bg AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM bn)),
 ks AS (SELECT DISTINCT k FROM bn),
 dg AS (SELECT DISTINCT doc_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k))
SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (k, g)""",
}
