"""Encoding of texts with a public byte-level BPE vocabulary.

Each piece of the pre-tokenisation is merged with a segment tree over the ranks of its adjacent pairs: the root
yields the leftmost pair of lowest rank, a merge is a few point updates of logarithmic cost. Pieces recur, so each
worker keeps what it has merged, up to a bound.

Defined results: null, missing and empty texts give an empty list; strings that look like special tokens are
ordinary text; repeated rows give repeated rows.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import chunks, table

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = os.environ.get("NEWSLOOM_TOKENIZERS", "/opt/tokenizers")
#: Pieces a worker keeps merged before it starts anew.
MOST_PIECES = 200_000
#: Fixed value: the pre-tokenisation pattern of the vocabulary.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself where printable, else from 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def load_vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Ids of the 256 bytes; pairs of ids (left << 32 | right) -> (rank, id). Its size is that of the file."""
    with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        pairs.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
    return [vocab[s] for s in byte_symbols()], pairs


def merge_piece(ids: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """Merges adjacent pairs, lowest rank first and leftmost among equals, until none is in the vocabulary."""
    n = len(ids)
    if n < 2:
        return ids
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        hit = pairs.get(ids[i] << 32 | ids[i + 1])
        if hit:
            tree[size + i] = hit[0] << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    if tree[1] == NONE:
        return ids
    ids = ids[:]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1

    while (root := tree[1]) != NONE:
        i = root & 0xFFFFFFFF
        j = after[i]
        ids[i] = new = pairs[ids[i] << 32 | ids[j]][1]
        ids[j] = -1
        k = after[i] = after[j]
        if j < n - 1:
            put(j, NONE)
        if k < n:
            before[k] = i
            hit = pairs.get(new << 32 | ids[k])
            put(i, hit[0] << 32 | i if hit else NONE)
        else:
            put(i, NONE)
        h = before[i]
        if h >= 0:
            hit = pairs.get(ids[h] << 32 | new)
            put(h, hit[0] << 32 | h if hit else NONE)
    return [x for x in ids if x >= 0]


NONE = 1 << 62
#: Trees of fewer leaves are merged together, in one array for each size; longer pieces one by one.
LONG = 4096


class Merger:
    """Merges pairs by rank: a segment tree over the pair ranks of each piece, many pieces' trees side by side."""

    def __init__(self, byte_ids: list[int], pairs: dict[int, tuple[int, int]]):
        self.byte_ids, self.pairs = np.array(byte_ids, dtype=np.int64), pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.merged = np.zeros(len(pairs) + 1, dtype=np.int64)
        for rank, new in pairs.values():
            self.merged[rank] = new

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """rank << 32 | place of pairs in the vocabulary, NONE of others and of those with a missing side."""
        code = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == code), self.rank[at] << 32 | place, NONE)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        for i in np.flatnonzero(sizes == 1):
            out[i] = (int(self.byte_ids[pieces[i][0]]),)
        size = 1
        while size < LONG:
            at = np.flatnonzero((sizes > max(1, size // 2 + (size > 1))) & (sizes <= size + 1))
            for k in range(0, len(at), max(1, 200_000 // size)):
                part = at[k : k + max(1, 200_000 // size)]
                for i, ids in zip(part, self.forest([pieces[i] for i in part], size)):
                    out[i] = ids
            size *= 2
        for i in np.flatnonzero(sizes > max(1, size // 2 + (size > 1))):  # all that the largest forest leaves
            out[i] = tuple(merge_piece(self.byte_ids[np.frombuffer(pieces[i], np.uint8)].tolist(), self.pairs))
        assert all(ids or not p for ids, p in zip(out, pieces)), "a piece got no ids"
        return out

    def forest(self, pieces: list[bytes], size: int) -> list[tuple[int, ...]]:
        """Pieces of at most size + 1 bytes: trees of size leaves, leaf p for the pair that begins at place p."""
        n, length = len(pieces), np.array([len(p) for p in pieces])
        ids = np.full((n, size + 2), -1, dtype=np.int64)  # the last column stands for the end
        ids[np.arange(size + 2) < length[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        after = np.minimum(np.arange(1, size + 3), length[:, None])
        after[after >= length[:, None]] = size + 1
        before = np.tile(np.arange(-1, size + 1), (n, 1))
        tree = np.full((n, 2 * size), NONE, dtype=np.int64)
        tree[:, size:] = self.leaves(ids[:, :size], ids[:, 1 : size + 1], np.arange(size))
        level = size // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        live = np.arange(n)
        while len(live := live[tree[live, 1] != NONE]):
            root = tree[live, 1]
            i = root & 0xFFFFFFFF
            j = after[live, i]
            k = after[live, j]
            new = self.merged[root >> 32]
            ids[live, i], ids[live, j] = new, -1
            after[live, i] = k
            some = k <= size
            before[live[some], k[some]] = i[some]
            h = before[live, i]
            paths = []
            for rows, place, value in (
                (live[j < size], j[j < size], NONE),
                (live, i, self.leaves(new, ids[live, k], i)),
                (live[h >= 0], h[h >= 0], self.leaves(ids[live, h], new, h)[h >= 0]),
            ):
                tree[rows, size + place] = value
                paths.append((rows, (size + place) >> 1))
            for rows, node in paths:
                for _ in range(size.bit_length() - 1):
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
        keep = ids >= 0
        flat, ends = ids[keep].tolist(), np.cumsum(keep.sum(1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]


class Encoder(dict):
    """Piece -> ids, filled as pieces come, emptied when it holds `most` of them."""

    def __init__(self, byte_ids: list[int], pairs: dict[int, tuple[int, int]], most: int = MOST_PIECES):
        super().__init__()
        self.merger, self.most = Merger(byte_ids, pairs), most
        self.split = regex.compile(PIECES).findall

    def encode(self, texts: list[str]) -> list[array]:
        words = [self.split(t) for t in texts]
        new = [w for w in set(chain.from_iterable(words)) if w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(set(chain.from_iterable(words)))
        self.update(zip(new, self.merger.merge([w.encode() for w in new])))
        return [array("i", chain.from_iterable(map(self.__getitem__, w))) for w in words]


#: The worker's last vocabulary and its encoder.
_HELD: list = [None, None]


def encode_texts(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids) of every row."""
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(name, folder))
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        if _HELD[0] is not vocabulary:
            _HELD[:] = [vocabulary, Encoder(*vocabulary)]
        encoder = _HELD[1]
        for batch in batches:
            texts = [t or "" for t in batch[text].to_pylist()]
            for block in chunks([len(t) for t in texts]):
                part = batch.slice(block.start, block.stop - block.start)
                lists = encoder.encode(texts[block])
                ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                values = np.frombuffer(b"".join(x.tobytes() for x in lists), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part[key], pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids a character by language."""
    docs = table(spark, sf_dir, "documents")
    ids = encode_texts(docs.select("doc_id", "text")).select("doc_id", F.size("ids").cast("long").alias("n_ids"))
    return ids.join(docs.select("doc_id", "lang", "n_chars"), "doc_id").groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n_ids").alias("n_ids"), F.sum("n_chars").alias("n_chars"))


QUERIES = {"p7_ids": p7_ids, "p7_lengths": p7_lengths}
