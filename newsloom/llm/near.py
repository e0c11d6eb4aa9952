"""Near-duplicate records by a chosen-path set similarity join.

A record is the set of SHINGLE-character substrings of its normalised text. Sets become signatures of minwise tokens
(one-permutation hashing with densification). In each of some independent trees a node branches its records by minwise
tokens that are chosen for its path, until it is small; small nodes are compared exhaustively by their signatures, and
the pairs that may reach the threshold are checked exactly on their texts.

The upper part of a tree is a shuffle: a record goes down one path, and only nodes that hold more than NODE_ROWS records,
as counted, are branched on. What is sent of a record is a copy a tree, and a node of depth d needs trees_for(d) trees,
so copies follow the depth that the collection needs where the record lies. Which nodes are too big is sent to the tasks
as a bitmap. Inside a task each node is branched twice a level, in INNER trees of its own. Nodes that stay too big (their
records are alike in all tokens chosen) are cut into blocks, and each two blocks are one node.

Copies (equal normalised texts) are first reduced to one representative. Links between different texts are reported
for all their members; copies among themselves all with all in classes of up to `paired`, else each with the
representative; near_duplicates returns links and membership, from which any form follows.

Defined results: null headlines count as empty, null paragraphs are left out, texts under SHINGLE characters are in
no pair; ids that come again count once; null ids are left out.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import bitmap, bits_set, chunks, codes, distinct_articles, mix, prefix_hash, span_hash, table, word_chars, written

SHINGLE = 8
THRESHOLD = 0.6
#: Places of a signature, one byte each.
PLACES = 64
#: Bins of the one-permutation hashing; PLACES of them are kept.
BINS = 128
#: Expected share of the pairs at the threshold that must be found, at any depth.
RECALL = 0.99
#: Records of a node that one task compares; a node with more is branched by one more shuffled level.
NODE_ROWS = 300_000
#: Most shuffled levels; nodes still too big after them are cut into blocks.
OUTER_LEVELS = 6
#: Trees in each node inside a task, their levels, and the records of a node from which it isn't branched any more.
INNER = 3
LEVELS = 7
SMALL = 40
#: Entries of nodes that a task branches at once.
MOST_ENTRIES = 1_000_000
#: Bits of the bitmap of big nodes: this many for each node that may be big; bounded by MOST_BITS (128 MB).
BITS_A_NODE = 8
MOST_BITS = 1 << 30
#: A pair is checked exactly if its signatures agree in at least this share of places: 3.5 standard deviations
#: of 64 places below the threshold.
AGREE = 0.6 - 3.5 * math.sqrt(0.6 * 0.4 / PLACES)
#: Most ids of candidates that are sent to all tasks to pick their texts; with more the texts are joined unpicked.
MOST_PICKED = 1_000_000
PAIRED = 20

SIGNATURES = "id string, h1 long, h2 long, sig binary"


def normalised(headline: str | None, paragraphs: list[str | None] | None) -> str:
    """Joined and lower-cased; normalise() makes runs of other characters one blank."""
    return " ".join([headline or "", *(p for p in paragraphs or [] if p is not None)]).lower()


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, runs of non-word characters made one blank, trimmed; and the texts' bounds."""
    cp = codes("\0".join(texts) + "\0")
    end = cp == 0  # a null character is no word character, and stands between texts
    size = np.array([len(t) for t in texts])
    bounds = np.cumsum(size + 1) - 1
    end[:] = False
    end[bounds] = True
    word = word_chars()[cp] & ~end
    before = np.concatenate(([False], word[:-1]))
    after = np.concatenate((word[1:], [False]))
    starts, ends = runs_of_gaps(word, end)
    blank = np.zeros(len(cp), bool)
    blank[starts] = True
    # a run of other characters is one blank if words of the same text stand on both sides
    keep = word.copy()
    inside = (starts > 0) & ~end[np.minimum(ends - 1, len(cp) - 1)]
    inside &= before[starts] & after[ends - 1]
    keep[starts[inside]] = True
    out = np.where(word, cp, 32)[keep]
    total = np.concatenate(([0], np.cumsum(keep)))
    return out, np.concatenate(([0], total[bounds]))


def runs_of_gaps(word: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of characters that aren't of words; a text's end closes the run it is in."""
    gap = ~word
    begin = gap & np.concatenate(([True], word[:-1] | end[:-1]))
    stop = gap & np.concatenate((word[1:] | end[:-1], [True]))
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


@functools.cache
def _fill_order() -> np.ndarray:
    """For each bin the order in which other bins are asked when it is empty."""
    return np.argsort(mix(np.arange(BINS * BINS)).reshape(BINS, BINS), axis=1)


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text lengths, two hashes of the whole text, and the signatures (PLACES bytes)."""
    cp, bounds = normalise(texts)
    size = np.diff(bounds)
    pre = prefix_hash(cp)
    h1 = span_hash(pre, bounds[:-1], bounds[1:])
    h2 = span_hash(prefix_hash(cp ^ np.uint32(0x5BD1E995)), bounds[:-1], bounds[1:])
    none = np.iinfo(np.uint64).max
    least = np.full((len(texts), BINS), none, dtype=np.uint64)
    if len(cp) >= SHINGLE:
        at = np.arange(len(cp) - SHINGLE + 1)
        doc = np.repeat(np.arange(len(texts)), size)[: len(at)]
        at = at[at + SHINGLE <= bounds[1:][doc]]
        doc = doc[at]
        h = span_hash(pre, at, at + SHINGLE)
        np.minimum.at(least.ravel(), doc * BINS + (h & np.uint64(BINS - 1)).astype(np.int64), h >> np.uint64(7))
    filled = least.copy()
    order = _fill_order()
    for step in range(BINS):
        rows, cols = np.nonzero(filled == none)
        if not len(rows):
            break
        filled[rows, cols] = least[rows, order[cols, step]]
    return size, np.stack((h1, h2), 1), (mix(filled[:, :PLACES]) >> np.uint64(40)).astype(np.uint8)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["id"].to_pylist()
        texts = [normalised(h, p) for h, p in zip(batch["headline"].to_pylist(), batch["paragraphs"].to_pylist())]
        for s in chunks([len(t) for t in texts]):
            size, whole, sig = signatures(texts[s])
            at = np.flatnonzero(size >= SHINGLE)
            yield pa.RecordBatch.from_arrays([pa.array([ids[s.start + i] for i in at], pa.string()), pa.array(whole[at, 0].view(np.int64)), pa.array(whole[at, 1].view(np.int64)), pa.array([sig[i].tobytes() for i in at], pa.binary())], names=["id", "h1", "h2", "sig"])


def survival(share: float, depth: int) -> float:
    """Chance that a pair whose signatures agree in this share of places is compared in one tree: it must stay together
    on a path of `depth` levels, then in one of INNER trees, where each node has two branches and a pair is lost only
    where all its paths are."""
    q = 1.0
    for _ in range(LEVELS):
        q = 1 - (1 - share * q) ** 2
    return share**depth * (1 - (1 - q) ** INNER)


def recall(similarity: float, depth: int, trees: int) -> float:
    """Expected share of pairs of a similarity that become candidates and pass the signature check."""
    ways = [math.comb(PLACES, k) * similarity**k * (1 - similarity) ** (PLACES - k) for k in range(PLACES + 1)]
    return sum(w * (1 - (1 - survival(k / PLACES, depth)) ** trees) for k, w in enumerate(ways) if k >= AGREE * PLACES)


@functools.cache
def trees_for(depth: int, target: float = RECALL) -> int:
    """Fewest trees that reach the target at the threshold, for nodes of a depth. Pairs whose nodes differ in depth from
    tree to tree reach it, too: a node of depth d contributes as much as one of trees_for(d)."""
    n = 1
    while recall(THRESHOLD, depth, n) < target:
        n += 1
    return n


@functools.cache
def order_of(tree: int) -> np.ndarray:
    """The places by which a tree branches, level by level."""
    return np.argsort(mix(np.arange(PLACES) + 1_000 * (tree + 1)))


def _branch(key: np.ndarray, place: np.ndarray | int, value: np.ndarray) -> np.ndarray:
    return mix(mix(key) ^ (np.asarray(place, np.uint64) * np.uint64(256) + value.astype(np.uint64)))


def _root(tree: int, n: int) -> np.ndarray:
    return np.full(n, tree + 1, np.uint64)


def _sigs(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint8).reshape(-1, PLACES)


class Plan:
    """Which nodes are branched on: a bitmap for each level, over hashes of nodes. Two nodes that share a bit count as
    one; then both are branched on, which costs a level and loses nothing."""

    def __init__(self, bits: int, levels: int = OUTER_LEVELS):
        self.bits, self.levels, self.big, self.depth = bits, levels, {}, 1

    def is_big(self, level: int, key: np.ndarray) -> np.ndarray:
        return bits_set(self.big.get(level), self.bits, key)

    def blocks(self, key: np.ndarray) -> np.ndarray:
        """Into how many blocks nodes of the last level are cut: a power of two; entry levels + c: nodes of more than 2**c
        times the records of a node."""
        out = np.ones(len(key), np.int64)
        for level in sorted(k for k in self.big if k >= self.levels):
            out = np.where(self.is_big(level, key), 4 << (level - self.levels), out)
        return out

    def ends(self, sig: np.ndarray, tree: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(depth, records, nodes) at which the records end in a tree."""
        rows, key = np.arange(len(sig)), _root(tree, len(sig))
        for level in range(1, self.depth + 1):
            place = int(order_of(tree)[level - 1])
            key = _branch(key, place, sig[rows, place])
            on = self.is_big(level, key) if level < self.depth else np.zeros(len(rows), bool)
            yield level, rows[~on], key[~on]
            rows, key = rows[on], key[on]


def _count_nodes(plan: Plan, level: int, trees: range):
    """(bit, n): records of the nodes of a level, by the bit that stands for the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            at = np.concatenate([k for k, _ in kept])
            bit, place = np.unique(at, return_inverse=True)
            return bit, np.bincount(place, weights=np.concatenate([n for _, n in kept])).astype(np.int64)

        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _sigs(batch)
            for tree in trees:
                for depth, _, key in plan.ends(sig, tree):
                    if depth == level and len(key):
                        bit, n = np.unique(key & np.uint64(plan.bits - 1), return_counts=True)
                        kept.append((bit.astype(np.int64), n))
            if sum(len(k) for k, _ in kept) > 500_000:
                kept = [merged()]
        if kept:
            bit, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(bit), pa.array(n)], names=["bit", "n"])

    return run


def plan_nodes(reps: DataFrame, total: int, node_rows: int = NODE_ROWS, levels: int = OUTER_LEVELS) -> Plan:
    """Counts the nodes level by level, and branches on those of more than node_rows records."""
    bits = 1 << 16
    while bits < BITS_A_NODE * total * trees_for(levels) // node_rows:
        bits *= 2
    if bits > MOST_BITS:
        raise ValueError("too many records for the bitmap of big nodes; raise NODE_ROWS")
    plan = Plan(bits, levels)

    def count(level: int, trees: range) -> DataFrame:
        at = Plan(bits, levels)
        at.big, at.depth = dict(plan.big), level
        parts = reps.select("sig").mapInArrow(_count_nodes(at, level, trees), "bit long, n long")
        return written(parts.groupBy("bit").agg(F.sum("n").alias("n")), "nodes")

    def add(level: int, more: np.ndarray | None) -> bool:
        if more is not None:
            plan.big[level] = plan.big[level] | more if level in plan.big else more
        return more is not None

    done: dict[int, int] = {}
    while True:
        deeper = False
        for level in range(1, plan.depth + 1):
            trees = range(done.get(level, 0), trees_for(plan.depth))
            counts = count(level, trees)
            if level < levels:
                more = add(level, bitmap(counts.where(F.col("n") > node_rows), bits))
                deeper = deeper or more
            else:
                c = 0
                while add(levels + c, bitmap(counts.where(F.col("n") > node_rows << c), bits)):
                    c += 1
            done[level] = trees.stop
        if not (deeper and plan.depth in plan.big) or plan.depth == levels:
            return plan
        plan.depth += 1


NODES = "node long, tree int, id string, sig binary"


def _paths(plan: Plan):
    """Rows (node, tree, id, sig): each record in the node where it ends in each tree that its depth needs."""
    trees = trees_for(plan.depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _sigs(batch)
            text = batch["h1"].to_numpy().view(np.uint64)
            for tree in range(trees):
                for depth, rows, key in plan.ends(sig, tree):
                    if not len(rows) or tree >= trees_for(depth):
                        continue
                    if depth == plan.levels:
                        n = plan.blocks(key)
                        copies = np.maximum(n - 1, 1)
                        at = np.repeat(np.arange(len(rows)), copies)
                        mine = (mix(text[rows[at]]) % n[at].astype(np.uint64)).astype(np.int64)
                        other = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                        other += other >= mine  # all blocks but its own
                        pair = np.where(n[at] > 1, (np.minimum(mine, other) << 32) + np.maximum(mine, other) + 1, 0)
                        rows, key = rows[at], np.where(pair > 0, mix(key[at] ^ mix(pair)), key[at])
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(rows), tree, np.int32)), batch["id"].take(take), batch["sig"].take(take)], names=["node", "tree", "id", "sig"])

    return run


def _agreeing(sig: np.ndarray, members: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of members of the same group (bounds) whose signatures agree often enough."""
    size = np.diff(bounds)
    reps = np.repeat(bounds[1:], size) - np.arange(bounds[0], bounds[-1]) - 1  # later members of the group
    start = 0
    total = np.cumsum(reps)
    while start < len(reps):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + 300_000, side="right")))
        n = reps[start:stop]
        a = np.repeat(np.arange(start, stop), n)
        b = a + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = members[bounds[0] + a], members[bounds[0] + b]
        ok = (sig[a] == sig[b]).sum(1) >= AGREE * PLACES
        yield np.stack((np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok])), 1)
        start = stop


def node_pairs(sig: np.ndarray, node: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """Candidate pairs (row, row) of some nodes, which are branched on until they are small."""
    out = [np.zeros((0, 2), np.int64)]
    stack = [(np.arange(len(sig)), node, mix(tree.astype(np.uint64) * np.uint64(INNER) + np.uint64(k)), 0) for k in range(INNER)]
    while stack:
        rows, node, path, level = stack.pop()
        order = np.argsort(node, kind="stable")
        rows, node, path = rows[order], node[order], path[order]
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        size = np.diff(np.concatenate((first, [len(rows)])))
        small = (size <= SMALL) | (level >= LEVELS)
        pick = np.flatnonzero(small & (size > 1))
        if len(pick):
            keep = np.zeros(len(size), bool)
            keep[pick] = True
            members = rows[np.repeat(keep, size)]
            out += _agreeing(sig, members, np.concatenate(([0], np.cumsum(size[pick]))))
        go = np.repeat(~small, size)
        rows, node, path = rows[go], node[go], path[go]
        if len(rows):
            one = mix(path) % np.uint64(PLACES)
            two = (one + np.uint64(1) + mix(path ^ np.uint64(77)) % np.uint64(PLACES - 1)) % np.uint64(PLACES)
            parts = [(rows, _branch(node, p, sig[rows, p.astype(np.int64)]), mix(path * np.uint64(2) + np.uint64(b)), level + 1) for b, p in enumerate((one, two))]
            if 2 * len(rows) <= MOST_ENTRIES:
                parts = [(*(np.concatenate(x) for x in zip(*(p[:3] for p in parts))), level + 1)]
            stack += parts
    return np.unique(np.concatenate(out), axis=0)


def _join_nodes():
    """Candidate pairs of the nodes of a task; input sorted by node, one block of whole nodes is held."""

    def one(node: list[np.ndarray], tree: list[np.ndarray], ids: list[pa.Array], sig: list[np.ndarray]) -> pa.RecordBatch:
        names = pa.chunked_array(ids, pa.string()).combine_chunks()
        pairs = node_pairs(np.concatenate(sig), np.concatenate(node), np.concatenate(tree))
        return pa.RecordBatch.from_arrays([names.take(pa.array(pairs[:, 0])), names.take(pa.array(pairs[:, 1]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch["node"].to_numpy().view(np.uint64)
            part = (node, batch["tree"].to_numpy().astype(np.int64), batch["id"], _sigs(batch))
            if rows > 20_000:
                cut = np.searchsorted(node != held[0][-1][-1], True) if (node != held[0][-1][-1]).any() else len(node)
                for h, p in zip(held, part):
                    h.append(p[:cut])
                if cut < len(node):
                    yield one(*held)
                    held, rows = ([], [], [], []), 0
                part = tuple(p[cut:] for p in part)
            if len(part[0]):
                for h, p in zip(held, part):
                    h.append(p)
                rows += len(part[0])
        if held[0]:
            yield one(*held)

    return run


def jaccard(texts: list[str], others: list[str]) -> np.ndarray:
    """Similarity of the shingle sets of each pair of texts."""
    n = len(texts)
    cp, bounds = normalise(texts + others)
    size = np.diff(bounds)
    if len(cp) < SHINGLE:
        return np.zeros(n)
    at = np.arange(len(cp) - SHINGLE + 1)
    doc = np.repeat(np.arange(2 * n), size)[: len(at)]
    at = at[at + SHINGLE <= bounds[1:][doc]]
    doc = doc[at]
    h = span_hash(prefix_hash(cp), at, at + SHINGLE)
    pair, side = doc % n, doc // n
    order = np.lexsort((side, h, pair))
    pair, side, h = pair[order], side[order], h[order]
    new = np.concatenate(([True], (pair[1:] != pair[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    union = np.bincount(pair[first], minlength=n)
    both = np.bincount(pair[first], weights=(np.minimum.reduceat(side, first) != np.maximum.reduceat(side, first)).astype(float), minlength=n) if len(first) else np.zeros(n)
    return np.divide(both, union, out=np.zeros(n), where=union > 0)


def _check(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch["text_a"].to_pylist(), batch["text_b"].to_pylist()
            got = []
            for s in chunks([len(x) + len(y) for x, y in zip(left, right)]):
                got.append(jaccard([x.lower() for x in left[s]], [y.lower() for y in right[s]]))
            sim = np.concatenate(got) if got else np.zeros(0)
            keep = pa.array(sim >= threshold)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(sim)], names=["a", "b", "similarity"]).filter(keep)

    return run


def near_duplicates(articles: DataFrame, threshold: float = THRESHOLD, node_rows: int = NODE_ROWS, levels: int = OUTER_LEVELS) -> tuple[DataFrame, DataFrame]:
    """Links between different texts (a, b, similarity), a < b, and members (id, representative) of all records with
    a text; a representative is the smallest id of its copies."""
    spark = articles.sparkSession
    docs = distinct_articles(articles)
    signed = written(docs.mapInArrow(_sign, SIGNATURES), "signatures")
    heads = written(signed.groupBy("h1", "h2").agg(F.min_by("sig", "id").alias("sig"), F.min("id").alias("id"), F.count("*").alias("n")), "heads")
    plan = plan_nodes(heads, heads.count(), node_rows, levels)
    nodes = heads.select("id", "h1", "sig").mapInArrow(_paths(plan), NODES)
    pairs = nodes.repartition("node").sortWithinPartitions("node").mapInArrow(_join_nodes(), "a string, b string")
    pairs = written(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    text = F.concat_ws(" ", F.coalesce("headline", F.lit("")), F.array_compact(F.coalesce("paragraphs", F.array().cast("array<string>"))))
    texts = docs.select("id", text.alias("text"))
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    if wanted.limit(MOST_PICKED + 1).count() <= MOST_PICKED:
        texts = texts.join(F.broadcast(wanted), "id", "left_semi")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.repartition(n, "id")  # one exchange for both sides
    one = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}).hint("merge"), "a")
    both = one.join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}).hint("merge"), "b").select("a", "b", "text_a", "text_b")
    links = both.mapInArrow(_check(threshold), "a string, b string, similarity double")
    copies = heads.where("n > 1").select("h1", "h2", F.col("id").alias("representative"))
    members = signed.select("id", "h1", "h2").join(copies, ["h1", "h2"], "left").select("id", F.coalesce("representative", "id").alias("representative"))
    return links, members


def all_pairs(links: DataFrame, members: DataFrame, paired: int | None = PAIRED) -> DataFrame:
    """(id_a, id_b): the links for all members of their classes, and the copies: all with all in classes of up to `paired`
    (None: in all), else each with the representative."""
    sizes = members.groupBy("representative").agg(F.count("*").alias("n"))
    copies = members.join(sizes.where("n > 1"), "representative").select("representative", "id", "n")
    a = copies.select(F.col("representative").alias("a"), F.col("id").alias("ma"))
    b = copies.select(F.col("representative").alias("b"), F.col("id").alias("mb"))
    full = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y"))
    star = copies.where("id <> representative").select(F.col("representative").alias("x"), F.col("id").alias("y"))
    few = copies.where(F.col("id") != F.col("representative"))
    few = few if paired is None else few.where(F.col("n") <= paired)
    rest = few.alias("l").join(few.alias("r"), "representative").where("l.id < r.id").select(F.col("l.id").alias("x"), F.col("r.id").alias("y"))
    out = full.unionByName(star).unionByName(rest)
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_pairs(*near_duplicates(table(spark, sf_dir, "articles")))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each article with a text: the representative of its copies and the number of its links."""
    links, members = near_duplicates(table(spark, sf_dir, "articles"))
    links = written(links, "links")
    degree = links.select(F.col("a").alias("representative")).unionByName(links.select(F.col("b").alias("representative"))).groupBy("representative").agg(F.count("*").alias("links"))
    return members.join(degree, "representative", "left").select("id", "representative", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


QUERIES = {"p4_found": p4_found, "p4_classes": p4_classes}

#: Normalised texts, their shingles (by hash) and sizes, and the shared shingles of pairs: exact, for small collections.
_EXACT = r"""d AS (SELECT id, any_value(headline) AS h, any_value(paragraphs) AS ps FROM articles WHERE id IS NOT NULL GROUP BY id),
n AS (SELECT id, trim(regexp_replace(lower(concat(coalesce(h, ''), ' ', coalesce(array_to_string(list_filter(ps, lambda x: x IS NOT NULL), ' '), ''))), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) AS t FROM d),
r AS (SELECT id, t, min(id) OVER (PARTITION BY t) AS representative FROM n WHERE length(t) >= 8),
s AS (SELECT DISTINCT id, hash(substr(t, i, 8)) AS g FROM (SELECT id, t, unnest(range(1, length(t) - 6)) AS i FROM r)),
z AS (SELECT id, count(*) AS c FROM s GROUP BY id),
b AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.id < y.id GROUP BY x.id, y.id),
e AS (SELECT id_a, id_b FROM b JOIN z p ON p.id = id_a JOIN z q ON q.id = id_b WHERE b.c >= 0.6::DOUBLE * (p.c + q.c - b.c))"""
SQL = {
    "p4_found": f"WITH {_EXACT} SELECT id_a, id_b FROM e",
    "p4_classes": f"""WITH {_EXACT}, h AS (SELECT id FROM r WHERE id = representative), l AS (SELECT id_a AS id, id_b AS o FROM e UNION ALL SELECT id_b, id_a FROM e),
g AS (SELECT id AS representative, count(*) AS links FROM l WHERE id IN (SELECT id FROM h) AND o IN (SELECT id FROM h) GROUP BY id)
SELECT id, representative, coalesce(links, 0) AS links FROM r LEFT JOIN g USING (representative)""",
}
