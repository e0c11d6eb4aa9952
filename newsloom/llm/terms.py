"""Terms of records: graph-of-words weights (how distinctive a term is) and vertical bitmaps (how frequent it is).

A term is a maximal run of letters and marks of the lower-cased text; Han, Hiragana, Katakana and Thai characters
and U+30FC break runs. Defined results: null or blank paragraphs, and null or empty lists of them, hold no terms;
ids that come again count once; null ids are left out; ties go to the term that is smaller by code points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import char_table, chunks, codes, distinct_articles, prefix_hash, runs, span_hash, table, with_numbers, written

#: Terms within this many places of each other in a record are neighbours in its graph.
WINDOW = 4
#: A term held by at least this share of the records is sent to all tasks with its document frequency. There are
#: at most (mean number of terms of a record) / COMMON_SHARE of them, whatever the number of records.
COMMON_SHARE = 0.002
#: Hard bound on what is sent; beyond it the share is doubled until it fits. Rarer terms go through a join.
MOST_COMMON = 200_000
#: Record numbers that share a container.
CONTAINER = 1 << 13
#: Occurrences of terms in records that a task holds before its containers go out; parts of one are united later.
MOST_HELD = 2_000_000

TERM_CLASS = r"[[\p{L}\p{M}]--[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Thai}ー]]+"


def term_table() -> np.ndarray:
    return char_table(TERM_CLASS)


class Terms:
    """Terms of a block of texts: for each occurrence its text's number (doc) and its term's number (term)."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        cp = codes(joined)
        starts, ends = runs(term_table()[cp])
        bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        self.doc = np.searchsorted(bounds, starts, side="right")
        if len(starts):
            hashes = span_hash(prefix_hash(cp), starts, ends)
            _, first, self.term = np.unique(hashes, return_index=True, return_inverse=True)
            self.words = [joined[starts[i] : ends[i]] for i in first]
        else:
            self.term, self.words = np.zeros(0, np.int64), []

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes: text, term and occurrences, sorted by text; and the node of every occurrence."""
        width = max(1, len(self.words))
        keys, node, n = np.unique(self.doc * width + self.term, return_inverse=True, return_counts=True)
        return keys // width, keys % width, n, node


def lowered(paragraphs: list[str | None] | None) -> str:
    return "\n".join(p.lower() for p in paragraphs or [] if p)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], Terms]]:
    """Ids and terms of blocks of records of bounded size."""
    for batch in batches:
        ids, texts = batch["id"].to_pylist(), [lowered(p) for p in batch["paragraphs"].to_pylist()]
        for s in chunks([len(t) for t in texts]):
            yield ids[s], Terms(texts[s])


# ---- frequencies by vertical bitmaps -------------------------------------------------------------------------


def pack(members: np.ndarray) -> bytes:
    """A container of sorted record numbers below CONTAINER: their list, or one bit each where that is shorter."""
    if 2 * len(members) < CONTAINER // 8:
        return b"\0" + members.astype("<u2").tobytes()
    bits = np.zeros(CONTAINER, dtype=np.uint8)
    bits[members] = 1
    return b"\1" + np.packbits(bits).tobytes()


def unpack(data: bytes) -> np.ndarray:
    if data[0] == 0:
        return np.frombuffer(data, dtype="<u2", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=1)))


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of each term over the record numbers of a container. Only (term, record, count) triples are held."""
    words: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        term, record, n = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((record, term))
        term, record, n = term[order], record[order], n[order]
        where = record // CONTAINER
        at = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (where[1:] != where[:-1]))))
        bits = [pack(m) for m in np.split(record % CONTAINER, at[1:])]
        names = pa.array(list(words), pa.string()).take(pa.array(term[at]))
        return pa.RecordBatch.from_arrays([names, pa.array(where[at]), pa.array(bits, pa.binary()), pa.array(np.add.reduceat(n, at), pa.int64())], names=["term", "container", "records", "n"])

    for batch in batches:
        numbers = batch["number"].to_numpy()
        texts = [lowered(p) for p in batch["paragraphs"].to_pylist()]
        for s in chunks([len(t) for t in texts]):
            block = Terms(texts[s])
            doc, term, n, _ = block.counted()
            local = np.fromiter((words.setdefault(w, len(words)) for w in block.words), dtype=np.int64, count=len(block.words))
            if len(doc):
                held.append((local[term], numbers[s][doc], n))
                size += len(doc)
            if size > MOST_HELD:
                yield flush()
                words, held, size = {}, [], 0
    if held:
        yield flush()


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unites the containers of equal (term, container) in sorted input; df from the cardinality of the union."""
    last: tuple[str, int] | None = None
    union: np.ndarray | None = None
    data = b""
    count = 0

    def result(rows: list[tuple[str, int, bytes, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())], names=["term", "container", "records", "n", "df"])

    def row() -> tuple:
        size = (len(data) - 1) // 2 if data[0] == 0 else int(np.bitwise_count(np.frombuffer(data, np.uint8, offset=1)).sum())
        return (*last, data, count, size)

    for batch in batches:
        rows = []
        for term, container, bits, n in zip(*(batch[c].to_pylist() for c in ("term", "container", "records", "n"))):
            if (term, container) == last:
                union = np.union1d(unpack(data) if union is None else union, unpack(bits))
                data = pack(union)
                count += n
                continue
            if last is not None:
                rows.append(row())
            last, data, count, union = (term, container), bits, n, None
        yield result(rows)
    if last is not None:
        yield result([row()])


def record_numbers(articles: DataFrame) -> DataFrame:
    """(id, paragraphs, number): the records and the numbers that stand for them in bitmaps."""
    return with_numbers(articles, "id", ["paragraphs"])


def term_bitmaps(articles: DataFrame) -> DataFrame:
    """(term, container, records, n, df): compressed bitmaps of record numbers by term, with their occurrences.

    A record's number is container * CONTAINER + its member, and is that of record_numbers. Containers that several
    tasks or batches hold in part are merged by union. A bitmap is never joined over the whole collection: each
    (term, container) stays a row of at most CONTAINER / 8 bytes, so no term, however common, becomes one task's work.
    """
    parts = record_numbers(articles).select("number", "paragraphs").mapInArrow(_containers, "term string, container long, records binary, n long")
    return united(parts)


def united(parts: DataFrame) -> DataFrame:
    """Union of bitmaps (term, container, records, n) that share no record: of tasks, or of batches of records."""
    return parts.select("term", "container", "records", "n").repartition("term", "container").sortWithinPartitions("term", "container").mapInArrow(_unite, "term string, container long, records binary, n long, df long")


def term_frequencies(articles: DataFrame) -> DataFrame:
    """(term, n, df): occurrences and number of articles of every term."""
    return term_bitmaps(articles).groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def useless_terms(articles: DataFrame, least: int = 3, most_share: float = 0.4) -> DataFrame:
    """(term, mark): `rare` below `least` articles, `common` above most_share of all articles, else no row.

    All articles count in the share, also those without terms."""
    total = articles.where(F.col("id").isNotNull()).agg(F.count_distinct("id").alias("total"))
    mark = F.when(F.col("df") < least, "rare").when(F.col("df") > most_share * F.col("total"), "common")
    return term_frequencies(articles).crossJoin(F.broadcast(total)).select("term", mark.alias("mark")).where("mark is not null")  # one row


# ---- distinctive terms by graphs of words --------------------------------------------------------------------


def _partial_df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, block in blocks(batches):
        _, term, _, _ = block.counted()
        df = np.bincount(term, minlength=len(block.words))
        yield pa.RecordBatch.from_arrays([pa.array(block.words, pa.string()), pa.array(df, pa.int64()), pa.array(np.zeros(len(df), np.int64)), ], names=["term", "df", "records"])
        yield pa.RecordBatch.from_arrays([pa.array([""], pa.string()), pa.array([0], pa.int64()), pa.array([len(ids)], pa.int64())], names=["term", "df", "records"])


def word_graph(block: Terms, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the graphs of all texts of a block: text, term, occurrences and number of distinct neighbours."""
    doc, term, n, node = block.counted()
    edges = []
    for gap in range(1, window):
        a, b = node[:-gap], node[gap:]
        keep = (block.doc[:-gap] == block.doc[gap:]) & (a != b)
        a, b = a[keep], b[keep]
        edges.append(np.minimum(a, b) * len(doc) + np.maximum(a, b))
    degree = np.zeros(len(doc), np.int64)
    if edges and len(doc):
        e = np.unique(np.concatenate(edges))
        degree = np.bincount(np.concatenate((e // len(doc), e % len(doc))), minlength=len(doc))
    return doc, term, n, degree


NODES = "id string, term string, n long, degree long, df long"


def _graph_batches(common: dict[str, int], left_out: frozenset[str], total: int, keep: int | None, by_degree: bool):
    """keep: only nodes that may be among a record's `keep` best; None: all nodes.

    Exact pruning: the scores of common terms are known here; for others the least document frequency bounds
    the score from above. A node whose bound lies under the `keep`-th best known score can't be among the best.
    """
    most = math.log((total + 1) / 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in blocks(batches):
            doc, term, n, degree = word_graph(block)
            df = np.fromiter((-1 if w in left_out else common.get(w, 0) for w in block.words), dtype=np.int64, count=len(block.words))[term] if len(doc) else np.zeros(0, np.int64)
            ok = df >= 0
            if keep is not None and len(doc):
                weight = (degree if by_degree else n).astype(np.float64)
                score = np.where(df > 0, weight * np.log((total + 1) / (np.maximum(df, 1) + 1)), -1.0)
                order = np.lexsort((-score, doc))
                first = np.searchsorted(doc[order], np.arange(len(ids)))
                place = np.minimum(first + keep - 1, len(doc) - 1)
                cut = np.where(doc[order][place] == np.arange(len(ids)), score[order][place], -1.0) - 1e-9
                ok &= np.where(df > 0, score, weight * most) >= cut[doc]
            at = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()).take(pa.array(doc[at])), pa.array(block.words, pa.string()).take(pa.array(term[at])), pa.array(n[at], pa.int64()), pa.array(degree[at], pa.int64()), pa.array(df[at], pa.int64(), mask=df[at] == 0)], names=["id", "term", "n", "degree", "df"])

    return run


def _shared_terms(df: DataFrame, total: int, share: float = COMMON_SHARE) -> dict[str, int]:
    while True:
        rows = df.where(F.col("df") >= max(2, math.ceil(share * total))).limit(MOST_COMMON + 1).collect()
        if len(rows) <= MOST_COMMON:
            return {r.term: r.df for r in rows}
        share *= 2


def distinctive_terms(articles: DataFrame, left_out: DataFrame, k: int | None = 3, by_degree: bool = False, least_df: int = 2) -> DataFrame:
    """(id, term, n, degree, df, score, place): terms of each record by their weight in its graph of words.

    The graph of a record links terms within WINDOW places. by_degree: weight = distinct neighbours times rarity;
    else weight = occurrences (the self-weight of the node) times rarity, rarity = ln((N+1)/(df+1)).
    left_out: table with a column word, bounded (it is sent to all tasks); nulls in it are ignored.
    k: best terms of each record, None for all.
    """
    records = distinct_articles(articles, ("paragraphs",))
    counts = written(records.mapInArrow(_partial_df, "term string, df long, records long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("records").alias("records")), "term-df")
    total = counts.agg(F.sum("records")).first()[0] or 0
    counts = counts.where("term <> ''").select("term", F.col("df").alias("all_df"))
    stop = left_out.select(F.col("word").alias("term")).where("term is not null").distinct()
    words = frozenset(r.term for r in stop.orderBy("term").limit(MOST_COMMON).collect())
    if len(words) == MOST_COMMON:
        counts = counts.join(stop, "term", "left_anti")  # those that aren't sent have no frequency to join
    common = _shared_terms(counts.withColumnRenamed("all_df", "df"), total)
    shared = articles.sparkSession.sparkContext.broadcast((common, words))
    run = lambda batches: _graph_batches(*shared.value, total, k, by_degree)(batches)
    nodes = records.mapInArrow(run, NODES)
    if common:
        nodes = written(nodes, "term-nodes")
        known, rest = nodes.where("df is not null"), nodes.where("df is null").drop("df")
        found = rest.join(counts, "term").where(F.col("all_df") >= least_df).select("id", "term", "n", "degree", F.col("all_df").alias("df"))
        nodes = known.unionByName(found)
    else:
        nodes = nodes.drop("df").join(counts, "term").where(F.col("all_df") >= least_df).withColumnRenamed("all_df", "df")
    score = F.col("degree" if by_degree else "n") * F.log((F.lit(total) + 1) / (F.col("df") + 1))
    out = nodes.select("id", "term", "n", "degree", "df", score.alias("score"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "term"))
    out = out.withColumn("place", place)
    return out if k is None else out.where(F.col("place") <= k)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive_terms(table(spark, sf_dir, "articles"), table(spark, sf_dir, "common_words")).select("id", "term")


def p2_graph_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best terms by distinct neighbours instead of occurrences."""
    out = distinctive_terms(table(spark, sf_dir, "articles"), table(spark, sf_dir, "common_words"), by_degree=True)
    return out.select("id", "term", "n", "degree", "df", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return useless_terms(table(spark, sf_dir, "articles"))


def p3_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(table(spark, sf_dir, "articles"))


QUERIES = {"p2_found": p2_found, "p2_graph_weights": p2_graph_weights, "p3_found": p3_found, "p3_frequencies": p3_frequencies}

#: One row (id, term) for each occurrence.
_OCCURRENCES = r"""
d AS (SELECT id, any_value(paragraphs) AS ps FROM articles WHERE id IS NOT NULL GROUP BY id),
w AS (SELECT id, unnest(regexp_extract_all(regexp_replace(lower(array_to_string(list_filter(ps, lambda x: x IS NOT NULL), chr(10))), '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー]+', ' ', 'g'), '[\p{L}\p{M}]+')) AS term FROM d),
t AS (SELECT id, term, count(*) AS n FROM w GROUP BY id, term),
f AS (SELECT term, sum(n)::BIGINT AS n, count(*) AS df FROM t GROUP BY term)
"""
SQL = {
    "p2_graph_weights": rf"""WITH {_OCCURRENCES}, s AS (SELECT id, regexp_extract_all(regexp_replace(lower(array_to_string(list_filter(ps, lambda x: x IS NOT NULL), chr(10))), '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}ー]+', ' ', 'g'), '[\p{{L}}\p{{M}}]+') AS ts FROM d),
o AS (SELECT id, ts, unnest(range(1, len(ts) + 1)) AS i FROM s),
e AS (SELECT DISTINCT id, ts[i] AS a, ts[i + g] AS b FROM o, (SELECT unnest(range(1, {WINDOW})) AS g) WHERE i + g <= len(ts) AND ts[i] <> ts[i + g]),
g AS (SELECT id, a AS term, count(*) AS degree FROM (SELECT id, a, b FROM e UNION SELECT id, b, a FROM e) GROUP BY id, a),
x AS (SELECT t.id, t.term, t.n, coalesce(degree, 0) AS degree, df, coalesce(degree, 0) * ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (df + 1)) AS score FROM t LEFT JOIN g USING (id, term) JOIN (SELECT term, df FROM f) USING (term) WHERE df >= 2 AND NOT EXISTS (SELECT 1 FROM common_words c WHERE c.word = t.term)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, term) AS place FROM x)
SELECT id, term, n, degree, df, round(score, 6) AS score, place FROM r WHERE place <= 3""",
    "p2_found": f"""WITH {_OCCURRENCES}, s AS (SELECT t.id, t.term, t.n * ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (f.df + 1)) AS score FROM t JOIN f USING (term) WHERE f.df >= 2 AND NOT EXISTS (SELECT 1 FROM common_words c WHERE c.word = t.term))
SELECT id, term FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, term) <= 3""",
    "p3_found": f"""WITH {_OCCURRENCES} SELECT term, CASE WHEN df < 3 THEN 'rare' ELSE 'common' END AS mark FROM f WHERE df < 3 OR df > 0.4 * (SELECT count(*) FROM d)""",
    "p3_frequencies": f"""WITH {_OCCURRENCES} SELECT term, n, df FROM f""",
}
