"""Long exact spans shared between records, by a log-structured index of fingerprints.

Of all runs of GRAM characters of a paragraph those with the least hash of some window are kept, so that every span
of `length` characters holds a kept one. Each batch of records becomes an immutable run of the index: a table
bucketed and sorted by hash, so that it is merge-joined with the runs of the history without another shuffle; what it
shares with them or inside itself comes out at once. Runs beyond the fan-out are compacted, the smallest into one, and
their files removed. The index lives in a folder and is opened again from it. Kept grams found in two records or more
are verified: all windows of `length` characters around them are compared within the group of the gram, character by
character, and the windows that another record holds, too, are joined to maximal stretches.

Defined results: null and short paragraphs have no span; ids that come again are one record; null ids are left out;
a paragraph that repeats inside one record only is not shared.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import chunks, codes, distinct_articles, folder, mix, prefix_hash, remove, span_hash, table, written

LENGTH = 160
GRAM = 48
#: Groups of more occurrences of one gram are compared by an aggregation of all windows instead of inside a task.
HOT = 2_000
#: Runs of the index beyond which the smallest are compacted into one.
FAN_OUT = 3
#: Fingerprints for a bucket of the index, and how many times its first batch it is expected to hold.
BUCKET_ROWS = 2_000_000
GROWTH = 16
#: Batches in which the queries feed the articles to the index, by year.
BATCHES = 4

PRINTS = "h long, id string, para_no int, pos int"
NEAR = "h long, id string, para_no int, at int, near string"
FOUND = "id string, para_no int, start_pos int, end_pos int"


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i:i+width] for each i, by doubling."""
    step = 1
    while 2 * step <= width:
        x = op(x[: len(x) - step], x[step:])
        step *= 2
    return op(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def kept_grams(texts: list[str], gram: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: text, place and hash of the grams that are the least of some window of `length` characters."""
    cp = codes("".join(texts))
    ends = np.cumsum([len(t) for t in texts])
    width = length - gram + 1
    if len(cp) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(cp) - gram + 1)
    h = span_hash(prefix_hash(cp), at, at + gram)
    end = np.repeat(ends, [len(t) for t in texts])
    h[at + gram > end[at]] = np.iinfo(np.uint64).max
    least = _sliding(h, width, np.minimum)
    first = np.arange(len(least))
    least[first + length > end[first]] = 0
    pad = np.zeros(width - 1, np.uint64)
    keep = np.flatnonzero((_sliding(np.concatenate((pad, least, pad)), width, np.maximum) == h) & (at + gram <= end[at]))
    text = np.searchsorted(ends, keep, side="right")
    return text, keep - np.concatenate(([0], ends))[text], h[keep]


def _prints(gram: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, no, texts = [], [], []
            for d, ps in enumerate(batch["paragraphs"].to_pylist()):
                for k, p in enumerate(ps or []):
                    if p and len(p) >= length:
                        doc.append(d)
                        no.append(k)
                        texts.append(p)
            doc, no = np.array(doc, np.int64), np.array(no, np.int32)
            for s in chunks([len(t) for t in texts]):
                text, pos, h = kept_grams(texts[s], gram, length)
                rows = pa.array(doc[s][text])
                more = [batch[c].take(rows) for c in batch.schema.names if c not in ("id", "paragraphs")]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch["id"].take(rows), pa.array(no[s][text]), pa.array(pos.astype(np.int32)), *more], names=["h", "id", "para_no", "pos", *(c for c in batch.schema.names if c not in ("id", "paragraphs"))])

    return run


def fingerprints(records: DataFrame, gram: int = GRAM, length: int = LENGTH) -> DataFrame:
    """(h, id, para_no, pos, *others): kept grams of records (id, paragraphs, *others)."""
    others = "".join(f", {f.name} {f.dataType.simpleString()}" for f in records.schema.fields if f.name not in ("id", "paragraphs"))
    return records.where("id is not null").mapInArrow(_prints(gram, length), PRINTS + others)


class FingerprintIndex:
    """Immutable runs of fingerprints in a folder; every run is bucketed and sorted by hash alike.

    path: the folder, for an index that is kept; it is opened again where it holds one. Without a path the index lies
    in the shared folder and goes when the application ends.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, gram: int = GRAM, length: int = LENGTH, fan_out: int = FAN_OUT):
        self.spark, self.gram, self.length, self.fan_out, self.buckets = spark, gram, length, fan_out, buckets
        self.path = (path or folder(spark, "index")).rstrip("/")
        self.runs: list[tuple[str, int]] = []
        self.version = 0
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        listed = [f.getPath().getName() for f in self._fs.listStatus(self._at(self.path))] if self._fs.exists(self._at(self.path)) else []
        found = [int(n.removeprefix("runs-")) for n in listed if n.startswith("runs-")]
        if found:
            self.version = max(found)
            state = json.loads(spark.read.text(f"{self.path}/runs-{self.version}").first().value)
            self.runs = [tuple(r) for r in state["runs"]]
            self.buckets, self.gram, self.length = state["buckets"], state["gram"], state["length"]
            for name, _ in self.runs:
                spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (h BIGINT, id STRING, para_no INT, pos INT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")

    def _save(self) -> None:
        """Writes the list of runs as a new version, which shows only when it is whole; then the one before it goes."""
        state = json.dumps({"runs": self.runs, "buckets": self.buckets, "gram": self.gram, "length": self.length})
        out = self._fs.create(self._at(f"{self.path}/_runs"), True)
        out.write(bytearray(state.encode()))
        out.close()
        self.version += 1
        self._fs.rename(self._at(f"{self.path}/_runs"), self._at(f"{self.path}/runs-{self.version}"))
        remove(self.spark, f"{self.path}/runs-{self.version - 1}")

    def append(self, records: DataFrame) -> DataFrame:
        """Adds a batch (id, paragraphs) as a run; see add. Copies of a record in it do no harm."""
        prints = fingerprints(records.select("id", "paragraphs"), self.gram, self.length)
        return self.add(written(prints, "prints") if self.buckets is None else prints)

    def add(self, prints: DataFrame) -> DataFrame:
        """Adds fingerprints as a run. Returns (h): those that the batch shares with another record, in the history or in
        itself; `places` has where they stand."""
        history = list(self.runs)
        self._write(prints)
        new = self._held(self.runs[-1][0])
        for name, _ in history:
            old = self._held(name).select("h", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
            new = new.hint("merge").join(old, "h", "left").select("h", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi"))
        shared = written(new.where("lo <> hi").select("h"), "shared")
        if len(self.runs) > self.fan_out:
            self.compact()
        else:
            self._save()
        return shared

    def places(self, shared: DataFrame) -> DataFrame:
        """(h, id, para_no, pos): where fingerprints (h) stand, in all runs."""
        wanted = shared.select("h").distinct()
        return reduce(DataFrame.unionByName, [self.spark.table(name).join(wanted, "h", "left_semi") for name, _ in self.runs])

    def _held(self, run: str) -> DataFrame:
        """(h, lo, hi): least and greatest id that hold a fingerprint in a run."""
        return self.spark.table(run).groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))

    def _write(self, prints: DataFrame) -> None:
        if self.buckets is None:
            self.buckets = max(12, math.ceil(prints.count() * GROWTH / BUCKET_ROWS))
        name = f"run_{uuid.uuid4().hex}"
        prints.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").saveAsTable(name)
        self.runs.append((name, self._fs.getContentSummary(self._at(f"{self.path}/{name}")).getLength()))

    def compact(self) -> None:
        """Merges the smallest runs, as many as exceed half the fan-out, into one; the old ones and their files go."""
        self.runs.sort(key=lambda r: r[1])
        n = len(self.runs) - self.fan_out // 2
        old, self.runs = self.runs[:n], self.runs[n:]
        self._write(reduce(DataFrame.unionByName, [self.spark.table(r) for r, _ in old]))
        self._save()  # before the files go: a list of runs always names whole ones
        for name, _ in old:
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, f"{self.path}/{name}")


def _surroundings(gram: int, length: int):
    """The text within length - gram characters of each fingerprint: it holds all windows with the fingerprint."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, ps, marks in zip(*(batch[c].to_pylist() for c in ("id", "paragraphs", "marks"))):
                for m in marks:
                    p = ps[m["para_no"]] if ps and m["para_no"] < len(ps) else None
                    if p:
                        at = max(0, m["pos"] - reach)
                        rows.append((m["h"], i, m["para_no"], at, p[at : m["pos"] + length]))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in NEAR.split(", ")])

    return run


def _windows(near: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts; row, place and beginning of every window of them."""
    cp = codes("".join(near))
    size = np.array([len(t) for t in near])
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    n = np.maximum(0, size - length + 1)
    row = np.repeat(np.arange(len(near)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return cp, row, place, begin[row] + place


def _equal_windows(cp: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Are the windows that begin at a and b equal, character by character? a ascending. Neighbouring windows that are
    compared at the same distance are compared in one stretch."""
    new = np.concatenate(([True], (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)))
    at = np.flatnonzero(new)
    size = np.diff(np.concatenate((at, [len(a)]))) + length - 1
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    same = cp[np.repeat(a[at], size) + step] == cp[np.repeat(b[at], size) + step]
    whole = np.logical_and.reduceat(same, np.cumsum(size) - size)
    out = np.repeat(whole, np.diff(np.concatenate((at, [len(a)]))))
    for i in np.flatnonzero(~out):  # a collision of hashes somewhere in the stretch
        out[i] = (cp[a[i] : a[i] + length] == cp[b[i] : b[i] + length]).all()
    return out


def _stretches(row: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and ends of runs of consecutive windows, sorted by row and place."""
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)))
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(row)])) - 1
    return row[at], place[at], place[last] + length


def shared_windows(near: list[str], h: np.ndarray, doc: np.ndarray, length: int, hashed=None) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of the windows that two records (doc) of a group (h) hold, compared by their characters."""
    cp, row, place, at = _windows(near, length)
    if not len(row):
        return row, place
    key = (hashed or span_hash)(prefix_hash(cp), at, at + length) ^ mix(h[row])
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[row][order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    size = np.diff(np.concatenate((first, [len(k)])))
    both = np.repeat(np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first), size)
    like = np.empty(len(row), np.int64)  # the first window of the same hash
    like[order] = np.repeat(order[first], size)
    keep = np.sort(order[both])
    if not len(keep):
        return row[keep], place[keep]
    equal = _equal_windows(cp, at[keep], at[like[keep]], length)
    if not equal.all():  # windows of one hash differ: their groups are divided by the characters themselves
        torn = np.isin(like[keep], like[keep[~equal]])
        held: dict[tuple[int, bytes], set[int]] = {}
        name = lambda i: (int(h[row[i]]), cp[at[i] : at[i] + length].tobytes())
        for i in keep[torn]:
            held.setdefault(name(i), set()).add(int(doc[row[i]]))
        torn[torn] = [len(held[name(i)]) < 2 for i in keep[torn]]
        keep = keep[~torn]
    return row[keep], place[keep]


def _compare(length: int):
    """Windows that two records of a group share; input sorted by h."""

    def one(h, i, no, at, near) -> pa.RecordBatch:
        row, place = shared_windows(near, np.asarray(h, np.int64), np.unique(np.array(i, object), return_inverse=True)[1], length)
        if not len(row):
            return pa.RecordBatch.from_arrays([pa.array([], pa.string()), *(pa.array([], pa.int32()) for _ in range(3))], names=["id", "para_no", "start_pos", "end_pos"])
        r, a, b = _stretches(row, place, length)
        base = np.asarray(at, np.int64)[r]
        return pa.RecordBatch.from_arrays([pa.array(i, pa.string()).take(pa.array(r)), pa.array(np.asarray(no, np.int32)[r]), pa.array((base + a).astype(np.int32)), pa.array((base + b).astype(np.int32))], names=["id", "para_no", "start_pos", "end_pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(5)]
        for batch in batches:
            for col, more in zip(held, batch.columns):
                col += more.to_pylist()
            h = held[0]
            # whole groups only, a few thousand rows at a time
            while len(h) > 4_000 and h[0] != h[-1]:
                cut = 4_000
                while cut < len(h) and h[cut] == h[cut - 1]:
                    cut += 1
                if cut == len(h):
                    while h[cut - 1] == h[-1]:
                        cut -= 1
                yield one(*(c[:cut] for c in held))
                held = [c[cut:] for c in held]
                h = held[0]
        if held[0]:
            yield one(*held)

    return run


def _explode_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2_000):
                part = batch.slice(s, 2_000)
                cp, row, place, at = _windows(part["near"].to_pylist(), length)
                keys = [span_hash(prefix_hash(x), at, at + length) ^ mix(part["h"].to_numpy()[row]) for x in (cp, cp ^ np.uint32(0x5BD1E995))]
                take = pa.array(row)
                start = part["at"].to_numpy()[row] + place
                yield pa.RecordBatch.from_arrays([*(pa.array(k.view(np.int64)) for k in keys), part["id"].take(take), part["para_no"].take(take), pa.array(start.astype(np.int32))], names=["w", "w2", "id", "para_no", "start_pos"])

    return run


def shared_spans(articles: DataFrame, hits: DataFrame, gram: int = GRAM, length: int = LENGTH) -> DataFrame:
    """(id, para_no, start_pos, end_pos): maximal stretches covered by spans that another record has.

    articles: all records; hits: the places of what their batches share. Groups of more than HOT occurrences are compared
    by an aggregation over their windows, which combines on the map side and so stands any number of records with the
    same gram; there two hashes of 64 bits stand for a window.
    """
    places = written(hits.select("h", "id", "para_no", "pos").distinct(), "occurrences")
    hot = written(places.groupBy("h").count().where(F.col("count") > HOT).select("h", F.lit(True).alias("hot")), "hot")
    any_hot = not hot.isEmpty()
    flagged = places.join(hot, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False))) if any_hot else places.withColumn("hot", F.lit(False))
    marks = flagged.groupBy("id").agg(F.collect_list(F.struct("h", "para_no", "pos", "hot")).alias("marks"))
    here = distinct_articles(articles, ("paragraphs",)).join(marks, "id")
    gather = _surroundings(gram, length)
    cold = here.withColumn("marks", F.filter("marks", lambda m: ~m["hot"])) if any_hot else here
    parts = cold.mapInArrow(gather, NEAR).repartition("h").sortWithinPartitions("h").mapInArrow(_compare(length), FOUND)
    if any_hot:
        crowd = here.withColumn("marks", F.filter("marks", lambda m: m["hot"])).where(F.size("marks") > 0).mapInArrow(gather, NEAR)
        windows = written(crowd.mapInArrow(_explode_windows(length), "w long, w2 long, id string, para_no int, start_pos int"), "windows")
        both = windows.groupBy("w", "w2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("w", "w2")
        parts = parts.unionByName(windows.join(both, ["w", "w2"]).select("id", "para_no", "start_pos", (F.col("start_pos") + length).alias("end_pos")))
    return merged_intervals(parts)


def merged_intervals(spans: DataFrame) -> DataFrame:
    """Joins intervals of a paragraph that overlap or adjoin."""
    place = Window.partitionBy("id", "para_no").orderBy("start_pos", "end_pos")
    before = F.max("end_pos").over(place.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before >= F.col("start_pos"), 0).otherwise(1)
    marked = spans.distinct().withColumn("new", new).withColumn("k", F.sum("new").over(place))
    return marked.groupBy("id", "para_no", "k").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("k")


def spans_of_batches(articles: DataFrame) -> DataFrame:
    """shared_spans of articles that come to an index in BATCHES batches by year, undated ones with the last."""
    spark = articles.sparkSession
    years = sorted(r.y for r in articles.select(F.year("date").alias("y")).where("y is not null").distinct().collect())
    last = [int(part[-1]) for part in np.array_split(years, min(BATCHES, len(years)))] if years else []
    batch = F.lit(max(0, len(last) - 1))
    for k in reversed(range(len(last) - 1)):
        batch = F.when(F.year("date") <= last[k], k).otherwise(batch)
    path = folder(spark, "batches")
    fingerprints(articles.select("id", "paragraphs", batch.alias("batch"))).write.partitionBy("batch").parquet(path)
    prints = spark.read.schema(PRINTS + ", batch int").parquet(path)
    index = FingerprintIndex(spark)
    shared = [index.add(prints.where(F.col("batch") == k).drop("batch")) for k in range(max(1, len(last)))]
    return shared_spans(articles, index.places(reduce(DataFrame.unionByName, shared)))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of_batches(table(spark, sf_dir, "articles"))


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each article and how many of them stand in shared spans."""
    articles = table(spark, sf_dir, "articles")
    spans = spans_of_batches(articles).groupBy("id").agg(F.sum((F.col("end_pos") - F.col("start_pos")).cast("long")).alias("shared"))
    total = F.aggregate(F.coalesce("paragraphs", F.array().cast("array<string>")), F.lit(0).cast("long"), lambda a, p: a + F.coalesce(F.length(p), F.lit(0)))
    docs = distinct_articles(articles, ("paragraphs",)).select("id", total.alias("n_chars"))
    return docs.join(spans, "id", "left").select("id", "n_chars", F.coalesce("shared", F.lit(0).cast("long")).alias("shared"))


QUERIES = {"p6_found": p6_found, "p6_shares": p6_shares}

_WINDOWS = r"""d AS (SELECT id, any_value(paragraphs) AS ps FROM articles WHERE id IS NOT NULL GROUP BY id),
p AS (SELECT id, para_no, ps[para_no + 1] AS t FROM (SELECT id, ps, unnest(range(0, len(ps))) AS para_no FROM d)),
w AS (SELECT id, para_no, a, substr(t, a + 1, 160) AS s FROM (SELECT id, para_no, t, unnest(range(0, length(t) - 159)) AS a FROM p WHERE length(t) >= 160)),
k AS (SELECT s FROM w GROUP BY s HAVING min(id) <> max(id)),
f AS (SELECT id, para_no, a FROM w SEMI JOIN k USING (s)),
g AS (SELECT *, CASE WHEN a <= lag(a) OVER (PARTITION BY id, para_no ORDER BY a) + 160 THEN 0 ELSE 1 END AS n FROM f),
h AS (SELECT *, sum(n) OVER (PARTITION BY id, para_no ORDER BY a) AS r FROM g),
x AS (SELECT id, para_no::INTEGER AS para_no, min(a)::INTEGER AS start_pos, (max(a) + 160)::INTEGER AS end_pos FROM h GROUP BY id, para_no, r)"""
SQL = {
    "p6_found": f"WITH {_WINDOWS} SELECT id, para_no, start_pos, end_pos FROM x",
    "p6_shares": f"""WITH {_WINDOWS}, sh AS (SELECT id, sum(end_pos - start_pos)::BIGINT AS shared FROM x GROUP BY id)
SELECT id, coalesce(list_sum(list_transform(ps, lambda q: coalesce(length(q), 0))), 0)::BIGINT AS n_chars, coalesce(shared, 0) AS shared FROM d LEFT JOIN sh USING (id)""",
}
