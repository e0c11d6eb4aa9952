"""Graph ranking of sentences. The similarity matrix is never built: cosines factor through the words.

With unit vectors x_i over words, row sums are x_i . (sum of x_j) and one step of the power iteration is
p'_j = (1 - d) * x_j . (sum of p_i / rowsum_i * x_i) + d * bias_j: two aggregations, whatever the topic's size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators import whole
from newsloom.operators.storage import cut

KEY = ["topic_id", "id", "sent_index"]
#: Rounds after which an iteration that doesn't converge ends; with damping 0.4 a few dozen are enough.
MOST_ROUNDS = 200


def unit_vectors(tokens: DataFrame, docset: DataFrame, idf_table: DataFrame) -> DataFrame:
    """(topic_id, id, sent_index, word, w): tf * idf, scaled to length one; computed per article, then joined."""
    tf = tokens.select("id", "sent_index", F.explode("tokens").alias("word")).groupBy("id", "sent_index", "word").agg(F.count("*").alias("tf"))
    raw = tf.join(idf_table.select("word", "idf"), "word").select("id", "sent_index", "word", (F.col("tf") * F.col("idf")).alias("w")).where("w > 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id", "sent_index")))
    return raw.withColumn("w", F.col("w") / norm).join(docset, "id").select(*KEY, "word", "w")


def row_sums(vectors: DataFrame) -> DataFrame:
    """(topic_id, id, sent_index, total): the sum of a sentence's similarities to all sentences of its topic."""
    sums = vectors.groupBy("topic_id", "word").agg(F.sum("w").alias("c"))
    return vectors.join(sums, ["topic_id", "word"]).groupBy(*KEY).agg(F.sum(F.col("w") * F.col("c")).alias("total"))


def adjacency(vectors: DataFrame, threshold: float) -> DataFrame:
    """(topic_id, a, b), a <= b: sentences (id, sent_index) of a topic more similar than the threshold, a sentence itself
    among them. The pairs are the result here; only sentences that share a word meet, and their products are summed on
    the map side before pairs are shuffled."""
    side = lambda s: vectors.select("topic_id", "word", F.struct("id", "sent_index").alias(s), F.col("w").alias(f"w{s}"))
    pairs = side("a").join(side("b"), ["topic_id", "word"]).where("a <= b").groupBy("topic_id", "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))
    return pairs.where(F.col("similarity") > threshold).select("topic_id", "a", "b")


def threshold_lexrank(vectors: DataFrame, bias: DataFrame | None, threshold: float, damping: float = 0.4, rounds: int | None = None) -> DataFrame:
    """lexrank over 0/1 adjacency by a threshold: a sentence hands its score in equal parts to those it is linked with,
    itself among them."""
    half = adjacency(vectors, threshold)
    both = half.unionByName(half.where("a <> b").select("topic_id", F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(both.select("topic_id", F.col("a.id").alias("id"), F.col("a.sent_index").alias("sent_index"), F.col("b.id").alias("to_id"), F.col("b.sent_index").alias("to_index")))
    nodes = edges.groupBy(*KEY).agg(F.count("*").cast("double").alias("total"))
    nodes = cut(_starts(nodes, bias))

    def spread(nodes: DataFrame) -> DataFrame:
        out = edges.join(nodes.select(*KEY, (F.col("p") / F.col("total")).alias("f")), KEY)
        return out.groupBy("topic_id", F.col("to_id").alias("id"), F.col("to_index").alias("sent_index")).agg(F.sum("f").alias("q"))

    return _iterate(nodes, spread, damping, rounds)


def query_bias(tokens: DataFrame, docset: DataFrame, queries: DataFrame, idf_table: DataFrame) -> DataFrame:
    """(topic_id, id, sent_index, raw, bias): sum over the query's words of (q + 1) (s + 1) idf, as a share of the
    topic's sum. queries: (topic_id, query_tokens)."""
    q = queries.select("topic_id", F.explode("query_tokens").alias("word")).groupBy("topic_id", "word").agg(F.count("*").alias("q")).join(idf_table.select("word", "idf"), "word")
    base = q.groupBy("topic_id").agg(F.sum((F.col("q") + 1) * F.col("idf")).alias("base"))
    tf = tokens.select("id", "sent_index", F.explode("tokens").alias("word")).groupBy("id", "sent_index", "word").agg(F.count("*").alias("s"))
    more = tf.join(docset, "id").join(q, ["topic_id", "word"]).groupBy(*KEY).agg(F.sum((F.col("q") + 1) * F.col("s") * F.col("idf")).alias("more"))
    all_sents = tokens.select("id", "sent_index").join(docset, "id").join(base, "topic_id")
    raw = all_sents.join(more, KEY, "left").select(*KEY, (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("raw"))
    return raw.withColumn("bias", F.try_divide(F.col("raw"), F.sum("raw").over(Window.partitionBy("topic_id"))))


def _starts(nodes: DataFrame, bias: DataFrame | None) -> DataFrame:
    """Adds b, the bias as a share of the topic, and p, the uniform start."""
    nodes = nodes.withColumn("n", F.count("*").over(Window.partitionBy("topic_id")))
    if bias is not None:
        both = nodes.join(bias.select(*KEY, "bias"), KEY)
        nodes = both.withColumn("b", F.col("bias") / F.sum("bias").over(Window.partitionBy("topic_id"))).drop("bias")
    else:
        nodes = nodes.withColumn("b", 1 / F.col("n"))
    return nodes.select(*KEY, "total", "b", (1 / F.col("n")).alias("p"))


def _iterate(nodes: DataFrame, spread: Callable[[DataFrame], DataFrame], damping: float, rounds: int | None) -> DataFrame:
    """The damped iteration; lineage is cut by checkpoint() into the cluster's shared folder. A sentence that is given
    nothing keeps its bias."""
    for _ in range(rounds) if rounds is not None else range(MOST_ROUNDS):
        step = nodes.withColumnRenamed("p", "before").join(spread(nodes), KEY, "left")
        nodes = cut(step.select(*KEY, "total", "b", "before", ((1 - damping) * F.coalesce("q", F.lit(0.0)) + damping * F.col("b")).alias("p")))
        moved = F.abs(F.col("p") - F.col("before")) > 1e-8 + 1e-5 * F.abs("p")
        if rounds is None and nodes.where(moved).isEmpty():
            break
        nodes = nodes.drop("before")
    return nodes.select(*KEY, F.col("p").alias("score"))


def lexrank(vectors: DataFrame, bias: DataFrame | None, damping: float = 0.4, rounds: int | None = 8) -> DataFrame:
    """(topic_id, id, sent_index, score): `rounds` steps of the damped iteration from the uniform start, None: until no
    score moves by more than 1e-5 of itself and 1e-8. bias: column bias by sentence, None for uniform."""
    nodes = cut(_starts(row_sums(vectors), bias))
    edges = cut(vectors.join(nodes.select(*KEY), KEY, "left_semi"))

    def spread(nodes: DataFrame) -> DataFrame:
        c = edges.join(nodes.select(*KEY, F.try_divide("p", "total").alias("f")), KEY).groupBy("topic_id", "word").agg(F.sum(F.col("f") * F.col("w")).alias("c"))
        return edges.join(c, ["topic_id", "word"]).groupBy(*KEY).agg(F.sum(F.col("w") * F.col("c")).alias("q"))

    return _iterate(nodes, spread, damping, rounds)


#: Most words of a term table that is sent to all tasks.
MOST_TERMS = 500_000
QUERY = -2  # sent_index of a topic's query among its rows


def raw_bias(topic: np.ndarray, asked: np.ndarray, row: np.ndarray, column: np.ndarray, tf: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """raw of query_bias of each row (0 of queries), and the topics whose query has a word of the term table. topic, asked:
    of each row, its topic and if it is a query; row, column, tf, term: of each word of a row that the term table knows,
    the row, the number of topic and word, how often it is there and its idf."""
    q = asked[row]
    of = topic[row[q]]
    base = np.bincount(of, weights=(tf[q] + 1) * term[q], minlength=topic[-1] + 1)
    times = np.zeros(column.max() + 1 if len(column) else 0)
    times[column[q]] = tf[q] + 1
    raw = np.where(asked, 0.0, base[topic] + np.bincount(row, weights=times[column] * tf * term, minlength=len(topic)))
    return raw, np.bincount(of, minlength=topic[-1] + 1) > 0


def rank_topics(table: pa.Table, idf: dict[str, float], bias: bool, damping: float, rounds: int | None) -> pa.Table:
    """lexrank of unit_vectors with query_bias over a table (topic_id, id, sent_index, tokens) of whole topics in order,
    in which a row of sent_index QUERY is a topic's query."""
    words, topic = whole.Words(table), whole.starts(whole.one(table["topic_id"]))
    n_topics, n_rows = int(topic[-1]) + 1, len(topic)
    asked = table["sent_index"].to_numpy() == QUERY
    value = np.array([idf.get(w, np.nan) for w in words.names.to_pylist()], float)
    per_topic = lambda x, of=topic: np.bincount(of, weights=x, minlength=n_topics)
    width = max(len(value), 1)
    held, tf = np.unique(words.row * width + words.code, return_counts=True)
    row, code = held // width, held % width
    known = ~np.isnan(value[code])
    row, code, tf, term = row[known], code[known], tf[known], value[code[known]]
    q = asked[row]
    keys, column = np.unique(topic[row] * width + code, return_inverse=True)  # words of topics
    column = column.reshape(-1)
    there = np.ones(n_topics, bool)
    if bias:
        raw, there = raw_bias(topic, asked, row, column, tf, term)
    keep = ~q & (tf * term > 0)
    row, column, w = row[keep], column[keep], (tf * term)[keep]
    w = w / np.sqrt(np.bincount(row, weights=w * w, minlength=n_rows))[row]
    spread = lambda f: np.bincount(row, weights=w * np.bincount(column, weights=w * f[row], minlength=len(keys))[column], minlength=n_rows)
    node = np.zeros(n_rows, bool)
    node[row] = True
    total = np.where(node, spread(np.ones(n_rows)), np.nan)
    n = per_topic(node)
    with np.errstate(divide="ignore", invalid="ignore"):
        b = raw / per_topic(raw)[topic] if bias else 1 / n[topic]
        if bias:
            b = b / per_topic(np.where(node, b, 0.0))[topic]
        p, moving = 1 / n[topic], there & (n > 0)
        for _ in range(rounds if rounds is not None else MOST_ROUNDS):
            f = np.where(node & (total != 0), p / total, 0.0)
            new = np.where(moving[topic], (1 - damping) * spread(f) + damping * b, p)
            moved = node & (np.abs(new - p) > 1e-8 + 1e-5 * np.abs(new))
            p = new
            if rounds is None:
                moving = moving & (per_topic(moved) > 0)
                if not moving.any():
                    break
    out = node & there[topic]
    return table.select(["topic_id", "id", "sent_index"]).append_column("score", pa.array(p, mask=np.isnan(p))).filter(pa.array(out))


def term_table(idf_table: DataFrame) -> pa.Table | None:
    """(word, idf), to be sent to all tasks; None where it is too large for that."""
    terms = idf_table.select("word", "idf").limit(MOST_TERMS + 1).toArrow()
    return terms if terms.num_rows <= MOST_TERMS else None


def idf_of(sent) -> dict[str, float]:
    """The words of a broadcast term table, made once in a worker."""
    if not hasattr(sent, "_idf"):
        sent._idf = dict(zip(sent.value["word"].to_pylist(), sent.value["idf"].to_pylist()))
    return sent._idf


def query_rows(queries: DataFrame, docset: DataFrame) -> DataFrame:
    """(topic_id, id, sent_index, tokens): a topic's query as a row beside its sentences."""
    asked = queries.join(docset.select("topic_id").distinct(), "topic_id", "left_semi")
    return asked.select("topic_id", F.lit("").alias("id"), F.lit(QUERY).cast("long").alias("sent_index"), F.array_join("query_tokens", whole.MARK).alias("tokens"))


def lexrank_of_tokens(tokens: DataFrame, docset: DataFrame, idf_table: DataFrame, queries: DataFrame | None, damping: float = 0.4, rounds: int | None = 8) -> DataFrame:
    """lexrank(unit_vectors, query_bias of queries): topics are ranked in whole, and each until none of its own scores
    moves. Large topics, and all where the term table is large, are ranked by joins over all tasks."""
    terms = term_table(idf_table)
    by_joins = lambda d: lexrank(unit_vectors(tokens, d, idf_table), query_bias(tokens, d, queries, idf_table) if queries is not None else None, damping, rounds)
    if terms is None:
        return by_joins(docset)
    small, large = whole.split(tokens, docset)
    rows = whole.sentences_of(tokens, small).select(*KEY, "tokens")
    if queries is not None:
        rows = rows.unionByName(query_rows(queries, small))
    sent = tokens.sparkSession.sparkContext.broadcast(terms)
    biased = queries is not None

    def run(table: pa.Table):
        yield from rank_topics(table, idf_of(sent), biased, damping, rounds).to_batches()

    out = whole.apply(rows, run, "topic_id string, id string, sent_index long, score double")
    return out.unionByName(by_joins(docset.where(F.col("topic_id").isin(large)))) if large else out
