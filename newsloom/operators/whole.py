"""Work on whole topics: the sentences of a topic meet in one task, several topics in one Arrow batch.

What is shuffled is a sentence's list of words, once for each of its topics, instead of a row for each word. A topic of
more than MOST_WORDS words isn't held at once: it goes through the joins that spread its words over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most words of a topic that is held at once (about 100 bytes a word).
MOST_WORDS = 2_000_000
#: Most links of topics and articles that are sent to all tasks (about 130 bytes each).
MOST_LINKS = 1_000_000
#: Between the words of a list that is moved as one string.
MARK = "\x1f"
#: Rows that are gathered, topics in whole, before they are worked on.
ROWS = 8_000


def split(tokens: DataFrame, docset: DataFrame, most: int | None = None, squared: bool = False) -> tuple[DataFrame, list[str]]:
    """docset of the topics of at most `most` words (squared: pairs of words), and the ids of the larger ones, of which
    there are few, as each is large."""
    size = F.size("tokens").cast("long")
    each = tokens.groupBy("id").agg(F.sum(size * size if squared else size).alias("words"))
    sums = each.join(docset, "id").groupBy("topic_id").agg(F.sum("words").alias("words"))
    large = [r.topic_id for r in sums.where(F.col("words") > (most or MOST_WORDS)).select("topic_id").collect()]
    return (docset.where(~F.col("topic_id").isin(large)) if large else docset), large


def sentences_of(tokens: DataFrame, docset: DataFrame, *more: Column) -> DataFrame:
    """(topic_id, id, sent_index, tokens, *more): the sentences of each topic, words as one string, which takes less room
    than a list. Up to MOST_LINKS links are sent to the sentences, so these are moved to their topics only."""
    rows = tokens.select("id", "sent_index", F.array_join("tokens", MARK).alias("tokens"), *more)
    return rows.join(F.broadcast(docset) if docset.limit(MOST_LINKS + 1).count() <= MOST_LINKS else docset, "id")


def by_topic(rows: DataFrame) -> DataFrame:
    """Rows (topic_id, id, sent_index, ...), all of a topic in one task and beside each other. The number of tasks is
    fixed, since what a batch becomes is larger than what is shuffled."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "topic_id").sortWithinPartitions("topic_id", "id", "sent_index")


def apply(rows: DataFrame, run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run over tables of whole topics."""

    def batches(given):
        for table in whole(given):
            yield from run(table)

    return by_topic(rows).mapInArrow(batches, schema)


def whole(batches, least: int = ROWS) -> Iterator[pa.Table]:
    """Tables of whole topics of batches in the order of topics, of `least` rows and what completes the last topic."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        last = batch.column("topic_id")[batch.num_rows - 1]
        if n >= least and held[0].column("topic_id")[0] != last:
            table = pa.Table.from_batches(held)
            end = pc.index(table["topic_id"], last).as_py()
            yield table.slice(0, end).combine_chunks()
            rest = table.slice(end)
            held, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def one(column) -> pa.Array:
    """A column of a table as one array."""
    if isinstance(column, pa.ChunkedArray):
        return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def starts(keys: pa.Array) -> np.ndarray:
    """Numbers 0, 1, ... of runs of equal values of a column without nulls."""
    n = len(keys)
    return np.concatenate([[0], np.cumsum(pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False))]).astype(np.int64)


def best_first(table: pa.Table) -> Iterator[list[int]]:
    """Of each topic of a table (topic_id, id, sent_index, score) of whole topics: its rows by falling score; ties go to the
    earlier article and sentence."""
    ids, at, score = (table[c].to_pylist() for c in ("id", "sent_index", "score"))
    topic = starts(one(table["topic_id"]))
    for places in np.split(np.arange(len(topic)), np.flatnonzero(topic[1:] != topic[:-1]) + 1):
        yield sorted(places.tolist(), key=lambda k: (-score[k], ids[k], at[k]))


class Words:
    """The words of a table's rows: row (of the table) and code of each, in order; names: the word of a code."""

    def __init__(self, table: pa.Table, column: str = "tokens"):
        lists = one(table[column])
        if pa.types.is_string(lists.type):
            lists = pc.split_pattern(pc.replace_with_mask(lists, pc.equal(lists, ""), pa.scalar(None, lists.type)), MARK)
        self.size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        self.names = coded.dictionary
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(lists)), self.size)
