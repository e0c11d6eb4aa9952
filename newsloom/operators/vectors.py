"""Word vectors as an optional table (word, vector): means of sentences, their cosines, a bias towards the query.

A cosine of unit vectors is a sum over dimensions, so dense vectors take the place of words in the graph ranking
(`lexrank.row_sums`, `lexrank.lexrank` with the dimension as word) and the matrix isn't built there either.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.operators import whole
from newsloom.operators.storage import written

KEY = ["topic_id", "id", "sent_index"]
#: Most words, and numbers of different vectors, that are sent to all tasks.
MOST_TERMS, MOST_NUMBERS = 500_000, 8_000_000
#: Words of which vectors are held at once.
CHUNK = 50_000


def hashed_vectors(words: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(word, vector): for collections without word vectors, a vector of a table (vec_id 0 to n - 1, embedding) by the
    word's hash. Words are distinct before the join, and the table is read as it is."""
    n = embeddings.agg(F.count("*").alias("n"))
    head = F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 8), 16, 10).cast("long")
    picked = words.select("word").distinct().crossJoin(F.broadcast(n)).select("word", (head % F.col("n")).alias("vec_id"))  # one row
    return picked.join(embeddings.select("vec_id", "embedding"), "vec_id").select("word", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def mean_vectors(items: DataFrame, key: list[str], vectors: DataFrame, idf_table: DataFrame | None = None) -> DataFrame:
    """(*key, vector): the mean vector of each item's words that have one, scaled to length one; with a term table weighted
    by idf, and over its words only. items: (*key, tokens). An item without such words, or of length zero, has no row."""
    words = items.select(*key, F.explode("tokens").alias("word")).groupBy(*key, "word").agg(F.count("*").cast("double").alias("n"))
    if idf_table is not None:
        words = words.join(idf_table.select("word", "idf"), "word").withColumn("n", F.col("n") * F.col("idf"))
    each = words.join(vectors.select("word", "vector"), "word").where("n > 0").select(*key, "n", array_to_vector("vector").alias("v"))
    sums = each.groupBy(*key).agg(vector_to_array(Summarizer.sum(F.col("v"), F.col("n"))).alias("v"))  # scaling cancels a mean's divisor
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return sums.withColumn("norm", norm).where("norm > 0").select(*key, F.transform("v", lambda x: x / F.col("norm")).alias("vector"))


def as_words(means: DataFrame, docset: DataFrame) -> DataFrame:
    """(topic_id, id, sent_index, word, w) for the graph ranking, a row for each dimension, from means by (id, sent_index)."""
    return means.join(docset, "id").select(*KEY, F.posexplode("vector").alias("word", "w")).withColumn("word", F.col("word").cast("string"))


def row_sums(means: DataFrame, docset: DataFrame) -> DataFrame:
    """(topic_id, id, sent_index, total): the sum of a sentence's cosines with all of its topic: its product with the sum
    of their vectors."""
    each = means.join(docset, "id").select(*KEY, "vector")
    sums = each.groupBy("topic_id").agg(vector_to_array(Summarizer.sum(array_to_vector("vector"))).alias("s"))
    return each.join(sums, "topic_id").select(*KEY, cosine(F.col("vector"), F.col("s")).alias("total"))


def sent_table(vectors: DataFrame, idf_table: DataFrame | None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray] | None:
    """Words, the number of each one's vector and its weight, and the different vectors, which words may share; None where
    they are too many to be sent, or a word has several vectors."""
    each = vectors.select("word", "vector").where("word is not null")
    each = each.withColumn("idf", F.lit(1.0)) if idf_table is None else each.join(idf_table.select("word", "idf"), "word").where("idf > 0")
    shared = written(each.groupBy("vector").agg(F.collect_list(F.struct("word", "idf")).alias("words")), "vectors")
    n = shared.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    if n[0] > MOST_TERMS or n[1] > MOST_NUMBERS:
        return None
    table = shared.toArrow().combine_chunks()
    lists, rows = whole.one(table["words"]), whole.one(table["vector"])
    words = lists.flatten().field("word")
    if len(words.unique()) < len(words):
        return None
    matrix = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1))
    return words, np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().field("idf").to_numpy(zero_copy_only=False), matrix


def topic_row_sums(table: pa.Table, words: pa.Array, number: np.ndarray, weight: np.ndarray, matrix: np.ndarray) -> pa.Table:
    """row_sums of mean_vectors of a table (topic_id, id, sent_index, tokens) of whole topics in order."""
    held, topic = whole.Words(table), whole.starts(whole.one(table["topic_id"]))
    place = pc.fill_null(pc.index_in(held.names, value_set=words), -1).to_numpy(zero_copy_only=False)[held.code]
    row, place = held.row[place >= 0], place[place >= 0]
    means = np.zeros((len(topic), matrix.shape[1]))
    for at in range(0, len(row), CHUNK):
        r, p = row[at : at + CHUNK], place[at : at + CHUNK]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        means[r[first]] += np.add.reduceat(matrix[number[p]] * weight[p][:, None], first, axis=0)
    norm = np.sqrt((means * means).sum(1))
    there = norm > 0
    means[there] /= norm[there][:, None]
    first = np.flatnonzero(np.concatenate([[True], topic[1:] != topic[:-1]]))
    total = np.einsum("ij,ij->i", means, np.add.reduceat(means, first, axis=0)[topic])
    return table.select(KEY).append_column("total", pa.array(total)).filter(pa.array(there))


def row_sums_of_tokens(tokens: DataFrame, docset: DataFrame, vectors: DataFrame, idf_table: DataFrame | None = None) -> DataFrame:
    """row_sums of mean_vectors: topics in whole, with the vectors of words sent to all tasks, so that no vector of a word
    or a sentence is moved. Large topics, and all where the vectors are too many, go through joins."""
    by_joins = lambda d: row_sums(mean_vectors(tokens.join(d.select("id").distinct(), "id", "left_semi"), ["id", "sent_index"], vectors, idf_table), d)
    table = sent_table(vectors, idf_table)
    if table is None:
        return by_joins(docset)
    small, large = whole.split(tokens, docset)
    sent = tokens.sparkSession.sparkContext.broadcast(table)

    def run(rows: pa.Table):
        yield from topic_row_sums(rows, *sent.value).to_batches()

    out = whole.apply(whole.sentences_of(tokens, small), run, "topic_id string, id string, sent_index long, total double")
    return out.unionByName(by_joins(docset.where(F.col("topic_id").isin(large)))) if large else out


def query_similarity(means: DataFrame, docset: DataFrame, query_means: DataFrame) -> DataFrame:
    """(topic_id, id, sent_index, raw, bias): cosine of each sentence with its topic's query, and as a share of the
    topic's sum. query_means: (topic_id, vector)."""
    q = query_means.select("topic_id", F.col("vector").alias("q"))
    raw = means.join(docset, "id").join(q, "topic_id").select(*KEY, cosine(F.col("vector"), F.col("q")).alias("raw"))
    return raw.withColumn("bias", F.try_divide("raw", F.sum("raw").over(Window.partitionBy("topic_id"))))


def cosine(a: Column, b: Column) -> Column:
    """Product of two vectors, the cosine of unit vectors; 0 where one is absent."""
    return F.coalesce(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of a parquet table of word vectors."""
    return spark.read.parquet(path).select("word", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
