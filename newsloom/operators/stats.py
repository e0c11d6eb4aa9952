"""Corpus statistics: term and document frequencies, inverse document frequency, local vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import whole
from newsloom.operators.storage import written


def _words(articles: DataFrame, stop_words: list[str], remove_quotes: bool = True) -> DataFrame:
    """(id, words): tokens worth counting of each article, cleaned as one text; no shuffle. Other columns stay."""
    text = F.array_join(F.filter(F.coalesce("paragraphs", F.array().cast("array<string>")), lambda p: p.isNotNull()), " ")
    bare = F.transform(F.split(T.clean_text(text, remove_quotes), " "), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return articles.withColumn("words", F.filter(bare, lambda w: T.countworthy(w, stop_words)))


def article_terms(articles: DataFrame, stop_words: list[str], remove_quotes: bool = True) -> DataFrame:
    """(id, word, cnt) of tokens worth counting, from the whole article cleaned as one text. One shuffle."""
    return _words(articles, stop_words, remove_quotes).select("id", F.explode("words").alias("word")).groupBy("id", "word").agg(F.count("*").alias("cnt"))


def vocabulary(terms: DataFrame) -> DataFrame:
    """(word, number): words in their order, numbered from 0. The order is that of a sorted table's files, so no task
    sees all words."""
    words = written(terms.select("word").where("word is not null").distinct().orderBy("word"), "vocabulary")
    placed = words.select("word", F.input_file_name().alias("file"), F.col("_metadata.row_index").alias("row"))
    sizes = placed.groupBy("file").agg(F.min("word").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of files
    starts = sizes.select(F.col("file").alias("at"), before.alias("before"))
    return placed.join(F.broadcast(starts), F.col("file") == F.col("at")).select("word", (F.col("row") + F.col("before")).alias("number"))


def document_frequencies(articles: DataFrame, stop_words: list[str], group: list[str] | None = None) -> DataFrame:
    """(*group, word, df, n): articles that hold a word, and n of all articles with a counted word, by one aggregation:
    each such article also counts for the word "", which no article has. Kept, since n is looked up in it."""
    group = group or []
    words = F.when(F.size("words") > 0, F.concat(F.array_distinct("words"), F.array(F.lit(""))))
    each = _words(articles, stop_words).select(*group, F.explode(words).alias("word"))
    counts = written(each.groupBy(*group, "word").agg(F.count("*").alias("df")), "frequencies")
    n = counts.where("word = ''").select(*group, F.col("df").alias("n"))
    counts = counts.where("word <> ''")
    return counts.join(F.broadcast(n), group) if group else counts.crossJoin(F.broadcast(n))  # one row a group


def idf_of(frequencies: DataFrame, merge: str = "last", group: list[str] | None = None) -> DataFrame:
    """(*group, word, df, idf): ln(n / df) by lower-cased word of document_frequencies. Spellings that differ in case:
    merge="last" keeps the one that sorts last, "sum" adds them up."""
    group = group or []
    low = frequencies.groupBy(*group, F.lower("word").alias("word")).agg((F.max_by("df", "word") if merge == "last" else F.sum("df")).alias("df"), F.max("n").alias("n"))
    return low.select(*group, "word", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def idf(terms: DataFrame, merge: str = "last") -> DataFrame:
    """(word, df, idf) of a table of terms (id, word), each once an article: one more aggregation for n."""
    each = terms.groupBy("id").agg(F.collect_list("word").alias("words"))
    counts = written(each.select(F.explode(F.concat("words", F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("df")), "frequencies")
    n = counts.where("word = ''").select(F.col("df").alias("n"))
    return idf_of(counts.where("word <> ''").crossJoin(F.broadcast(n)), merge)  # one row


def idf_of_lists(tokens: DataFrame, merge: str = "last") -> DataFrame:
    """idf of the words of (id, ..., tokens), several rows an article: lists are put together by article, so a word is no
    row before it is counted on the map side. They are moved as strings."""
    words = F.array_distinct(F.split(F.array_join(F.collect_list(F.array_join("tokens", whole.MARK)), whole.MARK), whole.MARK))
    each = tokens.where(F.size("tokens") > 0).groupBy("id").agg(words.alias("words"))
    counts = written(each.select(F.explode(F.concat("words", F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("df")), "frequencies")
    n = counts.where("word = ''").select(F.col("df").alias("n"))
    return idf_of(counts.where("word <> ''").crossJoin(F.broadcast(n)), merge)  # one row


def default_idf(n: int, smooth: bool = True) -> float:
    """What words outside the table get."""
    import math

    return math.log(n + 1) if smooth else 0.0


def local_vocabulary(tokens: DataFrame, docset: DataFrame, idf_table: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(topic_id, word, cnt) of words that the term table knows, over the sentences and headlines of a topic's articles
    (tokens) and its title and narrative (spans: topic_id, tokens); articles are counted before topics are joined."""
    words = tokens.select("id", F.explode("tokens").alias("word")).groupBy("id", "word").agg(F.count("*").alias("cnt"))
    counts = words.join(docset, "id").select("topic_id", "word", "cnt")
    if spans is not None:
        asked = docset.select("topic_id").distinct()
        counts = counts.unionByName(spans.join(asked, "topic_id", "left_semi").select("topic_id", F.explode("tokens").alias("word"), F.lit(1).cast("long").alias("cnt")))
    return counts.groupBy("topic_id", "word").agg(F.sum("cnt").alias("cnt")).join(idf_table.select("word"), "word", "left_semi").select("topic_id", "word", "cnt")


def mean_idf(tokens: DataFrame, idf_table: DataFrame) -> DataFrame:
    """(id, sent_index, mean_idf) over the tokens of each sentence that the table knows."""
    words = tokens.select("id", "sent_index", F.explode("tokens").alias("word"))
    return words.join(idf_table.select("word", "idf"), "word").groupBy("id", "sent_index").agg(F.avg("idf").alias("mean_idf"))
