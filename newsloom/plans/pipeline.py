"""Stages composed: articles of topics to summaries. Every stage is a DataFrame of the same keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.config import Config, LexRankConfig
from newsloom.functions import text as T
from newsloom.operators import lexrank, ngram, order, realize, segment, stats
from newsloom.operators import topics as subtopics
from newsloom.operators import vectors as wordvectors
from newsloom.operators.storage import written
from newsloom.sources import tables

#: Most stop words taken into expressions.
MOST_STOP_WORDS = 5_000
#: Most selected sentences of which hashes are sent to all tasks (about 30 bytes each).
MOST_HASHES = 3_000_000


def stop_words(spark: SparkSession, sf_dir: str) -> list[str]:
    rows = tables.table(spark, sf_dir, "common_words").select("word").where("word is not null").distinct().orderBy("word").limit(MOST_STOP_WORDS + 1).collect()
    if len(rows) > MOST_STOP_WORDS:
        raise ValueError(f"more than {MOST_STOP_WORDS} stop words")
    return [r.word for r in rows]


def query_tokens(topics: DataFrame, stop: list[str]) -> DataFrame:
    """(topic_id, query_tokens): accepted tokens of the narrative, else of the title."""
    keep = F.filter(T.tokens(T.clean_text(F.coalesce("narrative", "title"))), lambda t: ~t.isin(stop))
    return topics.where("coalesce(narrative, title) is not null").select("topic_id", keep.alias("query_tokens"))


def span_tokens(topics: DataFrame, stop: list[str]) -> DataFrame:
    """(topic_id, tokens) of each title and narrative."""
    keep = lambda c: F.filter(T.tokens(T.clean_text(F.col(c))), lambda t: ~t.isin(stop))
    parts = [topics.where(F.col(c).isNotNull()).select("topic_id", keep(c).alias("tokens")) for c in ("title", "narrative")]
    return parts[0].unionByName(parts[1])


def tokens(spark: SparkSession, sf_dir: str, headlines: bool = False) -> DataFrame:
    """(id, date, para_idx, sent_index, text, n_words, tokens) of all sentences, with headlines also of these, as
    sent_index -1. Kept in the shared folder: every score reads it several times, a few columns at a time."""
    articles = tables.articles(spark, sf_dir)
    sents = segment.sentences(articles)
    if headlines:
        sents = sents.unionByName(headline_rows(articles))
    return written(segment.sentence_tokens(sents, stop_words(spark, sf_dir)), "tokens")


def headline_rows(articles: DataFrame) -> DataFrame:
    """The cleaned headlines as rows of sentences, with sent_index -1."""
    none = F.lit(-1).cast("long")
    heads = articles.where("headline is not null").select("id", "date", none.alias("para_idx"), none.alias("sent_index"), T.clean_text(F.col("headline")).alias("text")).where("text <> ''")
    return heads.withColumn("n_words", T.words_in(F.col("text")))


def term_idf(tok: DataFrame) -> DataFrame:
    """(word, df, idf) over the sentences of tok, without its headlines."""
    return stats.idf_of_lists(tok.where("sent_index >= 0"))


def graph_vectors(tok: DataFrame, docset: DataFrame, idf: DataFrame, config: LexRankConfig, vectors: DataFrame | None) -> DataFrame:
    """(topic_id, id, sent_index, word, w): unit vectors by the similarity that the settings name."""
    if config.similarity == "tf_idf":
        return lexrank.unit_vectors(tok, docset, idf)
    if config.similarity not in ("tf_idf_vector", "word_vector"):
        raise ValueError(f"unknown similarity {config.similarity}")
    if vectors is None:
        raise ValueError("this similarity needs a table of word vectors")
    means = wordvectors.mean_vectors(tok.select("id", "sent_index", "tokens"), ["id", "sent_index"], vectors, idf if config.similarity == "tf_idf_vector" else None)
    return wordvectors.as_words(means, docset)


def graph_bias(tok: DataFrame, docset: DataFrame, queries: DataFrame, idf: DataFrame, config: LexRankConfig, vectors: DataFrame | None) -> DataFrame | None:
    """(topic_id, id, sent_index, raw, bias) towards the query, None without."""
    if not config.bias:
        return None
    if config.bias_by == "ir":
        return lexrank.query_bias(tok, docset, queries, idf)
    if vectors is None:
        raise ValueError("this bias needs a table of word vectors")
    means = wordvectors.mean_vectors(tok.select("id", "sent_index", "tokens"), ["id", "sent_index"], vectors, idf)
    asked = wordvectors.mean_vectors(queries.select("topic_id", F.col("query_tokens").alias("tokens")), ["topic_id"], vectors, idf)
    return wordvectors.query_similarity(means, docset, asked)


def _select_lexrank(tok, docset, queries, entities, config, vectors) -> DataFrame:
    idf, graph = written(term_idf(tok), "idf"), config.lexrank
    if graph.similarity == "tf_idf" and not graph.threshold and (not graph.bias or graph.bias_by == "ir"):
        return lexrank.lexrank_of_tokens(tok, docset, idf, queries if graph.bias else None, graph.damping, graph.rounds)
    bias = graph_bias(tok, docset, queries, idf, config.lexrank, vectors)
    x = graph_vectors(tok, docset, idf, config.lexrank, vectors)
    if config.lexrank.threshold:
        return lexrank.threshold_lexrank(x, bias, config.lexrank.threshold, config.lexrank.damping, config.lexrank.rounds)
    return lexrank.lexrank(x, bias, config.lexrank.damping, config.lexrank.rounds)


def _select_ngram(tok, docset, queries, entities, config, vectors) -> DataFrame:
    bias = lexrank.query_bias(tok, docset, queries, term_idf(tok)) if config.ngram.bias_weight else None
    flagged = tok.withColumn("removable", ngram.removable(F.col("text"), F.col("n_words"), config.ngram.length_limit))
    return ngram.select_stateful(flagged, docset, config.ngram, queries, entities, bias)


def _select_lda(tok, docset, queries, entities, config, vectors) -> DataFrame:
    return subtopics.select_by_subtopic(tok, docset, subtopics.topic_words(tok, docset))


#: Methods of selection by name: tokens, docset, queries, headline entities, settings, word vectors -> scored sentences.
METHODS = {"select_lexrank": _select_lexrank, "select_ngram": _select_ngram, "select_lda": _select_lda}


def with_texts(top: DataFrame, tok: DataFrame, most: int | None = None) -> DataFrame:
    """(topic_id, id, date, sent_index, score, text) of the sentences of top; kept. Sentences that aren't among them are
    dropped where they are read, by hashes that are sent to all tasks, so their texts aren't moved; with more than
    MOST_HASHES all texts are."""
    top = written(top.select("topic_id", "id", "sent_index", "score"), "top")
    texts, h = tok.select("id", "date", "sent_index", "text"), F.xxhash64("id", "sent_index")
    most = MOST_HASHES if most is None else most
    if top.limit(most + 1).count() <= most:
        texts = texts.withColumn("_h", h).join(F.broadcast(top.select(h.alias("_h")).distinct()), "_h", "left_semi").drop("_h")
    return written(top.join(texts, ["id", "sent_index"]).select("topic_id", "id", "date", "sent_index", "score", "text"), "candidates")


def select(tok: DataFrame, docset: DataFrame, topics: DataFrame, stop: list[str], config: Config, entities: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """The best sentences of each topic: (topic_id, id, sent_index, score, text). Kept, since all steps after it are few
    rows and read it several times."""
    if config.method not in METHODS:
        raise ValueError(f"unknown method {config.method}")
    scored = METHODS[config.method](tok, docset, query_tokens(topics, stop), entities, config, vectors)
    top = ngram.best(scored, ["topic_id"], config.max_sentences)
    return with_texts(top, tok)


def summarize(spark: SparkSession, sf_dir: str, config: Config | None = None, vectors: DataFrame | None = None, similarity=None, succession=None) -> DataFrame:
    """(topic_id, line_no, sentence) of all topics. vectors: (word, vector), for similarities of meaning; similarity and
    succession: functions of two sentences, such as a model's (remove_redundant, order_rows)."""
    config = config or Config()
    stop, docset = stop_words(spark, sf_dir), tables.docset(spark, sf_dir)
    tok = tokens(spark, sf_dir, headlines=config.method == "select_lexrank")
    entities = ngram.headline_entities(tables.articles(spark, sf_dir)) if config.ngram.headline_weight else None
    picked = select(tok, docset, tables.topics(spark, sf_dir), stop, config, entities, vectors)
    add = None
    if vectors is not None:

        def add(df: DataFrame) -> DataFrame:
            key = ["topic_id", "id", "sent_index"]
            means = wordvectors.mean_vectors(segment.sentence_tokens(df.select(*key, "text"), stop).drop("text"), key, vectors)
            return df.join(means, key, "left")

    final = realize.realize(picked.drop("date"), config.realization, similarity, add)
    dated = final.join(picked.select("topic_id", "id", "sent_index", "date"), ["topic_id", "id", "sent_index"])
    return order.ordered(add(dated) if add else dated, config.ordering, succession)
