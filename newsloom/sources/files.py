"""Readers of the wire formats and writers of summaries, evaluation settings and term statistics."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources.tables import article_date

#: Entities of the old files and their characters.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&UR;", ""), ("&LR;", ""), ("&QL;", ""), ("&QR;", ""), ("&QC;", ""), ("&MD;", "-"), ("&AMP;", "&")]

TOPIC_SCHEMA = "_id string, title string, narrative string, docsetA struct<doc: array<struct<_VALUE: string, _id: string>>>"
NEW_SCHEMA = "_id string, _type string, HEADLINE string, TEXT struct<_VALUE: string, P: array<string>>"


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """Topic file -> (topic_id, title, narrative, docset)."""
    df = spark.read.format("xml").option("rowTag", "topic").schema(TOPIC_SCHEMA).load(path)
    blank = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))
    return df.select(F.col("_id").alias("topic_id"), blank("title").alias("title"), blank("narrative").alias("narrative"), F.transform("docsetA.doc", lambda d: d["_id"]).alias("docset"))


def _article(article_id: Column, kind: Column, headline: Column, own: Column, paragraphs: Column) -> list[Column]:
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    parts = F.transform(F.filter(F.coalesce(paragraphs, F.array().cast("array<string>")), lambda p: p.isNotNull()), strip)
    head = strip(F.coalesce(own, F.lit("")))
    return [article_id.alias("id"), article_date(article_id).alias("date"), kind.alias("type"), F.nullif(strip(headline), F.lit("")).alias("headline"), F.when(head != "", F.concat(F.array(head), parts)).otherwise(parts).alias("paragraphs")]


def read_new_articles(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """Well-formed files, one DOC element an article."""
    df = spark.read.format("xml").option("rowTag", "DOC").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).schema(NEW_SCHEMA).load(path)
    return df.select(*_article(F.col("_id"), F.col("_type"), F.col("HEADLINE"), F.col("TEXT._VALUE"), F.col("TEXT.P")))


def _records(spark: SparkSession, path: str | list[str], glob: str, start: str) -> DataFrame:
    """(doc): the text of each record, cut at its end tag, not by a parser; entities replaced."""
    text = F.col("value")
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, lineSep="</DOC>").where(F.contains(text, F.lit(start)))
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return raw.select(text.alias("doc"))


def _tag(name: str, column: str = "doc") -> Column:
    """The text of an element; another element, or the end, closes one that isn't closed."""
    return F.regexp_extract(column, rf"(?s)<{name}>(.*?)(?:</{name}>|<(?:HEADLINE|TEXT|/BODY|DATELINE)>|$)", 1)


def _paragraphs() -> tuple[Column, Column]:
    """What TEXT holds before its first P, and its P elements."""
    text = F.regexp_extract("doc", r"(?s)<TEXT>(.*?)(?:</TEXT>|$)", 1)
    return F.regexp_extract(text, r"(?s)^(.*?)(?:<P>|$)", 1), F.regexp_extract_all(text, F.lit(r"(?s)<P>(.*?)(?=</P>|<P>|$)"), 1)


def read_recovered_articles(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """Files of the newer form, plain or gzip, of which records may be malformed: what can be read of each is kept. A
    gzip file is one task; store them small."""
    own, paras = _paragraphs()
    mark = r'<DOC\s[^>]*?\b{}\s*=\s*"([^"]*)"'
    article_id = F.regexp_extract("doc", mark.format("id"), 1)
    kind = F.nullif(F.regexp_extract("doc", mark.format("type"), 1), F.lit(""))
    return _records(spark, path, glob, "<DOC").where(article_id != "").select(*_article(article_id, kind, _tag("HEADLINE"), own, paras))


def read_old_articles(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """Old files, whose markup need not be well formed; a record is known by its DOCNO."""
    own, paras = _paragraphs()
    kind = F.nullif(F.trim(F.regexp_replace(_tag("DOCTYPE"), r"\s+", " ")), F.lit(""))
    article_id = F.trim(F.regexp_replace(_tag("DOCNO"), r"\s+", " "))
    return _records(spark, path, glob, "<DOCNO>").where(article_id != "").select(*_article(article_id, kind, _tag("HEADLINE"), own, paras))


def read_articles(spark: SparkSession, path: str | list[str], form: str, glob: str = "*") -> DataFrame:
    """form: old, new or gz."""
    return {"old": read_old_articles, "new": read_new_articles, "gz": read_recovered_articles}[form](spark, path, glob)


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files below root whose name matches a glob, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")


def summary_name(topic_id: Column) -> Column:
    return F.concat(F.substring(topic_id, 1, 5), F.lit("-A.M.100."), F.substring(topic_id, 6, 100), F.lit(".1"))


def write_summaries(lines: DataFrame, path: str) -> None:
    """(topic_id, line_no, sentence) -> one directory a summary, one sentence a line, written by the executors."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "sentence"))), lambda s: s["sentence"]), "\n")
    lines.groupBy(summary_name(F.col("topic_id")).alias("name")).agg(body.alias("value")).write.partitionBy("name").mode("overwrite").text(path)


def rouge_pairs(peers: DataFrame, models: DataFrame) -> DataFrame:
    """(peer, model): models whose name contains the peer's name without its last two characters, by a join on the
    topic part that both names begin with; the substring is tested after it."""
    key = lambda c: F.substring_index(c, ".", 1)
    p = peers.select(F.col("name").alias("peer"), key(F.col("name")).alias("k"))
    m = models.select(F.col("name").alias("model"), key(F.col("name")).alias("k"))
    return p.join(m, "k").where(F.expr("contains(model, substring(peer, 1, length(peer) - 2))")).select("peer", "model")


def rouge_config(pairs: DataFrame, peer_root: str, model_root: str, path: str) -> None:
    """Evaluation settings as text, one EVAL element a peer, written by the executors."""
    ref = F.concat(F.lit('<M ID="'), F.substring_index("model", ".", -1), F.lit('">'), F.col("model"), F.lit("</M>"))
    refs = F.array_join(F.array_sort(F.collect_set(ref)), "")
    row = F.concat(F.lit('<EVAL ID="'), F.col("peer"), F.lit(f'"><PEER-ROOT>{peer_root}</PEER-ROOT><MODEL-ROOT>{model_root}</MODEL-ROOT><INPUT-FORMAT TYPE="SPL"/><PEERS><P ID="'), F.substring_index("peer", ".", -1), F.lit('">'), F.col("peer"), F.lit("</P></PEERS><MODELS>"), F.col("refs"), F.lit("</MODELS></EVAL>"))
    pairs.groupBy("peer").agg(refs.alias("refs")).select(row.alias("value")).write.mode("overwrite").text(path)


def write_idf(idf: DataFrame, default: float, path: str) -> None:
    """Term table as parquet, its default beside it."""
    idf.write.mode("overwrite").parquet(os.path.join(path, "idf"))
    idf.sparkSession.createDataFrame([(json.dumps({"default_value": default}),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "meta"))


def read_idf(spark: SparkSession, path: str) -> tuple[DataFrame, float] | None:
    """What write_idf wrote, None where it is absent."""
    try:
        meta = spark.read.text(os.path.join(path, "meta")).first()
        return spark.read.parquet(os.path.join(path, "idf")), json.loads(meta.value)["default_value"]
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise

