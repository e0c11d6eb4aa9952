"""Named datasets: where their topics and corpora lie, what was read of them, and how it is read again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.storage import remove
from newsloom.sources import files


#: Form and file names of each corpus of tables.CORPORA.
FORMS = {"A": ("old", "{*NYT,*_ENG}"), "B": ("new", "*.xml"), "C": ("gz", "*.gz")}


def corpora(**roots: str) -> tuple[tuple[str, str, str], ...]:
    """(root, form, glob) of corpora by name: corpora(A="...", C="...")."""
    return tuple((root, *FORMS[name]) for name, root in roots.items())


@dataclass(frozen=True)
class Dataset:
    """topics: the topic file; corpora: (root, form, glob) of each corpus, form as files.read_articles; store: a folder
    for what was read."""

    name: str
    topics: str
    corpora: tuple[tuple[str, str, str], ...]
    store: str


class Registry:
    """Datasets by name. Nothing is read before it is asked for."""

    def __init__(self, *datasets: Dataset):
        self.by_name = {d.name: d for d in datasets}

    def __getitem__(self, name: str) -> Dataset:
        if name not in self.by_name:
            raise ValueError(f"unknown dataset {name}; known: {sorted(self.by_name)}")
        return self.by_name[name]

    def under(self, root: str) -> Registry:
        """The same datasets below another root."""
        at = lambda p: f"{root.rstrip('/')}/{p.lstrip('/')}"
        return Registry(*(replace(d, topics=at(d.topics), store=at(d.store), corpora=tuple((at(r), f, g) for r, f, g in d.corpora)) for d in self.by_name.values()))

    def topics(self, spark: SparkSession, name: str) -> DataFrame:
        """(topic_id, title, narrative, id, date, type, headline, paragraphs): the articles of each topic, read through
        the store. An article asked for and not found is an error."""
        d = self[name]
        return stored(spark, f"{d.store.rstrip('/')}/{name}", lambda: _articles_of_topics(spark, d))

    def regenerate(self, spark: SparkSession, *names: str) -> None:
        """Reads datasets anew, all of them without names."""
        for name in names or self.by_name:
            remove(spark, f"{self[name].store.rstrip('/')}/{name}")
            self.topics(spark, name)


def stored(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, where it is whole; else what build gives, written there first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _articles_of_topics(spark: SparkSession, d: Dataset) -> DataFrame:
    asked = files.read_topics(spark, d.topics)
    docset = asked.select("topic_id", "title", "narrative", F.explode("docset").alias("id")).distinct()
    found = all_articles(spark, d).join(docset, "id")
    missing = docset.join(found.select("id"), "id", "left_anti").select("id").limit(20).collect()
    if missing:
        raise ValueError(f"articles not found: {sorted(r.id for r in missing)}")
    return found


def all_articles(spark: SparkSession, d: Dataset, files_of_each: int | None = None) -> DataFrame:
    """Articles of all corpora of a dataset; files_of_each: of the first files of each corpus only, as a sample."""
    parts = []
    for root, form, glob in d.corpora:
        paths = [r.path for r in files.list_files(spark, root, glob).select("path").orderBy("path").limit(files_of_each).collect()] if files_of_each else root
        if paths:
            parts.append(files.read_articles(spark, paths, form, glob))
    if not parts:
        return spark.createDataFrame([], "id string, date date, type string, headline string, paragraphs array<string>")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def word_counts(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """(id, word, cnt), read through a store: what build gives is kept there, sorted by word so that a word's rows are
    in few files."""
    return stored(spark, path, lambda: build().select("id", "word", "cnt").repartitionByRange("word").sortWithinPartitions("word"))


def words_of(counts: DataFrame, article_id: str) -> dict[str, int]:
    """The counts of one article."""
    return {r.word: r.cnt for r in counts.where(F.col("id") == article_id).collect()}
