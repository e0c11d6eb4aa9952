"""Lines that return in many documents of one source, by templates from fixed-depth token trees.

Lines of a source go down a tree of fixed depth: number of tokens, then the first tokens (numbers in them as a
wildcard). A leaf holds templates, token lists in which places that differ became wildcards; at least half of a
template's places are tokens. Tasks build trees of their own lines; the trees are merged leaf by leaf; a template covers
the documents whose lines it matches, and the lines of templates that cover many documents are what is removed.

Lines are the same if equal after trimming, making runs of white space one blank, and lower-casing. Defined
results: null ids, null and blank elements hold no lines (blank lines are counted in line_no); ids that come again
count once; a document counts once for a line however often it has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import distinct_articles, table, written

#: Levels of tokens below the token count.
DEPTH = 6
#: Share of equal tokens from which a line joins a template.
ALIKE = 0.5
WILD = "<*>"


def source_of(article_id: F.Column) -> F.Column:
    """The journal in an article id: up to the first "_", else up to the first digit of the part before the dot."""
    head = F.substring_index(article_id, ".", 1)
    return F.when(F.contains(head, F.lit("_")), F.substring_index(head, "_", 1)).otherwise(F.regexp_extract(head, "^([^0-9]*)", 1))


def lines_of(articles: DataFrame) -> DataFrame:
    """(journal, id, para_no, line_no, line): every line that isn't blank, normalised."""
    paras = distinct_articles(articles, ("paragraphs",)).select("id", F.posexplode("paragraphs").alias("para_no", "p")).where("p is not null")
    lines = paras.select("id", "para_no", F.posexplode(F.split("p", "\n")).alias("line_no", "raw"))
    norm = F.lower(F.trim(F.regexp_replace("raw", "[ \t\r\n]+", " ")))
    return lines.select(source_of(F.col("id")).alias("journal"), "id", "para_no", "line_no", norm.alias("line")).where("line <> ''")


def leaf_of() -> F.Column:
    """Hash of a line's path through the tree: source, token count, first tokens."""
    n = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit("")))
    head = F.regexp_replace(F.substring_index("line", " ", DEPTH), "[0-9]+", "#")
    return F.xxhash64("journal", n, head)


TEMPLATES = "journal string, leaf long, template array<string>, n long"


class Leaf:
    """Templates of one leaf as rows of token numbers; 0 is the wildcard."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {WILD: 0}
        self.rows = np.zeros((0, 0), np.int32)
        self.n: list[int] = []

    def add(self, tokens: list[str], n: int) -> None:
        """Joins a line, or a template, of n occurrences to the most similar template, or begins one."""
        row = np.array([self.number.setdefault(t, len(self.number)) for t in tokens], np.int32)
        k = len(self.n)
        if k:
            same = ((self.rows[:k] == row) & (row > 0)).sum(1)
            best = int(same.argmax())
            if same[best] >= ALIKE * len(row):
                self.rows[best][self.rows[best] != row] = 0
                self.n[best] += n
                return
        if k == len(self.rows):
            more = np.zeros((max(4, 2 * k), len(row)), np.int32)
            if k:
                more[:k] = self.rows
            self.rows = more
        self.rows[k] = row
        self.n.append(n)

    def templates(self) -> list[tuple[list[str], int]]:
        words = list(self.number)
        return [([words[t] for t in row], n) for row, n in zip(self.rows.tolist(), self.n)]


def _leaf_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Builds the leaves of a task from lines, or merges those of templates; input sorted by leaf, one leaf is held."""
    key, leaf = None, Leaf()

    def out() -> pa.RecordBatch:
        rows = leaf.templates() if key else []
        return pa.RecordBatch.from_arrays([pa.array([key[0] for _ in rows], pa.string()), pa.array([key[1] for _ in rows], pa.int64()), pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.int64())], names=["journal", "leaf", "template", "n"])

    for batch in batches:
        done = []
        for journal, at, tokens, n in zip(*(batch[c].to_pylist() for c in ("journal", "leaf", "template", "n"))):
            if (journal, at) != key:
                if key:
                    done.append(out())
                key, leaf = (journal, at), Leaf()
            leaf.add(tokens, n)
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
    yield out()


def full_leaves(lines: DataFrame, least: int) -> DataFrame:
    """Lines of leaves with at least `least` lines: no other leaf can hold a line of as many documents."""
    lines = lines.withColumn("leaf", leaf_of())
    leaves = lines.groupBy("journal", "leaf").count().where(F.col("count") >= least).select("journal", "leaf")
    return written(lines.join(written(leaves, "leaves"), ["journal", "leaf"], "left_semi"), "lines")


def line_templates(lines: DataFrame, least: int = 1) -> DataFrame:
    """(journal, leaf, template, n) of lines with leaves; n: occurrences of the lines that made it, at least `least`.
    Tasks first reduce their own lines to templates, so a leaf that holds much of the collection reaches the merge as a
    few templates of each task. A line of `least` documents is among those that made a template of as many."""
    each = lines.groupBy("journal", "leaf", "line").agg(F.count("*").alias("n")).select("journal", "leaf", F.split("line", " ").alias("template"), "n")
    local = each.sortWithinPartitions("journal", "leaf", "template").mapInArrow(_leaf_trees, TEMPLATES)
    return local.repartition("journal", "leaf").sortWithinPartitions("journal", "leaf", "template").mapInArrow(_leaf_trees, TEMPLATES).where(F.col("n") >= least)


def covered_lines(lines: DataFrame, least: int) -> DataFrame:
    """Lines that a template of at least `least` documents matches; adds template and documents."""
    tokens = F.split("line", " ")
    hit = F.forall(F.zip_with("template", tokens, lambda t, x: (t == WILD) | (t == x)), lambda x: x)
    matched = lines.join(line_templates(lines, least).drop("n"), ["journal", "leaf"]).where(hit)
    cover = matched.select("journal", "leaf", "template", "id").distinct().groupBy("journal", "leaf", "template").agg(F.count("*").alias("documents")).where(F.col("documents") >= least)
    return matched.join(cover, ["journal", "leaf", "template"])


def repeated_lines(articles: DataFrame, least: int = 8) -> DataFrame:
    """(id, para_no, line_no, journal, line): each occurrence of a line held by at least `least` articles of its
    journal. Candidates come from the templates, equal lines among them are then counted."""
    lines = full_leaves(lines_of(articles), least)
    found = covered_lines(lines, least).select("journal", "line", "id", "para_no", "line_no").distinct()
    counts = found.select("journal", "line", "id").distinct().groupBy("journal", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("journal", "line")
    return found.join(counts, ["journal", "line"], "left_semi")


def without_covered_lines(articles: DataFrame, least: int = 8) -> DataFrame:
    """(id, paragraphs): articles without the lines of templates that cover at least `least` articles of their journal,
    equal or not; paragraphs that keep no line are null."""
    covered = covered_lines(full_leaves(lines_of(articles), least), least)
    gone = covered.groupBy("id").agg(F.collect_set(F.struct("para_no", "line_no")).alias("gone"))
    docs = distinct_articles(articles, ("paragraphs",)).join(gone, "id", "left")

    def clean(p: F.Column, i: F.Column) -> F.Column:
        keep = F.filter(F.split(p, "\n"), lambda x, j: ~F.exists("gone", lambda g: (g["para_no"] == i) & (g["line_no"] == j)))
        return F.when(F.size(keep) > 0, F.array_join(keep, "\n"))

    return docs.select("id", F.when(F.col("gone").isNull(), F.col("paragraphs")).otherwise(F.transform("paragraphs", clean)).alias("paragraphs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "articles")).select("id", "para_no", "line_no")


def p5_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates that cover at least 8 articles of a journal."""
    lines = full_leaves(lines_of(table(spark, sf_dir, "articles")), 8)
    return covered_lines(lines, 8).groupBy("journal", F.array_join("template", " ").alias("template"), "documents").agg(F.count("*").alias("n_lines"))


def p5_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_covered_lines(table(spark, sf_dir, "articles"))


QUERIES = {"p5_found": p5_found, "p5_templates": p5_templates, "p5_cleaned": p5_cleaned}

SQL = {
    "p5_found": r"""
WITH d AS (SELECT id, any_value(paragraphs) AS ps FROM articles WHERE id IS NOT NULL GROUP BY id),
p AS (SELECT id, unnest(range(0, len(ps))) AS para_no, ps FROM d),
l AS (SELECT id, para_no, string_split(ps[para_no + 1], chr(10)) AS ls FROM p WHERE ps[para_no + 1] IS NOT NULL),
x AS (SELECT id, para_no, ls, unnest(range(0, len(ls))) AS line_no FROM l),
n AS (SELECT id, CASE WHEN contains(split_part(id, '.', 1), '_') THEN split_part(id, '_', 1) ELSE regexp_extract(split_part(id, '.', 1), '^([^0-9]*)', 1) END AS journal,
 para_no, line_no, lower(trim(regexp_replace(ls[line_no + 1], '[ \t\r\n]+', ' ', 'g'))) AS line FROM x),
k AS (SELECT journal, line FROM n WHERE line <> '' GROUP BY journal, line HAVING count(DISTINCT id) >= 8)
SELECT id, para_no::INTEGER AS para_no, line_no::INTEGER AS line_no FROM n WHERE (journal, line) IN (SELECT (journal, line) FROM k)""",
}
