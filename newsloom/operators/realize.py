"""From candidates to summaries: filters within a word budget, rewrites, redundancy, packing.

Candidates are (topic_id, id, sent_index, score, text), at most a few dozen a topic after selection.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.config import WORD_QUOTA, RealizationConfig
from newsloom.functions import text as T
from newsloom.operators import whole
from newsloom.operators.storage import written


def _rank() -> Window:
    return Window.partitionBy("topic_id").orderBy(F.col("score").desc(), "id", "sent_index")


def total_words() -> Column:
    return F.sum(T.words_in(F.col("text"))).over(Window.partitionBy("topic_id"))


def removal_step(candidates: DataFrame, match: Column, quota: int = WORD_QUOTA) -> DataFrame:
    """Drops matches, best first, until the words above the quota are dropped; later matches stay."""
    words = F.when(F.col("_match"), F.col("_words")).otherwise(0)
    before = F.coalesce(F.sum(words).over(_rank().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = candidates.withColumn("_words", T.words_in(F.col("text"))).withColumn("_match", F.coalesce(match, F.lit(False)))
    df = df.withColumn("_drop", F.col("_match") & (before < F.sum("_words").over(Window.partitionBy("topic_id")) - quota))
    return df.where("not _drop").drop("_words", "_match", "_drop")


def question(text: Column) -> Column:
    return F.contains(text, F.lit("?"))


def fragment(text: Column) -> Column:
    return ~F.right(text, F.lit(1)).isin(".", ";")


def full_match(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")") if patterns else F.lit(False)


def rewrite_over_quota(candidates: DataFrame, change, quota: int = WORD_QUOTA) -> DataFrame:
    """Rewrites all candidates of topics that hold more words than the quota."""
    return candidates.withColumn("text", F.when(total_words() > quota, change(F.col("text"))).otherwise(F.col("text")))


def overlap(a: Column, b: Column) -> Column:
    """Words of both, each once, by the number of words of b: not symmetric."""
    wa, wb = T.overlap_words(a), T.overlap_words(b)
    return F.size(F.array_intersect(wa, wb)) / F.size(wb)


def overlaps(candidates: DataFrame) -> DataFrame:
    """(topic_id, a, a_index, b, b_index, overlap) of different candidates of a topic (a few dozen)."""
    a = candidates.select("topic_id", F.col("id").alias("a"), F.col("sent_index").alias("a_index"), F.col("text").alias("ta"))
    b = candidates.select("topic_id", F.col("id").alias("b"), F.col("sent_index").alias("b_index"), F.col("text").alias("tb"))
    pairs = a.join(b, "topic_id").where("a <> b or a_index <> b_index")
    return pairs.select("topic_id", "a", "a_index", "b", "b_index", overlap(F.col("ta"), F.col("tb")).alias("overlap"))


def _words(text: str) -> list[str]:
    return text[:-1].lower().replace("-", " ").split(" ")


def _cosine(a, b) -> float:
    """Of two rows' unit vectors; 0 where one has none."""
    return float(sum(x * y for x, y in zip(a["vector"], b["vector"]))) if a["vector"] is not None and b["vector"] is not None else 0.0


def remove_redundant(candidates: DataFrame, threshold: float = 0.74, quota: int = WORD_QUOTA, similarity=None, similar: float = 0.95) -> DataFrame:
    """Adds kept: greedy, best first; a sentence removes any other that it covers, until the words above the quota
    are gone. A topic has a few dozen rows; many topics are a call, but with a similarity each is one.

    similarity: a function of two rows (text, and vector where candidates have that column) -> how alike they are, or
    None; a sentence also removes those more alike than `similar`. Vectors (of unit length) are compared by default."""
    names = ["topic_id", "id", "sent_index", "score", "text"]
    more = ["vector"] if "vector" in candidates.columns else []
    alike = similarity or (_cosine if more else None)

    if alike is None:
        return whole.apply(candidates.select(*names), lambda table: _judged(table, threshold, quota).to_batches(), JUDGED)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id", "sent_index"], ascending=[False, True, True]).reset_index(drop=True)
        rows["kept"] = greedy(list(rows["text"]), threshold, quota, lambda i, j: (alike(rows.iloc[i], rows.iloc[j]) or 0.0) > similar)
        return rows[[*names, "kept"]]

    return candidates.select(*names, *more).groupBy("topic_id").applyInPandas(run, JUDGED)


JUDGED = "topic_id string, id string, sent_index long, score double, text string, kept boolean"


def greedy(texts: list[str], threshold: float, quota: int, alike=None) -> list[bool]:
    """Which of a topic's texts, best first, are kept. alike: if one place also removes another."""
    n = [len(t.split()) for t in texts]
    spare, gone, dropped = sum(n) - quota, set(), 0
    lists = [_words(t) for t in texts]
    sets = [set(w) for w in lists]
    for i in range(len(texts)):
        if dropped >= spare:
            break
        if i in gone:
            continue
        for j in range(len(texts)):
            if dropped >= spare:
                break
            if j != i and j not in gone and (len(sets[i] & sets[j]) / len(lists[j]) > threshold or alike is not None and alike(i, j)):
                gone.add(j)
                dropped += n[j]
    return [k not in gone for k in range(len(texts))]


def _judged(table: pa.Table, threshold: float, quota: int) -> pa.Table:
    """remove_redundant of a table of whole topics."""
    texts, kept = table["text"].to_pylist(), [True] * table.num_rows
    for places in whole.best_first(table):
        for k, keep in zip(places, greedy([texts[k] for k in places], threshold, quota)):
            kept[k] = keep
    return table.append_column("kept", pa.array(kept, pa.bool_()))


def pack(candidates: DataFrame, quota: int = WORD_QUOTA) -> DataFrame:
    """First fit in the order of scores: a sentence that doesn't fit is skipped, later ones may fit. Adds packed."""
    item = F.struct((-F.col("score")).alias("neg"), F.col("id"), F.col("sent_index"), F.col("score"), F.col("text"), T.words_in(F.col("text")).alias("n"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("fits"))

    def step(acc: Column, x: Column) -> Column:
        ok = acc["used"] + x["n"] <= quota
        return F.struct(F.when(ok, acc["used"] + x["n"]).otherwise(acc["used"]).alias("used"), F.concat(acc["fits"], F.array(ok)).alias("fits"))

    rows = candidates.groupBy("topic_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = rows.withColumn("fits", F.aggregate("items", start, step, lambda acc: acc["fits"]))
    flat = rows.select("topic_id", F.explode(F.arrays_zip("items", "fits")).alias("z"))
    return flat.select("topic_id", "z.items.id", "z.items.sent_index", "z.items.score", "z.items.text", F.col("z.fits").alias("packed"))


def extra(packed: DataFrame, removed: DataFrame, threshold: float = 0.84, quota: int = WORD_QUOTA) -> DataFrame:
    """The best removed sentence of each topic that fits into what the packed ones leave and isn't covered by them."""
    chosen = packed.where("packed")
    used = chosen.groupBy("topic_id").agg(F.sum(T.words_in(F.col("text"))).alias("used"))
    fit = removed.join(used, "topic_id", "left").where(T.words_in(F.col("text")) <= quota - F.coalesce("used", F.lit(0))).drop("used")
    a = chosen.select("topic_id", F.col("text").alias("ta"))
    covered = fit.join(a, "topic_id").where(overlap(F.col("ta"), F.col("text")) > threshold).select("topic_id", "id", "sent_index")
    free = fit.join(covered, ["topic_id", "id", "sent_index"], "left_anti")
    return free.withColumn("k", F.row_number().over(_rank())).where("k = 1").select("topic_id", "id", "sent_index", "score", "text")


def steps_of(config: RealizationConfig) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """The filters and rewrites before redundancy is judged, by name, in their order."""
    text = F.col("text")
    drop = lambda match: lambda df: removal_step(df, match)
    steps = [
        (config.remove_quotes, "quotes", drop(T.contains_quote(text))),
        (config.remove_questions, "questions", drop(question(text))),
        (config.remove_pronoun_openings, "pronouns", drop(T.opens_with_pronoun(text))),
        (config.remove_subjectless, "subjectless", drop(T.lacks_subject(text))),
        (bool(config.remove_full_spans_that_match), "spans", drop(full_match(text, config.remove_full_spans_that_match))),
        (True, "fragments", drop(fragment(text))),
        (config.remove_sentence_initial_terms, "openers", lambda df: rewrite_over_quota(df, T.trim_sentence)),
        (config.remove_appositives, "appositives", lambda df: rewrite_over_quota(df, T.remove_appositives)),
        (config.remove_attributions, "attributions", lambda df: df.withColumn("text", T.remove_attribution(text))),
        (bool(config.remove_subspans_that_match), "subspans", lambda df: rewrite_over_quota(df, lambda t: T.rewrite(t, [(p, "") for p in config.remove_subspans_that_match]))),
    ]
    return [(name, step) for on, name, step in steps if on]


def realize(candidates: DataFrame, config: RealizationConfig, similarity=None, vectors=None) -> DataFrame:
    """All steps in their order: (topic_id, id, sent_index, score, text) of the sentences that make up the summary.
    similarity: as in remove_redundant; vectors: a function that adds a column vector to candidates. What was judged is
    kept, as three steps read it."""
    df = candidates
    for _, step in steps_of(config):
        df = step(df)
    df = df.where("trim(text) <> ''")
    judged = written(remove_redundant(vectors(df) if vectors else df, config.overlap_threshold, similarity=similarity, similar=config.similarity_threshold), "judged")
    kept, removed = judged.where("kept").drop("kept"), judged.where("not kept").drop("kept")
    kept = removal_step(kept, T.words_in(F.col("text")) <= config.minimum_sentence_length)
    kept = kept.withColumn("text", T.clean_up(F.col("text")))
    packed = pack(kept)
    return packed.where("packed").drop("packed").unionByName(extra(packed, removed, config.extra_overlap))


def changes(candidates: DataFrame, config: RealizationConfig) -> DataFrame:
    """(topic_id, place, step, sentences, words) after each filter and rewrite, place 0 before all: what they did."""
    df, parts = candidates, []
    for place, (name, step) in enumerate([("start", lambda d: d), *steps_of(config)]):
        df = step(df)
        parts.append(df.groupBy("topic_id").agg(F.count("*").alias("sentences"), F.sum(T.words_in(F.col("text"))).alias("words")).select("topic_id", F.lit(place).cast("long").alias("place"), F.lit(name).alias("step"), "sentences", "words"))
    return reduce(DataFrame.unionByName, parts)
