"""N-gram distributions of topics and the sentence scores built on them."""

from __future__ import annotations

import copy
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.config import NgramConfig
from newsloom.functions import text as T
from newsloom.operators import lexrank, whole


def grams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by blanks."""
    if n == 1:
        return tokens
    last = F.size(tokens) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def pairs(tokens: Column) -> Column:
    """All ordered pairs of different tokens of a sentence, with multiplicity."""
    return F.flatten(F.transform(tokens, lambda a: F.transform(F.filter(tokens, lambda b: b != a), lambda b: F.concat(b, F.lit(" "), a))))


def probabilities(tokens: DataFrame, docset: DataFrame, n: int) -> DataFrame:
    """(topic_id, gram, cnt, p). The headline of an article adds one to the unigrams' total and takes one from the
    trigrams'; sentences shorter than n lower the total. Articles are reduced before topics are joined."""
    counts = tokens.select("id", F.explode(grams(F.col("tokens"), n)).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("cnt"))
    sizes = tokens.groupBy("id").agg(F.sum(F.size("tokens") - (n - 1)).alias("total"))
    totals = sizes.join(docset, "id").groupBy("topic_id").agg((F.sum("total") + EXTRA[n] * F.count("*")).alias("total"))
    per_topic = counts.join(docset, "id").groupBy("topic_id", "gram").agg(F.sum("cnt").alias("cnt"))
    return per_topic.join(totals, "topic_id").select("topic_id", "gram", "cnt", F.try_divide(F.col("cnt").cast("double"), F.col("total")).alias("p"))


def pair_probabilities(tokens: DataFrame, docset: DataFrame) -> DataFrame:
    """(topic_id, gram, cnt, p) of pairs. Topics are counted in whole, large ones by joins."""
    small, large = whole.split(tokens, docset, squared=True)

    def run(table: pa.Table):
        words, topic = whole.Words(table), whole.starts(whole.one(table["topic_id"]))
        unigram, _ = _distinct(topic[words.row] * len(words.names) + words.code)
        if not len(unigram):
            return
        code, of = np.zeros(unigram.max() + 1, np.int64), np.zeros(unigram.max() + 1, np.int64)
        code[unigram], of[unigram] = words.code, topic[words.row]
        _, a, b, met = _pairs_of(words, topic, unigram)
        keys, number = np.unique(a * len(code) + b, return_inverse=True)
        cnt = np.bincount(number.reshape(-1), weights=met)
        a, b = keys // len(code), keys % len(code)
        total = np.bincount(of[a], weights=2 * cnt, minlength=topic[-1] + 1)[of[a]]
        first = np.flatnonzero(np.concatenate([[True], topic[1:] != topic[:-1]]))
        ids = whole.one(table["topic_id"]).take(pa.array(first)).take(pa.array(of[a]))
        share, cnt = pa.array(cnt / total), pa.array(cnt.astype(np.int64))
        one, two = words.names.take(pa.array(code[a])), words.names.take(pa.array(code[b]))
        for gram in (pc.binary_join_element_wise(one, two, " "), pc.binary_join_element_wise(two, one, " ")):
            yield from pa.Table.from_arrays([ids, gram, cnt, share], ["topic_id", "gram", "cnt", "p"]).to_batches(100_000)

    out = whole.apply(whole.sentences_of(tokens, small), run, "topic_id string, gram string, cnt long, p double")
    return out.unionByName(pair_probabilities_by_joins(tokens, docset.where(F.col("topic_id").isin(large)))) if large else out


def pair_probabilities_by_joins(tokens: DataFrame, docset: DataFrame) -> DataFrame:
    """pair_probabilities over all tasks."""
    counts = tokens.select("id", F.explode(pairs(F.col("tokens"))).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("cnt"))
    per_topic = counts.join(docset, "id").groupBy("topic_id", "gram").agg(F.sum("cnt").alias("cnt"))
    totals = per_topic.groupBy("topic_id").agg(F.sum("cnt").alias("total"))
    return per_topic.join(totals, "topic_id").select("topic_id", "gram", "cnt", (F.col("cnt") / F.col("total")).alias("p"))


def gram_scores(tokens: DataFrame, docset: DataFrame, probs: DataFrame, items: Column, name: str, per_item: bool = False) -> DataFrame:
    """(topic_id, id, sent_index, name): sum of p over a sentence's items, by its tokens (or by its items)."""
    exploded = tokens.select("id", "sent_index", F.explode(items).alias("gram")).groupBy("id", "sent_index", "gram").agg(F.count("*").alias("k"))
    sums = exploded.join(docset, "id").join(probs.select("topic_id", "gram", "p"), ["topic_id", "gram"]).groupBy("topic_id", "id", "sent_index").agg(F.sum(F.col("p") * F.col("k")).alias("s"))
    sizes = tokens.select("id", "sent_index", F.size(items if per_item else F.col("tokens")).alias("size")).where("size > 0")
    return sums.join(sizes, ["id", "sent_index"]).select("topic_id", "id", "sent_index", (F.col("s") / F.col("size")).alias(name))


#: What a headline adds to the totals of n-grams.
EXTRA = {1: 1, 2: 0, 3: -1}


def tagged_grams(tokens: Column, sizes: list[int]) -> Column:
    """Structs (n, gram) of all sizes, so that one explode serves them."""
    return F.flatten(F.array(*(_tagged(tokens, n) for n in sizes)))


def _tagged(tokens: Column, n: int) -> Column:
    return F.transform(grams(tokens, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))


def gram_table(tokens: DataFrame, docset: DataFrame, sizes: list[int], others: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Occurrences (topic_id, id, sent_index, size, *others, n, gram) and probabilities (topic_id, n, gram, p) of n-grams of
    some sizes. Topics are joined to sentences, so what is exploded isn't moved before it is counted."""
    keep = ["topic_id", "id", "sent_index", *(others or [])]
    rows = tokens.select("id", "sent_index", "tokens", *(others or [])).join(docset, "id")
    each = rows.select(*keep, F.size("tokens").alias("size"), F.explode(tagged_grams(F.col("tokens"), sizes)).alias("g"))
    occurrences = each.select(*keep, "size", F.col("g.n").alias("n"), F.col("g.gram").alias("gram"))
    counts = occurrences.groupBy("topic_id", "n", "gram").agg(F.count("*").alias("cnt"))
    articles = tokens.groupBy("id").agg(F.sum(F.size("tokens")).alias("words"), F.count("*").alias("sentences"))
    sums = articles.join(docset, "id").groupBy("topic_id").agg(F.sum("words").alias("words"), F.sum("sentences").alias("sentences"), F.count("*").alias("articles"))
    total = F.col("words") - (F.col("n") - 1) * F.col("sentences")
    for n in sizes:
        total = total + F.when(F.col("n") == n, EXTRA[n] * F.col("articles")).otherwise(0)
    return occurrences, counts.join(sums, "topic_id").select("topic_id", "n", "gram", F.try_divide(F.col("cnt").cast("double"), total).alias("p"))


def headline_entities(articles: DataFrame) -> DataFrame:
    """(id, entities): runs of capitalised words of each headline, in lower case; no tagger is at hand."""
    runs = F.regexp_extract_all("headline", F.lit(r"([A-Z][\w'-]*(?: [A-Z][\w'-]*)*)"), 1)
    return articles.where("headline is not null").select("id", F.transform(runs, F.lower).alias("entities")).where(F.size("entities") > 0)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each key among the distinct ones, and how often it is there."""
    _, number, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return number.reshape(-1), counts


def _pairs_of(words: whole.Words, topic: np.ndarray, unigram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different words of a row, each once: row, both words as numbers of unigram, and how often they meet."""
    width = int(unigram.max()) + 1 if len(unigram) else 1
    held, tf = np.unique(words.row * width + unigram, return_counts=True)
    row, word = held // width, held % width
    behind = np.searchsorted(row, row, "right") - np.arange(len(row)) - 1  # the words of the row after this one
    a = np.repeat(np.arange(len(row)), behind)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(behind) - behind, behind)
    return row[a], word[a], word[b], tf[a] * tf[b]


def score_topics(table: pa.Table, config: NgramConfig) -> np.ndarray:
    """The terms of sentence_scores by n-grams, headline entities and pairs, of a table (topic_id, id, tokens, entities)
    of whole topics in order. Counts are whole numbers until they are divided."""
    words, topic = whole.Words(table), whole.starts(whole.one(table["topic_id"]))
    n_rows, row, size = len(topic), words.row, words.size
    article = topic[np.concatenate([[True], whole.starts(whole.one(table["id"]))[1:] != whole.starts(whole.one(table["id"]))[:-1]]) | np.concatenate([[True], topic[1:] != topic[:-1]])]
    of_words, sentences, articles = (np.bincount(x, weights=w, minlength=topic[-1] + 1) for x, w in ((topic, size), (topic, None), (article, None)))
    score, key, at = np.zeros(n_rows), topic[row], np.arange(len(row))
    named = config.headline_weight and "entities" in table.column_names
    hits = _entity_hits(table, words) if named else None
    unigram = None
    for n, weight in ((1, config.unigram_weight), (2, config.bigram_weight), (3, config.trigram_weight)):
        if n > 1:
            ahead = at + (n - 1) < len(row)
            at, key = at[ahead], key[ahead]
            inside = row[at + (n - 1)] == row[at]
            at, key = at[inside], key[inside]
        key, counts = _distinct(key * len(words.names) + words.code[at + (n - 1)])
        unigram = key if n == 1 else unigram
        total = (of_words - (n - 1) * sentences + EXTRA[n] * articles)[topic]
        for w, times in ((weight, None), (config.headline_weight if named and n <= 2 else 0, hits[n - 1] if named and n <= 2 else None)):
            if w:
                sums = np.bincount(row[at], weights=counts[key] * (1 if times is None else times), minlength=n_rows)
                score += np.divide(w * sums, total * (np.maximum(size, 1) if times is None else 1), out=np.zeros(n_rows), where=total != 0)
    if config.cartesian_weight:
        of, a, b, met = _pairs_of(words, topic, unigram)
        number, _ = _distinct(a * (int(unigram.max()) + 1 if len(unigram) else 1) + b)
        together = np.bincount(number, weights=met)
        pairs_of_row = np.bincount(of, weights=2 * met, minlength=n_rows)
        total = np.bincount(topic, weights=pairs_of_row)[topic]
        score += config.cartesian_weight * np.divide(np.bincount(of, weights=2 * met * together[number], minlength=n_rows), pairs_of_row * total, out=np.zeros(n_rows), where=pairs_of_row > 0)
    return score


def _entity_hits(table: pa.Table, words: whole.Words) -> list[np.ndarray]:
    """Entities of the article that hold the word at each place, and the two words from there on."""
    names, entities = words.names.to_pylist(), whole.one(table["entities"]).to_pylist()
    one, two = np.zeros(len(words.row)), np.zeros(len(words.row))
    for i in np.flatnonzero([bool(entities[r]) for r in words.row]):
        held, w = entities[words.row[i]], names[words.code[i]]
        one[i] = sum(w in e for e in held)
        if one[i] and i + 1 < len(words.row) and words.row[i + 1] == words.row[i]:
            both = f"{w} {names[words.code[i + 1]]}"
            two[i] = sum(both in e for e in held)
    inside = np.concatenate([words.row[1:] == words.row[:-1], [False]]) if len(words.row) else np.zeros(0, bool)
    return [one, two[inside]]


SCORED = "topic_id string, id string, sent_index long, score double"


def sentence_scores(tokens: DataFrame, docset: DataFrame, config: NgramConfig, queries: DataFrame | None = None, entities: DataFrame | None = None, bias: DataFrame | None = None, only: Column | None = None, idf: DataFrame | None = None) -> DataFrame:
    """(topic_id, id, sent_index, score): the weighted sum; terms of weight zero aren't planned; sentences without
    tokens score 0 before the bias. queries: (topic_id, query_tokens); entities: of headline_entities; bias: (topic_id,
    id, sent_index, raw), blended in as a share of its article, or idf: the term table, for the bias of
    lexrank.query_bias, which then isn't made as a table; only: the sentences that are returned, by columns of tokens,
    while all count. Topics are scored in whole with their queries, large ones by joins."""
    small, large = whole.split(tokens, docset, squared=bool(config.cartesian_weight))
    rows = whole.sentences_of(tokens, small, *([] if only is None else [F.coalesce(only, F.lit(False)).alias("only")]))
    if entities is not None and config.headline_weight:
        rows = rows.join(entities.select("id", "entities"), "id", "left")
    blended = config.bias_weight and bias is None and idf is not None and queries is not None
    terms = lexrank.term_table(idf) if blended else None
    base = _scores_in_whole(rows, config, lexrank.query_rows(queries, small) if queries is not None and (config.query_weight or terms is not None) else None, terms)
    of_queries = lambda d: lexrank.query_bias(tokens, d, queries, idf) if blended else bias
    if terms is None:
        base = _with_bias(base, config, of_queries(small))
    if large:
        more = docset.where(F.col("topic_id").isin(large))
        scored = _with_bias(_with_queries(scores_by_joins(tokens, more, config, entities), tokens, more, config, queries), config, of_queries(more))
        base = base.unionByName(scored if only is None else scored.join(tokens.where(only).select("id", "sent_index"), ["id", "sent_index"], "left_semi"))
    return base


def _scores_in_whole(rows: DataFrame, config: NgramConfig, asked: DataFrame | None, terms: pa.Table | None) -> DataFrame:
    """The scores of rows with the terms of their queries, and with a term table the bias."""
    sent = rows.sparkSession.sparkContext.broadcast(terms) if terms is not None else None
    queried = asked is not None

    def run(table: pa.Table):
        plain = pc.not_equal(table["sent_index"], lexrank.QUERY)
        given, scores = table.filter(plain), np.zeros(0)
        if given.num_rows:
            scores = score_topics(given.combine_chunks(), config)
        if queried:
            hits, share = query_terms(table, lexrank.idf_of(sent) if sent is not None else None)
            at = plain.to_numpy()
            scores = scores + config.query_weight * hits[at]
            if share is not None:
                scores = (1 - config.bias_weight) * scores + config.bias_weight * share[at]
        out = given.select(["topic_id", "id", "sent_index"]).append_column("score", pa.array(scores))
        yield from (out.filter(given["only"]) if "only" in given.column_names else out).to_batches()

    return whole.apply(rows.unionByName(asked, allowMissingColumns=True) if queried else rows, run, SCORED)


def query_terms(table: pa.Table, idf: dict[str, float] | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Of each row of a table of whole topics with their queries: the score of query_scores, and, with a term table, raw of
    lexrank.query_bias as a share of its article."""
    words, topic = whole.Words(table), whole.starts(whole.one(table["topic_id"]))
    asked, n_rows = table["sent_index"].to_numpy() == lexrank.QUERY, len(topic)
    width = max(len(words.names), 1)
    held, tf = np.unique(words.row * width + words.code, return_counts=True)
    row, code = held // width, held % width
    keys, column = np.unique(topic[row] * width + code, return_inverse=True)  # words of topics
    column, q = column.reshape(-1), asked[row]
    times = np.zeros(len(keys))
    times[column[q]] = tf[q]
    hits = np.bincount(row, weights=times[column], minlength=n_rows)
    hits = np.divide(hits, words.size, out=np.zeros(n_rows), where=words.size > 0)
    if idf is None:
        return hits, None
    value = np.array([idf.get(w, np.nan) for w in words.names.to_pylist()], float)
    known = ~np.isnan(value[code])
    raw, _ = lexrank.raw_bias(topic, asked, row[known], column[known], tf[known], value[code[known]])
    article = whole.starts(whole.one(table["id"]))
    article = np.cumsum(np.concatenate([[False], (topic[1:] != topic[:-1]) | (article[1:] != article[:-1])]))
    total = np.bincount(article, weights=raw)[article]
    return hits, np.divide(raw, total, out=np.zeros(n_rows), where=total != 0)


def scores_by_joins(tokens: DataFrame, docset: DataFrame, config: NgramConfig, entities: DataFrame | None = None) -> DataFrame:
    """The terms of score_topics, (topic_id, id, sent_index, score), by joins over all tasks."""
    key = ["topic_id", "id", "sent_index"]
    weights = {n: w for n, w in ((1, config.unigram_weight), (2, config.bigram_weight), (3, config.trigram_weight)) if w}
    named = entities is not None and config.headline_weight
    sizes = sorted({*weights, *((1, 2) if named else ())})
    base = tokens.select("id", "sent_index").join(docset, "id").select(*key)
    score = F.lit(0.0)
    if sizes:
        given = tokens
        if named:
            given = tokens.join(entities.select("id", "entities"), "id", "left")
        occurrences, probs = gram_table(given, docset, sizes, ["entities"] if named else None)
        weight = F.lit(0.0)
        for n, w in weights.items():
            weight = F.when(F.col("n") == n, w).otherwise(weight)
        value = weight / F.col("size")
        if named:
            hits = F.when(F.col("n") <= 2, F.size(F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: F.contains(e, F.col("gram"))))).otherwise(0)
            value = value + config.headline_weight * hits
        part = occurrences.select(*key, "n", "gram", value.alias("value")).join(probs, ["topic_id", "n", "gram"]).groupBy(*key).agg(F.sum(F.col("p") * F.col("value")).alias("s"))
        base = base.join(part, key, "left")
        score = score + F.coalesce("s", F.lit(0.0))
    if config.cartesian_weight:
        part = gram_scores(tokens, docset, pair_probabilities_by_joins(tokens, docset), pairs(F.col("tokens")), "s4", True)
        base = base.join(part, key, "left")
        score = score + config.cartesian_weight * F.coalesce("s4", F.lit(0.0))
    return base.select(*key, score.alias("score"))


def _with_queries(base: DataFrame, tokens: DataFrame, docset: DataFrame, config: NgramConfig, queries: DataFrame | None) -> DataFrame:
    """Adds the terms of queries to scores."""
    key, score = ["topic_id", "id", "sent_index"], F.col("score")
    if config.query_weight and queries is not None:
        base = base.join(query_scores(tokens, docset, queries).withColumnRenamed("score", "s5"), key, "left")
        score = score + config.query_weight * F.coalesce("s5", F.lit(0.0))
    return base.select(*key, score.alias("score"))


def _with_bias(base: DataFrame, config: NgramConfig, bias: DataFrame | None) -> DataFrame:
    """Blends the bias into scores, as a share of its article."""
    key, score = ["topic_id", "id", "sent_index"], F.col("score")
    if config.bias_weight and bias is not None:
        total = F.sum("raw").over(Window.partitionBy("topic_id", "id"))
        share = bias.select(*key, F.coalesce(F.try_divide("raw", total), F.lit(0.0)).alias("share"))
        base = base.join(share, key, "left")
        score = (1 - config.bias_weight) * score + config.bias_weight * F.coalesce("share", F.lit(0.0))
    return base.select(*key, score.alias("score"))


def query_scores(tokens: DataFrame, docset: DataFrame, queries: DataFrame) -> DataFrame:
    """(topic_id, id, sent_index, score): query tokens, with repeats, that a sentence holds, by the sentence's tokens.
    queries: (topic_id, query_tokens)."""
    joined = tokens.select("id", "sent_index", "tokens").join(docset, "id").join(queries, "topic_id")
    hits = F.size(F.filter("query_tokens", lambda q: F.array_contains("tokens", q)))
    return joined.select("topic_id", "id", "sent_index", F.coalesce(F.try_divide(hits.cast("double"), F.size("tokens")), F.lit(0.0)).alias("score"))


def removable(text: Column, n_words: Column, length_limit: int = 4) -> Column:
    """A sentence that is not selected: quoted, not ended by . or ;, a question, short, or with a pronoun opening."""
    return T.contains_quote(text) | ~F.right(text, F.lit(1)).isin(".", ";") | F.contains(text, F.lit("?")) | (n_words < length_limit) | T.opens_with_pronoun(text)


def best(scored: DataFrame, group: list[str], k: int) -> DataFrame:
    """The k best of each group; ties go to the earlier article and sentence."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "id", "sent_index"))
    return scored.withColumn("place", place).where(F.col("place") <= k)


# ---- stateful selection: one kernel call a topic ---------------------------------------------------------------


class Scorer:
    """The score of sentences of one topic against distributions that change as sentences are used."""

    def __init__(self, rows: pd.DataFrame, config: NgramConfig):
        words = list(rows["tokens"])
        self.config, self.query = config, list(rows["query"].iloc[0]) if len(rows) else []
        self.size = sum(map(len, words)) + rows["id"].nunique()
        self.tri_size = sum(len(w) - 2 for w in words) - rows["id"].nunique()
        self.uni = self._shares([x for w in words for x in w], self.size)
        self.bi = self._shares([f"{a} {b}" for w in words for a, b in zip(w, w[1:])], sum(len(w) - 1 for w in words))
        self.tri = self._shares([" ".join(x) for w in words for x in zip(w, w[1:], w[2:])], self.tri_size) if config.trigram_weight else {}
        self.pairs = {}
        if config.cartesian_weight:
            both = [p for w in words for p in self._pairs(w)]
            self.pairs = self._shares(both, len(both))

    @staticmethod
    def _shares(items: list[str], total: int) -> dict[str, float]:
        return {k: n / total for k, n in Counter(items).items()} if total else {}

    @staticmethod
    def _pairs(words: list[str]) -> list[str]:
        return [f"{b} {a}" for a in words for b in words if a != b]

    def one(self, words: list[str], entities: list[str]) -> float:
        """The weighted sum. With the scheme before_selection each n-gram that is scored loses one count at once, so the
        next sentence meets lower values; they may fall below zero."""
        c = self.config
        if not words:
            return 0.0
        lower = c.reweight_scheme == "before_selection"
        total = 0.0
        if c.unigram_weight > 0:
            total += c.unigram_weight * sum(self.uni.get(x, 0.0) for x in words) / len(words)
            for x in words if lower else ():
                if self.size > 0:
                    self.uni[x] = self.uni.get(x, 0.0) - 1 / self.size
                    self.size -= 1
        if c.bigram_weight > 0:
            total += c.bigram_weight * sum(self.bi.get(f"{a} {b}", 0.0) for a, b in zip(words, words[1:])) / len(words)
        if c.trigram_weight > 0:
            three = [" ".join(x) for x in zip(words, words[1:], words[2:])]
            total += c.trigram_weight * sum(self.tri.get(x, 0.0) for x in three) / len(words)
            for x in three if lower and self.tri_size > 0 else ():
                self.tri[x] = self.tri.get(x, 0.0) - 1 / self.tri_size
        if c.headline_weight > 0:
            two = [f"{a} {b}" for a, b in zip(words, words[1:])]
            total += c.headline_weight * sum(sum(self.uni.get(x, 0.0) for x in words if x in e) + sum(self.bi.get(x, 0.0) for x in two if x in e) for e in entities)
        if c.cartesian_weight > 0:
            both = self._pairs(words)
            total += c.cartesian_weight * sum(self.pairs.get(x, 0.0) for x in both) / len(both) if both else 0.0
        if c.query_weight > 0:
            held = set(words)
            total += c.query_weight * sum(x in held for x in self.query) / len(words)
        return total

    def used(self, words: list[str]) -> None:
        """The scheme sumbasic squares a word's probability at each of its places in a sentence that is visited."""
        if self.config.reweight_scheme == "sumbasic":
            for x in words:
                if x in self.uni:
                    self.uni[x] **= 2

    def restored(self, start: Scorer) -> None:
        self.uni, self.bi = dict(start.uni), dict(start.bi)


def pick_by_article(rows: pd.DataFrame, scorer: Scorer, backward: bool = False) -> dict[int, float]:
    """Articles in order: score once, drop the lowest removable sentences while more than N remain, then go down the
    scores; every sentence visited is re-weighted, N that aren't removable are kept. Ties: the earlier one first."""
    c, out = scorer.config, {}
    for article in sorted(rows["id"].unique(), reverse=backward):
        part = rows[rows["id"] == article]
        raw = part["raw"].fillna(0.0).to_numpy(float)
        bias = raw / raw.sum() if raw.sum() else raw
        scores = [(1 - c.bias_weight) * scorer.one(w, e) + c.bias_weight * x for w, e, x in zip(part["tokens"], part["entities"], bias)]
        flags = part["removable"].to_numpy()
        order = sorted(range(len(part)), key=lambda i: scores[i])
        spare = max(0, len(order) - c.num_sents_per_article)
        gone = set([i for i in order if flags[i]][:spare])
        kept = 0
        for i in sorted((i for i in order if i not in gone), key=lambda i: scores[i], reverse=True):
            if kept == c.num_sents_per_article:
                break
            scorer.used(part["tokens"].iloc[i])
            if not flags[i]:
                out[part.index[i]] = float(scores[i])
                kept += 1
    return out


def pick_globally(rows: pd.DataFrame, scorer: Scorer) -> dict[int, float]:
    """Again and again the best remaining sentence of the topic (ties: the earliest), re-weighted after each; the picks'
    scores as shares of their sum, the bias added. Sentences are scored anew only where a word of theirs was used, but
    for before_selection, where scoring itself changes the distributions."""
    c, left, out = scorer.config, len(rows), {}
    words = list(rows["tokens"])
    every = c.reweight_scheme == "before_selection"
    alive = np.ones(left, bool)
    scores = np.full(left, -np.inf) if every else np.array([scorer.one(w, []) for w in words])
    where: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        for x in set(w):
            where.setdefault(x, []).append(i)
    for _ in range(min(c.num_sents_per_glob, left)):
        if every:
            for j in np.flatnonzero(alive):
                scores[j] = scorer.one(words[j], [])
        i = int(np.argmax(np.where(alive, scores, -np.inf)))
        out[rows.index[i]] = float(scores[i])
        alive[i] = False
        scorer.used(words[i])
        if c.reweight_scheme == "sumbasic":
            for j in sorted({j for x in set(words[i]) for j in where[x] if alive[j]}):
                scores[j] = scorer.one(words[j], [])
    total = sum(out.values())
    raw = rows["raw"].fillna(0.0)
    bias = raw / raw.sum() if raw.sum() else raw
    return {k: (v / total if total else 0.0) + c.bias_weight * float(bias[k]) for k, v in out.items()}


PICKED = "topic_id string, id string, sent_index long, score double"


def select_stateful(tokens: DataFrame, docset: DataFrame, config: NgramConfig, queries: DataFrame | None = None, entities: DataFrame | None = None, bias: DataFrame | None = None) -> DataFrame:
    """(topic_id, id, sent_index, score) by the stateful schemes. tokens: with removable; the others as sentence_scores.
    The state runs through the sentences of a topic, so a topic is one call; only what scores need goes there."""
    none = F.array().cast("array<string>")
    rows = tokens.select("id", "sent_index", "tokens", "removable").join(docset, "id")
    rows = rows.join(bias.select("topic_id", "id", "sent_index", "raw"), ["topic_id", "id", "sent_index"], "left") if bias is not None and config.bias_weight else rows.withColumn("raw", F.lit(None).cast("double"))
    rows = rows.join(entities.select("id", F.col("entities").alias("ents")), "id", "left") if entities is not None and config.headline_weight else rows.withColumn("ents", none)
    rows = rows.join(queries.select("topic_id", F.col("query_tokens").alias("asked")), "topic_id", "left") if queries is not None and config.query_weight else rows.withColumn("asked", none)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "sent_index"]).reset_index(drop=True)
        for c in ("tokens", "entities", "query"):
            rows[c] = [list(t) for t in rows[c]]
        scorer = Scorer(rows, config)
        if config.grouping == "glob":
            got = pick_globally(rows, scorer)
        else:
            start = copy.copy(scorer)
            start.restored(scorer)
            got = pick_by_article(rows, scorer)
            if config.forward_backward:
                scorer.restored(start)
                back = pick_by_article(rows, scorer, True)
                got = {k: (got.get(k, 0.0) + back.get(k, 0.0)) / 2 for k in {**got, **back}}
        keep = rows.loc[sorted(got)]
        return pd.DataFrame({"topic_id": keep["topic_id"], "id": keep["id"], "sent_index": keep["sent_index"], "score": [got[k] for k in sorted(got)]})

    rows = rows.select("topic_id", "id", "sent_index", "tokens", "removable", "raw", F.coalesce("ents", none).alias("entities"), F.coalesce("asked", none).alias("query"))
    return rows.groupBy("topic_id").applyInPandas(run, PICKED)
