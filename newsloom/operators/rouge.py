"""N-gram overlap of summaries with references: recall, precision and F, per pair, averaged, with intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators.ngram import grams


def first_tokens(text: Column, limit: int = 100, stop_words: list[str] | None = None, stem=None) -> Column:
    """Lower-cased tokens of the first `limit` words, without stop words; stem: a function of a token column."""
    out = T.tokens(F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, limit), " "))
    if stop_words:
        out = F.filter(out, lambda t: ~t.isin(stop_words))
    return F.transform(out, stem) if stem else out


def plural_stem(token: Column) -> Column:
    """A light stem: plural and participle endings go where three letters stay before them."""
    return F.regexp_replace(token, r"^(\w{3,}?)(?:ies|ied|ing|ed|es|s|ly)$", "$1")


def pair_scores(peers: DataFrame, models: DataFrame, n: int) -> DataFrame:
    """(topic_id, peer_id, model_id, r, p, f) of peers (topic_id, peer_id, tokens), several of a topic each by itself,
    against models (topic_id, model_id, tokens)."""
    pc = peers.select("topic_id", "peer_id", F.explode(grams(F.col("tokens"), n)).alias("g")).groupBy("topic_id", "peer_id", "g").agg(F.count("*").alias("cp"))
    mc = models.select("topic_id", "model_id", F.explode(grams(F.col("tokens"), n)).alias("g")).groupBy("topic_id", "model_id", "g").agg(F.count("*").alias("cm"))
    key = ["topic_id", "peer_id", "model_id"]
    hits = mc.join(pc, ["topic_id", "g"]).groupBy(*key).agg(F.sum(F.least("cp", "cm")).alias("hits"))
    size = lambda df, c: df.withColumn(c, F.greatest(F.size("tokens") - (n - 1), F.lit(0))).drop("tokens")
    sizes = size(models.select("topic_id", "model_id", "tokens"), "nm").join(size(peers.select("topic_id", "peer_id", "tokens"), "np"), "topic_id")
    out = sizes.join(hits, key, "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(*key, zero(F.try_divide("hits", "nm")).alias("r"), zero(F.try_divide("hits", "np")).alias("p"), zero(F.try_divide(2 * F.col("hits"), F.col("nm") + F.col("np"))).alias("f"))


def per_topic(scores: DataFrame, best: bool = False) -> DataFrame:
    """A peer's score: the mean over its models, or the best model by F."""
    pick = (lambda c: F.max_by(c, F.struct("f", "model_id"))) if best else F.avg
    return scores.groupBy("topic_id", "peer_id").agg(*(pick(c).alias(c) for c in "rpf"))


def bootstrap(topic_scores: DataFrame, rounds: int = 1000, seed: int = 7) -> DataFrame:
    """(metric, mean, low, high): 95 % intervals over resamples; each peer of a topic draws its number of copies per round from a
    Poisson distribution by hash, so no resample is gathered anywhere."""
    k = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")
    df = topic_scores.select("topic_id", "peer_id", F.expr("stack(3, 'r', r, 'p', p, 'f', f) as (metric, x)")).select("*", k)
    u = (F.pmod(F.xxhash64("topic_id", "peer_id", "round", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)).alias("u")
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    copies = sum((F.when(F.col("u") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    df = df.select("*", u).withColumn("n", copies)
    means = df.groupBy("metric", "round").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("m"))
    lows = means.groupBy("metric").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    mean = topic_scores.select(F.expr("stack(3, 'r', r, 'p', p, 'f', f) as (metric, x)")).groupBy("metric").agg(F.avg("x").alias("mean"))
    return mean.join(lows, "metric")


def report_slice(lines: DataFrame) -> DataFrame:
    """Lines after one that begins with --- up to and including one that begins with ..., by report: lines
    (report, line_no, line). The flag is a running maximum of marks within a report."""
    from pyspark.sql import Window

    w = Window.partitionBy("report").orderBy("line_no")
    mark = F.when(F.startswith("line", F.lit("---")), F.col("line_no"))
    stop = F.when(F.startswith("line", F.lit("...")), F.col("line_no"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = lines.withColumn("a", F.max(mark).over(before)).withColumn("b", F.max(stop).over(before))
    return df.where("a is not null and (b is null or b < a)").select("report", "line_no", "line")
