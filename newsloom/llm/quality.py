"""Per-document text statistics, a rule for what is no running prose, and a Gaussian mixture over the statistics.

Defined results: null texts, and texts without words, have zero counts and null shares and are never flagged; null or
unknown `lang` switches the rules that need the language off; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import chunks, codes, prefix_hash, runs, span_hash, table, white_chars, word_chars, written

#: Marks that close a line of prose.
LINE_ENDS = frozenset(".!?…。！？।؟\"'”’»)」』")
#: Most common words that are sent to all tasks.
MOST_WORDS = 100_000
ROUNDS = 50
FEATURES = ("symbol_share", "ended_share", "mean_word_length", "common_share", "words_per_line", "digit_share")
#: Features of which the logarithm is taken, after adding this.
LOGS = {"mean_word_length": 0.0, "words_per_line": 1.0}
#: Inspected examples: the kind and the FEATURES of documents that were read. The mixture has a component for each, and
#: begins there; a fitted component gets the kind of the nearest example.
EXAMPLES = [
    ("prose", (0.03, 1.0, 5.9, 0.25, 16.0, 0.02)),  # paragraphs
    ("prose", (0.04, 0.97, 5.5, 0.18, 60.0, 0.01)),  # one long line
    ("prose", (0.1, 0.95, 65.0, 0.0, 1.0, 0.06)),  # scripts without blanks
    ("prose", (0.04, 0.95, 8.0, 0.0, 3.0, 0.02)),  # languages without common words
    ("list", (0.04, 0.0, 6.9, 0.0, 4.7, 0.04)),  # numbered
    ("list", (0.03, 0.0, 8.4, 0.0, 4.0, 0.12)),  # timetable
    ("list", (0.2, 0.0, 5.5, 0.0, 4.0, 0.02)),  # bullets
    ("list", (0.04, 0.13, 6.2, 0.17, 7.5, 0.05)),  # after some sentences
    ("table", (0.17, 0.0, 2.6, 0.0, 8.0, 0.4)),  # columns
    ("table", (0.24, 0.0, 6.1, 0.0, 6.6, 0.49)),  # report of scores
    ("junk", (0.26, 0.0, 6.4, 0.0, 1.7, 0.03)),  # mark-up
    ("junk", (0.85, 0.4, 24.0, 0.0, 1.7, 0.0)),  # symbols
    ("junk", (0.03, 1.0, 75.0, 0.0, 2.3, 0.02)),  # words without blanks
    ("junk", (0.02, 1.0, 1.1, 0.05, 90.0, 0.01)),  # single letters
    ("junk", (0.01, 1.0, 6.2, 0.0, 25.0, 0.0)),  # words without a sentence
]

STATS = "doc_id long, lang string, n_words long, n_chars long, n_symbols long, n_digits long, n_lines long, n_ended long, n_common long"


def word_hashes(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    joined = codes("\n".join(words))
    starts, ends = runs(joined != 10)
    return np.unique(span_hash(prefix_hash(joined), starts, ends))


def _per_text(flag: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flag)))
    return np.diff(total[bounds])


def _statistics(common: np.ndarray):
    def block(texts: list[str]) -> list[np.ndarray]:
        cp = codes("\n".join(texts))
        bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        bounds[-1] -= 1
        if not len(cp):
            return [np.zeros(len(texts), np.int64)] * 7
        white, word = white_chars()[cp], word_chars()[cp]
        starts, _ = runs(~white)
        begins = np.zeros(len(cp), np.int8)
        begins[starts] = 1
        digit = (cp >= 48) & (cp <= 57)
        n_words, n_chars, n_symbols, n_digits = (_per_text(x, bounds) for x in (begins, ~white, ~white & ~word, digit))
        n_lines, n_ended = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            for line in t.split("\n"):
                line = line.strip(" \t\r\n")
                if line:
                    n_lines[i] += 1
                    n_ended[i] += line[-1] in LINE_ENDS
        low = [t.lower() for t in texts]
        cp = codes("\n".join(low))
        bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in low])))
        bounds[-1] -= 1
        word = word_chars()[cp]
        starts, ends = runs(~white_chars()[cp])
        seen = np.concatenate(([0], np.cumsum(word)))
        keep = seen[ends] > seen[starts]
        starts, ends = starts[keep], ends[keep]
        at = np.flatnonzero(word)
        n_common = np.zeros(len(texts), np.int64)
        if len(starts):
            first, last = at[seen[starts]], at[seen[ends] - 1] + 1
            hits = np.isin(span_hash(prefix_hash(cp), first, last), common)
            n_common = np.bincount(np.searchsorted(bounds, first[hits], side="right") - 1, minlength=len(texts))[: len(texts)]
        return [n_words, n_chars, n_symbols, n_digits, n_lines, n_ended, n_common]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            for s in chunks([len(t) for t in texts]):
                got = block(texts[s])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(s.start, s.stop - s.start), batch["lang"].slice(s.start, s.stop - s.start), *(pa.array(x.astype(np.int64)) for x in got)], names=[c.split()[0] for c in STATS.split(", ")])

    return run


def text_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """One row of counts for each document; lang_known: does `lang` occur in common_words?"""
    spark: SparkSession = documents.sparkSession
    rows = common_words.select("lang", "word").distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"common_words has more than {MOST_WORDS} rows")
    shared = spark.sparkContext.broadcast(word_hashes(sorted({r.word for r in rows if r.word})))
    langs = sorted({r.lang for r in rows if r.lang is not None})
    run = lambda batches: _statistics(shared.value)(batches)
    out = documents.select("doc_id", "text", "lang").mapInArrow(run, STATS)
    known = F.coalesce(F.col("lang").isin(langs), F.lit(False)) if langs else F.lit(False)
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return out.select(
        "*",
        known.alias("lang_known"),
        ratio("n_symbols", "n_chars").alias("symbol_share"),
        ratio("n_ended", "n_lines").alias("ended_share"),
        ratio("n_chars", "n_words").alias("mean_word_length"),
        ratio("n_common", "n_words").alias("common_share"),
        ratio("n_words", "n_lines").alias("words_per_line"),
        ratio("n_digits", "n_chars").alias("digit_share"),
    )


def not_prose() -> F.Column:
    """The rule of the problem on the columns of text_statistics; counts are compared whole where they can be."""
    return (F.col("n_words") > 0) & (
        (F.col("symbol_share") > 0.2)
        | (2 * F.col("n_ended") < F.col("n_lines"))
        | (F.col("lang_known") & ((F.col("n_chars") < 3 * F.col("n_words")) | (F.col("n_chars") > 12 * F.col("n_words"))))
        | (F.col("lang_known") & (10 * F.col("n_common") < F.col("n_words")))
    )


# ---- mixture -------------------------------------------------------------------------------------------------


def _design(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    for f, more in LOGS.items():
        x[:, FEATURES.index(f)] = np.log(x[:, FEATURES.index(f)] + more)
    return (x - mean) / std


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch[f].to_numpy(zero_copy_only=False) for f in FEATURES])


def _responsibilities(x: np.ndarray, weight: np.ndarray, mu: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, float]:
    log = np.log(weight) - 0.5 * (np.log(2 * np.pi * var).sum(1) + ((x[:, None, :] - mu) ** 2 / var).sum(2))
    top = log.max(1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(log - top).sum(1))
    return np.exp(log - total[:, None]), float(total.sum())


def fit_mixture(stats: DataFrame, rounds: int = ROUNDS) -> dict | None:
    """Diagonal Gaussian mixture by expectation-maximisation over the standardised statistics of all documents with
    words. Every round is one pass; tasks send k * (2 d + 1) sums each. It begins at EXAMPLES, so it is deterministic.
    None where no document has words.
    """
    rows = stats.where("n_words > 0").select(*FEATURES)
    value = {f: F.log(F.col(f) + LOGS[f]) if f in LOGS else F.col(f) for f in FEATURES}
    r = rows.agg(F.count("*").alias("n"), *(F.sum(v).alias(f"s_{f}") for f, v in value.items()), *(F.sum(v * v).alias(f"q_{f}") for f, v in value.items())).first()
    if not r.n:
        return None
    mean = np.array([r[f"s_{f}"] for f in FEATURES]) / r.n
    std = np.maximum(np.sqrt(np.maximum(np.array([r[f"q_{f}"] for f in FEATURES]) / r.n - mean**2, 0)), 1e-3)
    mu = _design(np.array([x for _, x in EXAMPLES]), mean, std)
    components = len(mu)
    weight = np.full(components, 1 / components)
    var = np.full_like(mu, 0.25)
    last = -np.inf
    for _ in range(rounds):
        args = (mean, std, weight, mu, var)

        def sums(batches: Iterator[pa.RecordBatch], args=args) -> Iterator[pa.RecordBatch]:
            mean, std, weight, mu, var = args
            total = np.zeros((len(weight), 2 * mu.shape[1] + 1))
            like = 0.0
            for batch in batches:
                if batch.num_rows:
                    x = _design(_features(batch), mean, std)
                    resp, more = _responsibilities(x, weight, mu, var)
                    like += more
                    total += np.column_stack((resp.sum(0), resp.T @ x, resp.T @ x**2))
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64())), pa.array([like])], names=["sums", "like"])

        parts = rows.mapInArrow(sums, "sums array<double>, like double").select(F.posexplode("sums").alias("i", "x"), "like").groupBy("i").agg(F.sum("x").alias("x"), F.sum("like").alias("like")).orderBy("i").collect()
        total = np.array([p.x for p in parts]).reshape(components, -1)
        r = np.maximum(total[:, 0], 1e-9)
        weight = r / r.sum()
        d = len(FEATURES)
        mu = total[:, 1 : d + 1] / r[:, None]
        var = np.maximum(total[:, d + 1 :] / r[:, None] - mu**2, 1e-3)
        like = parts[0].like
        if like - last < 1e-4 * abs(like):
            break
        last = like
    return {"mean": mean, "std": std, "weight": weight, "mu": mu, "var": var}


def name_components(model: dict) -> list[str]:
    """The kind of the inspected example nearest to each component's centre, in standardised units."""
    examples = _design(np.array([x for _, x in EXAMPLES]), model["mean"], model["std"])
    return [EXAMPLES[int(((examples - centre) ** 2).sum(1).argmin())][0] for centre in model["mu"]]


def classify(stats: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, component, kind, probability); documents without words get nulls."""
    if model is None:
        return stats.select("doc_id", F.lit(None).cast("int").alias("component"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("probability"))
    names = name_components(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch["n_words"].to_numpy() > 0
            best, p = np.zeros(len(some), np.int32), np.zeros(len(some))
            if some.any():
                part = batch.filter(pa.array(some))
                resp, _ = _responsibilities(_design(_features(part), model["mean"], model["std"]), model["weight"], model["mu"], model["var"])
                best[some], p[some] = resp.argmax(1), resp.max(1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(best, pa.int32(), mask=~some), pa.array([names[b] for b in best], pa.string(), mask=~some), pa.array(p, pa.float64(), mask=~some)], names=["doc_id", "component", "kind", "probability"])

    return stats.select("doc_id", "n_words", *FEATURES).mapInArrow(run, "doc_id long, component int, kind string, probability double")


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).where(not_prose()).select("doc_id")


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select("doc_id", "n_words", "n_chars", "n_symbols", "n_lines", "n_ended")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of each document by the mixture, beside what the rule says."""
    stats = written(_stats(spark, sf_dir), "text-stats")
    kinds = classify(stats, fit_mixture(stats))
    return kinds.join(stats.select("doc_id", not_prose().alias("flagged")), "doc_id").select("doc_id", "kind", F.round("probability", 6).alias("probability"), "flagged")


QUERIES = {"p9_found": p9_found, "p9_statistics": p9_statistics, "p9_mixture": p9_mixture}

_COUNTS = r"""
t AS (SELECT doc_id, lang, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(x), '[^ \t\r\n]+')) AS w FROM t),
l AS (SELECT doc_id, trim(unnest(string_split(x, chr(10))), concat(' ', chr(9), chr(10), chr(13))) AS l FROM t),
wc AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE regexp_replace(regexp_replace(w, '^[^\p{L}\p{M}\p{N}]+', ''), '[^\p{L}\p{M}\p{N}]+$', '') IN (SELECT word FROM common_words)) AS n_common FROM w GROUP BY doc_id),
lc AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE contains('.!?…。！？।؟"''”’»)」』', right(l, 1))) AS n_ended FROM l WHERE l <> '' GROUP BY doc_id),
s AS (SELECT doc_id, lang, coalesce(n_words, 0) AS n_words, coalesce(n_common, 0) AS n_common, coalesce(n_lines, 0) AS n_lines, coalesce(n_ended, 0) AS n_ended,
  length(regexp_replace(x, '[ \t\r\n]+', '', 'g')) AS n_chars, length(regexp_replace(x, '[ \t\r\n\p{L}\p{M}\p{N}]+', '', 'g')) AS n_symbols
  FROM t LEFT JOIN wc USING (doc_id) LEFT JOIN lc USING (doc_id))
"""
SQL = {
    "p9_statistics": f"WITH {_COUNTS} SELECT doc_id, n_words, n_chars, n_symbols, n_lines, n_ended FROM s",
    "p9_found": f"""WITH {_COUNTS} SELECT doc_id FROM s WHERE n_words > 0 AND (n_symbols > 0.2::DOUBLE * n_chars OR 2 * n_ended < n_lines
 OR (lang IN (SELECT lang FROM common_words) AND (n_chars < 3 * n_words OR n_chars > 12 * n_words OR 10 * n_common < n_words)))""",
}
