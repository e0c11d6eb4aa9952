"""Sentence boundaries across languages and scripts by document-centred disambiguation.

Whether a full stop between two words ends a sentence is first asked of the document: a word that stands there with a
stop before a lower-case word, and nowhere without one, is an abbreviation; a word that stands inside a sentence without
a stop is none; after an abbreviation a word that the document also has in lower case begins a sentence, one it has
capitalised inside a sentence is a name. Where the document is silent the collection answers, by what follows each word
with a stop over all documents (`abbreviation_evidence`, one pass and one aggregation); a short list answers last.
Scripts without blanks or with stops of their own have terminator rules of their own.

Defined results: null and blank paragraphs have no sentence; a paragraph without a stop is one sentence; an
article with null paragraphs has no row; ids that come again give one set of rows; null ids are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import distinct_articles, table, written

#: Most abbreviations of the collection that are sent to all tasks, those with the most evidence; the others are joined
#: to the documents that hold them.
MOST_ABBREVIATIONS = 50_000
#: Least share of lower-case followers from which a word with a stop is an abbreviation.
LOWER_SHARE = 0.15
#: At most this share of common words among capitalised followers: the abbreviation never ends a sentence.
NEVER_SHARE = 0.05
#: Documents with a lower-case follower from which a word with a stop may be an abbreviation.
LEAST_LOWER = 3
#: Documents with another follower that a word needs before the collection may call it one that never ends a sentence.
LEAST_FOLLOWERS = 18

#: A word that stands without a stop in more than this share of its documents is no abbreviation by its followers alone.
PLAIN_SHARE = 0.3

#: Abbreviations that stand before what they belong to, for collections too small to learn from.
BEFORE_NAMES = frozenset("Mr Mrs Ms Dr Prof Gen Col Capt Lt Sgt Sen Rep Gov Rev St No Fig pp vs Sr Sra Dra núm avda Nr M Mme cf p ул д डॉ د".split())
#: Verbs of attribution that may follow a quotation that ends in ? or !.
ATTRIBUTION = frozenset("said asked wrote told added replied shouted cried called explained demanded says asks adds".split())

_BLANKS = str.maketrans("\t\r\n", "   ")
_OPEN = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "``": "''"}
_QUOTE = re.compile(r"``|''|[“”„«»「」『』\"()\[\]（）]")
_BRACKET = {"(": ")", "[": "]", "（": "）"}
_CLOSERS = "”“»」』\"'’)]）`"
_STOP = re.compile(r"[.!?…؟।॥۔。！？｡]+")
_WIDE = frozenset("。！？｡")
_THAI_GAP = re.compile(r"(?<=[฀-฾เ-๏๚-๿]) +(?=[฀-฾เ-๏๚-๿])")
_DATELINE = re.compile(r"[A-Z][A-Z'’. -]+(?:, [^_\n]{1,40}?)?\s*(?:\([^)]{1,30}\)\s*)?(?:--|_|—|–)\s")
_FOLLOW = re.compile(r"(?<![^\s(“„«\"`\[])[(“„«\"`\[]*(\S{1,14})\.\s+(\S+)")
_STOPPED = re.compile(r"(\S{1,14})\.")
_LEAD = "(“„«\"`'‘[¿¡’"
_DEVANAGARI = re.compile(r"[ऀ-ॿ]")

EVIDENCE = pa.schema([("lang", pa.string()), ("word", pa.string()), *((c, pa.int64()) for c in ("lower", "common", "other", "plain", "lower_docs", "capital_docs"))])
SENTENCES = pa.schema([("id", pa.string()), ("para_no", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32())])


def language(article_id: str) -> str:
    """LANG of JOURNAL_LANG_YYYYMMDD.NNNN; English otherwise."""
    part = article_id.split("_")
    return part[1] if len(part) == 3 else "ENG"


def _word(token: str) -> str:
    """The key of a word before a stop; numbers of one or two digits share one."""
    token = token.lstrip(_LEAD)
    return "##" if token.isdigit() and len(token) <= 2 else token


def _is_lower(word: str) -> bool:
    """A lower-case word, but not one such as eBay."""
    return word[0].islower() and not (len(word) > 1 and word[1].isupper())


def _is_common(word: str, words: set[str], starters: set[str]) -> bool:
    """Does the document show that word is no name? Scripts without case go by the words that begin paragraphs."""
    word = word.strip(_LEAD + ",.;:!?)]}”»")
    low = word.lower()
    return low in words if low != word else word in starters


def _vocabulary(texts: list[str]) -> tuple[set[str], set[str]]:
    """Words of a document as they are spelt; words that surely begin a sentence."""
    words: set[str] = set()
    starters: set[str] = set()
    for t in texts:
        parts = t.split()
        words.update(parts)
        if parts:
            starters.add(parts[0].lstrip(_LEAD))
        for a, b in zip(parts, parts[1:]):
            if a[-1] in "!?؟":
                starters.add(b.lstrip(_LEAD))
    return words, starters


def _followers(texts: list[str], words: set[str], starters: set[str]) -> Iterator[tuple[str, int]]:
    """Each word with a stop inside a paragraph, and what follows: 0 a lower-case word, 1 a common word, 2 another."""
    for t in texts:
        for m in _FOLLOW.finditer(t):
            x, y = _word(m[1]), m[2]
            if not x or x[-1] in ".!?…":
                continue
            yield x, 0 if _is_lower(y) else 1 if _is_common(y, words, starters) else 2


def _texts(paragraphs: list[str | None] | None) -> list[str]:
    return [p for p in paragraphs or [] if p]


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for i, ps in zip(batch["id"].to_pylist(), batch["paragraphs"].to_pylist()):
            texts = _texts(ps)
            lang = language(i)
            if lang in ("CMN", "JPN", "THA") or not texts:
                continue
            words, starters = _vocabulary(texts)
            seen: set[tuple[str, str, int]] = set()
            for x, k in _followers(texts, words, starters):
                counts[lang, x, k] += 1
                if x in words:
                    counts[lang, x, 3] += 1
                seen.add((lang, x, 5 if k else 4))
            counts.update(seen)
        keys = list(dict.fromkeys((a, b) for a, b, _ in counts))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), *(pa.array([counts[(*k, c)] for k in keys], pa.int64()) for c in range(6))], schema=EVIDENCE)


def abbreviation_evidence(articles: DataFrame) -> DataFrame:
    """(lang, word, lower, common, other, plain, lower_docs, capital_docs): what follows each word with a stop, over all
    articles, an id that comes again counted once; plain: how often the document also has the word without a stop;
    lower_docs, capital_docs: documents in which a lower-case word, another word follows."""
    return _evidence_of_distinct(distinct_articles(articles, ("paragraphs",)))


def _evidence_of_distinct(documents: DataFrame) -> DataFrame:
    counts = EVIDENCE.names[2:]
    return (
        documents.select("id", "paragraphs")
        .mapInArrow(_evidence, "lang string, word string, " + ", ".join(f"{c} long" for c in counts))
        .groupBy("lang", "word").agg(*(F.sum(c).alias(c) for c in counts))
    )


def abbreviation_table(evidence: DataFrame) -> DataFrame:
    """(lang, word, ends, n): abbreviations of the collection; ends: may one end a sentence? n: the evidence."""
    capital = F.col("common") + F.col("other")
    lower = (F.col("lower_docs") >= LEAST_LOWER) & (F.col("lower") >= LOWER_SHARE * (F.col("lower") + capital))
    never = (F.col("common") <= NEVER_SHARE * capital) & (((F.col("capital_docs") >= LEAST_FOLLOWERS) & ((F.col("plain") <= PLAIN_SHARE * capital) | (F.length("word") == 1) | (F.col("word") == "##"))) | lower)
    return evidence.where(lower | never).select("lang", "word", (~never).alias("ends"), (F.col("lower") + capital).alias("n"))


def abbreviations(evidence: DataFrame, most: int = MOST_ABBREVIATIONS) -> dict[tuple[str, str], bool]:
    """(lang, word) -> may it end a sentence? Of the `most` abbreviations with the most evidence."""
    rows = abbreviation_table(evidence).orderBy(F.desc("n"), "lang", "word").limit(most).collect()
    return {(r.lang, r.word): r.ends for r in rows}


class Splitter:
    """Splits the paragraphs of one article."""

    def __init__(self, lang: str, texts: list[str], known: dict[tuple[str, str], bool], more: dict[str, bool] | None = None):
        self.lang, self.texts, self.known, self.more = lang, texts, known, more
        self._words: tuple[set[str], set[str]] | None = None
        self._short: dict[str, bool] = {}
        self._plain: dict[str, bool] = {}

    def vocabulary(self) -> tuple[set[str], set[str]]:
        if self._words is None:
            self._words = _vocabulary(self.texts)
        return self._words

    def common(self, word: str) -> bool:
        return _is_common(word, *self.vocabulary())

    def short(self, x: str) -> bool:
        """Does the document show x as an abbreviation: with a stop before a lower-case word, and nowhere without one?"""
        hit = self._short.get(x)
        if hit is None:
            hit = self._short[x] = self.stopped(x) and x not in self.vocabulary()[0]
        return hit

    def stopped(self, x: str) -> bool:
        """Does x stand with a stop before a lower-case word?"""
        dotted = x + "."
        for t in self.texts:
            k = t.find(dotted)
            while k >= 0:
                end = k + len(dotted)
                if (k == 0 or t[k - 1].isspace() or t[k - 1] in _LEAD) and t[end : end + 1].isspace():
                    after = t[end : end + 60].split(None, 1)
                    if after and _is_lower(after[0]):
                        return True
                k = t.find(dotted, k + 1)
        return False

    def inside(self, word: str) -> Iterator[str]:
        """What follows word where it stands after a word in lower case: inside a sentence, without a stop."""
        if word in self.vocabulary()[0]:
            for t in self.texts:
                if word in t:
                    parts = t.split()
                    for a, b, c in zip(parts, parts[1:], parts[2:] + [""]):
                        if b == word and a[-1].islower():
                            yield c

    def plain(self, x: str) -> bool:
        """Does the document show x inside a sentence without a stop, and never with one before a lower-case word?"""
        hit = self._plain.get(x)
        if hit is None:
            hit = self._plain[x] = x[-1].isalpha() and any(c and _is_lower(c) for c in self.inside(x)) and not self.stopped(x)
        return hit

    def name(self, y: str) -> bool:
        """Does y stand capitalised inside a sentence?"""
        return bool(y) and y[0].isupper() and y[-1].isalpha() and any(True for _ in self.inside(y))

    def of_collection(self, forms: list[str]) -> bool | None:
        for w in forms:
            ends = self.known.get((self.lang, w))
            if ends is None and self.more:
                ends = self.more.get(w)
            if ends is not None:
                return ends
        return None

    def stop_ends(self, x: str, y: str) -> bool:
        """Does "x. y" hold a boundary? y begins with something else than a lower-case letter."""
        x = _word(x)
        if not x or x[-1] == ".":
            return False
        if _DEVANAGARI.match(x):
            return False  # the danda ends sentences there, the full stop marks abbreviations
        forms = [x, x[2:]] if len(x) > 2 and x[1] in "’'" else [x]  # an article may be elided before it
        ends = self.of_collection(forms)
        if x == "##":
            return ends is not False or self.common(y)
        initial = len(x) == 1 and x.isalpha()
        own = not initial and any(map(self.short, forms))
        if not own and not initial and any(map(self.plain, forms)):
            return True  # a word of the document, no abbreviation
        if not own and ends is None and not initial and x not in BEFORE_NAMES:
            return True  # nothing speaks for an abbreviation
        z = y.strip(_LEAD + ",.;:!?)]}”»")
        if len(z) > 1 and z.lower() != z and z.lower() in self.vocabulary()[0]:
            return True  # an abbreviation before a common word
        if ends is not None and not (own and not ends and not self.name(z)):
            return ends
        if initial or x in BEFORE_NAMES:
            return False
        return not self.name(z) and self.common(y)

    def split(self, text: str) -> list[tuple[int, int]]:
        """Sentences of one paragraph as (start, end)."""
        text = text.translate(_BLANKS)
        first, last = len(text) - len(text.lstrip(" ")), len(text.rstrip(" "))
        if first >= last:
            return []
        spans = self._spans(text) if _QUOTE.search(text) else []
        cuts = self._cuts(text, spans, first, last)
        out, at = [], first
        for c in cuts:
            if at < c < last:
                out.append((at, c))
                at = c
                while text[at] == " ":
                    at += 1
        out.append((at, last))
        return out

    def _spans(self, text: str) -> list[tuple[int, int, int, bool]]:
        """Outermost quotations and brackets: start, start of the closing mark, end, is it a bracket? A mark
        that nothing closes in its paragraph, or that nothing opens, encloses nothing."""
        marks = [(m.start(), m.end(), m[0]) for m in _QUOTE.finditer(text)]
        out, i = [], 0
        while i < len(marks):
            s, e, a = marks[i]
            end = None
            if a in _BRACKET:
                end, depth = None, 0
                for j in range(i, len(marks)):
                    depth += (marks[j][2] == a) - (marks[j][2] == _BRACKET[a])
                    if not depth:
                        end = j
                        break
            elif a == '"':
                end = next((j for j in range(i + 1, len(marks)) if marks[j][2] == '"'), None)
            elif a in _OPEN:
                want = {_OPEN[a]} | ({"``", "''", '"', "”"} if a == "„" else {"''", '"'} if a == "“" else set())
                depth = 1
                for j in range(i + 1, len(marks)):
                    if marks[j][2] in want:
                        depth -= 1
                        if not depth:
                            end = j
                            break
                    elif marks[j][2] == a:
                        depth += 1
            elif a == "»" and (s == 0 or text[s - 1] == " "):
                end = next((j for j in range(i + 1, len(marks)) if marks[j][2] == "«"), None)
            if end is None:
                i += 1
            else:
                out.append((s, marks[end][0], marks[end][1], a in _BRACKET))
                i = end + 1
        return out

    def _cuts(self, text: str, spans: list[tuple[int, int, int, bool]], first: int, last: int) -> list[int]:
        cuts: list[int] = []
        start, k = first, 0  # the running sentence's start, the first span that may matter
        head = _DATELINE.match(text, first)
        guard = head.end() if head else -1
        gaps = [m for m in _THAI_GAP.finditer(text)] if "฀" <= max(text[first:last]) and _THAI_GAP.search(text) else []
        places = [(m.end(), m.start(), m) for m in _STOP.finditer(text)] + [(m.start(), m.start(), None) for m in gaps]
        if gaps:
            places.sort(key=lambda p: p[:2])
        done = 0  # closing marks up to here are dealt with
        for at, stop, m in places:
            if stop < done or at <= guard:
                continue
            while k < len(spans) and spans[k][2] <= stop:
                k += 1
            span = spans[k] if k < len(spans) and spans[k][0] < stop else None
            if m is None:
                if span is None:
                    cuts.append(at)
                    start = at
                    while text[start] == " ":
                        start += 1
                continue
            dots = m[0]
            inner = False
            if span is not None:  # only a stop right before the closing mark counts
                if text[at : span[1]].strip(_CLOSERS + " "):
                    continue
                at = done = span[2]
                inner = True
            while at < last and text[at] in _CLOSERS and not (k + 1 < len(spans) and spans[k + 1][0] == at) and not (span is None and k < len(spans) and spans[k][0] == at):
                at += 1
            if at >= last:
                break
            wide = dots[-1] in _WIDE
            if wide and inner and not span[3]:
                continue  # a stop inside quotation marks ends nothing there
            if not wide and text[at] != " ":
                continue
            if dots[-1] == "…" or dots[-1] == "." and len(dots) > 1 and set(dots) == {"."}:
                continue
            y = at
            while text[y] == " ":
                y += 1
            if not wide and not self._ends(text, stop, dots, y, span if inner else None, start, last):
                continue
            cuts.append(at)
            start = y
        return cuts

    def _ends(self, text: str, stop: int, dots: str, y: int, span: tuple[int, int, int, bool] | None, start: int, last: int) -> bool:
        stop_at = text.find(" ", y)
        word = text[y : stop_at if stop_at > 0 else last]
        opening = span is not None and span[0] == start
        if span is not None and span[3] and opening:
            return True  # a sentence wholly in brackets
        if _is_lower(word) or word[0] in ",;:—–" or word in ("-", "--"):
            return False
        if span is not None and not span[3] and opening:
            cased = word.lower() != word.upper()
            if not cased and word[0].isalpha():
                return False  # scripts without case: the words that attribute it follow
            if dots[-1] in "?!" and cased:
                return not any(w.rstrip(",.") in ATTRIBUTION for w in text[y : y + 120].split(maxsplit=5)[1:5])
        if dots[0] == "." and len(dots) == 1:
            x = text[max(text.rfind(" ", 0, stop) + 1, start) : stop]
            return self.stop_ends(x, word) or span is not None and not span[3]
        return True


def _split_batches(known: dict[tuple[str, str], bool]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, no, start, end = [], [], [], []
            more = batch["more"].to_pylist() if "more" in batch.schema.names else [None] * batch.num_rows
            for i, ps, own in zip(batch["id"].to_pylist(), batch["paragraphs"].to_pylist(), more):
                texts = _texts(ps)
                if not texts:
                    continue
                splitter = Splitter(language(i), texts, known, dict(own) if own else None)
                for k, p in enumerate(ps):
                    if p:
                        for a, b in splitter.split(p):
                            ids.append(i)
                            no.append(k)
                            start.append(a)
                            end.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], schema=SENTENCES)

    return run


def _held_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lang, word): the words with a stop of each article, in the forms they are asked for."""
    for batch in batches:
        rows = set()
        for i, ps in zip(batch["id"].to_pylist(), batch["paragraphs"].to_pylist()):
            for t in _texts(ps):
                for m in _STOPPED.finditer(t):
                    x = _word(m[1])
                    rows.update((i, w) for w in (x, x[2:]) if w)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([language(r[0]) for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["id", "lang", "word"])


def split_sentences(articles: DataFrame, known: dict[tuple[str, str], bool] | None = None, most: int = MOST_ABBREVIATIONS) -> DataFrame:
    """(id, para_no, start_pos, end_pos) of every sentence; known: the collection's abbreviations, else learned here.
    Abbreviations beyond `most` are joined to the articles that hold them: the result doesn't depend on `most`."""
    spark: SparkSession = articles.sparkSession
    documents = distinct_articles(articles, ("paragraphs",))
    if known is None:
        learned = written(abbreviation_table(_evidence_of_distinct(documents)), "abbreviations")
        known = {(r.lang, r.word): r.ends for r in learned.orderBy(F.desc("n"), "lang", "word").limit(most).collect()}
        if len(known) == most:
            sent = spark.createDataFrame(list(known), "lang string, word string")
            rest = learned.join(F.broadcast(sent), ["lang", "word"], "left_anti").select("lang", "word", "ends")
            held = documents.mapInArrow(_held_words, "id string, lang string, word string").join(rest, ["lang", "word"])
            more = held.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("word", "ends"))).alias("more"))
            documents = documents.join(more, "id", "left")
    shared = spark.sparkContext.broadcast(known)
    run = lambda batches: _split_batches(shared.value)(batches)
    return documents.mapInArrow(run, "id string, para_no int, start_pos int, end_pos int")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "articles"))


def p1_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the collection shows about words with a stop: what answers where a document is silent."""
    return abbreviation_evidence(table(spark, sf_dir, "articles"))


QUERIES = {"p1_found": p1_found, "p1_abbreviations": p1_abbreviations}
__all__ = ["Splitter", "abbreviation_evidence", "abbreviations", "split_sentences"]
