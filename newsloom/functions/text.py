"""Text functions as Column builders; the same rules as SQL text for the checks."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import rules


def rewrite(text: Column, steps: list[tuple[str, str]]) -> Column:
    """Applies rules in order with the JVM's regular expressions."""
    for pattern, replacement in steps:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(re.sub(r"\\(\d)", r"$\1", replacement)))
    return text


def rewrite_sql(text: str, steps: list[tuple[str, str]]) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern, replacement in steps:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(replacement)}, 'g')"
    return text


def clean_all(texts: Column, remove_quotes: bool = False) -> Column:
    """Cleans every text of an array. A group of rules is skipped where none of it can match, and in a group each rule
    with an entry in NEEDS; the text is a lambda variable, so the chain stays as long as the list of rules."""
    groups = rules.GROUPS + ([(rules.QUOTE_GUARD, rules.NO_QUOTES)] if remove_quotes else []) + [rules.GROUPS[0]]
    for guard, steps in groups:
        texts = F.transform(texts, lambda t: F.when(t.rlike(guard), _in_turn(F.array(t), steps)[0]).otherwise(t))
    return F.transform(texts, lambda t: F.trim(t))


def _in_turn(texts: Column, steps: list[tuple[str, str]]) -> Column:
    """Rules one after the other; those without an entry in NEEDS that follow each other are one expression."""
    for need, run in itertools.groupby(steps, lambda step: rules.NEEDS.get(step[0])):
        rest = list(run)
        if need:
            texts = F.transform(texts, lambda t: F.when(t.rlike(need), rewrite(t, rest)).otherwise(t))
        else:
            texts = F.transform(texts, lambda t: rewrite(t, rest))
    return texts


def clean_text(text: Column, remove_quotes: bool = False) -> Column:
    return clean_all(F.array(text), remove_quotes)[0]


MARK = "\x01"
STOP = r'([.;!]"?)\s+'


def split_sentences(paragraph: Column) -> Column:
    """Sentences of a cleaned paragraph: ends at . ; ! and a blank, but not inside double quotation marks."""
    pieces = F.split(F.regexp_replace(paragraph, F.lit(STOP), F.lit("$1" + MARK)), MARK)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, piece: Column) -> Column:
        joined = F.when(acc["open"] == "", piece).otherwise(F.concat(acc["open"], F.lit(" "), piece))
        odd = (F.length(joined) - F.length(F.replace(joined, F.lit('"'), F.lit("")))) % 2 == 1
        return F.struct(F.when(odd, acc["done"]).otherwise(F.concat(acc["done"], F.array(joined))).alias("done"), F.when(odd, joined).otherwise(F.lit("")).alias("open"))

    merged = F.aggregate(pieces, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return F.filter(F.transform(merged, lambda s: F.trim(s)), lambda s: s != "")


def words_in(text: Column) -> Column:
    """Number of blank-separated words."""
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+"))).cast("long")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def contains_quote(text: Column) -> Column:
    """Has a double quotation mark that isn't a pair around one to three words inside a sentence."""
    return F.contains(text, F.lit('"')) & ~text.rlike(r'\w "\w+( \w+){0,2}" \w')


def countworthy(token: Column, stop_words: list[str]) -> Column:
    """A token worth counting. Literal tests come first, they are cheaper."""
    bad = F.lit(False)
    for s in rules.NEVER_IN_TOKEN:
        bad = bad | F.contains(token, F.lit(s))
    bad = bad | F.lower(token).isin(rules.NUMBER_WORDS) | token.rlike(rules.LIKE_ADDRESS)
    bad = bad | token.rlike("|".join(rules.NEVER_MATCHED)) | token.rlike(r"(\w)\1{2,}") | ~token.rlike(r"[\p{L}\p{N}]")
    return ~(bad | F.lower(token).isin(stop_words)) if stop_words else ~bad


def first_words(text: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.slice(F.split(text, " "), 1, 2)))


def opens_with_pronoun(text: Column) -> Column:
    """Begins with a pronoun, unless it is one of the openings that are kept, or with an adverb before a verb."""
    first = F.lower(F.regexp_extract(text, r"^\W*(\w+)", 1))
    second = F.lower(F.regexp_extract(text, r"^\W*\w+ (\w+)", 1))
    return (first.isin(rules.PRONOUNS) & ~first_words(text).isin(rules.KEPT_OPENINGS)) | (first.isin(rules.OPENING_ADVERBS) & second.isin(rules.OPENING_VERBS))


def lacks_subject(text: Column) -> Column:
    """Begins with a bare verb, or has no word that could be a subject's verb: a guess in place of a parser."""
    first = F.lower(F.regexp_extract(text, r"^\W*(\w+)", 1))
    return first.isin(rules.BARE_OPENERS) | ~text.rlike(rules.FINITE)


def remove_appositives(text: Column) -> Column:
    """Takes out ", a ..., " after a capitalised word: a guess in place of a parser."""
    return rewrite(text, rules.APPOSITIVES)


def trim_sentence(text: Column) -> Column:
    return rewrite(text, rules.TRIM)


def remove_attribution(text: Column) -> Column:
    return rewrite(text, rules.ATTRIBUTIONS)


def clean_up(text: Column) -> Column:
    """First word capitalised (its rest in lower case), single blanks, none before . ? ! and commas."""
    words = F.split(F.trim(text), r"\s+")
    first = F.concat(F.upper(F.substring(words[0], 1, 1)), F.lower(F.substring(words[0], 2, 1_000_000)))
    rest = F.array_join(F.slice(words, 2, 1_000_000), " ")
    joined = F.when(F.size(words) > 1, F.concat(first, F.lit(" "), rest)).otherwise(first)
    return F.regexp_replace(F.regexp_replace(joined, "  +", " "), r" +([.?!,])", "$1")


def overlap_words(text: Column) -> Column:
    """Lower-cased pieces between blanks and hyphens of the text without its last character."""
    return F.split(F.lower(F.regexp_replace(text, "(?s).$", "")), "[ -]")


def unlikely_first_word(text: Column) -> Column:
    """Penalty of the first word: 10 for a weak start, 5 for a part of "The"."""
    first = F.split(F.trim(text), r"\s+")[0]
    return F.when(first.isin(rules.WEAK_STARTS), 10).when(F.instr(F.lit("The"), first) > 0, 5).otherwise(0)
