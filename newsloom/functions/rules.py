"""Ordered rewrite rules, as data. Patterns keep to what both Java and RE2 regular expressions know.

Each rule is (pattern, replacement); the replacement names groups \\1, \\2 and so on. Patterns that begin with (?i)
ignore case. Fixed values: the patterns must equal those of the established cleaning pipeline for equal results;
where a pattern was rewritten, it accepts the same one-line texts in linear time.
"""

WHITE = [
    (r"\s+\n", " "),
    (r"\t", " "),
    (r"(\S+)\n", r"\1 "),
    (r"\s+", " "),
]

# Fixed values, in order: tag lines, web and mail addresses.
TAGLINES = [
    (r"(?i)^.*top news stories.*$", ""),
    (r"(?i)^\s*on the net.*$", ""),
    (r"(?i).{0,50}e-?mail address is.{0,100}", ""),
    (r"(?i)^\s*e-?mail.{0,100}", ""),
    (r"(?i)^\s*\(e-?mail.{0,100}\)", ""),
    (r"(?i)\.\s*e-?mail.{0,100}", "."),
    (r"(?i)^\s*story filed by.{0,100}", ""),
    (r"(?i)^\s*for use by.{0,100}", ""),
    (r"(?i)^\s*photos and graphics.{0,100}", ""),
    (r"(?i)\s*phone:.{0,100}", ""),
    (r"(?i)\s*pager:.{0,100}", ""),
    (r"(?i)^\s*technical problems.{0,100}", ""),
    (r"(?i)^\s*questions or.{0,100}", ""),
    (r"(?i)^\s*With photo\s*(\w+\s*){0,5}\.?", ""),
    (r"(?i)^\s*With photo.", ""),
    (r"^https?://\S*$", ""),
    (r"www.{4,100}$", ""),
    (r"https?://www.{4,100}$", ""),
    (r"^\s*[A-Z|\-|\s]{2,50} \(Undated\)\s*", ""),
    (r"\s+\.\s+\.\s+\.", "."),
    (r"\(\s*\)", ""),
    (r"(?i)^\s*(SOURCES:)+\s*(\w+\s*){0,6},?\sstaff reporting.?", ""),
    (r"(?i),?\sstaff reporting.?", ""),
    (r"(?i)^By [\w+] ([\w+])? ([\w+])?.$", ""),
    (r"(?i)The Washington Post [a-zA-z|\s]*\.", ""),
    (r"(?i)Associated Press Writers [a-zA-z|\s|;|\.]*$", ""),
]

# Fixed values, in order: datelines.
DATELINES = [
    (r"^.{0,50}\(AP\) (--)*", ""),
    (r"^[A-Z]{2,}[,|\w|\d|\s]*\(\w+\)\s*--", ""),
    (r"^[A-Z|\-|\.|,|\s]{2,50}\s+[A-Z|a-z|\.]{0,50}\s+--", ""),
    (r"^.{0,50}\(JP\):? (--)*", ""),
    (r"^[A-Z|\-|\.|\s]{2,100}\(.+\)\s*_", ""),
    (r"^\s*_+", ""),
    (r"^[A-Z]{2,}[A-Z |\w|,|\.]*_", ""),
    (r"^[A-Z]{0,50} --", ""),
    (r"^\([A-Za-z]{0,50}\)--", ""),
    (r".{0,10}\(JP\):\s?", ""),
]

# Fixed values, in order: slugs and leftovers.
JUNK = [
    (r"^\s*\(?[A-Za-z]{2}/[A-Za-z0-9]{2,4}\)?$", ""),
    (r"^\s*\(?[a-z]{2}\-[a-z0-9]{2,3}\s?(/[a-z]{2,3})?\)?$", ""),
    (r"^\s*[a-z]{2}[0-9]{2}$", ""),
    (r"^\s*nn\s*$", ""),
    (r"^[\s-]*-[\s-]*$", ""),
    (r"^\.+$", ""),
    (r"[A-Z|a-z]*-[A-Z|a-z]*-[A-Z|a-z]*-[A-Z|a-z]*\s+", ""),
    (r"\( \) --", ""),
    (r"\s+_\s+", ""),
]

# Fixed values, in order: desk markers.
MARKERS = [
    (r"(?i)^\s*with\s*[\w | -]{0,50}.?$", ""),
    (r"(?i)^[\w|\s]*NewsBrief by.{0,100}$", ""),
    (r"^ENDIT$", ""),
    (r"^\(Begin optional trim\)$", ""),
    (r"^\(Optional add end\)$", ""),
    (r"^\(STORY CAN END HERE. OPTIONAL MATERIAL FOLLOWS\)$", ""),
    (r"[\w]* Not Otherwise Specified", "not otherwise specified"),
    (r"([\w]*)\s?\([A-Z]{2,4}\)\s?", r"\1 "),
]

# Fixed values, in order: quotation marks.
QUOTES = [
    (r"([^`])`([^`])", r"\1'\2"),
    (r"'''", "'\""),
    (r"``", '"'),
    (r"''", '"'),
    (r",\s([\"|'])\s", r",\1 "),
    (r"!\"( \w+)", r'!", \1 '),
]
NO_QUOTES = [
    (r"\"", ""),
    (r"\s'([A-Z|a-z])", r" \1"),
    (r"([A-Z|a-z])'\s", r"\1 "),
]

# Fixed values, in order: attributions at the end of a sentence, then in its middle.
ATTRIBUTIONS = [
    (r"(?i), citing [\s|a-zA-Z]+\.$", "."),
    (r", [a-zA-Z]* said\.$", "."),
    (r", [a-zA-Z]*\s([a-zA-Z]*\s)?([a-zA-Z]*\s)?said\.$", "."),
    (r", [a-zA-Z]* said today\.$", "."),
    (r", said [a-zA-Z]*\.$", "."),
    (r", [a-zA-Z]* press reported today\.$", "."),
    (r", [a-zA-Z]* reported\.$", "."),
    (r", [a-zA-Z]* reported today\.$", "."),
    (r", reported [a-zA-Z]*\.$", "."),
    (r", [a-zA-Z]* reports\.$", "."),
    (r", reports [a-zA-Z]*\.$", "."),
    (r"(?i), according to[\s|a-zA-Z]+\.$", "."),
    (r", (\w*\s+){1,2}said,", ""),
]

# Conjunctions and adverbs that may open a sentence and be cut, a closed class in place of a tagger.
OPENERS = "and|but|or|nor|yet|also|however|meanwhile|moreover|furthermore|then|still|thus|therefore|instead|besides|again|perhaps|indeed|[A-Za-z]+ly"
TRIM = [
    (rf"^((?:(?i:{OPENERS}))\s*,?\s+)+", ""),
    (r"\s+--\s+", "--"),
    (r"^-- ", ""),
    (r"^- ", ""),
    (r"^; ", ""),
    (r"^A: ", ""),
]

# What a token worth counting doesn't contain, then what it doesn't match.
NEVER_IN_TOKEN = ["--", "~", "$", "..", "(", ")", "|", "%", "\\", "/", "^", "@", "#", "!", "+", ",", ";", ":", "{", "}"]
NEVER_MATCHED = [r"[A-Z|a-z]+[0-9]{2,}", r"-", r"\s", r"\..*\.", r"^\d*\.", r"^\d"]

# Tokens like a number or an address: number words, and ends of addresses without the marks above.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion".split()
LIKE_ADDRESS = r"(?i)^www\.|\w\.(?:com|org|net|edu|gov)$"

# Adverbs before a verb that open a sentence without naming its subject, a closed class in place of a tagger.
OPENING_ADVERBS = ["here", "now", "then", "thus", "so", "only", "also", "still"]
OPENING_VERBS = ["is", "has", "does", "comes", "goes", "says", "seems", "remains", "stands", "lies", "begins", "ends"]
# Openings that keep a sentence although they begin with a pronoun.
KEPT_OPENINGS = ["there are", "there 're", "there is", "there 's", "it is", "it 's", "it has", "it was", "this is", "that 's", "that is"]
# Pronouns and determiners that open a sentence without naming its subject, a closed class in place of a parser.
PRONOUNS = ["he", "she", "it", "they", "we", "i", "you", "this", "that", "these", "those", "who", "there", "most", "some", "all", "none"]
# Weak first words of a summary.
WEAK_STARTS = ["He", "She", "It", "They", "That", "Those", "Some", "Since"]


# Closed classes in place of a parser: openers without a subject, signs of a finite verb, appositions.
BARE_OPENERS = ["according", "including", "citing", "see", "add", "call", "mail", "visit", "send", "note"]
FINITE = r"(?i)\b(?:is|are|was|were|be|been|has|have|had|do|does|did|will|would|can|could|may|might|must|shall|should|says?|said)\b|\w{2,}(?:ed|es|s)\b"
APPOSITIVES = [(r"([A-Z][\w'-]*), (?:an?|the) [^,.;!?]{1,80},", r"\1")]

#: What a text must hold for a rule to match: cheap to look for, where the rule itself tries many places or lengths.
NEEDS = {
    r"\s+\n": r"\n",
    r"(\S+)\n": r"\n",
    r"\s+": r"[\t\n\x0B\f\r]|  ",
    r"(?i)^.*top news stories.*$": r"(?i)top news stories",
    r"(?i).{0,50}e-?mail address is.{0,100}": r"(?i)mail address is",
    r"(?i)\.\s*e-?mail.{0,100}": r"(?i)\.\s*e-?mail",
    r"(?i)\s*phone:.{0,100}": r"(?i)phone:",
    r"(?i)\s*pager:.{0,100}": r"(?i)pager:",
    r"www.{4,100}$": r"www",
    r"https?://www.{4,100}$": r"://www",
    r"\s+\.\s+\.\s+\.": r"\s\.\s+\.\s+\.",
    r"(?i),?\sstaff reporting.?": r"(?i)staff reporting",
    r"(?i)Associated Press Writers [a-zA-z|\s|;|\.]*$": r"(?i)associated press writers",
    r"^.{0,50}\(AP\) (--)*": r"\(AP\) ",
    r"^.{0,50}\(JP\):? (--)*": r"\(JP\)",
    r".{0,10}\(JP\):\s?": r"\(JP\):",
    r"[A-Z|a-z]*-[A-Z|a-z]*-[A-Z|a-z]*-[A-Z|a-z]*\s+": r"-[A-Z|a-z]*-[A-Z|a-z]*-[A-Z|a-z]*\s",
    r"\s+_\s+": r"\s_\s",
    r"[\w]* Not Otherwise Specified": r" Not Otherwise Specified",
    r"([\w]*)\s?\([A-Z]{2,4}\)\s?": r"\([A-Z]{2,4}\)",
    r"([^`])`([^`])": r"`",
}

#: Each group of cleaning rules with what a text must hold for any rule of the group to match.
GROUPS = [
    (r"[\t\n\x0B\f\r]|  ", WHITE),
    (r"(?i)top news|on the net|mail|filed by|for use by|photo|phone:|pager:|technical|questions|http|www|\(undated\)|\s\.\s+\.|\(\s*\)|staff reporting|^by |washington post|associated press", TAGLINES),
    (r"\((?:AP|JP)\)|--|_", DATELINES),
    (r"-|_|/|^\.|^\s*nn\s*$|^\s*[a-z]{2}[0-9]{2}$", JUNK),
    (r"(?i)^\s*with|newsbrief|^endit$|optional|not otherwise|\([a-z]{2,4}\)", MARKERS),
    (r"[`'\"]", QUOTES),
]
QUOTE_GUARD = r"[\"']"


def cleaning(remove_quotes: bool = False) -> list[tuple[str, str]]:
    """All cleaning rules in order."""
    return WHITE + TAGLINES + DATELINES + JUNK + MARKERS + QUOTES + (NO_QUOTES if remove_quotes else []) + WHITE
