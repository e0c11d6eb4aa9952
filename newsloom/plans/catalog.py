"""All queries of the core by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.config import Config, NgramConfig, OrderingConfig, RealizationConfig
from newsloom.functions import rules
from newsloom.functions import text as T
from newsloom.operators import lexrank, ngram, order, realize, rouge, segment, stats, topics, vectors
from newsloom.operators.storage import written
from newsloom.plans import pipeline as P
from newsloom.sources import files, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | Callable[[], str] | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- SQL building blocks ---------------------------------------------------------------------------------------

DOCS = "docs AS (SELECT id, any_value(date) AS date, any_value(headline) AS headline, any_value(paragraphs) AS ps FROM articles WHERE id IS NOT NULL GROUP BY id)"
DOCSET = "docset AS (SELECT DISTINCT topic_id, full_article_id AS id FROM article_queries WHERE topic_id IS NOT NULL AND full_article_id IS NOT NULL)"
TOPICS = "tp AS (SELECT id AS topic_id, max(title) AS title, max(narrative) AS narrative FROM topics WHERE id IS NOT NULL GROUP BY id)"


def clean_sql(x: str, remove_quotes: bool = False) -> str:
    return f"trim({T.rewrite_sql(x, rules.cleaning(remove_quotes))})"


def n_words_sql(x: str) -> str:
    return f"CASE WHEN trim({x}) = '' THEN 0 ELSE len(regexp_split_to_array(trim({x}), '\\s+')) END"


PARAS = f"""{DOCS},
cl AS (SELECT id, date, list_filter(list_transform(list_filter(ps, lambda x: x IS NOT NULL), lambda x: {clean_sql("x")}), lambda x: x <> '') AS c FROM docs),
paras AS (SELECT id, date, i - 1 AS para_idx, c[i] AS text FROM (SELECT id, date, c, unnest(range(1, len(c) + 1)) AS i FROM cl))"""
SENTS = f"""{PARAS},
pieces AS (SELECT id, date, para_idx, i, ls[i] AS piece FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT id, date, para_idx, string_split(regexp_replace(text, '([.;!]"?)\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ls FROM paras))),
par AS (SELECT *, coalesce(sum(length(piece) - length(replace(piece, '"', ''))) OVER (PARTITION BY id, para_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS odd FROM pieces),
grp AS (SELECT *, sum(CASE WHEN odd = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id, para_idx ORDER BY i) AS g FROM par),
s0 AS (SELECT id, any_value(date) AS date, para_idx, g, trim(string_agg(piece, ' ' ORDER BY i)) AS text FROM grp GROUP BY id, para_idx, g),
sents AS (SELECT id, date, para_idx, row_number() OVER (PARTITION BY id ORDER BY para_idx, g) - 1 AS sent_index, text, ({n_words_sql("text")})::BIGINT AS n_words FROM s0 WHERE text <> '')"""
TOKS = f"""{SENTS}, sw AS (SELECT list(DISTINCT word) AS ws FROM common_words),
toks AS (SELECT id, date, sent_index, text, n_words, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda t: NOT list_contains(ws, t)) AS t FROM sents, sw)"""


#: Sentences and headlines (sent_index -1) of articles.
ATOKS = f"""atoks AS (SELECT id, sent_index, text, t FROM toks UNION ALL SELECT id, -1, text, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda t: NOT list_contains(ws, t)) FROM (SELECT id, {clean_sql("headline")} AS text FROM docs WHERE headline IS NOT NULL), sw WHERE text <> '')"""


def grams_sql(n: int) -> str:
    parts = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
    return f"list_transform(range(1, len(t) - {n - 2}), lambda i: {parts})"


def probs_sql(n: int) -> str:
    extra = {1: "+ count(*)", 2: "", 3: "- count(*)"}[n]
    return f"""c{n} AS (SELECT id, unnest({grams_sql(n)}) AS gram FROM toks),
z{n} AS (SELECT topic_id, sum(m) {extra} AS total FROM (SELECT id, sum(len(t) - {n - 1}) AS m FROM toks GROUP BY id) JOIN docset USING (id) GROUP BY topic_id),
p{n} AS (SELECT topic_id, gram, cnt, cnt / nullif(total, 0)::DOUBLE AS p FROM (SELECT topic_id, gram, count(*) AS cnt FROM c{n} JOIN docset USING (id) GROUP BY topic_id, gram) JOIN z{n} USING (topic_id))"""


def gram_score_sql(n: int) -> str:
    return f"""g{n} AS (SELECT topic_id, id, sent_index, sum(p) / any_value(len(t)) AS s{n} FROM (SELECT id, sent_index, t, unnest({grams_sql(n)}) AS gram FROM toks) JOIN docset USING (id) JOIN p{n} USING (topic_id, gram) GROUP BY topic_id, id, sent_index)"""


SCORED = f"""{TOKS}, {DOCSET}, {probs_sql(1)}, {probs_sql(2)}, {gram_score_sql(1)}, {gram_score_sql(2)},
scored AS (SELECT topic_id, id, sent_index, text, n_words, round(0.2::DOUBLE * coalesce(s1, 0) + 0.9::DOUBLE * coalesce(s2, 0), 9) AS score
 FROM toks JOIN docset USING (id) LEFT JOIN g1 USING (topic_id, id, sent_index) LEFT JOIN g2 USING (topic_id, id, sent_index))"""
QUOTED = """(contains(text, '"') AND NOT regexp_matches(text, '\\w "\\w+( \\w+){0,2}" \\w'))"""
def _listed(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


PRONOUN = rf"""((lower(regexp_extract(text, '^\W*(\w+)', 1)) IN ({_listed(rules.PRONOUNS)}) AND lower(array_to_string(string_split(text, ' ')[1:2], ' ')) NOT IN ({_listed(rules.KEPT_OPENINGS)}))
 OR (lower(regexp_extract(text, '^\W*(\w+)', 1)) IN ({_listed(rules.OPENING_ADVERBS)}) AND lower(regexp_extract(text, '^\W*\w+ (\w+)', 1)) IN ({_listed(rules.OPENING_VERBS)})))"""
REMOVABLE = f"({QUOTED} OR right(text, 1) NOT IN ('.', ';') OR contains(text, '?') OR n_words < 4 OR {PRONOUN})"
CAND = f"""{SCORED},
cand AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, id, sent_index) AS rk, sum(n_words) OVER (PARTITION BY topic_id) AS w FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, id, sent_index) <= 20))"""
IDF = f"""tf AS (SELECT id, word, count(*) AS cnt FROM (SELECT id, unnest(t) AS word FROM toks) GROUP BY id, word),
idf AS (SELECT word, count(*) AS df, ln((SELECT count(DISTINCT id) FROM tf) / count(*)::DOUBLE) AS idf FROM tf GROUP BY word)"""
TQ = f"""{TOPICS}, tq AS (SELECT topic_id, list_filter(regexp_extract_all(lower({clean_sql("coalesce(narrative, title)")}), '[\\p{{L}}\\p{{N}}]+'), lambda t: NOT list_contains(ws, t)) AS q FROM tp, sw WHERE coalesce(narrative, title) IS NOT NULL)"""
LEADS = f"""{DOCS}, {DOCSET}, sm AS (SELECT substr(name, 1, 5) || split_part(name, '.', 4) AS topic_id, name AS peer_id, string_agg(sentence, ' ' ORDER BY line_no) AS text FROM summaries GROUP BY name),
lead AS (SELECT topic_id, id AS model_id, array_to_string(list_filter(ps, lambda x: x IS NOT NULL), ' ') AS text FROM docs JOIN docset USING (id)),
pe AS (SELECT topic_id, peer_id, regexp_extract_all(lower(array_to_string(regexp_split_to_array(trim(text), '\\s+')[1:100], ' ')), '[\\p{{L}}\\p{{N}}]+') AS t FROM sm),
mo AS (SELECT topic_id, model_id, regexp_extract_all(lower(array_to_string(regexp_split_to_array(trim(text), '\\s+')[1:100], ' ')), '[\\p{{L}}\\p{{N}}]+') AS t FROM lead)"""


def rouge_sql(n: int) -> str:
    return f"""{LEADS}, pc AS (SELECT topic_id, peer_id, g, count(*) AS cp FROM (SELECT topic_id, peer_id, unnest({grams_sql(n)}) AS g FROM pe) GROUP BY ALL),
mc AS (SELECT topic_id, model_id, g, count(*) AS cm FROM (SELECT topic_id, model_id, unnest({grams_sql(n)}) AS g FROM mo) GROUP BY ALL),
h AS (SELECT topic_id, peer_id, model_id, sum(least(cp, cm))::DOUBLE AS hits FROM mc JOIN pc USING (topic_id, g) GROUP BY ALL),
sz AS (SELECT topic_id, peer_id, model_id, greatest(len(mo.t) - {n - 1}, 0) AS nm, greatest(len(pe.t) - {n - 1}, 0) AS np FROM mo JOIN pe USING (topic_id)),
sc AS (SELECT topic_id, peer_id, model_id, coalesce(coalesce(hits, 0) / nullif(nm, 0), 0) AS r, coalesce(coalesce(hits, 0) / nullif(np, 0), 0) AS p, coalesce(2 * coalesce(hits, 0) / nullif(nm + np, 0), 0) AS f FROM sz LEFT JOIN h USING (topic_id, peer_id, model_id))"""


# ---- sources and routing ---------------------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT id, try_strptime(nullif(regexp_extract(id, '^[^0-9]*(\\d{{8}})', 1), ''), '%Y%m%d')::DATE AS date FROM docs")
def article_dates(spark: SparkSession, d: str) -> DataFrame:
    return tables.articles(spark, d).select("id", tables.article_date(F.col("id")).alias("date"))


@query(f"WITH {DOCS} SELECT id, coalesce(array_to_string(list_filter(ps, lambda x: x IS NOT NULL), ' '), '') AS text FROM docs")
def raw_text(spark: SparkSession, d: str) -> DataFrame:
    return tables.articles(spark, d).select("id", F.coalesce(F.array_join("paragraphs", " "), F.lit("")).alias("text"))


_ID = """SELECT DISTINCT id, split_part(id, '.', 2) AS article_id, CASE WHEN contains(h, '_') THEN split_part(h, '_', 1) ELSE regexp_extract(h, '^([^0-9]*)', 1) END AS journal_id,
 CASE WHEN contains(h, '_') THEN split_part(h, '_', 2) ELSE 'ENG' END AS language, CASE WHEN contains(h, '_') THEN split_part(h, '_', 3) ELSE regexp_extract(h, '^[^0-9]*(.*)$', 1) END AS file_id
 FROM (SELECT full_article_id AS id, split_part(full_article_id, '.', 1) AS h FROM article_queries WHERE full_article_id IS NOT NULL)"""


@query(f"SELECT *, try_cast(substr(file_id, 1, 4) AS INTEGER) AS year FROM ({_ID})")
def article_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = tables.table(spark, d, "article_queries").where("full_article_id is not null").select(F.col("full_article_id").alias("id")).distinct()
    return ids.select("id", *(c.alias(n) for n, c in tables.parse_id(F.col("id")).items()))


_YEARS = "cy AS (SELECT y AS year, arg_max(corpus, rank) AS corpus FROM (SELECT unnest(range(lo, hi + 1)) AS y, corpus, rank FROM (VALUES ('A', 0, 1996, 2000), ('B', 1, 2004, 2006), ('C', 2, 2006, 2008)) v(corpus, rank, lo, hi)) GROUP BY y)"
_ROUTED = f"""{DOCSET}, ids AS ({_ID}), {_YEARS}, routed AS (SELECT topic_id, docset.id, journal_id, file_id, year, corpus, CASE corpus
 WHEN 'A' THEN lower(journal_id) || '/' || substr(file_id, 1, 4) || '/' || file_id || '_' || CASE WHEN journal_id = 'XIE' THEN 'XIN' ELSE journal_id END || CASE WHEN journal_id = 'NYT' THEN '' ELSE '_ENG' END
 ELSE lower(journal_id) || '_eng/' || lower(journal_id) || '_eng_' || substr(file_id, 1, 6) || CASE corpus WHEN 'B' THEN '.xml' ELSE '.gz' END END AS path
 FROM docset JOIN ids USING (id) JOIN cy ON cy.year = try_cast(substr(file_id, 1, 4) AS BIGINT))"""


@query(f"WITH {_ROUTED} SELECT topic_id, id, corpus, path FROM routed")
def corpus_routing(spark: SparkSession, d: str) -> DataFrame:
    return tables.routed(tables.docset(spark, d), spark).select("topic_id", "id", "corpus", "path")


@query(f"WITH {_ROUTED} SELECT path, count(*) AS n_queries, count(DISTINCT id) AS n_articles FROM routed GROUP BY path")
def queries_by_file(spark: SparkSession, d: str) -> DataFrame:
    return tables.routed(tables.docset(spark, d), spark).groupBy("path").agg(F.count("*").alias("n_queries"), F.count_distinct("id").alias("n_articles"))


@query(f"""WITH {_ROUTED}, q AS (SELECT topic_id, full_article_id AS id, row_number() OVER () AS place FROM article_queries)
SELECT path, id, arg_max(topic_id, place) AS topic_id FROM routed JOIN q USING (topic_id, id) GROUP BY path, id""")
def docset_strict(spark: SparkSession, d: str) -> DataFrame:
    return tables.last_topic_of_file(tables.routed(tables.asked_in_order(spark, d), spark))


@query(f"WITH {DOCS}, {DOCSET} SELECT topic_id, id, date, coalesce(len(ps), 0)::BIGINT AS n_paragraphs FROM docs JOIN docset USING (id)")
def topic_articles(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.size(F.col("paragraphs")), F.lit(0))
    return tables.articles(spark, d).select("id", "date", F.greatest(n, F.lit(0)).cast("long").alias("n_paragraphs")).join(tables.docset(spark, d), "id").select("topic_id", "id", "date", "n_paragraphs")


@query(f"WITH {DOCSET} SELECT DISTINCT id FROM docset WHERE id NOT IN (SELECT id FROM articles WHERE id IS NOT NULL)")
def missing_articles(spark: SparkSession, d: str) -> DataFrame:
    return tables.docset(spark, d).select("id").distinct().join(tables.table(spark, d, "articles").select("id"), "id", "left_anti")


@query("SELECT name, string_agg(sentence, chr(10) ORDER BY line_no) AS content FROM summaries GROUP BY name")
def summary_files(spark: SparkSession, d: str) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "sentence"))), lambda s: s["sentence"]), "\n")
    return tables.table(spark, d, "summaries").groupBy("name").agg(body.alias("content"))


@query("""WITH n AS (SELECT DISTINCT name FROM summaries), m AS (SELECT name FROM n UNION ALL SELECT replace(name, '.A.1', '.A.2') FROM n)
SELECT p.name AS peer, m.name AS model FROM n p JOIN m ON contains(m.name, substr(p.name, 1, length(p.name) - 2))""")
def rouge_config_pairs(spark: SparkSession, d: str) -> DataFrame:
    names = tables.table(spark, d, "summaries").select("name").distinct()
    return files.rouge_pairs(names, names.unionByName(names.select(F.replace("name", F.lit(".A.1"), F.lit(".A.2")).alias("name"))))


_REPORT = """l AS (SELECT name AS report, line_no + 1 AS line_no, sentence AS line FROM summaries
 UNION ALL SELECT DISTINCT name, 0, '---' FROM summaries UNION ALL SELECT DISTINCT name, 3, '...' FROM summaries WHERE name LIKE '%1.%')"""


@query(f"""WITH {_REPORT}, m AS (SELECT *, max(CASE WHEN line LIKE '---%' THEN line_no END) OVER w AS a, max(CASE WHEN line LIKE '...%' THEN line_no END) OVER w AS b FROM l WINDOW w AS (PARTITION BY report ORDER BY line_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT report, line_no::BIGINT AS line_no, line FROM m WHERE a IS NOT NULL AND (b IS NULL OR b < a) AND NOT (line_no = 3 AND report LIKE '%1.%' AND line <> '...')""")
def report_slice(spark: SparkSession, d: str) -> DataFrame:
    s = tables.table(spark, d, "summaries")
    mark = lambda no, text, cond: s.where(cond).select("name").distinct().select("name", F.lit(no).alias("line_no"), F.lit(text).alias("line"))
    lines = s.where("not (line_no + 1 = 3 and name like '%1.%')").select("name", (F.col("line_no") + 1).alias("line_no"), F.col("sentence").alias("line"))
    lines = lines.unionByName(mark(0, "---", "true")).unionByName(mark(3, "...", "name like '%1.%'"))
    return rouge.report_slice(lines.select(F.col("name").alias("report"), F.col("line_no").cast("long").alias("line_no"), "line"))


# ---- cleaning and segmentation ---------------------------------------------------------------------------------


@query(f"WITH {PARAS} SELECT id, para_idx, text FROM paras")
def clean_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return segment.paragraphs(tables.articles(spark, d))


@query(f"WITH {DOCS} SELECT id, {clean_sql("coalesce(array_to_string(list_filter(ps, lambda x: x IS NOT NULL), ' '), '')", True)} AS text FROM docs")
def clean_articles(spark: SparkSession, d: str) -> DataFrame:
    return tables.articles(spark, d).select("id", T.clean_text(F.coalesce(F.array_join("paragraphs", " "), F.lit("")), True).alias("text"))


@query(f"WITH {SENTS} SELECT id, para_idx, sent_index, text, n_words FROM sents")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    return segment.sentences(tables.articles(spark, d)).drop("date")


@query(f"""WITH {DOCS}, {TOPICS}, r AS (SELECT id, 'article_headline' AS span_type, headline AS text FROM docs UNION ALL SELECT topic_id, 'topic_title', title FROM tp UNION ALL SELECT topic_id, 'narrative', narrative FROM tp)
SELECT id, span_type, {clean_sql("text")} AS text FROM r WHERE text IS NOT NULL AND {clean_sql("text")} <> ''""")
def typed_spans(spark: SparkSession, d: str) -> DataFrame:
    return segment.typed_spans(tables.articles(spark, d), tables.topics(spark, d))


@query(f"WITH {SENTS} SELECT id, sent_index, {QUOTED} AS quoted, {PRONOUN} AS pronoun, {REMOVABLE} AS removable FROM sents")
def removable_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = segment.sentences(tables.articles(spark, d))
    t = F.col("text")
    return s.select("id", "sent_index", T.contains_quote(t).alias("quoted"), T.opens_with_pronoun(t).alias("pronoun"), ngram.removable(t, F.col("n_words")).alias("removable"))


_NEVER = " OR ".join("contains(word, '{}')".format(x) for x in rules.NEVER_IN_TOKEN)
_SAME3 = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
_TERMS = f"""{DOCS}, ca AS (SELECT id, {clean_sql("coalesce(array_to_string(list_filter(ps, lambda x: x IS NOT NULL), ' '), '')", True)} AS text FROM docs),
rw AS (SELECT id, regexp_replace(unnest(string_split(text, ' ')), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') AS word FROM ca),
tm AS (SELECT id, word, count(*) AS cnt FROM rw WHERE NOT ({_NEVER} OR lower(word) IN ({_listed(rules.NUMBER_WORDS)}) OR regexp_matches(word, '{rules.LIKE_ADDRESS}') OR regexp_matches(word, '{"|".join(rules.NEVER_MATCHED)}') OR regexp_matches(word, '{_SAME3}') OR NOT regexp_matches(word, '[\\p{{L}}\\p{{N}}]')) AND lower(word) NOT IN (SELECT word FROM common_words) GROUP BY id, word)"""


@query(f"WITH {_TERMS} SELECT id, word, cnt FROM tm")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.article_terms(tables.articles(spark, d), P.stop_words(spark, d))


_DF = f"{_TERMS}, df AS (SELECT word, count(*) AS df FROM tm GROUP BY word), n AS (SELECT count(DISTINCT id) AS n FROM tm)"


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    return stats.document_frequencies(tables.articles(spark, d), P.stop_words(spark, d))


@query(f"WITH {_DF}, low AS (SELECT lower(word) AS word, arg_max(df, encode(word)) AS df FROM df GROUP BY lower(word)) SELECT word, df, round(ln(n / df::DOUBLE), 9) AS idf FROM low, n")
def idf(spark: SparkSession, d: str) -> DataFrame:
    return stats.idf_of(_frequencies(spark, d)).withColumn("idf", F.round("idf", 9))


@query(f"WITH {_DF}, low AS (SELECT lower(word) AS word, sum(df)::BIGINT AS df FROM df GROUP BY lower(word)) SELECT word, df, round(ln(n / df::DOUBLE), 9) AS idf FROM low, n")
def idf_merged(spark: SparkSession, d: str) -> DataFrame:
    return stats.idf_of(_frequencies(spark, d), "sum").withColumn("idf", F.round("idf", 9))


@query(f"""WITH {_TERMS}, {_YEARS}, yr AS (SELECT id, corpus FROM (SELECT id, try_cast(substr(CASE WHEN contains(h, '_') THEN split_part(h, '_', 3) ELSE regexp_extract(h, '^[^0-9]*(.*)$', 1) END, 1, 4) AS BIGINT) AS year FROM (SELECT id, split_part(id, '.', 1) AS h FROM docs)) JOIN cy USING (year)),
ct AS (SELECT corpus, id, word FROM tm JOIN yr USING (id)), nc AS (SELECT corpus, count(DISTINCT id) AS n FROM ct GROUP BY corpus), dc AS (SELECT corpus, word, count(*) AS df FROM ct GROUP BY ALL),
low AS (SELECT corpus, lower(word) AS word, arg_max(df, encode(word)) AS df FROM dc GROUP BY ALL) SELECT corpus, word, df, round(ln(n / df::DOUBLE), 9) AS idf FROM low JOIN nc USING (corpus)""")
def idf_by_corpus(spark: SparkSession, d: str) -> DataFrame:
    years = tables.articles(spark, d).withColumn("year", tables.parse_id(F.col("id"))["year"]).join(F.broadcast(tables.corpus_by_year(spark)), "year")
    counts = stats.document_frequencies(years, P.stop_words(spark, d), ["corpus"])
    return stats.idf_of(counts, group=["corpus"]).withColumn("idf", F.round("idf", 9))


@query(f"WITH {_TERMS} SELECT word, row_number() OVER (ORDER BY encode(word)) - 1 AS number FROM (SELECT DISTINCT word FROM tm)")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return stats.vocabulary(token_counts(spark, d))


@query(f"WITH {TOKS}, {IDF} SELECT id, sent_index, round(avg(idf), 6) AS mean_idf FROM (SELECT id, sent_index, unnest(t) AS word FROM toks) JOIN idf USING (word) GROUP BY id, sent_index")
def mean_idf(spark: SparkSession, d: str) -> DataFrame:
    tok = P.tokens(spark, d)
    return stats.mean_idf(tok, P.term_idf(tok)).withColumn("mean_idf", F.round("mean_idf", 6))


@query(f"""WITH {TOKS}, {ATOKS}, {IDF}, {DOCSET}, {TOPICS}, sp AS (SELECT topic_id, unnest([title, narrative]) AS text FROM tp WHERE topic_id IN (SELECT topic_id FROM docset)),
st AS (SELECT topic_id, list_filter(regexp_extract_all(lower({clean_sql("text")}), '[\\p{{L}}\\p{{N}}]+'), lambda t: NOT list_contains(ws, t)) AS t FROM sp, sw WHERE text IS NOT NULL),
al AS (SELECT topic_id, unnest(t) AS word FROM atoks JOIN docset USING (id) UNION ALL SELECT topic_id, unnest(t) FROM st)
SELECT topic_id, word, count(*) AS cnt FROM al WHERE word IN (SELECT word FROM idf) GROUP BY topic_id, word""")
def local_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    tok = P.tokens(spark, d, headlines=True)
    spans = P.span_tokens(tables.topics(spark, d), P.stop_words(spark, d))
    return stats.local_vocabulary(tok, tables.docset(spark, d), P.term_idf(tok), spans)


# ---- n-gram scores ---------------------------------------------------------------------------------------------


def _probabilities(n: int):
    def f(spark: SparkSession, d: str) -> DataFrame:
        return ngram.probabilities(P.tokens(spark, d), tables.docset(spark, d), n).withColumn("p", F.round("p", 9))

    f.__name__ = {1: "unigram_probs", 2: "bigram_probs", 3: "trigram_probs"}[n]
    return query(f"WITH {TOKS}, {DOCSET}, {probs_sql(n)} SELECT topic_id, gram, cnt, round(p, 9) AS p FROM p{n}")(f)


for _n in (1, 2, 3):
    _probabilities(_n)

_PAIR_LIST = "flatten(list_transform(t, lambda a: list_transform(list_filter(t, lambda b: b <> a), lambda b: b || ' ' || a)))"
_PAIRS = f"pr AS (SELECT id, unnest({_PAIR_LIST}) AS gram FROM toks), pp AS (SELECT topic_id, gram, count(*) AS cnt FROM pr JOIN docset USING (id) GROUP BY topic_id, gram)"


@query(f"WITH {TOKS}, {DOCSET}, {_PAIRS} SELECT topic_id, gram, cnt, round(cnt / (sum(cnt) OVER (PARTITION BY topic_id))::DOUBLE, 9) AS p FROM pp")
def cartesian_probs(spark: SparkSession, d: str) -> DataFrame:
    return ngram.pair_probabilities(P.tokens(spark, d), tables.docset(spark, d)).withColumn("p", F.round("p", 9))


@query(f"WITH {SCORED} SELECT topic_id, id, sent_index, score FROM scored")
def sentence_scores(spark: SparkSession, d: str) -> DataFrame:
    return ngram.sentence_scores(P.tokens(spark, d), tables.docset(spark, d), NgramConfig()).withColumn("score", F.round("score", 9))


@query(f"""WITH {TOKS}, {DOCSET}, {TQ} SELECT topic_id, id, sent_index, round(CASE WHEN len(t) = 0 THEN 0 ELSE len(list_filter(q, lambda x: list_contains(t, x))) / len(t)::DOUBLE END, 9) AS score FROM toks JOIN docset USING (id) JOIN tq USING (topic_id)""")
def query_scores(spark: SparkSession, d: str) -> DataFrame:
    q = P.query_tokens(tables.topics(spark, d), P.stop_words(spark, d))
    return ngram.query_scores(P.tokens(spark, d), tables.docset(spark, d), q).withColumn("score", F.round("score", 9))


_ALL = NgramConfig(trigram_weight=0.5, headline_weight=0.4, cartesian_weight=0.3, query_weight=0.2, bias_weight=0.25)
_ENTS = """en AS (SELECT id, list_transform(regexp_extract_all(headline, '[A-Z][\\w''-]*(?: [A-Z][\\w''-]*)*'), lambda e: lower(e)) AS es FROM docs WHERE headline IS NOT NULL),
hd AS (SELECT topic_id, id, sent_index, sum(p * len(list_filter(es, lambda e: contains(e, gram)))) AS s6 FROM (
 SELECT topic_id, id, sent_index, gram, p FROM (SELECT id, sent_index, unnest(t) AS gram FROM toks) JOIN docset USING (id) JOIN p1 USING (topic_id, gram)
 UNION ALL SELECT topic_id, id, sent_index, gram, p FROM (SELECT id, sent_index, unnest({}) AS gram FROM toks) JOIN docset USING (id) JOIN p2 USING (topic_id, gram)) JOIN en USING (id) GROUP BY ALL)""".format(grams_sql(2))


@query(lambda: f"""WITH {TOKS}, {DOCSET}, {IDF}, {_BIAS.replace("atoks", "toks")}, {probs_sql(1)}, {probs_sql(2)}, {probs_sql(3)}, {gram_score_sql(1)}, {gram_score_sql(2)}, {gram_score_sql(3)}, {_PAIRS}, {_ENTS},
pq AS (SELECT topic_id, gram, cnt / (sum(cnt) OVER (PARTITION BY topic_id))::DOUBLE AS p FROM pp), pz AS (SELECT id, sent_index, unnest({_PAIR_LIST}) AS gram FROM toks),
g4 AS (SELECT topic_id, id, sent_index, avg(p) AS s4 FROM pz JOIN docset USING (id) JOIN pq USING (topic_id, gram) GROUP BY ALL),
g5 AS (SELECT topic_id, id, sent_index, CASE WHEN len(t) = 0 THEN 0 ELSE len(list_filter(q, lambda x: list_contains(t, x))) / len(t)::DOUBLE END AS s5 FROM toks JOIN docset USING (id) JOIN tq USING (topic_id)),
sh AS (SELECT topic_id, id, sent_index, coalesce(raw / nullif(sum(raw) OVER (PARTITION BY topic_id, id), 0), 0) AS share FROM bias)
SELECT topic_id, id, sent_index, round(0.75::DOUBLE * (0.2::DOUBLE * coalesce(s1, 0) + 0.9::DOUBLE * coalesce(s2, 0) + 0.5::DOUBLE * coalesce(s3, 0) + 0.4::DOUBLE * coalesce(s6, 0) + 0.3::DOUBLE * coalesce(s4, 0) + 0.2::DOUBLE * coalesce(s5, 0)) + 0.25::DOUBLE * coalesce(share, 0), 8) AS score
FROM toks JOIN docset USING (id) LEFT JOIN g1 USING (topic_id, id, sent_index) LEFT JOIN g2 USING (topic_id, id, sent_index) LEFT JOIN g3 USING (topic_id, id, sent_index) LEFT JOIN hd USING (topic_id, id, sent_index) LEFT JOIN g4 USING (topic_id, id, sent_index) LEFT JOIN g5 USING (topic_id, id, sent_index) LEFT JOIN sh USING (topic_id, id, sent_index)""")
def weighted_scores(spark: SparkSession, d: str) -> DataFrame:
    """All terms of the score at once: trigrams, headline entities, pairs, query and the bias of an article."""
    tok, docset = P.tokens(spark, d), tables.docset(spark, d)
    q = P.query_tokens(tables.topics(spark, d), P.stop_words(spark, d))
    entities = ngram.headline_entities(tables.articles(spark, d))
    return ngram.sentence_scores(tok, docset, _ALL, q, entities, idf=P.term_idf(tok)).withColumn("score", F.round("score", 8))


def _scored(spark: SparkSession, d: str, only: Column | None = None) -> DataFrame:
    return ngram.sentence_scores(P.tokens(spark, d), tables.docset(spark, d), NgramConfig(), only=only).withColumn("score", F.round("score", 9))


@query(f"WITH {SCORED} SELECT topic_id, id, sent_index FROM scored WHERE NOT {REMOVABLE} QUALIFY row_number() OVER (PARTITION BY topic_id, id ORDER BY score DESC, sent_index) <= 2")
def top_sentences_per_article(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d, ~ngram.removable(F.col("text"), F.col("n_words")))
    return ngram.best(scored, ["topic_id", "id"], 2).select("topic_id", "id", "sent_index")


@query(f"WITH {CAND} SELECT topic_id, id, sent_index, rk AS place FROM cand")
def topic_top20(spark: SparkSession, d: str) -> DataFrame:
    return ngram.best(_scored(spark, d), ["topic_id"], 20).select("topic_id", "id", "sent_index", F.col("place").cast("long").alias("place"))


def _stateful(name: str, config: NgramConfig):
    def f(spark: SparkSession, d: str) -> DataFrame:
        tok = P.tokens(spark, d).withColumn("removable", ngram.removable(F.col("text"), F.col("n_words")))
        return ngram.select_stateful(tok, tables.docset(spark, d), config)

    f.__name__ = name
    return query()(f)


_stateful("sumbasic_per_article", NgramConfig())
_stateful("lowered_per_article", NgramConfig(reweight_scheme="before_selection"))
_stateful("forward_backward", NgramConfig(forward_backward=True))
_stateful("sumbasic_glob", NgramConfig(grouping="glob"))


# ---- graph ranking ---------------------------------------------------------------------------------------------

_VEC = f"""{TOKS}, {ATOKS}, {IDF}, {DOCSET}, rv AS (SELECT id, sent_index, word, count(*) * any_value(idf) AS w FROM (SELECT id, sent_index, unnest(t) AS word FROM atoks) JOIN idf USING (word) GROUP BY ALL HAVING count(*) * any_value(idf) > 0),
vec AS (SELECT topic_id, id, sent_index, word, w / sqrt(sum(w * w) OVER (PARTITION BY topic_id, id, sent_index)) AS w FROM rv JOIN docset USING (id)),
cs AS (SELECT topic_id, word, sum(w) AS c FROM vec GROUP BY ALL), rs AS (SELECT topic_id, id, sent_index, sum(w * c) AS total FROM vec JOIN cs USING (topic_id, word) GROUP BY ALL)"""


@query(f"WITH {_VEC} SELECT topic_id, id, sent_index, round(total, 6) AS total FROM rs")
def similarity_row_sums(spark: SparkSession, d: str) -> DataFrame:
    tok = P.tokens(spark, d, headlines=True)
    return lexrank.row_sums(lexrank.unit_vectors(tok, tables.docset(spark, d), P.term_idf(tok))).withColumn("total", F.round("total", 6))


_BIAS = f"""{TQ}, q AS (SELECT topic_id, word, count(*) AS q FROM (SELECT topic_id, unnest(q) AS word FROM tq) GROUP BY ALL), qi AS (SELECT * FROM q JOIN idf USING (word)),
qb AS (SELECT topic_id, sum((q + 1) * idf) AS base FROM qi GROUP BY topic_id),
qm AS (SELECT topic_id, id, sent_index, sum((q + 1) * s * idf) AS more FROM (SELECT id, sent_index, word, count(*) AS s FROM (SELECT id, sent_index, unnest(t) AS word FROM atoks) GROUP BY ALL) JOIN docset USING (id) JOIN qi USING (topic_id, word) GROUP BY ALL),
bias AS (SELECT topic_id, id, sent_index, raw, raw / nullif(sum(raw) OVER (PARTITION BY topic_id), 0) AS bias FROM (SELECT topic_id, id, sent_index, base + coalesce(more, 0) AS raw FROM atoks JOIN docset USING (id) JOIN qb USING (topic_id) LEFT JOIN qm USING (topic_id, id, sent_index)))"""


@query(f"WITH {TOKS}, {ATOKS}, {IDF}, {DOCSET}, {_BIAS} SELECT topic_id, id, sent_index, round(raw, 6) AS raw, round(bias, 9) AS bias FROM bias")
def ir_bias(spark: SparkSession, d: str) -> DataFrame:
    tok = P.tokens(spark, d, headlines=True)
    q = P.query_tokens(tables.topics(spark, d), P.stop_words(spark, d))
    return lexrank.query_bias(tok, tables.docset(spark, d), q, P.term_idf(tok)).withColumn("raw", F.round("raw", 6)).withColumn("bias", F.round("bias", 9))


def _rounds_sql(k: int) -> str:
    out = ["nd0 AS (SELECT topic_id, id, sent_index, total, bias / sum(bias) OVER (PARTITION BY topic_id) AS b, 1.0::DOUBLE / n AS p FROM (SELECT *, count(*) OVER (PARTITION BY topic_id) AS n FROM rs) JOIN bias USING (topic_id, id, sent_index))", "ed AS (SELECT vec.* FROM vec SEMI JOIN nd0 USING (topic_id, id, sent_index))"]
    for i in range(k):
        out.append(f"cc{i} AS (SELECT topic_id, word, sum(p / total * w) AS c FROM ed JOIN nd{i} USING (topic_id, id, sent_index) GROUP BY ALL)")
        out.append(f"st{i} AS (SELECT topic_id, id, sent_index, sum(w * c) AS q FROM ed JOIN cc{i} USING (topic_id, word) GROUP BY ALL)")
        out.append(f"nd{i + 1} AS (SELECT topic_id, id, sent_index, total, b, 0.6::DOUBLE * q + 0.4::DOUBLE * b AS p FROM nd{i} JOIN st{i} USING (topic_id, id, sent_index))")
    return ", ".join(out)


@query(f"WITH {_VEC}, {_BIAS}, {_rounds_sql(8)} SELECT topic_id, id, sent_index, round(p, 8) AS score FROM nd8")
def lexrank_scores(spark: SparkSession, d: str) -> DataFrame:
    tok = P.tokens(spark, d, headlines=True)
    docset, terms = tables.docset(spark, d), P.term_idf(tok)
    queries = P.query_tokens(tables.topics(spark, d), P.stop_words(spark, d))
    return lexrank.lexrank_of_tokens(tok, docset, terms, queries).withColumn("score", F.round("score", 8))


_EDGES = """ce AS (SELECT topic_id, a.id AS id, a.sent_index AS sent_index, b.id AS to_id, b.sent_index AS to_index FROM vec a JOIN vec b USING (topic_id, word) GROUP BY ALL HAVING sum(a.w * b.w) > 0.1::DOUBLE),
nd0 AS (SELECT topic_id, id, sent_index, total, 1.0::DOUBLE / count(*) OVER (PARTITION BY topic_id) AS b, 1.0::DOUBLE / count(*) OVER (PARTITION BY topic_id) AS p FROM (SELECT topic_id, id, sent_index, count(*)::DOUBLE AS total FROM ce GROUP BY ALL))"""
_STEPS_OF_EDGES = ", ".join(f"nd{i + 1} AS (SELECT topic_id, id, sent_index, total, b, 0.6::DOUBLE * coalesce(q, 0) + 0.4::DOUBLE * b AS p FROM nd{i} LEFT JOIN (SELECT topic_id, to_id AS id, to_index AS sent_index, sum(p / total) AS q FROM ce JOIN nd{i} USING (topic_id, id, sent_index) GROUP BY ALL) USING (topic_id, id, sent_index))" for i in range(4))


@query(f"WITH {_VEC}, {_EDGES}, {_STEPS_OF_EDGES} SELECT topic_id, id, sent_index, round(p, 8) AS score FROM nd4")
def lexrank_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The graph with 0/1 adjacency by a threshold of 0.1 and without a bias, four rounds."""
    tok = P.tokens(spark, d, headlines=True)
    x = lexrank.unit_vectors(tok, tables.docset(spark, d), P.term_idf(tok))
    return lexrank.threshold_lexrank(x, None, 0.1, rounds=4).withColumn("score", F.round("score", 8))


_HASHED = "ne AS (SELECT count(*) AS n FROM embeddings), wv AS (SELECT word, embedding AS v FROM (SELECT DISTINCT unnest(t) AS word FROM atoks), ne JOIN embeddings ON vec_id = ('0x' || substr(md5(word), 1, 8))::BIGINT % n)"


def _means_sql(name: str, source: str, key: str, weighted: bool) -> str:
    """Unit vectors (key, v) of the items of a source with a list t."""
    idf, weight = ("JOIN idf USING (word)", "any_value(idf)") if weighted else ("", "1")
    return f"""{name}w AS (SELECT {key}, word, count(*) * {weight} AS n FROM (SELECT {key}, unnest(t) AS word FROM {source}) {idf} GROUP BY {key}, word),
{name}d AS (SELECT {key}, i, sum(n * x) AS x FROM (SELECT {key}, n, unnest(v)::DOUBLE AS x, generate_subscripts(v, 1) AS i FROM {name}w JOIN wv USING (word) WHERE n > 0) GROUP BY {key}, i),
{name} AS (SELECT {key}, list(x / norm ORDER BY i) AS v FROM {name}d JOIN (SELECT {key}, sqrt(sum(x * x)) AS norm FROM {name}d GROUP BY {key}) USING ({key}) WHERE norm > 0 GROUP BY {key})"""


_MEAN_SUMS = """vs AS (SELECT topic_id, id, sent_index, i, x FROM (SELECT id, sent_index, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM mv) JOIN docset USING (id)), vt AS (SELECT topic_id, i, sum(x) AS s FROM vs GROUP BY ALL)
SELECT topic_id, id, sent_index, round(sum(x * s), 5) AS total FROM vs JOIN vt USING (topic_id, i) GROUP BY ALL"""


def _vectors(spark: SparkSession, d: str, tok: DataFrame) -> DataFrame:
    return vectors.hashed_vectors(tok.select(F.explode("tokens").alias("word")), tables.table(spark, d, "embeddings"))


def _vector_sums(name: str, weighted: bool):
    def f(spark: SparkSession, d: str) -> DataFrame:
        tok = P.tokens(spark, d, headlines=True)
        sums = vectors.row_sums_of_tokens(tok, tables.docset(spark, d), _vectors(spark, d, tok), P.term_idf(tok) if weighted else None)
        return sums.withColumn("total", F.round("total", 5))

    f.__name__ = name
    return query(f"WITH {TOKS}, {ATOKS}, {IDF}, {DOCSET}, {_HASHED}, {_means_sql('mv', 'atoks', 'id, sent_index', weighted)}, {_MEAN_SUMS}")(f)


_vector_sums("tf_idf_vector_sums", True)
_vector_sums("word_vector_sums", False)


@query(f"""WITH {TOKS}, {ATOKS}, {IDF}, {DOCSET}, {TQ}, {_HASHED}, qs AS (SELECT topic_id, q AS t FROM tq), {_means_sql('mv', 'atoks', 'id, sent_index', True)}, {_means_sql('qv', 'qs', 'topic_id', True)}
SELECT topic_id, id, sent_index, round(list_dot_product(mv.v, qv.v), 6) AS raw FROM mv JOIN docset USING (id) JOIN qv USING (topic_id)""")
def vector_bias(spark: SparkSession, d: str) -> DataFrame:
    tok = P.tokens(spark, d, headlines=True)
    idf_table, table = written(P.term_idf(tok), "idf"), _vectors(spark, d, tok)
    means = vectors.mean_vectors(tok, ["id", "sent_index"], table, idf_table)
    asked = vectors.mean_vectors(P.query_tokens(tables.topics(spark, d), P.stop_words(spark, d)).withColumnRenamed("query_tokens", "tokens"), ["topic_id"], table, idf_table)
    return vectors.query_similarity(means, tables.docset(spark, d), asked).select("topic_id", "id", "sent_index", F.round("raw", 6).alias("raw"))


@query()
def lda_topics(spark: SparkSession, d: str) -> DataFrame:
    return topics.topic_words(P.tokens(spark, d), tables.docset(spark, d))


@query()
def topic_hits(spark: SparkSession, d: str) -> DataFrame:
    tok, docset = P.tokens(spark, d), tables.docset(spark, d)
    both = tok.join(docset, "id").join(topics.topic_words(tok, docset), "topic_id")
    return both.select("topic_id", "id", "sent_index", "subtopic", topics.topic_hits(F.col("tokens"), F.col("words")).alias("hits"))


@query()
def sentences_by_subtopic(spark: SparkSession, d: str) -> DataFrame:
    tok, docset = P.tokens(spark, d), tables.docset(spark, d)
    return topics.select_by_subtopic(tok, docset, topics.topic_words(tok, docset))


# ---- realization -----------------------------------------------------------------------------------------------


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """The best sentences of each topic with their texts and dates; kept, a few dozen rows a topic."""
    tok = P.tokens(spark, d)
    scored = ngram.sentence_scores(tok, tables.docset(spark, d), NgramConfig()).withColumn("score", F.round("score", 9))
    return P.with_texts(ngram.best(scored, ["topic_id"], 20), tok)


def _step_sql(match: str) -> str:
    return f"SELECT topic_id, id, sent_index FROM (SELECT *, {match} AS m, coalesce(sum(CASE WHEN {match} THEN n_words ELSE 0 END) OVER (PARTITION BY topic_id ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM cand) WHERE NOT (m AND b < w - 100)"


_STEPS = {
    "remove_quotes": (QUOTED, lambda t: T.contains_quote(t)),
    "remove_questions": ("contains(text, '?')", lambda t: realize.question(t)),
    "remove_fragments": ("right(text, 1) NOT IN ('.', ';')", lambda t: realize.fragment(t)),
    "remove_pronouns": (PRONOUN, lambda t: T.opens_with_pronoun(t)),
    "remove_matching": ("regexp_matches(text, '^(?:(?:The )|(?:A ))')", lambda t: realize.full_match(t, ("The ", "A "))),
    "remove_short": ("n_words <= 4", lambda t: T.words_in(t) <= 4),
}


def _removal(name: str):
    sql, match = _STEPS[name]

    def f(spark: SparkSession, d: str) -> DataFrame:
        return realize.removal_step(_candidates(spark, d), match(F.col("text"))).select("topic_id", "id", "sent_index")

    f.__name__ = name
    return query(f"WITH {CAND} {_step_sql(sql)}")(f)


for _name in _STEPS:
    _removal(_name)


@query(f"WITH {CAND} SELECT topic_id, id, sent_index, CASE WHEN w > 100 THEN {T.rewrite_sql('text', rules.TRIM)} ELSE text END AS text FROM cand")
def trim_sentences(spark: SparkSession, d: str) -> DataFrame:
    return realize.rewrite_over_quota(_candidates(spark, d), T.trim_sentence).drop("score", "date")


@query(f"WITH {SENTS} SELECT id, sent_index, {T.rewrite_sql('text', rules.ATTRIBUTIONS)} AS text FROM sents")
def attributions(spark: SparkSession, d: str) -> DataFrame:
    return segment.sentences(tables.articles(spark, d)).select("id", "sent_index", T.remove_attribution(F.col("text")).alias("text"))


@query(f"""WITH {SENTS}, ws AS (SELECT id, sent_index, regexp_split_to_array(trim(text), '\\s+') AS x FROM sents)
SELECT id, sent_index, regexp_replace(regexp_replace(upper(substr(x[1], 1, 1)) || lower(substr(x[1], 2)) || CASE WHEN len(x) > 1 THEN ' ' || array_to_string(x[2:], ' ') ELSE '' END, '  +', ' ', 'g'), ' +([.?!,])', '\\1', 'g') AS text FROM ws""")
def clean_up(spark: SparkSession, d: str) -> DataFrame:
    return segment.sentences(tables.articles(spark, d)).select("id", "sent_index", T.clean_up(F.col("text")).alias("text"))


_OV = "len(list_intersect(list_distinct({a}), list_distinct({b}))) / len({b})::DOUBLE"
_WORDS = "regexp_split_to_array(lower(left(text, length(text) - 1)), '[ -]')"


@query(f"""WITH {CAND}, x AS (SELECT topic_id, id, sent_index, {_WORDS} AS ws FROM cand)
SELECT a.topic_id, a.id AS a, a.sent_index AS a_index, b.id AS b, b.sent_index AS b_index, round({_OV.format(a="a.ws", b="b.ws")}, 9) AS overlap FROM x a JOIN x b USING (topic_id) WHERE (a.id, a.sent_index) <> (b.id, b.sent_index)""")
def lexical_overlap(spark: SparkSession, d: str) -> DataFrame:
    return realize.overlaps(_candidates(spark, d)).withColumn("overlap", F.round("overlap", 9))


#: The greedy removal as a walk over all ordered pairs of a topic's candidates: what is gone, and how many words went.
_GREEDY = f"""{CAND}, tm AS (SELECT topic_id, max(rk) AS m, sum(n_words) - 100 AS spare FROM cand GROUP BY topic_id), x AS (SELECT topic_id, rk, n_words, {_WORDS} AS ws FROM cand),
o AS MATERIALIZED (SELECT topic_id, (a.rk - 1) * m + b.rk - 1 AS s, a.rk AS i, b.rk AS j, b.n_words AS n, a.rk <> b.rk AND {_OV.format(a="a.ws", b="b.ws")} > 0.74::DOUBLE AS hit FROM x a JOIN x b USING (topic_id) JOIN tm USING (topic_id)),
wk AS (SELECT topic_id, 0::BIGINT AS s, []::BIGINT[] AS gone, 0::BIGINT AS dropped, m, spare FROM tm
 UNION ALL SELECT wk.topic_id, wk.s + 1, CASE WHEN hit AND dropped < spare AND NOT list_contains(gone, i) AND NOT list_contains(gone, j) THEN list_append(gone, j) ELSE gone END,
  CASE WHEN hit AND dropped < spare AND NOT list_contains(gone, i) AND NOT list_contains(gone, j) THEN dropped + n ELSE dropped END, m, spare FROM wk JOIN o ON o.topic_id = wk.topic_id AND o.s = wk.s)"""


@query(f"WITH RECURSIVE {_GREEDY} SELECT topic_id, id, sent_index, NOT list_contains(gone, rk) AS kept FROM cand JOIN wk USING (topic_id) WHERE wk.s = m * m")
def redundancy(spark: SparkSession, d: str) -> DataFrame:
    return realize.remove_redundant(_candidates(spark, d)).select("topic_id", "id", "sent_index", "kept")


_PACK = f"""{CAND}, pk AS (SELECT topic_id, rk, id, sent_index, text, n_words, CASE WHEN n_words <= 100 THEN n_words ELSE 0 END AS used, n_words <= 100 AS packed FROM cand WHERE rk = 1
 UNION ALL SELECT c.topic_id, c.rk, c.id, c.sent_index, c.text, c.n_words, CASE WHEN pk.used + c.n_words <= 100 THEN pk.used + c.n_words ELSE pk.used END, pk.used + c.n_words <= 100 FROM pk JOIN cand c ON c.topic_id = pk.topic_id AND c.rk = pk.rk + 1)"""


@query(f"WITH RECURSIVE {_PACK} SELECT topic_id, id, sent_index, packed FROM pk")
def pack_quota(spark: SparkSession, d: str) -> DataFrame:
    return realize.pack(_candidates(spark, d)).select("topic_id", "id", "sent_index", "packed")


_WHOLE = _PACK.replace("FROM cand", "FROM whole").replace("JOIN cand c", "JOIN whole c").replace(f"{CAND},", f"{CAND}, whole AS (SELECT * EXCLUDE (rk), row_number() OVER (PARTITION BY topic_id ORDER BY rk) AS rk FROM cand WHERE right(text, 1) IN ('.', ';')),")


@query(f"""WITH RECURSIVE {_WHOLE}, u AS (SELECT topic_id, max(used) AS used FROM pk GROUP BY topic_id), wk AS (SELECT *, {_WORDS} AS ws FROM pk WHERE packed), ot AS (SELECT *, {_WORDS} AS ws FROM cand WHERE right(text, 1) NOT IN ('.', ';'))
SELECT topic_id, id, sent_index FROM ot e LEFT JOIN u USING (topic_id) WHERE n_words <= 100 - coalesce(u.used, 0) AND NOT EXISTS (SELECT 1 FROM wk a WHERE a.topic_id = e.topic_id AND {_OV.format(a="a.ws", b="e.ws")} > 0.84::DOUBLE)
QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY rk) = 1""")
def extra_quota(spark: SparkSession, d: str) -> DataFrame:
    """The best fragment that still fits beside the packed whole sentences."""
    candidates = _candidates(spark, d)
    odd = realize.fragment(F.col("text"))
    return realize.extra(realize.pack(candidates.where(~odd)), candidates.where(odd)).select("topic_id", "id", "sent_index")


@query()
def realization_steps(spark: SparkSession, d: str) -> DataFrame:
    """Sentences and words of each topic after each filter and rewrite."""
    return realize.changes(_candidates(spark, d), RealizationConfig(remove_subjectless=True, remove_appositives=True))


# ---- ordering, summaries, evaluation ---------------------------------------------------------------------------

_WEAK = ", ".join(f"'{w}'" for w in rules.WEAK_STARTS)
_DATED = f"{CAND}, dc AS (SELECT cand.*, docs.date FROM cand JOIN docs USING (id))"


@query(f"""WITH {_DATED}, f AS (SELECT *, regexp_split_to_array(trim(text), '\\s+')[1] AS w1 FROM dc)
SELECT topic_id, id, sent_index, round(score * 100 + CASE WHEN sent_index IN (0, -1) THEN 15 ELSE 0 END - CASE WHEN w1 IN ({_WEAK}) THEN 10 WHEN contains('The', w1) THEN 5 ELSE 0 END - date_diff('day', min(date) OVER (PARTITION BY topic_id), date) * 0.1::DOUBLE + n_words * 0.22::DOUBLE, 8) AS start_score FROM f""")
def start_scores(spark: SparkSession, d: str) -> DataFrame:
    return order.start_score(_candidates(spark, d)).select("topic_id", "id", "sent_index", F.round("start_score", 8).alias("start_score"))


@query(f"""WITH {_DATED} SELECT a.topic_id, a.id AS a, a.sent_index AS a_index, b.id AS b, b.sent_index AS b_index, round(CASE WHEN a.id = b.id THEN CASE WHEN b.sent_index > a.sent_index THEN greatest(20 - 0.2::DOUBLE * (b.sent_index - a.sent_index), 15) ELSE 5.0::DOUBLE / (a.sent_index - b.sent_index) + 10 END
 WHEN a.date <= b.date THEN greatest(date_diff('day', b.date, a.date) * 0.5::DOUBLE + 9, 0) + greatest((50 - b.sent_index) * 0.02::DOUBLE, 0)
 ELSE greatest(-date_diff('day', b.date, a.date)::DOUBLE, -7) + greatest((20 - b.sent_index) * 0.05::DOUBLE - 1, -3) END, 6) AS chrono FROM dc a JOIN dc b USING (topic_id) WHERE (a.id, a.sent_index) <> (b.id, b.sent_index)""")
def chrono_scores(spark: SparkSession, d: str) -> DataFrame:
    dated = _candidates(spark, d)
    side = lambda s: dated.select("topic_id", F.col("id").alias(s), F.col("sent_index").alias(f"{s}_index"), F.col("date").alias(f"{s}_date"))
    pairs = side("a").join(side("b"), "topic_id").where("a <> b or a_index <> b_index")
    c = order.chronology(F.col("a") == F.col("b"), F.col("a_date"), F.col("a_index"), F.col("b_date"), F.col("b_index"))
    return pairs.select("topic_id", "a", "a_index", "b", "b_index", F.round(c, 6).alias("chrono"))


_AFTER = """CASE WHEN a.id = b.id THEN CASE WHEN b.sent_index > a.sent_index THEN greatest(20 - 0.2::DOUBLE * (b.sent_index - a.sent_index), 15) ELSE 5.0::DOUBLE / (a.sent_index - b.sent_index) + 10 END
 WHEN a.date <= b.date THEN greatest(date_diff('day', b.date, a.date) * 0.5::DOUBLE + 9, 0) + greatest((50 - b.sent_index) * 0.02::DOUBLE, 0)
 ELSE greatest(-date_diff('day', b.date, a.date), -7) + greatest((20 - b.sent_index) * 0.05::DOUBLE - 1, -3) END"""


@query(f"""WITH RECURSIVE {_DATED}, f AS MATERIALIZED (SELECT *, regexp_split_to_array(trim(text), '\\s+')[1] AS w1 FROM dc),
fs AS (SELECT topic_id, rk, 100::DOUBLE * score + CASE WHEN sent_index IN (0, -1) THEN 15 ELSE 0 END - CASE WHEN w1 IN ({_WEAK}) THEN 10 WHEN contains('The', w1) THEN 5 ELSE 0 END - 0.1::DOUBLE * date_diff('day', min(date) OVER (PARTITION BY topic_id), date) + 0.22::DOUBLE * n_words AS v FROM f),
nx AS MATERIALIZED (SELECT topic_id, a.rk AS i, b.rk AS j, 0.1::DOUBLE * 0.5::DOUBLE + 0.0::DOUBLE + 0.7::DOUBLE * ({_AFTER}) AS v FROM f a JOIN f b USING (topic_id) WHERE a.rk <> b.rk),
sq AS (SELECT topic_id, 0::BIGINT AS line_no, arg_max(rk, {{'v': v, 'k': rk}}) AS rk, [arg_max(rk, {{'v': v, 'k': rk}})] AS seen FROM fs GROUP BY topic_id
 UNION ALL SELECT topic_id, line_no, rk, list_append(seen, rk) FROM (SELECT sq.topic_id, sq.line_no + 1 AS line_no, arg_max(j, {{'v': v, 'k': j}}) AS rk, any_value(seen) AS seen FROM sq JOIN nx ON nx.topic_id = sq.topic_id AND nx.i = sq.rk WHERE NOT list_contains(seen, j) GROUP BY sq.topic_id, sq.line_no))
SELECT topic_id, line_no, text AS sentence FROM sq JOIN f USING (topic_id, rk)""")
def ordered_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of each topic in the order a summary would have them."""
    return order.ordered(_candidates(spark, d), OrderingConfig())


@query()
def summaries_ngram(spark: SparkSession, d: str) -> DataFrame:
    return P.summarize(spark, d)


@query()
def summaries_lexrank(spark: SparkSession, d: str) -> DataFrame:
    return P.summarize(spark, d, Config(method="select_lexrank"))


def _rouge_inputs(spark: SparkSession, d: str, stop: list[str] | None = None, stem=None) -> tuple[DataFrame, DataFrame]:
    s = tables.table(spark, d, "summaries").groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))
    first = rouge.first_tokens(F.col("text"), 100, stop, stem)
    peers = s.select(F.concat(F.substring("name", 1, 5), F.split_part("name", F.lit("."), F.lit(4))).alias("topic_id"), F.col("name").alias("peer_id"), first.alias("tokens"))
    asked = tables.docset(spark, d)
    models = raw_text(spark, d).join(asked, "id").select("topic_id", F.col("id").alias("model_id"), first.alias("tokens"))
    return peers, models


def _rouge(n: int, best: bool):
    def f(spark: SparkSession, d: str) -> DataFrame:
        out = rouge.per_topic(rouge.pair_scores(*_rouge_inputs(spark, d), n), best)
        return out.select("topic_id", "peer_id", *(F.round(c, 9).alias(c) for c in "rpf"))

    f.__name__ = f"rouge{n}_best" if best else f"rouge{n}"
    cols = ", ".join(f"round({f'arg_max({c}, (f, model_id))' if best else f'avg({c})'}, 9) AS {c}" for c in "rpf")
    return query(f"WITH {rouge_sql(n)} SELECT topic_id, peer_id, {cols} FROM sc GROUP BY topic_id, peer_id")(f)


for _n in (1, 2):
    _rouge(_n, False)
    _rouge(_n, True)


@query(f"WITH {rouge_sql(1)}, t AS (SELECT topic_id, avg(r) AS r, avg(p) AS p, avg(f) AS f FROM sc GROUP BY topic_id, peer_id) SELECT count(*) AS n_topics, round(avg(r), 9) AS r, round(avg(p), 9) AS p, round(avg(f), 9) AS f FROM t")
def rouge_system(spark: SparkSession, d: str) -> DataFrame:
    t = rouge.per_topic(rouge.pair_scores(*_rouge_inputs(spark, d), 1))
    return t.agg(F.count("*").alias("n_topics"), *(F.round(F.avg(c), 9).alias(c) for c in "rpf"))


_STEMMED = "list_filter(list_transform(list_filter({}, lambda t: NOT list_contains(ws, t)), lambda t: regexp_replace(t, '^(\\w{{3,}}?)(?:ies|ied|ing|ed|es|s|ly)$', '\\1')), lambda t: true)"


@query(lambda: "WITH " + rouge_sql(1).replace("pe AS (SELECT topic_id, peer_id, regexp", "sw AS (SELECT list(DISTINCT word) AS ws FROM common_words), pe0 AS (SELECT topic_id, peer_id, regexp").replace("mo AS (SELECT topic_id, model_id, regexp", "mo0 AS (SELECT topic_id, model_id, regexp").replace(", pc AS (", f", pe AS (SELECT topic_id, peer_id, {_STEMMED.format('t')} AS t FROM pe0, sw), mo AS (SELECT topic_id, model_id, {_STEMMED.format('t')} AS t FROM mo0, sw), pc AS (", 1) + " SELECT topic_id, peer_id, round(avg(r), 9) AS r, round(avg(p), 9) AS p, round(avg(f), 9) AS f FROM sc GROUP BY topic_id, peer_id")
def rouge1_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """Without stop words, and with light stems."""
    out = rouge.per_topic(rouge.pair_scores(*_rouge_inputs(spark, d, P.stop_words(spark, d), rouge.plural_stem), 1))
    return out.select("topic_id", "peer_id", *(F.round(c, 9).alias(c) for c in "rpf"))


@query()
def rouge_intervals(spark: SparkSession, d: str) -> DataFrame:
    return rouge.bootstrap(rouge.per_topic(rouge.pair_scores(*_rouge_inputs(spark, d), 1)))


SQL.update({name: sql() for name, sql in SQL.items() if callable(sql)})  # those that use blocks below them

__all__ = ["QUERIES", "SQL", "Window"]
