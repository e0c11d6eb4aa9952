import datetime
import gzip
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.config import Config, LexRankConfig, NgramConfig, OrderingConfig
from newsloom.functions import rules
from newsloom.functions import text as T
from newsloom.operators import lexrank, ngram, order, realize, rouge, segment, stats, storage, topics, vectors, whole
from newsloom.plans import catalog
from newsloom.plans import pipeline as P
from newsloom.sources import datasets, files, tables

#: A text for each rule, in the order of the rules, and what is left of it.
CLEAN = [
    ("A wet  \nroad.", "A wet road."),
    ("A\twet road.", "A wet road."),
    ("A wet\nroad.", "A wet road."),
    ("A   wet road.", "A wet road."),
    ("Here are the top news stories at noon", ""),
    ("On the Net: a list", ""),
    ("Reach Ann Ash, whose e-mail address is ash at paper", ""),
    ("E-mail: ash at paper", ""),
    ("(E-mail ash at paper)", ""),
    ("The lake froze. E-mail ash at paper", "The lake froze."),
    ("Story filed by Bay Wire", ""),
    ("For use by clients only", ""),
    ("Photos and graphics to come", ""),
    ("Ann Ash, phone: 555 0100", "Ann Ash,"),
    ("Ann Ash, pager: 555 0100", "Ann Ash,"),
    ("Technical problems: Bay desk", ""),
    ("Questions or comments to the desk", ""),
    ("With photo of a boat.", ""),
    ("https://bay.example/a", ""),
    ("https://bay.example/a is the lake's page.", "https://bay.example/a is the lake's page."),
    ("See www.bay.example", "See"),
    ("LAKE-REPORT (Undated) The ice broke.", "The ice broke."),
    ("It ended . . . then", "It ended. then"),
    ("The bridge () fell.", "The bridge fell."),
    ("SOURCES: Bay Board, staff reporting", ""),
    ("The lake rose, staff reporting.", "The lake rose"),
    ("By A B C.", ""),
    ("The Washington Post Magazine. The ice broke.", "The ice broke."),
    ("Associated Press Writers Ann Ash; Bob Bay", ""),
    ("BAYTOWN (AP) -- The ice broke.", "The ice broke."),
    ("BAYTOWN, May 3 (Bay) -- The ice broke.", "The ice broke."),
    ("BAY HARBOR, Ont. -- The ice broke.", "The ice broke."),
    ("Baytown (JP) The ice broke.", "The ice broke."),
    ("BAY-HARBOR (Bay Wire) _ The ice broke.", "The ice broke."),
    ("__ The ice broke.", "The ice broke."),
    ("BAYTOWN, May 3 _ The ice broke.", "The ice broke."),
    ("BAYTOWN -- The ice broke.", "The ice broke."),
    ("(Bay)--The ice broke.", "The ice broke."),
    ("Ice (JP):broke early.", "broke early."),
    ("ab/cd12", ""),
    ("(ab-cde/fg)", ""),
    ("ab12", ""),
    ("nn", ""),
    ("- - -", ""),
    ("....", ""),
    ("BAY-LAKE-ICE-NEWS The ice broke.", "The ice broke."),
    ("The ice _ broke.", "The icebroke."),
    ("With a map-graphic", ""),
    ("Bay NewsBrief by Ann Ash", ""),
    ("ENDIT", ""),
    ("(Begin optional trim)", ""),
    ("(Optional add end)", ""),
    ("(STORY CAN END HERE. OPTIONAL MATERIAL FOLLOWS)", ""),
    ("Illness Not Otherwise Specified rose.", "not otherwise specified rose."),
    ("The Bay Board (BB) met.", "The Bay Board met."),
    ("It was `cold` there.", "It was 'cold' there."),
    ("He said ``it was 'cold''' then.", "He said \"it was 'cold'\" then."),
    ("``Ice,'' he said.", '"Ice," he said.'),
    ('Ice, " he said.', 'Ice," he said.'),
    ('Stop!" he said.', 'Stop!", he said.'),
]
#: Rules that an earlier one leaves nothing to.
IDLE = {r"(?i)^\s*With photo.", r"https?://www.{4,100}$", r"\( \) --"}


def test_clean_text(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CLEAN)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", T.clean_text(F.col("t")).alias("c")).collect()}
    assert [got[i] for i in range(len(CLEAN))] == [b for _, b in CLEAN]
    df = spark.createDataFrame([("It's an 'icy' \"day\" here.",)], "t string")
    assert df.select(T.clean_text(F.col("t"), True)).first()[0] == "It's an icy day here."


def test_each_cleaning_rule_has_an_example_and_a_sound_guard():
    fired = set()
    for text in [a for a, _ in CLEAN] + ["It's an 'icy' \"day\" here."]:
        for pattern, replacement in rules.cleaning(True):
            new = re.sub(pattern, replacement, text)
            if new != text:
                fired.add(pattern)
                assert pattern not in rules.NEEDS or re.search(rules.NEEDS[pattern], text), pattern
                group = next(g for g, steps in [*rules.GROUPS, (rules.QUOTE_GUARD, rules.NO_QUOTES)] if (pattern, replacement) in steps)
                assert re.search(group, text), (pattern, text)
            text = new
    assert {p for p, _ in rules.cleaning(True)} - fired == IDLE


def test_guards_change_nothing(spark):
    """Whole articles, cleaned with and without the guards."""
    a = spark.read.parquet("/root/testdata/sf0.001/articles.parquet").select(F.array_join("paragraphs", " ").alias("t")).where("t is not null")
    rows = a.select(T.clean_text(F.col("t"), True).alias("x"), F.trim(T.rewrite(F.col("t"), rules.cleaning(True))).alias("y")).collect()
    assert rows and all(r.x == r.y for r in rows)


def test_countworthy(spark):
    bad = ["--pixar", "a0014", "13:45", "2,308.70", "-addressing", ".atlantawatergardens", "/dare", "000bo", "07.6'e", "box/", "c.l.g", "~~~ike", "zzzzznnappp", "x-43a", "Seventy", "www.bay", "bay.org"]
    df = spark.createDataFrame([(w,) for w in [*bad, "zurbirggen"]], "w string")
    got = {r.w: r.c for r in df.select("w", T.countworthy(F.col("w"), []).alias("c")).collect()}
    assert got == {w: False for w in bad} | {"zurbirggen": True}


def test_openings(spark):
    df = spark.createDataFrame([("He left.",), ("There are boats.",), ("Here is the list.",), ("Here boats sank.",), ("Most sank.",), ("Boats sank.",)], "t string")
    assert [r[0] for r in df.select(T.opens_with_pronoun(F.col("t"))).collect()] == [True, False, True, False, True, False]
    df = spark.createDataFrame([("According to plan.",), ("Boats on the lake.",), ("Ann Ash, the captain, sailed.",)], "t string")
    assert [tuple(r) for r in df.select(T.lacks_subject(F.col("t")), T.remove_appositives(F.col("t"))).collect()] == [(True, "According to plan."), (False, "Boats on the lake."), (False, "Ann Ash sailed.")]


def articles(spark, rows):
    return spark.createDataFrame(rows, "id string, date date, headline string, paragraphs array<string>")


def test_sentences_restart_and_skip_empty(spark):
    d = datetime.date(1999, 4, 21)
    a = articles(spark, [("A19990421.0001", d, None, ["One here. Two there.", "", None, 'He said "It is. So be it" and left. Then went.']), ("B", d, None, None), ("C", d, None, [])])
    got = [(r.para_idx, r.sent_index, r.text) for r in segment.sentences(a).orderBy("sent_index").collect()]
    assert got == [(0, 0, "One here."), (0, 1, "Two there."), (1, 2, 'He said "It is. So be it" and left.'), (1, 3, "Then went.")]


def test_probabilities_sum_to_one_with_headlines(spark):
    tok = spark.createDataFrame([("a", 0, ["x", "y", "x"]), ("a", 1, []), ("b", 0, ["y"])], "id string, sent_index long, tokens array<string>")
    docset = spark.createDataFrame([("t", "a"), ("t", "b")], "topic_id string, id string")
    p = {r.gram: r.p for r in ngram.probabilities(tok, docset, 1).collect()}
    assert p == {"x": 2 / 6, "y": 2 / 6}  # two of six are the headlines' mass
    scores = ngram.sentence_scores(tok, docset, NgramConfig(bigram_weight=0.0)).collect()
    assert {(r.id, r.sent_index) for r in scores if r.score == 0} == {("a", 1)}


def test_idf_merges(spark):
    t = spark.createDataFrame([("a", "Apple", 1), ("b", "apple", 1), ("c", "apple", 2)], "id string, word string, cnt long")
    assert [r.df for r in stats.idf(t).collect()] == [2]
    assert [r.df for r in stats.idf(t, "sum").collect()] == [3]
    assert stats.default_idf(3) == pytest.approx(1.3862943611)


def candidates(spark, texts):
    return spark.createDataFrame([("t", "a", i, 1.0 - i / 100, t) for i, t in enumerate(texts)], "topic_id string, id string, sent_index long, score double, text string")


def test_removal_keeps_all_below_quota_and_drops_best_first(spark):
    few = candidates(spark, ["Is it so?", "It is."])
    assert realize.removal_step(few, realize.question(F.col("text"))).count() == 2
    many = candidates(spark, ["a " * 60 + "?", "b " * 60 + "?", "c " * 10 + "?"])
    assert [r.sent_index for r in realize.removal_step(many, realize.question(F.col("text"))).orderBy("sent_index").collect()] == [1, 2]


def test_pack_first_fit_and_extra(spark):
    c = candidates(spark, ["a " * 60 + ".", "b " * 50 + ".", "c " * 30 + "."])
    packed = realize.pack(c)
    assert {r.sent_index for r in packed.where("packed").collect()} == {0, 2}
    assert realize.extra(packed, packed.where("not packed").drop("packed")).count() == 0


def test_redundancy_and_rewrites(spark):
    c = candidates(spark, ["the dog ate the big red apple " + "x " * 100 + ".", "the dog ate the apple.", "something else entirely here."])
    assert {r.sent_index for r in realize.remove_redundant(c).where("not kept").collect()} == {1}
    df = spark.createDataFrame([("NASA went up , now .",)], "t string")
    assert df.select(T.clean_up(F.col("t"))).first()[0] == "Nasa went up, now."
    df = spark.createDataFrame([("The plan failed, officials said.",), ("However, -- it failed.",)], "t string")
    assert [r[0] for r in df.select(T.trim_sentence(T.remove_attribution(F.col("t")))).collect()] == ["The plan failed.", "it failed."]


def test_chronological_order():
    d = lambda n: datetime.date(1999, 4, n)
    rows = pd.DataFrame([("c", d(22), 1, "A", "x"), ("d", d(27), 3, "D", "x"), ("a", d(21), 0, "P", "x"), ("b", d(22), 0, "A", "x"), ("e", d(21), 4, "P", "x"), ("f", d(22), 1, "B", "x")], columns=["name", "date", "sent_index", "id", "text"])
    rows["score"] = 0.0
    at = order.order_rows(rows, OrderingConfig(topical_weight=0.0, succession_weight=0.0, chrono_weight=1.0), start=2)
    assert [rows["name"][k] for k in at] == ["a", "e", "b", "c", "f", "d"]


def test_rouge_clips_and_keeps_peers_apart(spark):
    p = spark.createDataFrame([("t", "one", ["a", "a", "b"]), ("t", "two", ["c"])], "topic_id string, peer_id string, tokens array<string>")
    m = spark.createDataFrame([("t", "m", ["a", "b", "c", "d"])], "topic_id string, model_id string, tokens array<string>")
    r = {x.peer_id: (x.r, x.p) for x in rouge.pair_scores(p, m, 1).collect()}
    assert r == {"one": (0.5, pytest.approx(2 / 3)), "two": (0.25, 1.0)}
    df = spark.createDataFrame([("The boats sailed on the lakes",)], "t string")
    assert df.select(rouge.first_tokens(F.col("t"), 5, ["the"], rouge.plural_stem)).first()[0] == ["boat", "sail", "on"]


def test_ids_and_paths(spark):
    df = spark.createDataFrame([("NYT19990421.0284",), ("XIN_ENG_20050101.0001",), ("bad",)], "id string")
    got = [tuple(r) for r in df.select(*tables.parse_id(F.col("id")).values(), tables.article_date(F.col("id"))).collect()]
    assert got[0] == ("NYT", "ENG", "19990421", "0284", 1999, datetime.date(1999, 4, 21))
    assert got[1][:5] == ("XIN", "ENG", "20050101", "0001", 2005) and got[2][5] is None


def test_readers(spark, tmp_path):
    (tmp_path / "topics.xml").write_text('<data><topic id="D1"><title> T </title><narrative>\nN\n</narrative><docsetA><doc id="A19990101.0001"/><doc id="B"/></docsetA></topic></data>')
    t = files.read_topics(spark, str(tmp_path / "topics.xml")).first()
    assert (t.topic_id, t.title, t.narrative, t.docset) == ("D1", "T", "N", ["A19990101.0001", "B"])
    (tmp_path / "old").write_text("<DOC>\n<DOCNO> APW19990421.0284 </DOCNO>\n<DOCTYPE> NEWS </DOCTYPE>\n<BODY>\n<HEADLINE> H &amp; K </HEADLINE>\n<TEXT>\nlead\n<P>\none\n</P>\n<P>\ntwo <broken\n</P>\n</TEXT>\n</BODY>\n</DOC>\n<DOC><DOCNO>X19990101.0001</DOCNO><BODY><TEXT><P>z</P></TEXT></BODY></DOC>\n")
    a = files.read_articles(spark, str(tmp_path / "old"), "old").orderBy("id").collect()
    assert (a[0].headline, a[0].type, a[0].paragraphs) == ("H & K", "NEWS", ["lead", "one", "two <broken"])
    assert (a[1].headline, a[1].paragraphs) == (None, ["z"])
    with gzip.open(tmp_path / "new.xml.gz", "wt") as f:
        f.write('<root><DOC id="XIN_ENG_20050101.0001" type="story"><HEADLINE>\nH\n</HEADLINE><TEXT><P>\np1\n</P><P>p2</P></TEXT></DOC></root>')
    b = files.read_articles(spark, str(tmp_path / "new.xml.gz"), "gz").first()
    assert (b.id, b.type, b.headline, b.paragraphs) == ("XIN_ENG_20050101.0001", "story", "H", ["p1", "p2"])
    assert files.read_idf(spark, str(tmp_path / "none")) is None


def test_incomplete_docset_raises(spark):
    q = spark.createDataFrame([("t", "a"), ("t", "b")], "topic_id string, id string")
    with pytest.raises(ValueError):
        tables.require_complete(q.where("id = 'a'"), q)


def test_stream_gives_each_article_once(spark, tmp_path):
    from newsloom.streaming import arrivals

    rows = [("A", None, None, None, ["One. Two."], datetime.datetime(2000, 1, 1)), ("A", None, None, None, ["One. Two."], datetime.datetime(2000, 1, 2))]
    spark.createDataFrame(rows, arrivals.SCHEMA).write.parquet(str(tmp_path / "in"))
    arrivals.sentence_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize("name", ["article_ids", "corpus_routing", "topic_articles", "clean_articles", "sentences", "idf", "unigram_probs", "topic_top20", "remove_fragments", "pack_quota", "rouge2"])
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("articles", "article_queries", "topics", "summaries", "common_words"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    assert got == sorted(map(repr, con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.SQL[name]})").fetchall()))


def test_config_is_json():
    assert '"max_sentences": 20' in Config().to_json()
    made = Config(ngram=NgramConfig(bias_weight=0.5), realization=realize.RealizationConfig(remove_subspans_that_match=("x",)))
    assert Config.from_json(made.to_json()) == made and Config.from_dict({"method": "select_lda"}).method == "select_lda"
    with pytest.raises(TypeError):
        Config.from_dict({"ngram": {"none": 1}})


def test_headlines_are_candidates_of_the_graph(spark):
    sf = "/root/testdata/sf0.001"
    tok = P.tokens(spark, sf, headlines=True)
    assert tok.where("sent_index = -1").count() > 0
    stop, docset, about = P.stop_words(spark, sf), tables.docset(spark, sf), tables.topics(spark, sf)
    graph = lambda **k: Config(method="select_lexrank", max_sentences=10_000, lexrank=LexRankConfig(rounds=1, **k))
    assert P.select(tok, docset, about, stop, graph()).where("sent_index = -1").count() > 0
    with pytest.raises(ValueError):
        P.select(tok, docset, about, stop, graph(similarity="word_vector"))
    with pytest.raises(ValueError):
        P.select(tok, docset, about, stop, Config(method="select_none"))


def test_threshold_graph_equals_the_matrix(spark):
    x = np.array([[0.8, 0.6, 0], [1, 0, 0], [0, 0.6, 0.8], [0, 0, 1]])
    v = spark.createDataFrame([("t", "a", i, str(w), float(x[i, w])) for i in range(4) for w in range(3) if x[i, w]], "topic_id string, id string, sent_index long, word string, w double")
    got = {r.sent_index: r.score for r in lexrank.threshold_lexrank(v, None, 0.5).collect()}
    m = ((x @ x.T) > 0.5) * 1.0
    want = np.linalg.solve(np.eye(4) - 0.6 * (m / m.sum(1, keepdims=True)).T, np.full(4, 0.1))
    assert [got[i] for i in range(4)] == pytest.approx(want.tolist(), rel=3e-5)


def test_word_vectors(spark):
    table = spark.createDataFrame([("ash", [1.0, 0.0]), ("bay", [0.0, 2.0]), ("nil", [0.0, 0.0])], "word string, vector array<double>")
    items = spark.createDataFrame([("a", 0, ["ash", "ash", "bay", "odd"]), ("a", 1, ["bay"]), ("a", 2, ["nil", "odd"]), ("a", 3, [])], "id string, sent_index long, tokens array<string>")
    docset = spark.createDataFrame([("t", "a")], "topic_id string, id string")
    means = vectors.mean_vectors(items, ["id", "sent_index"], table)
    got = {r.sent_index: r.vector for r in means.collect()}
    assert set(got) == {0, 1} and got[0] == pytest.approx([0.5**0.5] * 2) and got[1] == [0.0, 1.0]
    sums = {r.sent_index: r.total for r in vectors.row_sums(means, docset).collect()}
    assert sums == pytest.approx({0: 1 + 0.5**0.5, 1: 1 + 0.5**0.5})
    asked = vectors.mean_vectors(spark.createDataFrame([("t", ["ash"])], "topic_id string, tokens array<string>"), ["topic_id"], table)
    assert {r.sent_index: r.raw for r in vectors.query_similarity(means, docset, asked).collect()} == pytest.approx({0: 0.5**0.5, 1: 0.0})
    idf = spark.createDataFrame([("ash", 3, 0.5), ("bay", 1, 1.0)], "word string, df long, idf double")
    assert {r.sent_index: r.vector for r in vectors.mean_vectors(items, ["id", "sent_index"], table, idf).collect()}[0] == pytest.approx([1 / 5**0.5, 2 / 5**0.5])


def test_hooks_of_similarity_and_succession(spark):
    c = candidates(spark, ["Boats sank " + "x " * 100 + ".", "Ships went down.", "Something else."])
    seen = realize.remove_redundant(c, similarity=lambda a, b: 1.0 if {a["sent_index"], b["sent_index"]} == {0, 1} else 0.0)
    assert {r.sent_index for r in seen.where("not kept").collect()} == {1}
    alike = c.join(spark.createDataFrame([(0, [1.0, 0.0]), (2, [1.0, 0.0])], "sent_index long, vector array<double>"), "sent_index", "left")
    assert {r.sent_index for r in realize.remove_redundant(alike).where("not kept").collect()} == {2}
    day = datetime.date(1999, 4, 1)
    rows = pd.DataFrame([(n, day, 0, n, "x", 0.0) for n in "abc"], columns=["name", "date", "sent_index", "id", "text", "score"])
    config = OrderingConfig(topical_weight=0.0, succession_weight=1.0, chrono_weight=0.0)
    at = order.order_rows(rows, config, start=0, succession=lambda a, b: 1.0 if (a.name, b.name) == ("a", "b") else 0.0)
    assert [rows["name"][k] for k in at] == ["a", "b", "c"]


def test_scores_lower_while_they_are_taken():
    rows = pd.DataFrame({"id": ["a", "a"], "sent_index": [0, 1], "tokens": [["x", "y"], ["x"]], "entities": [[], []], "query": [["x"], ["x"]], "removable": [False, False], "raw": [1.0, 3.0]})
    lower = ngram.Scorer(rows, NgramConfig(reweight_scheme="before_selection", unigram_weight=1.0, bigram_weight=0.0))
    got = ngram.pick_by_article(rows, lower)
    assert got == pytest.approx({0: (0.5 + 0.25) / 2, 1: 0.5 - 1 / 4})  # sizes 4, then 3
    assert lower.uni["y"] == pytest.approx(0.25 - 1 / 3) and lower.size == 1
    blend = ngram.Scorer(rows, NgramConfig(unigram_weight=0.0, bigram_weight=0.0, query_weight=1.0, bias_weight=0.5))
    assert ngram.pick_by_article(rows, blend) == pytest.approx({0: 0.5 * 0.5 + 0.5 * 0.25, 1: 0.5 * 1 + 0.5 * 0.75})
    named = ngram.Scorer(rows.assign(entities=[["x y"], []]), NgramConfig(unigram_weight=0.0, bigram_weight=0.0, headline_weight=1.0))
    assert named.one(["x", "y"], ["x y"]) == pytest.approx(0.5 + 0.25 + 1.0)  # the only bigram


def test_one_of_each_row(spark, tmp_path):
    rows = [("a", 1), ("b", 2), ("a", 1), (None, 3), ("c", 4), ("a", 1)]
    df = spark.createDataFrame(rows, "id string, x int").repartition(3)
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t")).withColumn("y", F.lit(1))
    assert storage.in_files(stored) and not storage.in_files(df)
    for got in (storage.one_of_each(stored, "id", ["x"]), storage.one_of_each(stored, "id", ["x"], 0), storage.one_of_each(df, "id", ["x"]), storage.one_of_each(stored.where("false"), "id", ["x"])):
        assert sorted(tuple(r) for r in got.collect()) in ([("a", 1), ("b", 2), ("c", 4)], [])
    numbers = {r.id: r.number for r in storage.with_numbers(stored, "id", ["x"]).collect()}
    assert len(set(numbers.values())) == 3 and numbers == {r.id: r.number for r in storage.with_numbers(stored.repartition(1), "id", ["x"]).collect()} | numbers
    words = stats.vocabulary(spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "word string"))
    assert {r.word: r.number for r in words.collect()} == {"a": 0, "b": 1, "c": 2}


def test_datasets_are_read_once(spark, tmp_path):
    (tmp_path / "docs/old").mkdir(parents=True)
    (tmp_path / "docs/new").mkdir()
    (tmp_path / "topics.xml").write_text('<data><topic id="D1"><title>T</title><docsetA><doc id="A19990101.0001"/><doc id="X_ENG_20050101.0001"/></docsetA></topic></data>')
    (tmp_path / "docs/old/1_ENG").write_text("<DOC><DOCNO> A19990101.0001 </DOCNO><BODY><TEXT><P>One.</P></TEXT></BODY></DOC>")
    (tmp_path / "docs/old/2_ENG").write_text("<DOC><DOCNO> B19990101.0001 </DOCNO><BODY><TEXT><P>Two.</P></TEXT></BODY></DOC>")
    (tmp_path / "docs/old/readme").write_text("<DOC><DOCNO> C19990101.0001 </DOCNO></DOC>")
    with gzip.open(tmp_path / "docs/new/1.gz", "wt") as f:
        f.write('<DOC id="X_ENG_20050101.0001" type="story">\n<HEADLINE>\nA < B &amp; C\n<TEXT><P>Ash <b broken</P><P>Bay</TEXT></DOC>\n<DOC type="other" id="Y_ENG_20050101.0001"><TEXT>own</TEXT></DOC>')
    d = datasets.Dataset("devtest", "topics.xml", datasets.corpora(A="docs/old", C="docs/new"), "store")
    reg = datasets.Registry(d).under(str(tmp_path))
    got = {r.id: (r.headline, r.paragraphs) for r in reg.topics(spark, "devtest").collect()}
    assert got == {"A19990101.0001": (None, ["One."]), "X_ENG_20050101.0001": ("A < B & C", ["Ash <b broken", "Bay"])}
    assert {r.id for r in datasets.all_articles(spark, reg["devtest"]).collect()} == set(got) | {"B19990101.0001", "Y_ENG_20050101.0001"}
    assert datasets.all_articles(spark, reg["devtest"], 1).count() == 3
    (tmp_path / "docs/old/1_ENG").unlink()
    assert reg.topics(spark, "devtest").count() == 2  # from the store
    with pytest.raises(ValueError):
        reg.regenerate(spark)
    with pytest.raises(ValueError):
        reg.topics(spark, "none")
    counts = datasets.word_counts(spark, str(tmp_path / "counts"), lambda: spark.createDataFrame([("a", "x", 2), ("b", "x", 1)], "id string, word string, cnt long"))
    assert datasets.words_of(counts, "a") == {"x": 2} and datasets.word_counts(spark, str(tmp_path / "counts"), None).count() == 2


def test_sentences_by_subtopic(spark):
    tok = spark.createDataFrame([("a", 0, ["ash", "bay"]), ("a", 1, ["cod"]), ("a", 2, ["bay", "ash", "elm"])], "id string, sent_index long, tokens array<string>")
    docset = spark.createDataFrame([("t", "a")], "topic_id string, id string")
    sub = spark.createDataFrame([("t", 0, "ash bay"), ("t", 1, "cod elm")], "topic_id string, subtopic int, words string")
    assert {(r.sent_index, r.score) for r in topics.select_by_subtopic(tok, docset, sub).collect()} == {(0, 2.0), (1, 1.0)}


def test_writers(spark, tmp_path):
    lines = spark.createDataFrame([("D1001A", 0, "One."), ("D1001A", 1, "Two.")], "topic_id string, line_no long, sentence string")
    files.write_summaries(lines, str(tmp_path / "out"))
    made = [p for p in (tmp_path / "out").rglob("part-*")]
    assert [p.parent.name for p in made] == ["name=D1001-A.M.100.A.1"] and made[0].read_text() == "One.\nTwo.\n"
    pairs = files.rouge_pairs(spark.createDataFrame([("D1001-A.M.100.A.1",)], "name string"), spark.createDataFrame([("D1001-A.M.100.A.B",), ("D1002-A.M.100.A.B",)], "name string"))
    files.rouge_config(pairs, "peers", "models", str(tmp_path / "rouge"))
    text = "".join(p.read_text() for p in (tmp_path / "rouge").glob("part-*"))
    assert '<M ID="B">D1001-A.M.100.A.B</M>' in text and "D1002" not in text
    idf = spark.createDataFrame([("ash", 1, 0.5)], "word string, df long, idf double")
    files.write_idf(idf, 1.5, str(tmp_path / "idf"))
    back, default = files.read_idf(spark, str(tmp_path / "idf"))
    assert default == 1.5 and [tuple(r) for r in back.collect()] == [("ash", 1, 0.5)]


def test_graph_ranking_converges(spark):
    v = spark.createDataFrame([("t", "a", 0, "x", 0.8), ("t", "a", 0, "y", 0.6), ("t", "a", 1, "x", 1.0), ("t", "b", 0, "y", 0.6), ("t", "b", 0, "z", 0.8)], "topic_id string, id string, sent_index long, word string, w double")
    bias = spark.createDataFrame([("t", "a", 0, 0.7), ("t", "a", 1, 0.2), ("t", "b", 0, 0.1)], "topic_id string, id string, sent_index long, bias double")
    got = {(r.id, r.sent_index): r.score for r in lexrank.lexrank(v, bias, rounds=LexRankConfig().rounds).collect()}
    x = np.array([[0.8, 0.6, 0], [1, 0, 0], [0, 0.6, 0.8]])
    m = x @ x.T
    step = 0.6 * (m / m.sum(1, keepdims=True)).T
    want = np.linalg.solve(np.eye(3) - step, 0.4 * np.array([0.7, 0.2, 0.1]))
    assert [got["a", 0], got["a", 1], got["b", 0]] == pytest.approx(want.tolist(), rel=3e-5)


def test_production_parameters(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(rouge, "bootstrap", lambda scores, rounds=1000, seed=7: seen.update(rounds=rounds))
    monkeypatch.setattr(ngram, "select_stateful", lambda tok, docset, config: seen.update(glob=config.num_sents_per_glob))
    monkeypatch.setattr(P, "summarize", lambda spark, d, config: seen.update(graph=config.lexrank.rounds))
    for name in ("rouge_intervals", "sumbasic_glob", "summaries_lexrank"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == {"rounds": 1000, "glob": 1000, "graph": None}


def test_subtopics_of_each_topic(spark):
    sides = {"p": ["ash bay cod"] * 6 + ["elm fig gum"] * 6, "q": ["hay ivy jam"] * 6 + ["kit log mud"] * 6}
    rows = [(f"{t}{i}", 0, (x + " ").split() * 9) for t, xs in sides.items() for i, x in enumerate(xs)]
    tok = spark.createDataFrame(rows, "id string, sent_index long, tokens array<string>")
    got = topics.topic_words(tok, tok.select(F.substring("id", 1, 1).alias("topic_id"), "id"), n=3).collect()
    assert sorted((r.topic_id, r.subtopic) for r in got) == [("p", 0), ("p", 1), ("q", 0), ("q", 1)]
    assert {(r.topic_id, " ".join(sorted(r.words.split()))) for r in got} == {(t, x) for t, xs in sides.items() for x in xs}
    assert "topic_hits" in catalog.QUERIES


def scored_rows(spark):
    rng = random.Random(3)
    rows = [(a, i, [rng.choice("uvwxyz") for _ in range(rng.randrange(7))]) for a in "abcd" for i in range(5)]
    tok = spark.createDataFrame(rows, "id string, sent_index long, tokens array<string>")
    docset = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "b"), ("u", "c"), ("v", "d")], "topic_id string, id string")
    return tok, docset


def test_scores_of_whole_topics_equal_those_by_joins(spark, monkeypatch):
    tok, docset = scored_rows(spark)
    named = spark.createDataFrame([("a", ["u v", "w"]), ("b", ["x"])], "id string, entities array<string>")
    config = NgramConfig(trigram_weight=0.5, headline_weight=0.4, cartesian_weight=0.3)
    take = lambda: {(r.topic_id, r.id, r.sent_index): r.score for r in ngram.sentence_scores(tok, docset, config, None, named).collect()}
    pairs = lambda: {(r.topic_id, r.gram): (r.cnt, round(r.p, 12)) for r in ngram.pair_probabilities(tok, docset).collect()}
    got, counted = take(), pairs()
    for most in (0, 50):  # all topics by joins, some by joins
        monkeypatch.setattr(whole, "MOST_WORDS", most)
        assert take() == pytest.approx(got) and pairs() == counted
    assert len(got) == 25 and len(counted) > 20


def test_only_lists_of_words_are_moved_for_scores(spark):
    """no row for each n-gram (Generate) before or after a shuffle."""
    plan = ngram.sentence_scores(*scored_rows(spark), NgramConfig())._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_topics_are_gathered_whole():
    rows = [pa.RecordBatch.from_pydict({"topic_id": list(x)}) for x in ("aab", "bb", "bcd", "", "d")]
    assert ["".join(t["topic_id"].to_pylist()) for t in whole.whole(rows, 2)] == ["aa", "bbbbc", "dd"]
    assert ["".join(t["topic_id"].to_pylist()) for t in whole.whole(rows, 100)] == ["aabbbbcdd"]


@pytest.mark.parametrize("rounds", [0, 3, None])
def test_graph_of_whole_topics_equals_the_joins(spark, monkeypatch, rounds):
    """the rounds of a topic are one call, without jobs and checkpoints between them."""
    tok, docset = scored_rows(spark)
    idf = spark.createDataFrame([("u", 0.0), ("v", 0.5), ("w", 1.0), ("x", 1.5), ("q", 0.7)], "word string, idf double")
    asked = spark.createDataFrame([("t", ["v", "q", "v"]), ("u", ["none"])], "topic_id string, query_tokens array<string>")  # u has no known word, v no query
    for queries in (asked, None):
        take = lambda: {(r.topic_id, r.id, r.sent_index): r.score for r in lexrank.lexrank_of_tokens(tok, docset, idf, queries, rounds=rounds).collect()}  # noqa: B023, E731
        with monkeypatch.context() as m:
            m.setattr(lexrank, "cut", None)
            got = take()
            m.undo()
            m.setattr(lexrank, "MOST_TERMS", 1)
            assert take() == pytest.approx(got, rel=1e-4) and got
        assert {k[0] for k in got} == ({"t"} if queries is not None else {"t", "u", "v"})


def test_idf_of_lists_counts_articles(spark):
    tok, _ = scored_rows(spark)
    by_rows = stats.idf(tok.select("id", F.explode("tokens").alias("word")).distinct())
    assert sorted(map(tuple, stats.idf_of_lists(tok).collect())) == sorted(map(tuple, by_rows.collect()))


def test_only_some_sentences_are_returned(spark, monkeypatch):
    """which sentences may be selected goes with their words, so scores meet no other rows."""
    tok, docset = scored_rows(spark)
    every = {(r.topic_id, r.id, r.sent_index): r.score for r in ngram.sentence_scores(tok, docset, NgramConfig()).collect()}
    for most in (whole.MOST_WORDS, 0):
        monkeypatch.setattr(whole, "MOST_WORDS", most)
        some = {(r.topic_id, r.id, r.sent_index): r.score for r in ngram.sentence_scores(tok, docset, NgramConfig(), only=F.col("sent_index") > 2).collect()}
        assert some == pytest.approx({k: v for k, v in every.items() if k[2] > 2})


def test_texts_of_other_sentences_are_not_moved(spark, monkeypatch):
    """texts are dropped where they are read."""
    tok, docset = scored_rows(spark)
    tok = tok.withColumn("date", F.lit(None).cast("date")).withColumn("text", F.concat_ws(" ", "id", "sent_index"))
    top = ngram.best(ngram.sentence_scores(tok, docset, NgramConfig()), ["topic_id"], 2)
    kept = []
    monkeypatch.setattr(P, "written", lambda df, label: kept.append((label, df)) or storage.written(df, label))
    got, plain = (sorted(map(tuple, P.with_texts(top, tok, most).drop("date").collect())) for most in (100, 0))
    assert got == plain and len(got) == 6
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for label, df in kept if label == "candidates"]
    assert ["LeftSemi" in p for p in plans] == [True, False]


def test_subtopics_side_by_side_equal_a_call_each(spark, monkeypatch):
    """topics fitted together give the words that each gives alone."""
    tok, docset = scored_rows(spark)
    alone = sorted(map(tuple, topics.topic_words_each(tok, docset).collect()))
    with monkeypatch.context() as m:
        m.setattr(topics, "topic_words_each", None)
        assert sorted(map(tuple, topics.topic_words(tok, docset).collect())) == alone and len(alone) == 6
    monkeypatch.setattr(whole, "MOST_WORDS", 20)
    assert sorted(map(tuple, topics.topic_words(tok, docset).collect())) == alone


def test_queries_and_bias_are_scored_with_their_topics(spark, monkeypatch):
    """query hits and the bias are found where a topic is scored, without tables of words, with the joins' results."""
    tok, docset = scored_rows(spark)
    idf = spark.createDataFrame([("u", 0.0), ("v", 0.5), ("w", 1.0), ("x", 1.5), ("q", 0.7)], "word string, idf double")
    asked = spark.createDataFrame([("t", ["v", "q", "v"]), ("u", ["none", "y"]), ("away", ["v"])], "topic_id string, query_tokens array<string>")
    none = docset.unionByName(spark.createDataFrame([("away", "gone")], "topic_id string, id string"))  # no article is there
    config = NgramConfig(cartesian_weight=0.3, query_weight=0.2, bias_weight=0.25)
    take = lambda **more: {(r.topic_id, r.id, r.sent_index): r.score for r in ngram.sentence_scores(tok, none, config, asked, **more).collect()}
    want = take(bias=lexrank.query_bias(tok, none, asked, idf))
    with monkeypatch.context() as m:
        m.setattr(lexrank, "query_bias", None)
        m.setattr(ngram, "query_scores", None)
        plan = ngram.sentence_scores(tok, none, config, asked, idf=idf)._jdf.queryExecution().executedPlan().toString()
        assert take(idf=idf) == pytest.approx(want) and len(want) == 25 and "Generate" not in plan and "Window" not in plan
    with monkeypatch.context() as m:
        m.setattr(lexrank, "MOST_TERMS", 1)
        assert take(idf=idf) == pytest.approx(want)
    for most in (0, 50):  # all topics by joins, some by joins
        monkeypatch.setattr(whole, "MOST_WORDS", most)
        assert take(idf=idf) == pytest.approx(want)


@pytest.mark.parametrize("weighted", [True, False])
def test_vector_sums_of_whole_topics_equal_the_joins(spark, monkeypatch, weighted):
    """F16: vectors are sent to sentences instead of a vector for each word being moved to its sentence."""
    tok, docset = scored_rows(spark)
    table = spark.createDataFrame([("u", [1.0, 0.0]), ("v", [0.5, 2.0]), ("w", [0.5, 2.0]), ("x", [-1.0, 0.0]), ("y", [0.0, 0.0])], "word string, vector array<double>")
    idf = spark.createDataFrame([("u", 0.0), ("v", 0.5), ("w", 1.0), ("x", 1.5), ("q", 0.7)], "word string, idf double") if weighted else None
    take = lambda: {(r.topic_id, r.id, r.sent_index): r.total for r in vectors.row_sums_of_tokens(tok, docset, table, idf).collect()}
    want = {(r.topic_id, r.id, r.sent_index): r.total for r in vectors.row_sums(vectors.mean_vectors(tok, ["id", "sent_index"], table, idf), docset).collect()}
    with monkeypatch.context() as m:
        m.setattr(vectors, "mean_vectors", None)
        for chunk in (vectors.CHUNK, 3):
            m.setattr(vectors, "CHUNK", chunk)
            assert take() == pytest.approx(want) and 10 < len(want) < 25
    for name, most in (("MOST_TERMS", 1), ("MOST_NUMBERS", 1)):
        with monkeypatch.context() as m:
            m.setattr(vectors, name, most)
            assert take() == pytest.approx(want)
    for most in (0, 50):
        monkeypatch.setattr(whole, "MOST_WORDS", most)
        assert take() == pytest.approx(want)


def test_sentences_are_moved_once_to_their_topics(spark, monkeypatch):
    """F8: links are sent to the sentences, which aren't moved to meet them."""
    tok, docset = scored_rows(spark)
    take = lambda: ngram.pair_probabilities(tok, docset)
    plans, rows = [], []
    for most in (whole.MOST_LINKS, 1):
        monkeypatch.setattr(whole, "MOST_LINKS", most)
        plans.append(take()._jdf.queryExecution().optimizedPlan().toString())
        rows.append(sorted(map(tuple, take().collect())))
    assert ["strategy=broadcast" in p for p in plans] == [True, False] and rows[0] == rows[1] and rows[0]


def test_summaries_of_many_topics_are_a_call(spark):
    """redundancy and order are judged for many topics at once, with the results of a call for each."""
    rng, words = random.Random(5), ["ash", "bay", "cod", "dew", "elm"]
    rows = [(f"t{t}", f"a{i % 4}", i, rng.randrange(4) / 4, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) + ".", datetime.date(2000, 1, 1 + rng.randrange(9))) for t in range(9) for i in range(1 + 4 * t)]
    c = spark.createDataFrame(rows, "topic_id string, id string, sent_index long, score double, text string, date date")
    judged = lambda **more: realize.remove_redundant(c, 0.6, 20, **more)
    lines = lambda **more: order.ordered(c, OrderingConfig(), **more)
    for got, each in ((judged(), judged(similarity=lambda a, b: 0.0)), (lines(), lines(succession=lambda a, b: 0.0))):
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, each.collect())) and got.count() == len(rows)
    assert 0 < judged().where("not kept").count() < len(rows)
