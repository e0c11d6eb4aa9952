import collections
import datetime
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from newsloom.llm import encoding, leaks, lines, near, quality, sentences, spans, terms

ARTICLE = "id string, headline string, paragraphs array<string>, date date, doc long, text string"


def articles(spark, rows):
    """Rows (id, paragraphs[, headline]); with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(r[0], r[2] if len(r) > 2 else None, r[1], datetime.date(1999, 1, 1), 7, "x") for r in rows], ARTICLE)


EDGES = [("A19990101.0001", None), ("A19990101.0002", []), ("A19990101.0003", [None, "", " \n\t "]), (None, ["Lost text."])]


def split(text, lang="ENG", known=None):
    s = sentences.Splitter(lang, [text], known or {("ENG", "U.S"): True, ("ENG", "Inc"): True})
    return [text[a:b] for a, b in s.split(text)]


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("Dr. Ash left. He ran.", 2),
        ("Exports to the U.S. The end.", 2),
        ("The U.S. council met.", 1),
        ("It cost $3.5 million ... and more. Then rain.", 2),
        ("“Who said? We did!” asked A, who left. Next.", 2),
        ("He said, “One. Two.” The rest.", 2),
        ("“Will it?” Ash asked as it fell. Next.", 2),
        ("(Ash, a clerk, ran.) The end.", 2),
        ("ROME, Nov. 10 _ The census came; it went: fast.", 1),
        ("no stop at all", 1),
        ("\n  \t", 0),
        ("“Open. Never closed.", 2),
        ("eBay said. eBay did.", 2),
    ],
)
def test_sentence_counts(text, n):
    got = split(text)
    assert len(got) == n
    assert "".join("".join(got).split()) == "".join(text.split())


def test_document_decides_first():
    text = "The Gaz. reported losses. Then Gaz. Marlow left the Gaz. The end came."
    assert split(text) == ["The Gaz. reported losses.", "Then Gaz. Marlow left the Gaz.", "The end came."]
    assert len(split(text, known={("ENG", "Gaz"): True})) == 4
    assert len(split("He ran. then he ran off. Ash ran. Bob too.")) == 3  # a slip makes no abbreviation of "ran"


def test_one_document_splits_what_another_does_not():
    """The same words, in documents that show an abbreviation, a word, a name, a common word or nothing."""
    never = {("ENG", "Prof"): False, ("ENG", "Sun"): False}
    parts = lambda text, known=None: len(split(text + " They met Gaz. Marlow there.", known=known or never))
    assert parts("The Gaz. reported losses.") == 2
    assert parts("The Gaz. reported losses. All saw the old marlow swim.") == 4
    assert parts("It rained.") == 3
    sun = "It was seen by Sun. Later it rose."
    assert len(split(sun, known=never)) == 1
    assert len(split(sun + " We like the Sun very much.", known=never)) == 3
    assert len(split(sun + " It came later on.", known=never)) == 3


def test_abbreviations_beyond_the_bound_are_joined(spark):
    many = [(f"U{i}", ["He met Prof. Brown. He saw Capt. Green."]) for i in range(18)]
    a = articles(spark, many)
    assert {r.end_pos for r in sentences.split_sentences(a).collect()} == {19, 39}
    for most in (0, 1):
        assert {tuple(r) for r in sentences.split_sentences(a, most=most).collect()} == {tuple(r) for r in sentences.split_sentences(a).collect()}


def test_abbreviations_count_documents(spark):
    again = [("S", ["He met Smith. Brown ran."])] * 30
    inside = [("T", ["He met Jones. Brown ran. " * 30, "Etc. and so on etc. and. " * 9])]
    many = [(f"U{i}", ["He met Prof. Brown."]) for i in range(18)]
    got = sentences.abbreviations(sentences.abbreviation_evidence(articles(spark, again + inside + many)))
    assert got == {("ENG", "Prof"): False}
    assert sentences.split_sentences(articles(spark, again + many)).where("id = 'S'").count() == 2


def test_scripts_without_blanks():
    assert split("“一。二。”他说。三！四", "CMN") == ["“一。二。”他说。", "三！", "四"]
    assert split("ราคา 33.9 ล้าน สองคน", "THA") == ["ราคา 33.9 ล้าน", "สองคน"]
    assert split("डॉ. राम आए। वे गए।", "HIN") == ["डॉ. राम आए।", "वे गए।"]


def test_sentences_of_edge_rows(spark):
    got = sentences.split_sentences(articles(spark, [*EDGES, ("B", ["One. Two.", None]), ("B", ["One. Two.", None])])).collect()
    assert sorted(tuple(r) for r in got) == [("B", 0, 0, 4), ("B", 0, 5, 9)]
    assert sentences.split_sentences(articles(spark, [])).count() == 0


def naive_terms(ps):
    t = "\n".join(p.lower() for p in ps or [] if p)
    t = regex.sub(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー]+", " ", t)
    return collections.Counter(regex.findall(r"[\p{L}\p{M}]+", t))


def test_terms_against_brute_force(spark):
    random.seed(3)
    words = ["ash", "Éa", "naïve", "бор", "ab中cd", "tt", "zz", "kk", "ll", "mm"]
    rows = [(f"B{i}", [" ".join(random.choices(words, k=30)), None, ""]) for i in range(40)] + EDGES + [("L", ["long " * 300_000])]
    counts = {r[0]: naive_terms(r[1]) for r in rows if r[0]}
    df = collections.Counter(t for c in counts.values() for t in c)
    n = sum(counts.values(), collections.Counter())
    a = articles(spark, rows + rows[:5])
    got = {r.term: (r.n, r.df) for r in terms.term_frequencies(a).collect()}
    assert got == {t: (n[t], df[t]) for t in n}
    left = spark.createDataFrame([("ash",), (None,)], "word string")
    best = collections.defaultdict(dict)
    for r in terms.distinctive_terms(a, left).collect():
        best[r.id][r.place] = r.term
    for i, c in counts.items():
        want = sorted(((-k * np.log((len(counts) + 1) / (df[t] + 1)), t) for t, k in c.items() if df[t] >= 2 and t != "ash"))[:3]
        assert [best[i][p] for p in sorted(best[i])] == [t for _, t in want]
    assert terms.useless_terms(articles(spark, [])).count() == 0


def test_bitmaps_stand_for_records(spark, tmp_path):
    """Numbers lead back to ids, whatever the tasks; the union with a later batch counts all records."""
    rows = [(f"B{i:03}", ["ash elm" if i % 3 else "ash oak oak"]) for i in range(90)] + [(f"B{i:03}", ["ash elm" if i % 3 else "ash oak oak"]) for i in range(0, 90, 9)]
    for k, part in enumerate((rows[:50], rows[50:])):
        articles(spark, part).coalesce(1).write.parquet(str(tmp_path / f"day{k}"))
    both = spark.read.parquet(str(tmp_path / "day0"), str(tmp_path / "day1"))
    number = {r.number: r.id for r in terms.record_numbers(both).collect()}
    assert sorted(number.values()) == sorted({r[0] for r in rows})
    held = collections.defaultdict(set)
    for r in terms.term_bitmaps(both).collect():
        held[r.term] |= {number[r.container * terms.CONTAINER + int(m)] for m in terms.unpack(r.records)}
    assert held["oak"] == {f"B{i:03}" for i in range(0, 90, 3)} and held["ash"] == set(number.values())
    assert held["oak"] & held["elm"] == set()
    bits = terms.term_bitmaps(both)
    again = terms.united(bits.repartition(3).unionByName(bits.where("false")))
    assert {(r.term, r.df, r.n) for r in again.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).collect()} == {("ash", 90, 90), ("oak", 30, 60), ("elm", 60, 60)}


def test_bitmap_round_trip():
    for size in (1, 5, 511, 512, 8000):
        m = np.sort(np.random.default_rng(size).choice(terms.CONTAINER, size, replace=False))
        assert (terms.unpack(terms.pack(m)) == m).all()


def test_graph_degree():
    block = terms.Terms(["a b a c", ""])
    doc, term, n, degree = terms.word_graph(block)
    assert {(block.words[t], int(k), int(g)) for t, k, g in zip(term, n, degree)} == {("a", 2, 2), ("b", 1, 2), ("c", 1, 2)}


def test_near_duplicates_against_brute_force(spark):
    random.seed(5)
    rows = []
    for i in range(60):
        base = [random.choice("abcdefgh") * random.randint(1, 3) + str(random.randint(0, 99)) for _ in range(60)]
        for k in range(random.randint(1, 3)):
            rows.append((f"N{i}.{k}", [" ".join(w for w in base if random.random() > 0.04 * k), None]))
    rows += [("C1", ["Same text here."]), ("C2", ["same  TEXT, here"]), ("S", ["short"]), *EDGES]
    text = {r[0]: regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", " ".join(p for p in r[1] or [] if p is not None).lower()).strip() for r in rows if r[0]}
    sets = {i: {t[k : k + 8] for k in range(len(t) - 7)} for i, t in text.items() if len(t) >= 8}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    got = {tuple(r) for r in near.all_pairs(*near.near_duplicates(articles(spark, rows + rows[:3]))).collect()}
    assert ("C1", "C2") in got and not got - want and len(want & got) >= 0.95 * len(want)


@pytest.mark.parametrize(("depth", "small"), [(1, 40), (1, 1), (3, 1)])
def test_pairs_at_the_threshold_survive(monkeypatch, depth, small):
    """Pairs of signatures that agree in 0.61 of places, at a forced depth, down to the last level inside."""
    monkeypatch.setattr(near, "SMALL", small)
    rng = np.random.default_rng(4)
    n = 400
    left = rng.integers(0, 256, (n, near.PLACES), dtype=np.uint8)
    right = np.where(rng.random((n, near.PLACES)) < 0.61, left, left + 1 + rng.integers(0, 200, (n, near.PLACES), dtype=np.uint8)).astype(np.uint8)
    plan = near.Plan(1 << 16)
    plan.depth, plan.big = depth, {k: np.full(8192, 255, np.uint8) for k in range(1, depth)}
    sigs = [x.tobytes() for x in np.concatenate((left, right))]
    batch = near.pa.RecordBatch.from_arrays([near.pa.array([str(i) for i in range(2 * n)]), near.pa.array(np.arange(2 * n)), near.pa.array(sigs, near.pa.binary())], names=["id", "h1", "sig"])
    parts = list(near._paths(plan)(iter([batch])))
    node, tree = (np.concatenate([b[c].to_numpy() for b in parts]) for c in ("node", "tree"))
    ids = np.concatenate([np.array(b["id"].to_pylist(), int) for b in parts])
    sig = np.concatenate([near._sigs(b) for b in parts])
    pairs = ids[near.node_pairs(sig, node.view(np.uint64), tree.astype(np.int64))]
    agree = (left == right).sum(1) >= near.AGREE * near.PLACES
    met = {tuple(sorted(p)) for p in pairs.tolist()}
    assert np.mean([(i, i + n) in met for i in np.flatnonzero(agree)]) >= 0.98
    assert near.recall(near.THRESHOLD, depth, near.trees_for(depth)) >= near.RECALL > near.recall(near.THRESHOLD, depth, near.trees_for(depth) - 1)


def test_depth_follows_the_nodes_and_loses_nothing(spark):
    """Nodes of a few records force more levels; what is sent grows with the depth that the records need, links stay."""
    a = spark.read.parquet("/root/testdata/sf0.001/articles.parquet")
    want = {(r.a, r.b) for r in near.near_duplicates(a)[0].collect()}
    got = {(r.a, r.b) for r in near.near_duplicates(a, node_rows=20, levels=3)[0].collect()}
    assert len(got & want) >= 0.99 * len(want) and not got - want
    signed = near.written(a.dropDuplicates(["id"]).mapInArrow(near._sign, near.SIGNATURES), "signed")
    sent, depth = {}, {}
    for rows in (near.NODE_ROWS, 20):
        plan = near.plan_nodes(signed, signed.count(), rows, 3)
        sent[rows], depth[rows] = signed.mapInArrow(near._paths(plan), near.NODES).count() / signed.count(), plan.depth
    assert depth[near.NODE_ROWS] == 1 < depth[20]
    assert sent[20] <= 2 * sent[near.NODE_ROWS] and sent[near.NODE_ROWS] <= near.trees_for(1)


def test_crowded_nodes_are_cut_into_blocks(spark):
    random.seed(8)
    base = ["".join(random.choices("abcdefghij", k=6)) for _ in range(60)]
    rows = [(f"K{i:02}", [" ".join([*base, f"only {i} " + "".join(random.choices("xyzuvw", k=12))])]) for i in range(40)]
    links, _ = near.near_duplicates(articles(spark, rows), node_rows=9, levels=2)
    got = {(r.a, r.b) for r in links.collect()}
    assert len(got) == 40 * 39 // 2


def test_repeated_lines(spark):
    rows = [(f"ABC2000010{i}.0001", [f"By Ash\nText number {i} is here", None]) for i in range(9)] + [(f"XYZ2000010{i}.0001", ["by  ASH "]) for i in range(7)] + EDGES
    got = sorted(tuple(r) for r in lines.repeated_lines(articles(spark, rows + rows[:2])).select("id", "para_no", "line_no").collect())
    assert got == [(f"ABC2000010{i}.0001", 0, 0) for i in range(9)]
    clean = {r.id: r.paragraphs for r in lines.without_covered_lines(articles(spark, rows)).collect()}
    assert clean["XYZ20000101.0001"] == ["by  ASH "] and clean["ABC20000101.0001"] == [None, None]  # numbers vary


def test_templates_cover_lines_that_vary(spark):
    name = ["Ash", "Bay", "Cod", "Elm", "Fig", "Gum", "Hay", "Ivy", "Jam"]
    rows = [(f"ABC2000010{i}.0001", [f"This story was written in full by {n} {m} for the paper\nThe {n} went to {m} by boat at noon today"]) for i, (n, m) in enumerate(zip(name, name[::-1]))]
    a = articles(spark, rows)
    assert lines.repeated_lines(a).count() == 0
    clean = [r.paragraphs for r in lines.without_covered_lines(a).collect()]
    assert sorted(clean) == sorted([p.split("\n")[1]] for _, (p,) in rows)
    full = lines.full_leaves(lines.lines_of(a), 8)
    assert [(" ".join(r.template), r.n) for r in lines.line_templates(full).collect()] == [("this story was written in full by <*> <*> for the paper", 9)]
    split = full.repartition(5).sortWithinPartitions("line")  # whatever the tasks
    assert [r.n for r in lines.line_templates(split).collect()] == [9]


def test_templates_keep_half_of_their_tokens():
    leaf = lines.Leaf()
    for t in ("a b c d", "a b x y", "a q x z", "r q x z"):
        leaf.add(t.split(), 1)
    assert [t for t, _ in leaf.templates()] == [["a", "b", "<*>", "<*>"], ["<*>", "q", "x", "z"]]


@pytest.mark.parametrize("hot", [2000, 1])
def test_shared_spans_against_brute_force(spark, monkeypatch, tmp_path, hot):
    monkeypatch.setattr(spans, "HOT", hot)
    random.seed(9)
    part = ["".join(random.choices("abcdef ", k=random.randint(100, 300))) for _ in range(12)]
    rows = [(f"D{i}", ["".join(random.sample(part, 4)), "x" * 400 if i < 2 else None, part[0] * 2]) for i in range(15)] + EDGES
    a = articles(spark, rows + rows[:2])
    index = spans.FingerprintIndex(spark, str(tmp_path / "index"), buckets=4, fan_out=2)
    hits = [index.append(a.where("id < 'D11'"))]
    hits.append(index.append(a.where("id >= 'D11' and id < 'D13'")))
    for name, _ in index.runs:
        spark.sql(f"DROP TABLE {name}")
    again = spans.FingerprintIndex(spark, str(tmp_path / "index"), fan_out=2)  # opened from its files
    assert again.runs == index.runs and again.buckets == 4
    hits.append(again.append(a.where("id >= 'D13'")))
    assert len(again.runs) == 2  # compacted, and the files of the old runs are gone
    assert len([f for f in (tmp_path / "index").iterdir() if f.name.startswith("run_")]) == 2
    hits = again.places(hits[0].unionByName(hits[1]).unionByName(hits[2]))
    held = collections.defaultdict(set)
    for i, ps in rows[:15]:
        for p in ps:
            for k in range(len(p or "") - 159):
                held[p[k : k + 160]].add(i)
    want = set()
    for i, ps in rows[:15]:
        for no, p in enumerate(ps):
            run = None
            for k in range(len(p or "") - 159):
                if len(held[p[k : k + 160]]) > 1:
                    if run and k <= run[1]:
                        run[1] = k + 160
                    else:
                        want |= {(i, no, *run)} if run else set()
                        run = [k, k + 160]
            want |= {(i, no, *run)} if run else set()
    got = [tuple(r) for r in spans.shared_spans(a, hits).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_windows_are_compared_by_characters():
    """Where all hashes collide, only windows of equal characters count."""
    near = ["abcdefgh", "xabcdefy", "qqqqqqqq"]
    zero = lambda pre, a, b: np.zeros(len(a), np.uint64)
    row, place = spans.shared_windows(near, np.zeros(3, np.int64), np.arange(3), 6, zero)
    assert list(zip(row.tolist(), place.tolist())) == [(0, 0), (1, 1)]
    got = [x.tolist() for x in spans.shared_windows(near, np.zeros(3, np.int64), np.arange(3), 6)]
    assert got == [row.tolist(), place.tolist()]
    assert len(spans.shared_windows(near, np.arange(3), np.arange(3), 6)[0]) == 0


def test_spans_of_undated_and_empty_batches(spark):
    text = "A sentence of some length that stands in two articles, word for word. " * 4
    a = articles(spark, [("A19990101.0001", [text]), ("B19990101.0001", ["Here: " + text, None])])
    assert spans.spans_of_batches(a).count() == 2
    assert spans.spans_of_batches(a.withColumn("date", F.lit(None).cast("date"))).count() == 2
    assert spans.spans_of_batches(a.limit(0)).count() == 0


def test_encoding_equals_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    random.seed(1)
    texts = ["", "a", "<|endoftext|> x", "  \n\n tabs\t", "日本語のテキスト" * 20, "é" * 5000, "abc" * 3000, "I'll we've"] + ["".join(random.choices("abcde éб中 .,'0\n", k=k)) for k in range(1, 60)]
    rows = list(enumerate(texts)) + [(999, None), (999, None)]
    got = {r.doc_id: r.ids for r in encoding.encode_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[999] == []
    for i, t in enumerate(texts):
        assert got[i] == lib.encode(t, add_special_tokens=False).ids
    ids, pairs = encoding.load_vocabulary()
    assert encoding.merge_piece([ids[b] for b in b"hello"], pairs) == lib.encode("hello", add_special_tokens=False).ids


def test_pieces_of_all_lengths_get_ids():
    ids, pairs = encoding.load_vocabulary()
    merger = encoding.Merger(ids, pairs)
    sizes = [1, 2, 3, 4, 5, 1024, 1025, 1026, 2048, 2049, 2050, 3000, 4095, 4096, 4097, 4098, 8200]
    pieces = [(b * k)[:k] for k in sizes for b in (b"=", b"abcde", b"\n")]
    for p, got in zip(pieces, merger.merge(pieces)):
        assert list(got) == encoding.merge_piece([ids[b] for b in p], pairs), len(p)


def test_leaks(spark):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words[:30]), "k"), (2, "Short one here!", "k"), (3, None, "k"), (4, "...", "k"), (None, "w1", "k")], "item_id long, text string, kind string")
    docs = [(1, "x " + " ".join(words[5:18]) + " y"), (2, " ".join(words[5:17])), (3, "a SHORT, one; here b"), (4, None), (5, ""), (6, " ".join(words[17:30] + words[:13])), (6, " ".join(words[17:30] + words[:13])), (None, "short one here")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for size in (8_000_000, 60):
        got = {(r.doc_id, r.item_id): r for r in leaks.leaked_items(df, bench, size).collect()}
        assert set(got) == {(1, 1), (3, 2), (6, 1)}
        assert got[6, 1].tiles == 2 and got[6, 1].covered == 26
    assert leaks.leaked_items(df.limit(0), bench).count() == 0
    assert leaks.leaked_items(df, bench.limit(0)).count() == 0


def test_quality(spark):
    common = spark.createDataFrame([("en", "the"), ("en", "of"), (None, None)], "lang string, word string")
    rows = [(1, None, "en"), (2, " \n", "en"), (3, "the end of the day.", "en"), (4, "red blue green yellow.", "en"), (5, "red blue green yellow.", None), (6, "### ???", "xx"), (7, "one\ntwo\nthe end.", "xx"), (8, "(The) end.", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    stats = quality.text_statistics(df, common)
    assert {r.doc_id for r in stats.where(quality.not_prose()).collect()} == {4, 6, 7, 8}
    assert stats.where("doc_id = 8").first().n_common == 1
    kinds = quality.classify(stats, quality.fit_mixture(stats, rounds=3)).collect()
    assert {r.doc_id for r in kinds if r.kind is None} == {1, 2}
    empty = quality.text_statistics(df.limit(0), common)
    assert quality.classify(empty, quality.fit_mixture(empty)).count() == 0


def test_mixture_finds_all_four_kinds(spark):
    random.seed(6)
    word = lambda: "".join(random.choices("abcdefghij", k=random.randint(3, 9)))
    few = ["the", "of", "and", "in", "to"]
    prose = lambda: " ".join(random.choice(few) if random.random() < 0.3 else word() for _ in range(80)) + "."
    make = {
        "prose": lambda: "\n".join(prose() for _ in range(4)),
        "list": lambda: "\n".join(f"{k}) {word()} {word()} {word()}" for k in range(1, random.randint(9, 16))),
        "table": lambda: "\n".join(" | ".join([word()] + [str(random.randint(1, 200)) for _ in range(4)]) for _ in range(random.randint(9, 16))),
        "junk": lambda: "\n".join("".join(random.choices("#$%*+-/<>=@|~", k=20)) + " " + word() for _ in range(8)),
    }
    rows = [(k, f(), "en") for k, f in enumerate(f for kind, f in make.items() for _ in range(300 if kind == "prose" else 40))]
    kind = dict(enumerate(kind for kind in make for _ in range(300 if kind == "prose" else 40)))
    stats = quality.text_statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([("en", w) for w in few], "lang string, word string"))
    got = {r.doc_id: r.kind for r in quality.classify(stats, quality.fit_mixture(stats)).collect()}
    for name in make:
        mine = [got[k] for k in kind if kind[k] == name]
        assert sum(x == name for x in mine) >= 0.95 * len(mine), name


def test_clashing_columns(spark):
    df = articles(spark, [("A19990101.0001", ["One two. Three."])]).withColumn("h", F.lit(1)).withColumn("leaf", F.lit(2)).withColumn("term", F.lit("z"))
    assert terms.term_frequencies(df).count() == 3
    assert lines.repeated_lines(df).count() == 0
