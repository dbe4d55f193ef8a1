"""Contracts of the functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import chunking, scoring, text
from corpusmill.operators import crawl, html, matching, retrieval
from corpusmill.sources import files
from corpusmill.sources.files import flat_text


def test_plain_sections_pack_and_overlap():
    parts = ["a" * 800 + ". Tail one", "b" * 900, "c" * 100]
    got = chunking.chunk("\n\n".join(parts))
    assert got == [parts[0], f"Tail one\n\n{parts[1]}\n\n{parts[2]}"]


def test_a_section_is_never_cut_and_blank_input_stays():
    assert chunking.chunk("x" * 4000) == ["x" * 4000]
    assert chunking.chunk(" \n\n ") == [""]


def test_overlap_falls_back_to_paragraph_then_word_then_nothing():
    assert chunking.tail("x" * 400 + "\n\nabc", 300, False) == "abc"
    assert chunking.tail("x" * 400 + " abc", 300, False) == "abc"
    assert chunking.tail("x" * 400, 300, False) == ""
    assert chunking.tail("x" * 400 + " abc", 300, True) == ""


def test_heading_keeps_its_list():
    got = chunking.units(["MEMBRES", "- one", "Dupont, directeur", "Projet 2020-2021 | Marc 2020", "plain text"])
    assert got == [("MEMBRES\n\n- one\n\nDupont, directeur\n\nProjet 2020-2021 | Marc 2020", True), ("plain text", False)]


@pytest.mark.parametrize("t", ["é" * 300, "a. " * 200, "line\n" * 100, "p\n\n" * 150, "x" * 1000])
def test_pieces_fit_the_budget_and_lose_only_white_space(t):
    got = chunking.byte_pieces(t, 100)
    assert all(len(p.encode()) <= 100 for p in got)
    assert "".join("".join(got).split()) == "".join(t.split())


def test_accents_split_query_words():
    assert scoring.query_words("école de la vie") == ["cole", "vie"]
    assert scoring.query_words("de la ?") == ["de la"]


def test_relevance_arms():
    assert scoring.relevance_of("zebra crossing", "the zebra crossing is here") == pytest.approx(0.3 + 0.15 * 0.8)
    assert scoring.relevance_of("zebra", "a zebre stands") == pytest.approx(0.15 * 0.2 * 0.5 * 0.8)
    assert scoring.relevance_of("zebra", "nothing") == 0
    staff = "Membres du personnel\nMarie Roy, directrice"
    assert scoring.relevance_of("membres du personnel", staff) == 1.0
    assert scoring.relevance_of("projet personnel", "rien") <= 0.4


def test_near_word_reads_thirty_words_a_letter():
    crowd = " ".join(f"zq{i}xxxxxxxx" for i in range(30))
    assert scoring.near_word("zebra", f"{crowd} zebre") is None
    assert scoring.near_word("zebra", "zebre") == pytest.approx(0.8)


def test_boundary_of_matches(spark):
    filler = " ".join(["filler"] * 100)
    df = spark.createDataFrame([(f"needle {filler}",), (f"{filler} needle",), (f"needle {filler} needle",), (f"{filler} needle {filler}",), (filler,)], "t string")
    assert [r.p for r in df.select(scoring.boundary(F.lit("needle"), F.col("t")).alias("p")).collect()] == ["start", "end", "both", "middle", "none"]


def test_neighbours_widen_and_gaps_do_not(spark):
    chunks = spark.createDataFrame([("s", i, "needle " + "x " * 300 if i == 2 else f"text {i}", None) for i in (0, 1, 2, 4)], "source string, index int, text string, pdf_url string")
    top = chunks.filter("index = 2").selectExpr("1L query_id", "'needle' query", "source", "index", "text", "pdf_url", "1.0D score", "1 rank")
    assert sorted(x["index"] for x in retrieval.widened(top, chunks, 5).collect()) == [1, 2]


def test_non_content(spark):
    cases = [("a.css", "", True), ("data.json", "", True), (None, "{" * 50, False), ("p", "{" * 10, False), ("p", "{" * 11, True), ("p", "@x", True), ("p", None, False)]
    df = spark.createDataFrame(cases, "s string, t string, want boolean")
    assert df.filter(text.is_non_content(F.col("s"), F.col("t")) != F.col("want")).count() == 0


def test_accent_edges_of_keywords(spark):
    df = spark.createDataFrame([("une activité",), ("des activités club",), ("Quand?",), ("",)], "q string")
    assert [r.s for r in df.select(text.keyword_subjects(F.col("q")).alias("s")).collect()] == [["general", "other"], ["students", "general"], ["calendar", "general"], ["general", "other"]]


def test_page_extraction():
    page = "<body><nav><a href='/n'>N</a></nav><main><h1>T</h1><p>first paragraph here<p>second paragraph here<a href='/a#f'>x</a><a href='mailto:q'>m</a> see http://h.org/x.pdf).</main>"
    got = html.extracted(page, "http://h.org/p", True)
    assert got["text"].startswith("## T first paragraph here second paragraph here")
    assert got["links"] == ["http://h.org/a"]
    assert "http://h.org/x.pdf" in got["files"]
    assert html.extracted(None, "http://h.org", True)["text"] == ""


def test_robots(spark):
    rules = crawl.robots_rules(spark.createDataFrame([(1, ""), (2, "User-agent: *\nDisallow: /\nUser-agent: A\nAllow: /x\nCrawl-delay: 2.5")], "k int, b string"), "k", "b")
    assert {(r.k, r.allowed, r.crawl_delay) for r in crawl.robots_for(rules, "k", "a").collect()} == {(1, True, 3.0), (2, True, 2.5)}


def test_ocr_correction():
    assert matching.corrected("F (aise") == "fraise"
    assert matching.corrected("pOmme", accents=True) == "pomme"
    assert matching.corrected("zzzZzzz") == "zzzZzzz"


def test_flat_documents():
    run = lambda t: {"paragraph": {"elements": [{"textRun": {"content": t}}]}}
    doc = {"body": {"content": [run("a"), {"table": {"tableRows": [{"tableCells": [{"content": [run("x")]}, {"content": [run("y")]}]}]}}]}}
    import json

    assert flat_text(json.dumps(doc)) == "a\nx | y"


def test_size_labels(spark):
    sizes = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1152, 1075, 1076, 1048575, 1048576, 1572864, 2**40)], "n long")
    assert [r[0] for r in sizes.select(text.size_label(F.col("n"))).collect()] == ["0 B", "1023 B", "1.0 KB", "1.1 KB", "1.0 KB", "1.1 KB", "1024.0 KB", "1.00 MB", "1.50 MB", "1048576.00 MB"]
    texts = spark.createDataFrame([("é",), ("x" * 1536,), ("é" * 700,), ("x" * 1048576,)], "t string")
    assert [r[0] for r in texts.select(text.text_size_label(F.col("t"))).collect()] == ["2B / 1 chars", "2KB / 1,536 chars", "1KB / 700 chars", "1.00MB / 1,048,576 chars"]


def test_project_patterns_are_those_written_out():
    hit = lambda t: bool(scoring._PROJECT.search(t))
    assert all(map(hit, ("projet personnel", "projets  personnels", "project personnel", "projects personnels", "projet personnels")))
    assert not any(map(hit, ("projets personnel", "projects personnel", "projett personnel", "projet personel")))


def test_errors_that_left_nothing_are_raised(spark):
    usable = spark.createDataFrame([("a", "x")], "id string, content string")
    failed = lambda e: spark.createDataFrame([("b", e)], "id string, error string")
    assert files.checked(usable, failed("disk on fire")).count() == 1
    assert files.checked(usable.limit(0), failed("ENOENT: no such file or directory")).count() == 0
    with pytest.raises(ValueError, match="disk on fire"):
        files.checked(usable.limit(0), failed("disk on fire"))


def test_queue_order_under_a_limit(spark):
    edges = spark.createDataFrame([("s", "z", 0), ("s", "a", 1), ("s", "m", 2), ("a", "b", 0), ("z", "y", 0), ("z", "c", 1)], "src string, dst string, pos int").withColumn("external", F.lit(False))
    got = lambda n, e: {r.url for r in crawl.crawl(e, "s", 4, n).collect()}
    assert got(3, edges) == {"s", "z", "a"} and got(5, edges) == {"s", "z", "a", "m", "y"}
    assert got(3, edges.drop("pos")) == {"s", "a", "m"}


def test_contains_join(spark):
    import itertools
    import random

    r = random.Random(3)
    names = ["".join(r.choice("ab1") for _ in range(r.randint(0, 30))) for _ in range(60)] + ["", "a" * 40, "aaa"]
    df = lambda col: spark.createDataFrame([(k, n) for k, n in enumerate(names)], f"{col} int, part string")
    got = {(x.i, x.j) for x in matching.contains(df("i"), df("j")).collect()}
    assert got == {(i, j) for (i, a), (j, b) in itertools.product(enumerate(names), repeat=2) if b in a}


def test_keyword_subjects_are_those_of_the_plain_patterns(spark):
    """Words at edges, within others and in odd letters; texts without any word take no pattern, so they are quick."""
    import time

    from corpusmill.functions import lexicon as L

    words = [w for _, ws in L.SUBJECT_WORDS for w in ws.split("|")]
    texts = [None, "", "ſport", "ın ſtaff", "polıcies", "K", "İnscription", "WHO IS", "é"] + [t for w in words for t in (w, w.upper(), f"x{w}", f"{w}_", f"({w}) date", f"é{w}é", w.replace("s", "ſ").replace("i", "ı"))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    hits = lambda: F.array_compact(F.array(*(F.when(F.lower("t").rlike(f"(?iu){text.AB}(?:{ws}){text.AB}"), s) for s, ws in L.SUBJECT_WORDS)))
    plain = F.when(F.size(hits()) == 0, F.array(F.lit("general"), F.lit("other"))).otherwise(text.with_general(hits()))
    assert [tuple(r) for r in df.select("t", plain.alias("a"), text.keyword_subjects(F.col("t")).alias("b")).collect() if r.a != r.b] == []
    many = spark.range(20_000).select(F.concat(F.lit("lorem ipsum dolor oblong " * 12), F.col("id").cast("string")).alias("t")).localCheckpoint()

    def took(c):
        start = time.perf_counter()
        many.select(c.alias("x")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    assert min(took(text.keyword_subjects(F.col("t"))) for _ in range(3)) < 0.5 * min(took(F.size(hits())) for _ in range(3))
