"""Near words against all pairs, and files with one word in common against a bound on rows."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.scoring import edit_distance
from corpusmill.operators import matching


@pytest.mark.parametrize("short", [16, 4, 0])
def test_nearest_words_equal_all_pairs(spark, short):
    r = random.Random(short)
    text = lambda n: "".join(r.choice("abcé") for _ in range(n))
    entries = {text(r.randrange(0, 9)) for _ in range(80)} | {text(r.randrange(10, 45)) for _ in range(40)}

    def edited(w):
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w) + 1)
            w = r.choice([w[:k] + r.choice("abcx") + w[k:], w[:k] + w[k + 1 :], w[:k] + r.choice("abcx") + w[k + 1 :]])
        return w

    words = [edited(e) for e in sorted(entries) for _ in range(3)] + ["", "a", "zzzzzz", None, "a"]
    want = {}
    for w in {x for x in words if x is not None}:
        near = min(((edit_distance(w, e), e) for e in entries if abs(len(w) - len(e)) <= 2), default=(9, ""))
        if near[0] <= 2:
            want[w] = near
    ws = spark.createDataFrame([(w,) for w in words], "word string")
    es = spark.createDataFrame([(e,) for e in [*entries, None]], "entry string")
    got = {x.word: (x.distance, x.entry) for x in matching.nearest_words(ws, es, short=short).collect()}
    assert got == want and len(want) > 100


def test_deletions(spark):
    one = spark.createDataFrame([("abc",), ("",), ("aa",)], "w string").select("w", matching.deletions(F.col("w"), 2).alias("d"))
    assert {r.w: set(r.d) for r in one.collect()} == {"abc": {"abc", "ab", "ac", "bc", "a", "b", "c"}, "": {""}, "aa": {"aa", "a", ""}}


def test_a_word_in_all_names_gives_no_pairs(spark):
    """400 texts and 400 PDFs with one word: each distinct word is asked once, so the largest join stays linear."""
    n = 400
    texts = spark.createDataFrame([(f"report_{'x' * (k % 3)}{k}_0a.txt",) for k in range(n)], "text_file string")
    pdfs = spark.createDataFrame([(f"q{k} report.pdf",) for k in range(n)], "pdf_file string")
    found = matching.first_match(texts.selectExpr("'report' as word"), pdfs.selectExpr("pdf_file", "replace(pdf_file, '.pdf', '') as part"), True)
    assert [tuple(r) for r in found.collect()] == [("report", "q0 report.pdf")]
    got = {r.text_file: (r.pdf_file, r.strategy) for r in matching.pdf_matches(texts, pdfs).collect()}
    assert len(got) == n and set(got.values()) == {("q0 report.pdf", 2)}


def test_nearest_equals_a_loop_over_the_dictionary():
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcé-") for _ in range(n))
    dictionary = tuple(text(r.randrange(0, 8)) for _ in range(60)) + tuple(text(r.randrange(15, 24)) for _ in range(30))

    def by_loop(word):
        plain = lambda w: matching._MARKS.sub("", w.lower())
        d, k = min((edit_distance(plain(word), plain(e)), k) for k, e in enumerate(dictionary))
        return dictionary[k] if d <= 2 else None

    words = [text(r.randrange(0, 9)) for _ in range(300)] + [e[:k] + "b" + e[k + 1 :] for e in dictionary[60:] for k in (0, 9)] + ["", "zzz"]
    assert [matching.nearest(w, dictionary) for w in words] == [by_loop(w) for w in words]
