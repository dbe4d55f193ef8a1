"""Fill-in-middle texts against a loop over units, and back again."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import fill_in_middle as fim

SCHEMA = "doc_id long, text string, n long, form string, prefix string, _marked string"


def by_loop(doc_id, text, seed=7, rate=100, spm=50, unit=fim.LINES, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(unit, text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", p, m, s, f"{marks[1]}{s}{marks[0]}{p}{marks[2]}{m}"
    return len(units), "psm", p, m, s, f"{marks[0]}{p}{marks[1]}{s}{marks[2]}{m}"


ODD = [
    None, "", "\n", "\n\n\n", "one line", "two\nlines", "two\nlines\n", "a\x1fb\x1e\n\x1ee\x1ed\x1f\n\x1e", "\x1f", "\x1e\x1f\x1e\n", "has <P> in it\nand more", "<S", "a<\nS>b<\nM>P>\n<", "<<<\n<<\n", "é😀\n\r\n𝒳\n",
    "$0\n$1\\\n\\n\n", "x" * 70_000 + "\n" + "y\n" * 3000,
]


@pytest.mark.parametrize("rate", [100, 40])
def test_every_text_equals_a_loop_and_comes_back(spark, rate):
    rows = [(k * 100 + j, t) for k in range(6) for j, t in enumerate(ODD)] + [(None, "a\nb\nc\n"), (3, "twice\nthe\nsame"), (3, "twice\nthe\nsame")]
    df = spark.createDataFrame([(*r, 1, "f", "p", "m") for r in rows], SCHEMA)
    out = fim.transform(df, rate=rate).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix, r.middle, r.suffix, r.output) for r in out), key=key) == sorted(((k, *by_loop(k, t, rate=rate)) for k, t in rows), key=key)
    assert all(r.back == r.text for r in out) and {r.form for r in out} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], SCHEMA)).collect() == []


def test_other_units_and_markers(spark):
    marks = fim.Markers("|pre", "|suf", "|mid")
    rows = [(k, "one two  three |four\nfive ") for k in range(40)]
    out = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), unit=r"\S+\s*", markers=marks, spm_rate=20)
    got = {r.doc_id: (r.n, r.form, r.prefix, r.middle, r.suffix, r.output) for r in out.collect()}
    assert got == {k: by_loop(k, t, spm=20, unit=r"\S+\s*", marks=("|pre", "|suf", "|mid")) for k, t in rows}
    assert all(r.back == r.text for r in out.select("text", fim.restored(F.col("output"), F.col("form"), marks).alias("back")).collect())


@pytest.mark.parametrize("own", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "[S]", "<M>"), ("<P<", "<S>", "<M>"), ("<P", "<Px", "<M>")])
def test_markers_that_a_text_could_make_are_refused(own):
    with pytest.raises(ValueError):
        fim.Markers(*own)


def test_the_plan_has_no_python_and_no_exchange(spark):
    plan = fim.transform(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
