"""Pieces by bytes: equal to cutting and stripping the rest again and again, in time that grows with the text."""

import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import chunking


def again_and_again(text, most):
    out, near = [], most // 2
    while text:
        if len(text.encode()) <= most:
            return [*out, text]
        cut = 0
        for mark in ("\n\n", "\n", ". "):
            at = text.rfind(mark, 0, near + len(mark))
            if at > near / 4:
                cut = at + len(mark)
                break
        cut = min(cut or near, len(text))
        if len(text[:cut].encode()) > most:
            cut = len(text.encode()[:most].decode(errors="ignore"))
        out.append(text[: cut or 1])
        text = text[cut or 1 :].strip()
    return out or [""]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab é😀.\n\t  \x1c", max_size=120), st.integers(1, 40))
def test_same_pieces(text, most):
    assert chunking.byte_pieces(text, most) == again_and_again(text, most)


def test_time_grows_with_the_text():
    took = []
    for n in (1, 8):
        text = ("word. " * 700 + "\n" + "é" * 900) * (200 * n)
        start = time.process_time()
        assert sum(map(len, chunking.byte_pieces(text, 4096))) > 0.9 * len(text)
        took.append(time.process_time() - start)
    assert took[1] < 24 * max(took[0], 0.05)


def test_a_cap_cuts_one_piece(spark, monkeypatch):
    text = ("word. " * 700 + "\n") * 3000
    steps = []

    def counted(t, most, real=chunking.pieces):
        for p in real(t, most):
            steps.append(p)
            yield p

    monkeypatch.setattr(chunking, "pieces", counted)
    assert next(chunking.pieces(text, 7992)) == again_and_again(text[:9000], 7992)[0] and len(steps) == 1
    monkeypatch.undo()
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "")], "id long, text string")
    got = {r.id: r.t for r in df.select("id", chunking.capped(F.col("text"), 8192).alias("t")).collect()}
    assert got == {1: again_and_again(text[:9000], 7992)[0] + chunking.TRUNCATED, 2: "short", 3: None, 4: ""}
