"""Importance resampling against loops over words."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from corpusmill.llm import importance

SCHEMA = "doc_id long, text string, n_words long, score string, buckets long, rank string"
A_Z = str.maketrans(importance.UPPER, importance.LOWER)


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_Z))
    return len(words), Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1))


def by_loop(rows, target, percent=5):
    own = [(k, *features(t)) for k, t in rows]
    s, t = sum((f for *_, f in own), Counter()), sum((features(x)[1] for x in target), Counter())
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out = []
    for k, n, f in own:
        weight = sum(gain(b) * m for b, m in f.items())
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, n, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = percent * len(able) // 100
    place = {id(r): k for k, r in enumerate(able[:drawn], 1)}
    return [(*r, place.get(id(r))) for r in out]


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    vocabulary = ["Stone", "river", "cloud", "été", "naïve", "日本語", "x1", "B2B", "garden"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", "  ", "-", "\n", "\x00", "!? "]) for _ in range(n))
    rows = [(k, text(r.randrange(1, 60))) for k in range(120)] + [(None, text(30)), (None, text(30)), (200, None), (201, ""), (202, " - "), (203, "one"), (204, "two words"), (205, text(5000)), (206, "a" * 9000 + " b")]
    return rows + [(7, rows[7][1])] * 3, [text(40), None, "", "stone river cloud"]


@pytest.mark.parametrize(("segment", "percent"), [(1 << 20, 5), (300, 40)])
def test_every_row_equals_a_loop(spark, corpus, segment, percent):
    rows, target = corpus
    docs = spark.createDataFrame([(*r, 0, "s", 1, "r") for r in rows], SCHEMA).repartition(3)
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), segment=segment, percent=percent)
    assert key(got.collect()) == key(by_loop(rows, target, percent))


def test_empty_tables(spark, corpus):
    none = spark.createDataFrame([], SCHEMA)
    assert importance.resample(none, none).collect() == []
    rows = [(1, "a b c " * 10), (2, None)]
    assert key(importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), none).collect()) == key(by_loop(rows, []))


def test_pieces_end_between_words():
    text = "one two  three, four five six " * 20
    for size in (1, 3, 10, 1000):
        pieces = list(importance.pieces_of(text, size))
        assert "".join(p for p, _ in pieces) == text
        words = [importance._ANY_WORD.findall(p) for p, _ in pieces]
        for k, (_, more) in enumerate(pieces):
            assert more.split() == [w for own in words[k + 1 :] for w in own][:2] or k == len(pieces) - 1
