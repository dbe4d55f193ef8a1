"""Ids against the library, BM25 and greedy filling against loops, pieces against the whole."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from corpusmill.llm import byte_bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n string, rest long, key string, uid string"


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(PATH)


def library(codec, text):
    return codec.library.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys(codec):
    r = random.Random(1)
    parts = ["a", "b", "é", "1", "²", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "'t", "'ve", "'m", "'d", "!", "-", " ", " ", "​", "日", "😀", "́", "<", "s", "T", " x", "\r\n", "\x00", "ſ", "Ⅷ", "_", "word" * 20]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(4000)] + ["", " ", "a ", " <|endoftext|> x<|endoftext|>", "don'tell's'", "'", "\n" * 5]
    assert [x.tolist() for x in codec.encode(texts)] == [library(codec, t) for t in texts]
    for t in texts[:200]:
        assert np.concatenate(list(codec.long(t * 5, 7))).tolist() == library(codec, t * 5)


def test_a_small_memory_of_words_forgets(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MOST_WORDS", 8)
    own, r = byte_bpe.Codec(PATH), random.Random(2)
    for _ in range(20):
        texts = [" ".join(r.choice("one two three four five six seven".split()) + str(r.randrange(9)) for _ in range(r.randrange(30))) for _ in range(3)]
        assert [x.tolist() for x in own.encode(texts)] == [library(own, t) for t in texts]


def test_letters_are_those_of_the_library(codec):
    for text, b in ((chr(k), k) for k in range(128)):
        assert "".join(p for p, _ in codec.library.pre_tokenizer.pre_tokenize_str(text)) == chr(codec.letters[b])


def rests_of(seed, n, most):
    r = np.random.default_rng(seed)
    return [r.zipf(1.4, r.integers(0, most)).clip(0, 300).astype(np.uint32) for _ in range(n)]


def by_definition(rests, idf, mean, seed):
    """BM25 of each rest for the distinct ids of the seed's."""
    out = []
    for d in rests:
        tf = collections.Counter(d.tolist())
        out.append(sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (1 - 0.75 + 0.75 * len(d) / mean)) for t in sorted(set(rests[seed].tolist())) if t in tf))
    return out


def test_index_scores_are_bm25():
    rests = rests_of(3, 60, 80)
    seen = np.bincount([t for d in rests for t in set(d.tolist())], minlength=301)
    idf = packing.idf_of(seen, len(rests))
    assert all(math.isclose(x, max(math.log((60 - s + 0.5) / (s + 0.5)), 0)) for x, s in zip(idf, seen, strict=True))
    index, mean = packing.Index(rests, idf, 40.0), 40.0
    for seed in range(60):
        assert np.allclose(index.scores(seed), by_definition(rests, idf, mean, seed))


def test_neighbours_fill_windows_greedily():
    rests, size = rests_of(4, 50, 60), 64
    rests = [d[: size - 1] for d in rests]
    idf = packing.idf_of(np.bincount([t for d in rests for t in set(d.tolist())], minlength=301), 50)
    left = {k: [0, len(d)] for k, d in enumerate(rests)}
    index = packing.Index(rests, idf, 30.0)
    want, short = [], []
    for seed in range(50):
        while left[seed][1]:
            out, space = [], size
            scores = index.scores(seed)
            for d in [seed, *sorted(range(50), key=lambda k: (-scores[k], k))]:
                take = min(space, left[d][1])
                if take:
                    out.append((d, left[d][0], take))
                    left[d], space = [left[d][0] + take, left[d][1] - take], space - take
            (short if space else want).append(out)
    got = list(packing.windows(rests, idf, 30.0, size))
    full, tail = got[: len(want)], got[len(want) :]
    assert full == want and all(sum(n for *_, n in s) == size for s in full)
    sizes = [sum(n for *_, n in s) for s in tail]
    assert all(n & (n - 1) == 0 for n in sizes) and sizes == sorted(sizes, reverse=True) and len(short) <= 1
    assert sum(sizes) == sum(n for s in short for *_, n in s)


def held(codec, rows, pieces, window=1024):
    """Pieces cover every id of every row once, and sequences are gapless and as long as they may be."""
    want = collections.Counter()
    for doc, text in rows:
        want[doc, len(library(codec, text)) + 1, tuple([*library(codec, text), 0])] += 1
    by_doc, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    assert sorted(by_doc, key=str) == sorted({k[:2] for k in want}, key=str)
    for (doc, n), own in by_doc.items():
        texts = [(ids, times) for (d, m, ids), times in want.items() if (d, m) == (doc, n)]
        assert sum(p.length for p in own) == n * sum(times for _, times in texts)
        for p in own:
            crcs = {zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for ids, _ in texts}
            assert p.ids_crc32 in crcs and p.length > 0
        starts = collections.Counter(x for p in own for x in range(p.start, p.start + p.length))
        assert set(starts.values()) == {sum(times for _, times in texts)} and len(starts) == n
    for own in sequences.values():
        own.sort()
        total = sum(n for _, n in own)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and total <= window
        assert total == window or total & (total - 1) == 0


def test_every_id_is_in_one_piece(spark, codec):
    r = random.Random(6)
    text = lambda n: " ".join(r.choice(["stone", "river's", "cloud", "1999", "été", "日本"]) for _ in range(n))
    rows = [(k, text(r.randrange(0, 400))) for k in range(150)] + [(None, text(9)), (None, None), (500, ""), (501, None), (7, "twice"), (7, "twice"), (502, text(5000)), (503, "a <|endoftext|> b"), (504, "x" * 9000), (505, " " * 5000)]
    rows += [(600 + k, "the same text in each of these") for k in range(60)]
    docs = spark.createDataFrame([(*x, "n", 1, "k", "u") for x in rows], SCHEMA).repartition(3)
    pieces = packing.pack(docs, PATH, shard=64).collect()
    held(codec, rows, pieces)
    assert len({p.sequence_id for p in pieces}) < 150


def test_long_texts_are_read_by_segments(spark, codec, monkeypatch):
    rows = [(1, "one two three " * 300_000), (2, None)]
    held(codec, rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect())


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_neighbours_share_words(spark):
    """Two subjects whose documents come by turns: most windows hold one of them."""
    r = random.Random(8)
    subject = [[f"{a}{b}" for a in "kelm torv brus".split() for b in "anda ilo ufe".split()], [f"{a}{b}" for a in "wisp jaro quen".split() for b in "omi exa yth".split()]]
    rows = [(k, " ".join(r.choice(subject[k % 2]) for _ in range(60))) for k in range(200)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH, window=512).collect()
    kinds = collections.defaultdict(collections.Counter)
    for p in pieces:
        kinds[p.sequence_id][p.doc_id % 2] += p.length
    assert sum(max(c.values()) for c in kinds.values()) > 0.9 * sum(sum(c.values()) for c in kinds.values())


def test_rests_that_are_used_up_leave_the_lists():
    """Scores of the others stay as they were, and a window asks shorter lists."""
    rng = np.random.default_rng(3)
    rests = [rng.integers(0, 300, n).astype(np.uint32) for n in rng.integers(0, 400, 60)]
    index = packing.Index(rests, np.linspace(0, 5, 300), 200.0)
    used = rng.random(60) < 0.6
    before, size = [index.scores(k) for k in range(60)], len(index.doc)
    index.forget(used)
    assert len(index.doc) < 0.6 * size
    for k in range(60):
        assert (index.scores(k)[~used] == before[k][~used]).all() and not index.scores(k)[used].any()


def test_distinct_ids_and_heaviest():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 4, 50, 1000):
        ids = rng.integers(0, 200, n).astype(np.uint32)
        own, count = packing.distinct(ids)
        want = np.unique(ids, return_counts=True)
        assert (own == want[0]).all() and (count == want[1]).all()
        weight = rng.integers(0, 5, len(own)) / 4
        assert packing.heaviest(own, weight, 3) == [int(own[k]) for k in np.lexsort((own, -weight))[:3]]
