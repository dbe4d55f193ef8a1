"""The block-max index: bounds hold for every pair, and its rows are those of scoring every pair."""

import random
import re

import numpy as np
import pytest

from corpusmill.functions import lexicon as L
from corpusmill.functions import scoring
from corpusmill.operators import block_index, retrieval
from corpusmill.operators.block_index import Asked, BlockIndex

WORDS = [w for triggers, phrases in L.KEY_PHRASES for w in (*triggers, *phrases)] + [*L.ACTIVITY_WORDS, *L.COMMON_WORDS, *L.STOP_WORDS, *L.PROJECT, *L.RELATED, *L.ACTIVITIES[:9]]
WORDS += "zebra zebre zebras stone river cloud table a an 12h30 à 14h00 2024-2025 janvier responsable Marie Tremblay, directrice: enseignant project directice directrice personnel 250 ml info-parents pommes lentilles".split()
WORDS += ["membres du personnel", "mot de la direction", "projet\npersonnel", "DıRECTRICE", "enſeignant", "Kelvin K"]


def made(seed, most):
    r = random.Random(seed)
    return r.choice([" ", "\n", ", "]).join(r.choice(WORDS) for _ in range(r.randrange(1, most)))


def block(texts):
    return block_index.block_of([("s", k, t, None) for k, t in enumerate(texts)])


def test_bounds_hold_for_every_pair():
    queries = [made(k, 7) for k in range(150)] + ["la", "", "?", "le la les", "projet personnel", "the zebra stone", "robotique responsable"]
    asked = Asked(list(enumerate([*queries, None])))
    at_bound = 0
    for part in range(4):
        texts = [made(1000 + 64 * part + k, 25) for k in range(50)] + queries[part * 10 : part * 10 + 10] + ["", None]
        n, words, bits, rules, held, _ = block(texts)
        low, high = asked.lows(words, bits, rules, held, n), asked.highs(words, bits, rules, held, n)
        for q, query in enumerate(queries):
            for c, text in enumerate(texts):
                score = scoring.relevance_of(query, text) if text is not None else 0.0
                assert low[q, c] - 1e-5 <= score <= high[q, c] + 1e-5, (query, text)
                at_bound += high[q, c] - score < 0.02
        assert not high[-1].any() and not high[:, -1].any()
    assert at_bound > 1000


def test_needed_strings_are_in_every_match():
    """A rule's pattern matches no text that is flagged without bonus."""
    texts = [made(k, 30) for k in range(600)]
    for text in texts:
        for value, (_, pattern, _, most) in zip(block_index.rule_values(text), block_index.RULES, strict=False):
            assert value == most or not re.search(pattern, text, re.I)
    assert len(block_index.NEEDED) == len(block_index.RULES)


def rows_of(df):
    return sorted(((r.query_id, r.rank, r.source, r["index"], r.text, r.pdf_url, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("k", [1, 5])
def test_same_rows_as_scoring_every_pair(spark, tmp_path, k):
    r = random.Random(4)
    chunks = [(f"s{r.randrange(40)}", j, made(j, 20), r.choice([None, "u"])) for j in range(500)]
    chunks += [("a.css", 1, "zebra", None), (None, None, "zebra", None), ("n", 1, None, None), ("n", 2, "", None), ("tie", 2, "zebra stone", None), ("tie", 1, "zebra stone", None), ("tie", 1, "zebra stone", None)]
    df = spark.createDataFrame(chunks, "source string, index int, text string, pdf_url string").repartition(3)
    asked = spark.createDataFrame([(q, made(9000 + q, 6)) for q in range(40)] + [(100, None), (101, "qqqq wwww"), (102, "zebra stone"), (None, "zebra")], "query_id long, query string")
    counter = spark.sparkContext.accumulator(0)
    index = BlockIndex.build(df, str(tmp_path / f"index{k}"))
    got = rows_of(index.best_of(asked, k, counter))
    assert got == rows_of(retrieval.best_of(df, asked, k))
    assert 0 < counter.value < df.count() * asked.count()
    assert index.best_of(asked.limit(0), k).collect() == []


def test_an_empty_index_gives_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "source string, index int, text string, pdf_url string")
    index = BlockIndex.build(df, str(tmp_path / "none"))
    assert index.best_of(spark.createDataFrame([(1, "zebra")], "query_id long, query string"), 3).collect() == []


def test_blocks_end_at_a_budget_of_characters(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("s", k, "zebra " * (k + 1), None) for k in range(30)], "source string, index int, text string, pdf_url string").coalesce(1)
    assert [r.n for r in block_index.built(df).collect()] == [30]
    monkeypatch.setattr(block_index, "BLOCK_BYTES", 500)
    assert sorted(r.n for r in block_index.built(df).collect())[-1] < 15
    whole = BlockIndex.build(df, str(tmp_path / "one")).best_of(spark.createDataFrame([(1, "zebra stone")], "query_id long, query string"), 3)
    assert [r["index"] for r in sorted(whole.collect(), key=lambda r: r.rank)] == [0, 1, 2]


def test_few_pairs_of_the_fixture_are_scored(spark, sf, tmp_path):
    from corpusmill.plans import queries

    chunks, items = queries._chunk_rows(spark, sf), queries.items(spark, sf)
    counter = spark.sparkContext.accumulator(0)
    BlockIndex.build(chunks, str(tmp_path / "index")).best_of(items, 5, counter).collect()
    assert counter.value < 0.05 * chunks.count() * items.count()


def test_sums_of_words_that_repeat_in_a_query():
    asked = Asked([(1, "zebra zebra stone"), (2, "stone")])
    n, words, bits, *_ = block(["zebra", "stone river", "cloud"])
    least, most, partial, lacking = asked.sums(words, bits, n)
    assert np.allclose(least, [[2, 1, 0], [0, 1, 0]]) and np.allclose(most, least)
    assert np.allclose(partial, [[0.5, 1.0, 1.5], [0.5, 0, 0.5]]) and np.allclose(lacking, [[1, 1, 2], [1, 0, 1]])


def test_blocks_come_in_small_batches(spark, tmp_path):
    """A block holds its chunks, so a batch of them may not grow with the index."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    rows = spark.createDataFrame([("a", 1, "zebra crossing", None)], "source string, index int, text string, pdf_url string")
    index = block_index.BlockIndex.build(rows, str(tmp_path / "index"))
    index.frame()
    assert int(spark.conf.get(key)) <= 500
    spark.conf.set(key, before)
