"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items and documents become lower-case words without punctuation. Each item's n-grams are its seeds; how many
documents hold each is counted over the whole corpus. A document that holds a seed is aligned with the item around the
places that the seeds point to, those of rare seeds first; the local alignment of words, with mismatches and gaps, scores
exact, edited and paraphrased copies as a share of a full match. Rarity only orders places: one is passed over only if
it holds too few of the item's words to reach the threshold or the best score so far.

An item of fewer than MIN_WORDS words is too short to tell an edited copy from chance; a copy of it is a whole line, or a
whole document, of exactly its words.

Items come in blocks of bounded size, GROUP of them broadcast together and held against all documents, so nothing is
shuffled but the counts of seeds.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, chunks, id_text
from .shingles import combined, word_hashes

N = 3  #: words of a seed
MIN_WORDS = 5  #: an item with fewer words is matched as a whole line or document only
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5  #: share of a full match
RARE = 0.001  #: share of documents up to which a seed is rare
BLOCK_CHARS = 8 << 20  #: characters of the items of a block
GROUP = 4  #: blocks that are broadcast at once

_BETWEEN = np.ones(256, bool)
_BETWEEN[48:58] = _BETWEEN[97:123] = _BETWEEN[128:] = False


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    lowered = [(t or "").lower().encode() for t in texts]
    return *word_hashes(lowered, _BETWEEN), lowered


@dataclass
class Block:
    """Items and, by seed (sorted), where in which items it is; short items by hash and number of words."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray
    places: list[list[tuple[int, int]]]
    short: dict[int, dict[int, list[int]]]
    rare: np.ndarray | None = None


def block_of(items: list[tuple[int, str | None]]) -> Block:
    h, _, _, first, _ = words_of([t for _, t in items])
    ids, words, where, short = [], [], defaultdict(list), defaultdict(lambda: defaultdict(list))
    for k, (item, _) in enumerate(items):
        own = h[first[k] : first[k + 1]]
        if len(own) >= MIN_WORDS:
            for at, seed in enumerate(combined(own, N).tolist()):
                where[seed].append((len(ids), at))
            ids.append(item)
            words.append(own)
        elif len(own):
            short[len(own)][int(combined(own, len(own))[0])].append(item)
    seeds = np.array(sorted(where), np.uint64)
    return Block(ids, words, seeds, [where[s] for s in seeds.tolist()], {n: dict(x) for n, x in short.items()})


def seed_hits(seeds: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in grams that are seeds (sorted), and which."""
    if not len(seeds) or not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(seeds, grams), len(seeds) - 1)
    hit = seeds[at] == grams
    place = np.flatnonzero(hit)
    return place, at[place]


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the end of its place in window."""
    steps = np.arange(len(window) + 1) * -GAP
    row = np.zeros(len(window) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        here = np.zeros(len(window) + 1, np.int64)
        here[1:] = np.maximum(np.maximum(row[:-1] + np.where(window == w, MATCH, MISMATCH), row[1:] + GAP), 0)
        row = np.maximum.accumulate(here + steps) - steps  # gaps in the item
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def matches(block: Block, words: np.ndarray, place: np.ndarray, seed: np.ndarray, threshold: float) -> Iterator[tuple[int, float, int, int]]:
    """(item, score, first word, end) of items that a document's words hold, by the seeds found at place. Of places with
    one score the first counts."""
    diagonals: dict[int, dict[int, bool]] = defaultdict(dict)
    for p, s in zip(place.tolist(), seed.tolist(), strict=True):
        rare = block.rare is None or bool(block.rare[s])
        for item, at in block.places[s]:
            diagonals[item][p - at] = rare or diagonals[item].get(p - at, False)
    for item, starts in diagonals.items():
        own = block.words[item]
        slack = max(4, len(own) // 4)
        groups: list[tuple[bool, int, int]] = []  # without a rare seed, first and last diagonal
        for at in sorted(starts):
            if groups and at - groups[-1][2] <= slack:
                common, first, _ = groups.pop()
                groups.append((common and not starts[at], first, at))
            else:
                groups.append((not starts[at], at, at))
        best = (0, 0, 0)
        for _, first, last in sorted(groups):
            a, b = max(first - slack, 0), min(last + len(own) + slack, len(words))
            most = MATCH * int(np.isin(own, words[a:b]).sum())
            if (most, -a) < (best[0], -best[1]) or most / (MATCH * len(own)) < threshold:
                continue
            score, end = align(own, words[a:b])
            if (score, -a) > (best[0], -best[1]):
                best = score, a, a + end
        score, a, end = best
        share = score / (MATCH * len(own))
        if share >= threshold:
            _, back = align(own[::-1], words[a:end][::-1])
            yield block.ids[item], share, end - back, end


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("item_id is not null and text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // BLOCK_CHARS)
    for k in range(n):
        yield block_of([(r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "text").collect()])  # one block of items


def seeded(docs: DataFrame, blocks: list[Block]) -> None:
    """Count the blocks' seeds in one pass over all documents and mark the rare ones. docs: (doc_id, text)."""
    schema = pa.schema([("block", pa.int32()), ("seed", pa.int64()), ("n", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast([b.seeds for b in blocks])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, docs = shared.value, 0
        sums = [np.zeros(len(own), np.int64) for own in seeds]
        for chunk in chunks(it):
            h, _, _, first, _ = words_of([t for _, t in chunk])
            docs += len(chunk)
            grams = combined(h, N) if len(h) >= N else h[:0]
            for own, n in zip(seeds, sums, strict=True):
                place, seed = seed_hits(own, grams)
                if len(place):
                    doc = np.searchsorted(first, place, side="right")
                    inside = place + N <= first[np.minimum(doc, len(first) - 1)]
                    n += np.bincount(np.unique(doc[inside] * (len(own) + 1) + seed[inside]) % (len(own) + 1), minlength=len(n))[: len(n)]
        yield from batches([(-1, 0, docs), *((k, int(i), int(n[i])) for k, n in enumerate(sums) for i in np.flatnonzero(n))], schema, 50_000)

    rows = docs.mapInArrow(count, "block int, seed long, n long").groupBy("block", "seed").agg(F.sum("n").alias("n")).collect()  # at most the blocks' seeds
    counts, documents = [np.zeros(len(b.seeds), np.int64) for b in blocks], 0
    for r in rows:
        if r.block < 0:
            documents = r.n
        else:
            counts[r.block][r.seed] = r.n
    for block, n in zip(blocks, counts, strict=True):
        block.rare = n <= max(1, RARE * documents)


def whole_lines(block: Block, h: np.ndarray, first: np.ndarray, ends_line: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, 1, first word, end) of short items that are a whole line or text. ends_line: by word, whether its line ends with it."""
    for n, items in block.short.items():
        if len(h) < n:
            continue
        known = np.array(sorted(items), np.uint64)
        grams = combined(h, n)
        line_starts = np.r_[True, ends_line[: len(grams) - 1]] & ends_line[n - 1 : n - 1 + len(grams)]
        at = np.flatnonzero(line_starts & np.isin(grams, known))
        if n > 1 and len(at):  # no line ends inside
            inner = np.r_[0, np.cumsum(ends_line)]
            at = at[inner[at + n - 1] == inner[at]]
        text = np.searchsorted(first, at, side="right") - 1
        seen: set[tuple[int, int]] = set()
        for k, p in zip(text.tolist(), at.tolist(), strict=True):
            for item in items[int(grams[p])]:
                if (k, item) not in seen:
                    seen.add((k, item))
                    yield k, item, 1.0, p - int(first[k]), p - int(first[k]) + n


def found_in(blocks: list[Block], held: list[tuple[int | None, str | None]], threshold: float) -> Iterator[tuple[int, int, float, int, int, bytes]]:
    """(place in held, item, score, first word, end word, passage)."""
    h, starts, ends, first, lowered = words_of([t for _, t in held])
    offset = np.cumsum([0, *(len(x) + 1 for x in lowered)])
    grams = combined(h, N) if len(h) >= N else h[:0]

    def passage(k: int, w: int, end: int) -> bytes:
        return lowered[k][starts[first[k] + w] - offset[k] : ends[first[k] + end - 1] - offset[k]]

    ends_line = None
    for block in blocks:
        place, seed = seed_hits(block.seeds, grams)
        doc = np.searchsorted(first, place, side="right") - 1
        edge = np.flatnonzero(np.diff(np.r_[-1, doc, -1]))
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            k = int(doc[i])
            a, b = int(first[k]), int(first[k + 1])
            own = place[i:j] + N <= b
            for item, score, w, end in matches(block, h[a:b], place[i:j][own] - a, seed[i:j][own], threshold):
                yield k, item, score, w, end, passage(k, w, end)
        if block.short and len(h):
            if ends_line is None:
                feeds = np.flatnonzero(np.frombuffer(b"\n".join([*lowered, b""]), np.uint8) == 10)  # texts are joined by one, too
                ends_line = np.searchsorted(feeds, ends) < np.searchsorted(feeds, np.r_[starts[1:], offset[-1] + 1])
            for k, item, score, w, end in whole_lines(block, h, first, ends_line):
                yield k, item, score, w, end, passage(k, w, end)


def grouped(benchmark: DataFrame, id_col: str, text_col: str, docs: DataFrame) -> Iterator[list[Block]]:
    """Blocks, GROUP at a time, with their rare seeds as counted over docs."""
    blocks = blocks_of(benchmark, id_col, text_col)
    while group := list(itertools.islice(blocks, GROUP)):
        seeded(docs, group)
        yield group


def contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, first_word, n_words, passage: each document that holds a copy of an item, with the best
    place; of equally good ones, the first.

    score is the alignment's share of a full match, from threshold to 1. An item of fewer than MIN_WORDS words matches
    a line or a document of exactly its words, with score 1. Null or empty texts and items, and those without words,
    match nothing; a row with a null id gives rows with a null doc_id. Repeated rows are each reported, items that share
    an id too. Without items or documents the result is empty.
    """
    docs = id_text(documents, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("passage", pa.string())])
    kind = "doc_id long, item_id long, score double, first_word long, n_words long, passage string"

    def finder(shared: Broadcast):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from batches(((chunk[k][0], item, score, w, end - w, text.decode()) for chunk in chunks(it) for k, item, score, w, end, text in found_in(shared.value, chunk, threshold)), schema)

        return run

    out = docs.sparkSession.createDataFrame([], kind)
    for group in grouped(benchmark, item_col, item_text, docs):
        out = out.unionByName(docs.mapInArrow(finder(docs.sparkSession.sparkContext.broadcast(group)), kind))
    return out


def clean(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """documents, all columns, without those that hold a copy of an item. Narrow: rows are dropped where they are read.

    Null and empty texts hold nothing and stay; ids are not looked at, so that null ones stay and repeated rows go or stay
    each by its text. Seeds are counted over documents as given: a pass for each GROUP of blocks, then one that drops.
    """
    docs = id_text(documents, id_col, text_col)
    for group in grouped(benchmark, item_col, item_text, docs):
        shared = docs.sparkSession.sparkContext.broadcast(group)

        def run(it: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for batch in it:
                texts = batch.column(batch.schema.get_field_index(text_col))
                for a in range(0, batch.num_rows, 500):
                    part = batch.slice(a, 500)
                    bad = {k for k, *_ in found_in(shared.value, [(None, texts[a + k].as_py()) for k in range(part.num_rows)], threshold)}
                    yield part.filter(pa.array([k not in bad for k in range(part.num_rows)], pa.bool_())) if bad else part

        documents = documents.mapInArrow(run, documents.schema)
    return documents
