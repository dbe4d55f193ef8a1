"""Ranked retrieval by an inverted index over small blocks of chunks, with bounds that decide which blocks are opened.

A block holds up to 64 chunks in a row. For each of its words it has 64 bits that say which chunks hold it, and for each
rule of the score the most that it can give each chunk; the chunks themselves are compressed beside them. From words and
rules alone follow two bounds of every score. A first pass over the index takes the k-th best lower bound of each query; a second
opens a block only for queries whose upper bound in it reaches that far, and scores only the chunks that do.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import scoring as S
from ..functions.text import is_non_content
from ..session import small_batches
from .retrieval import BEST, BEST_ARROW, BROADCAST_QUERIES, top_k

BLOCK, BLOCK_BYTES = 64, 1 << 20  #: chunks of a block, at most as many as a word has bits; characters of its texts
SLACK = 1e-5  #: what the bounds may lose by rounding

RULES = [*L.INTENTS, *L.INTENTS_BUT_PROJECT, *L.INTENTS_STAFF]
#: In the order of RULES: strings of which a text must hold one (letter case aside) for the rule's pattern to match.
NEEDED = (
    ("calendrier", "grille", "horaire"), ("à", "période", "récréation", "dîner", "déplacement"), ("ingrédient", "ingredient"), ("ingrédient", "ingredient"), tuple("0123456789"),
    ("cari", "curry"), ("lentil",), ("ricardo",), ("cafétéria", "cafeteria"), ("végé", "vege"), ("cafétéria", "cafeteria"), ("info",), ("info",),
    ("direct",), ("direction",), ("conseill", "enseignant", "direct", "adjoint"), ("personnel",),
)
_WORD, _DIGIT = re.compile("[A-Za-z0-9_]+"), re.compile(r"\d")
ODD_CASES = "ſıİK"  #: match plain letters in patterns without case, but are not lowered to them
_RULE_NUMBER = {(pattern, bonus, most): k for k, (_, pattern, bonus, most) in enumerate(RULES)}
HIT, PROJECT_BONUS = len(RULES), len(RULES) + 1  #: rows of the rule table behind the rules

SCHEMA = "n int, words binary, bits binary, rules binary, held binary, payload binary"
_SCHEMA = pa.schema([("n", pa.int32()), ("words", pa.binary()), ("bits", pa.binary()), ("rules", pa.binary()), ("held", pa.binary()), ("payload", pa.binary())])
_CHUNK = pa.schema([("source", pa.string()), ("index", pa.int32()), ("text", pa.string()), ("pdf_url", pa.string())])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows one by one; a batch is never turned into Python objects as a whole."""
    for k in range(batch.num_rows):
        yield tuple(c[k].as_py() for c in batch.columns)


def _small(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _large(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def rule_values(text: str) -> list[float]:
    """The most that each rule can give a text, whether it names a personal project, and the bonus for that."""
    low = text.lower()
    odd = any(c in text for c in ODD_CASES) or not text.isascii() and any(c in low for c in "̀́̂̈")
    own = [most if odd or (any(x in low for x in needed) if needed[0] != "0" else bool(_DIGIT.search(low))) else 0.0 for (_, _, _, most), needed in zip(RULES, NEEDED, strict=True)]
    return [*own, float("personnel" in low and bool(S._PROJECT.search(low))), S.project_bonus(text)]


def block_of(rows: list[tuple]) -> tuple:
    """A row of the index."""
    postings: dict[str, int] = {}
    rules = np.zeros((len(RULES) + 2, len(rows)), np.float32)
    for k, (_, _, text, _) in enumerate(rows):
        if text is not None:
            for w in set(_WORD.findall(text.lower())):
                postings[w] = postings.get(w, 0) | 1 << k
            rules[:, k] = rule_values(text)
    words = sorted(postings)
    bits = np.array([postings[w] for w in words], np.uint64)
    held = np.array([text is not None for _, _, text, _ in rows], bool)
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CHUNK, strict=True)], schema=_CHUNK)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _CHUNK) as writer:
        writer.write_table(table)
    return len(rows), _small("\n".join(words).encode()), _small(bits.tobytes()), _small(rules.tobytes()), held.tobytes(), _small(sink.getvalue().to_pybytes())


def built(chunks: DataFrame) -> DataFrame:
    """The index of chunks (source, index, text, pdf_url), without style sheets and scripts. Rows stay in order, and none is
    moved, unless there are fewer partitions than cores: then sources are dealt out."""
    content = chunks.filter(~is_non_content(F.col("source"), F.col("text"))).select(F.col("source").cast("string"), F.col("index").cast("int"), F.col("text").cast("string"), F.col("pdf_url").cast("string"))

    cores = chunks.sparkSession.sparkContext.defaultParallelism
    if content.rdd.getNumPartitions() < cores:
        content = content.repartition(cores, "source")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple]:
            held, size = [], 0
            for batch in it:
                for row in _rows(batch):
                    held.append(row)
                    size += len(row[2] or "")
                    if len(held) == BLOCK or size >= BLOCK_BYTES:
                        yield block_of(held)
                        held, size = [], 0
            if held:
                yield block_of(held)

        for row in blocks():
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)

    return content.mapInArrow(run, SCHEMA)


@dataclass
class Asked:
    """Queries as arrays. What a word of a query brings stands in one list of (word, query) entries, by word."""

    queries: list[tuple[int | None, str | None]]
    plain: bool = False  #: score phrases and words alone

    def __post_init__(self):
        n = len(self.queries)
        self.n, self.bonus, self.said, self.related = np.ones(n, np.float32), np.zeros(n, np.float32), np.zeros(n, np.float32), np.zeros(n, np.float32)
        self.project, self.real = np.zeros(n, bool), np.array([q is not None for _, q in self.queries], bool)
        self.rules = np.zeros((n, len(RULES) + 2), np.float32)
        self.none = np.zeros((n, 4), np.float32)  # a chunk without any of the words: the least and the most of exact matches, the most of partial ones, words it lacks
        entries: dict[str, dict[int, np.ndarray]] = {}
        for k, (_, query) in enumerate(self.queries):
            if query is None:
                continue
            low = query.lower()
            project = not self.plain and any(p in low for p in L.PROJECT)
            words = S.query_words(query)
            self.n[k] = max(len(words), 1)
            for w in words:
                has, lacks = (np.array([1.0, 1.0, 0.0]), np.array([0.0, 1.0 * (" " in w or not w), 0.0])) if self.plain else self.brings(w, project)
                self.none[k, :3] += lacks
                entries.setdefault(w, {}).setdefault(k, np.zeros(4, np.float32))[:3] += has - lacks
            for w in set(words):
                self.none[k, 3] += 1
                entries[w][k][3] = -1
            if self.plain:
                continue
            self.project[k] = project
            self.said[k] = bool(S.phrases(low, project))
            self.related[k] = any(w in L.RELATED or w in ("directice", "directrice") for w in words)
            for pattern, bonus, most in S.intents(low):
                self.rules[k, _RULE_NUMBER[pattern.pattern, bonus, most]] += 1
            self.rules[k, PROJECT_BONUS] = project
            self.bonus[k] = 1.7 * any(t in low for t in L.ACTIVITY_INTENT)  # the most that a named activity brings
        self.words = {w: i for i, w in enumerate(entries)}
        self.first = np.cumsum([0, *(len(own) for own in entries.values())])
        self.query = np.array([k for own in entries.values() for k in own], np.int64)
        self.brought = np.array([x for own in entries.values() for x in own.values()], np.float32).reshape(-1, 4)

    def score(self, q: int, text: str) -> float:
        return (S.plain_relevance_of if self.plain else S.relevance_of)(self.queries[q][1], text)

    @staticmethod
    def brings(w: str, project: bool) -> tuple[np.ndarray, np.ndarray]:
        """The least and the most that a word adds to exact matches, and the most to partial ones, where a chunk has it, and where not."""
        active, common = w in L.ACTIVITY_WORDS, w in L.COMMON_WORDS
        weight = 3.0 if active else 0.3 if common else 1.0
        if project and w in ("personnel", "personnels"):
            return np.array([0.1, 2.0, 0.0]), np.array([0.0, 2.0, 0.0])
        exact = weight if " " in w else 1.5 if w == "directice" else 2.0 if w == "project" and project else 0.0
        partial = 0.1 if len(w) <= 2 or common else 1.5 if active else 0.7 if w == "directice" else 0.5
        return np.array([weight, weight, 0.0]), np.array([0.0, exact, partial])

    def sums(self, words: bytes, bits: bytes, n: int, columns: tuple[int, ...] = (0, 1, 2, 3)) -> np.ndarray:
        """Columns of self.none of each query with what the words of each of n chunks bring: (columns, queries, chunks)."""
        out = np.repeat(self.none.T[list(columns), :, None], n, axis=2)
        found = [(c, k) for k, w in enumerate(_large(words).decode().split("\n")) if (c := self.words.get(w)) is not None]
        if not found:
            return out
        word, place = np.array(found, np.int64).T
        own = np.frombuffer(_large(bits), np.uint64)[place]
        has = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=n).astype(np.float32)
        count = self.first[word + 1] - self.first[word]
        entry = np.repeat(self.first[word] - np.cumsum(count) + count, count) + np.arange(count.sum())
        order = np.argsort(self.query[entry], kind="stable")
        entry, chunk = entry[order], has[np.repeat(np.arange(len(word)), count)[order]]
        query = self.query[entry]
        edge = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        for k, j in enumerate(columns):
            out[k, query[edge]] += np.add.reduceat(chunk * self.brought[entry, j : j + 1], edge, axis=0)
        return out

    def lows(self, words: bytes, bits: bytes, rules: bytes, held: bytes, n: int) -> np.ndarray:
        """The least that each query (row) gives each chunk (column) of a block."""
        least, count = self.sums(words, bits, n, (0,))[0], self.n[:, None]
        sure = self.rules[:, PROJECT_BONUS:] @ np.frombuffer(_large(rules), np.float32).reshape(-1, n)[PROJECT_BONUS:]
        low = np.minimum(sure + 0.15 * 0.8 * least / count, 1)
        if self.project.any():
            low = np.where(self.project[:, None], np.minimum(sure + 0.1 * 0.6 * least / count, 0.4), low)
        return np.where(self.there(held), low, 0)

    def highs(self, words: bytes, bits: bytes, rules: bytes, held: bytes, n: int) -> np.ndarray:
        """The most that each query (row) gives each chunk (column) of a block."""
        most, partial, lacking = self.sums(words, bits, n, (1, 2, 3))
        values = np.frombuffer(_large(rules), np.float32).reshape(-1, n)
        count, said, related = self.n[:, None], self.said[:, None], self.related[:, None]
        bonus = self.bonus[:, None] + self.rules @ values
        whole = lacking <= 2.5  # a text that holds the query has all its words but the first and last
        high = np.minimum(bonus + 0.3 * whole + 0.25 * said + 0.15 * (0.8 * most + 0.2 * partial) / count + 0.05 * related, 1)
        if self.project.any():
            hits = np.minimum(bonus + 0.3 + 0.1 * (0.8 * most + 0.2 * partial) / count, 1)
            misses = np.minimum(bonus + 0.2 * whole + 0.2 * said + 0.1 * (0.6 * most + 0.15 * partial) / count + 0.03 * related, 0.4)
            high = np.where(self.project[:, None], np.where(values[None, HIT] > 0, hits, misses), high)
        return np.where(self.there(held), high, 0)

    def there(self, held: bytes) -> np.ndarray:
        return np.frombuffer(held, bool)[None] & self.real[:, None]


def thresholds(index: DataFrame, asked: Broadcast, most: int) -> np.ndarray:
    """A score that at least `most` chunks reach, for each query: the `most`-th best lower bound; 0 with fewer chunks. The driver gets a
    row a query."""
    schema = pa.schema([("q", pa.int32()), ("low", pa.float32())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Asked = asked.value
        best = np.zeros((len(own.queries), 0), np.float32)
        for batch in it:
            for n, words, bits, rules, held in _rows(batch):
                best = np.concatenate([best, own.lows(words, bits, rules, held, n)], axis=1)
                best = -np.sort(-best, axis=1)[:, :most]
        q = np.repeat(np.arange(len(own.queries), dtype=np.int32), best.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best.ravel().astype(np.float32))], schema=schema)

    lows = index.select("n", "words", "bits", "rules", "held").mapInArrow(run, "q int, low float")
    merged = lows.groupBy("q").agg(F.slice(F.sort_array(F.collect_list("low"), asc=False), most, 1).alias("low"))  # `most` rows a query and task
    out = np.zeros(len(asked.value.queries), np.float32)
    for r in merged.collect():
        out[r.q] = r.low[0] if r.low else 0
    return out


class BlockIndex:
    """An index that stands in a folder: written once, asked as often as wanted."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, chunks: DataFrame, path: str) -> BlockIndex:
        built(chunks).write.parquet(path)
        return cls(chunks.sparkSession, path)

    def frame(self) -> DataFrame:
        """The blocks. A worker takes them in small batches, as a block holds its chunks."""
        small_batches(self.spark)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def best_of(self, queries: DataFrame, k: int, counter=None, plain: bool = False) -> DataFrame:
        """What retrieval.best_of() gives over the same chunks; plain: by phrases and words alone. counter, an accumulator, counts the
        pairs that are scored.

        Up to BROADCAST_QUERIES queries are asked together, more in blocks; the index is read twice for each.
        """
        asked = queries.select(F.col("query_id").cast("long"), F.col("query").cast("string"))
        blocks = max(1, -(-asked.count() // BROADCAST_QUERIES))
        out = None
        for b in range(blocks):
            own = sorted(((r.query_id, r.query) for r in asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()), key=str)  # about BROADCAST_QUERIES rows
            part = self.found(Asked(own, plain), max(k, 3), counter)
            out = part if out is None else out.unionByName(part)
        return top_k(out, k, ["source", "index"])

    def found(self, asked: Asked, most: int, counter=None) -> DataFrame:
        context = self.spark.sparkContext
        shared = context.broadcast(asked)  # BROADCAST_QUERIES queries at most
        floor = context.broadcast(thresholds(self.frame(), shared, most) - SLACK)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: Asked = shared.value
            least = floor.value.copy()  # falls behind nothing: what a query's `most`-th best of this task or of all reaches
            held: list[list[tuple]] = [[] for _ in own.queries]
            seen = scored = 0
            for batch in it:
                for n, words, bits, rules, there, payload in _rows(batch):
                    high = own.highs(words, bits, rules, there, n)
                    wanted = high >= least[:, None] - SLACK
                    if not wanted.any():
                        seen += n
                        continue
                    rows = list(zip(*(c.to_pylist() for c in pa.ipc.open_stream(_large(payload)).read_all().columns), strict=True))
                    S.prepare((own.queries[q][1] for q in np.flatnonzero((wanted & (high > 0)).any(1)).tolist()), (rows[c][2] for c in np.flatnonzero((wanted & (high > 0)).any(0)).tolist()))
                    for c in np.flatnonzero(wanted.any(0)).tolist():
                        source, index, text, pdf = rows[c]
                        place = (source is not None, source or "", index is not None, index or 0, seen + c)
                        for q in np.flatnonzero(wanted[:, c] & (high[:, c] >= least - SLACK)).tolist():
                            if high[q, c] > 0:
                                scored += 1
                                score = own.score(q, text)
                            else:
                                score = 0.0
                            key, mine = (-score, *place), held[q]
                            if len(mine) < most or key < mine[-1][0]:
                                bisect.insort(mine, (key, source, index, text, pdf))
                                del mine[most:]
                                if len(mine) == most:
                                    least[q] = max(least[q], -mine[-1][0][0] - SLACK)
                    seen += n
            if counter is not None:
                counter.add(scored)
            for (query_id, query), mine in zip(own.queries, held, strict=True):
                if mine:
                    out = [(query_id, query, source, index, text, pdf, -key[0]) for key, source, index, text, pdf in mine]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), BEST_ARROW, strict=True)], schema=BEST_ARROW)

        return self.frame().mapInArrow(run, BEST)
