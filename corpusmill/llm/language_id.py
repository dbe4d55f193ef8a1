"""Language identification with spans of mixed-language text.

Words are runs of letters. The scripts of a word's letters (ranges of code points) narrow its candidates to
the languages seen in that script; each word then has a score per language, the mean-free sum of smoothed log
probabilities of its hashed character trigrams. Viterbi over the words, with a penalty for each switch, labels
them; neighbours with one label form a span. The document's language is that of most letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, id_text, rows

TRAIN_ROWS = 6_000  #: bound on the labelled documents that counts are taken from
BUCKETS = 1 << 16  #: of hashed trigrams
SWITCH = 12.0  #: penalty, in nats
CLIP = 12.0  #: most that one word may speak for a language
CHUNK = 4 << 20  #: characters handled together
UNKNOWN = "und"

#: First code points of script ranges, in order, and a number for each script.
RANGES = ((0x0, 0), (0x41, 1), (0x250, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0), (0x900, 7), (0x980, 8), (0xE00, 9), (0xE80, 0), (0x10A0, 10), (0x1100, 11), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 12), (0x3100, 0), (0x3400, 13), (0xA000, 0), (0xAC00, 11), (0xD7B0, 0), (0xF900, 13), (0xFB00, 0), (0x20000, 13), (0x30000, 0))
SCRIPTS = 14


class Tables:
    """Per code point: whether a letter, its lower case, its script."""

    _made: Tables | None = None

    def __init__(self):
        self.letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        for c in np.flatnonzero(self.letter):
            if len(x := chr(c).lower()) == 1:
                self.lower[c] = ord(x)
        starts, scripts = np.array([a for a, _ in RANGES]), np.array([b for _, b in RANGES], np.uint8)
        self.script = scripts[np.searchsorted(starts, np.arange(0x110000), side="right") - 1]

    @classmethod
    def get(cls) -> Tables:
        if cls._made is None:
            cls._made = cls()
        return cls._made


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: the words' starts and ends in the joined text, the first word of each text (and the end), trigram buckets by letter, scripts by word."""
    t = Tables.get()
    texts = [x or "" for x in texts]
    joined = "\n".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    letter = t.letter[points]
    edge = np.flatnonzero(np.diff(np.r_[False, letter, False].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    low = np.where(letter, t.lower[points], 32).astype(np.uint64)
    before, after = np.r_[np.uint64(32), low[:-1]], np.r_[low[1:], np.uint64(32)]
    mixed = (before * np.uint64(0x9E3779B97F4A7C15) + low * np.uint64(0xC2B2AE3D27D4EB4F) + after * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
    bucket = (mixed >> np.uint64(48)).astype(np.int32)
    first = np.searchsorted(starts, np.r_[0, np.cumsum(sizes)])
    script = t.script[points[starts]] if len(starts) else np.zeros(0, np.uint8)
    return starts, ends, first, bucket, script


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  #: buckets x languages
    allowed: np.ndarray  #: scripts x languages


def learn(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    """Trigram weights from at most train_rows documents with a language (the smallest hashes of their ids).

    Which rows may be learned from is the caller's choice. Of rows that share an id, the one with the least language
    and text counts; null and empty texts count nothing. The counts have at most 65,536 rows a language.
    """
    labelled = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and doc_id is not null")
    picked = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).distinct()
    train = labelled.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("r.text", "r.lang")  # at most train_rows ids are broadcast, as many texts come back
    schema = pa.schema([("lang", pa.string()), ("script", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in it:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                starts, ends, _, bucket, script = words([text.as_py()])
                own = seen.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
                letters = np.repeat(starts - np.r_[0, np.cumsum(ends - starts)[:-1]], ends - starts) + np.arange((ends - starts).sum())
                own += np.bincount(bucket[letters], minlength=BUCKETS)
                scripts.setdefault(lang.as_py(), np.zeros(SCRIPTS, np.int64))[:] += np.bincount(script, minlength=SCRIPTS)
        yield from batches(((lang, -1, int(k), int(n[k])) for lang, n in seen.items() for k in np.flatnonzero(n)), schema, 50_000)
        yield from batches(((lang, int(k), -1, int(n[k])) for lang, n in scripts.items() for k in np.flatnonzero(n)), schema)

    counts = train.mapInArrow(count, "lang string, script int, bucket int, n long").groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    grams, allowed = np.zeros((BUCKETS, len(langs))), np.zeros((SCRIPTS, len(langs)), bool)
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        g, s = own[own["script"] < 0], own[own["bucket"] < 0]
        grams[g["bucket"].to_numpy(), k] = g["n"].to_numpy()
        allowed[s["script"].to_numpy(), k] = s["n"].to_numpy() >= 0.001 * max(s["n"].sum(), 1)
    log = np.log((grams + 0.3) / (grams.sum(0) + 0.3 * BUCKETS))
    return Model([str(x) for x in langs], (log - log.mean(1, keepdims=True)).astype(np.float32) if langs else log.astype(np.float32), allowed)


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word. score: words x languages; text k has the words first[k] to first[k + 1]. All texts advance together."""
    n, langs = score.shape
    label = np.zeros(n, np.int16)
    if not n:
        return label
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, counts = first[:-1][order], counts[order]
    active = np.searchsorted(-counts, -np.arange(counts[0]), side="left")  # texts with more than t words
    back = np.zeros((n, langs), np.int16)
    own = np.arange(langs, dtype=np.int16)
    value = score[begin[: active[0]]].copy()
    for t in range(1, int(counts[0])):
        a = active[t]
        value = value[:a] if a < len(value) else value
        lead = value.argmax(1)
        switched = value[np.arange(a), lead] - penalty
        stay = value >= switched[:, None]
        at = begin[:a] + t
        back[at] = np.where(stay, own, lead[:, None])
        value = np.where(stay, value, switched[:, None]) + score[at]
        value -= value.max(1, keepdims=True)
        ending = 0 if t + 1 >= counts[0] else active[t + 1]
        if ending < a:
            label[at[ending:]] = value[ending:].argmax(1)
    short = active[1] if counts[0] > 1 else 0
    one = np.arange(short, active[0])
    label[begin[one]] = score[begin[one]].argmax(1)
    for t in range(int(counts[0]) - 1, 0, -1):
        at = begin[: active[t]] + t
        label[at - 1] = back[at, label[at]]
    return label


def identify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH) -> DataFrame:
    """doc_id, lang, score, spans array<struct<start, end, lang>> of each whole text, in code points.

    score is the share of letters in the language, times how surely its words speak for it. Null text, or none
    with a letter, gives 'und', 0 and no spans; so does a model without languages. Of languages with as many letters,
    the first by name counts. Null ids and repeated rows
    stay: one row out for each row in. Narrow: no shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])

    def labelled(held: list[tuple[int | None, str | None]]) -> Iterator[tuple]:
        starts, ends, first, bucket, script = words([t for _, t in held])
        langs = len(model.langs)
        if not langs:
            yield from ((k, UNKNOWN, 0.0, []) for k, _ in held)
            return
        sums = np.zeros((len(starts), langs), np.float32)
        if len(starts):
            edges = np.stack([starts, ends], 1).ravel()
            for k in range(langs):
                sums[:, k] = np.add.reduceat(np.r_[model.weight[:, k][bucket], np.float32(0)], edges)[::2]
            sums -= sums.mean(1, keepdims=True)
            np.clip(sums, -CLIP, CLIP, out=sums)
            ok = model.allowed[script]
            sums[~ok & ok.any(1)[:, None]] = -2 * CLIP
        label = viterbi(sums, first, penalty)
        size = ends - starts
        offset = np.r_[0, np.cumsum([len(t or "") + 1 for _, t in held])]
        for k, (doc, _) in enumerate(held):
            a, b = first[k], first[k + 1]
            if a == b:
                yield doc, UNKNOWN, 0.0, []
                continue
            own = label[a:b]
            letters = np.bincount(own, weights=size[a:b], minlength=langs)
            best = int(letters.argmax())
            mine = sums[a:b][own == best]
            rest = np.delete(mine, best, 1).max(1) if langs > 1 else mine[:, 0] - 1
            sure = 1 / (1 + np.exp(-np.clip(float((mine[:, best] - rest).sum()), -30, 30)))
            edge = np.r_[0, np.flatnonzero(np.diff(own)) + 1]
            yield doc, model.langs[best], float(letters[best] / letters.sum() * sure), [{"start": int(starts[a + i] - offset[k]), "end": int(ends[a + j] - offset[k]), "lang": model.langs[own[i]]} for i, j in zip(edge, np.r_[edge[1:] - 1, b - a - 1], strict=True)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            held, weight = [], 0
            for batch in it:
                for row in rows(batch):
                    held.append(row)
                    weight += len(row[1] or "")
                    if weight >= CHUNK:
                        yield from labelled(held)
                        held, weight = [], 0
            if held:
                yield from labelled(held)

        yield from batches(out(), schema)

    return id_text(documents, id_col, text_col).mapInArrow(run, "doc_id long, lang string, score double, spans array<struct<start:int,end:int,lang:string>>")
