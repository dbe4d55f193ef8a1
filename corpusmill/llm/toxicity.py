"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding is one character to one character (lower case, homoglyphs to Latin letters, digits that stand for letters
wherever they are, symbols that do between letters or digits), so spans keep their places. A lexicon term is a whole word or the start of a
word; its weight is the smoothed log odds of a labelled document being toxic given the term, learned from
labelled rows beside a small seed list. A hit inside an exception phrase does not count. The sum of weights,
raw and normalised by length, goes through a logistic curve fitted on the same labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, id_text, rows, small_batches

#: Words that are insults in nearly every use, with a starting weight.
SEED = {"idiot": 3.0, "moron": 3.0, "stupid": 2.5, "scum": 3.0, "worthless": 2.0, "pathetic": 2.0, "disgusting": 2.0, "loser": 2.5, "trash": 1.5, "clown": 1.5, "imbecile": 3.0, "dumbass": 3.5, "bastard": 3.0, "retard": 3.5}
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "idiot proof", "no stupid questions", "circus clown")
#: Characters that look like Latin letters (Cyrillic, Greek), and digits that stand for letters.
HOMOGLYPHS = dict(zip("аеорсухкмтвніјԁɡӏαεορκνιτυχ", "aeopcyxkmtbhijdglaeopkvitux", strict=True))
DIGITS = dict(zip("0134578", "oieastb", strict=True))
SYMBOLS = {"@": "a", "$": "s", "!": "i", "€": "e", "|": "l"}

TRAIN_ROWS = 12_000  #: bound on the labelled rows that the lexicon and the curve are fitted on
MIN_DOCS = 4  #: toxic labelled documents that a term needs
MIN_SHARE = 0.8  #: share of toxic among a term's labelled documents
PREFIXES = range(3, 9)  #: lengths of word starts that may become terms

_TABLE = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()} | {0xFF01 + k: chr(0x21 + k).lower() for k in range(94)}
_WORD = re.compile(r"[^\W_]+")
_INSIDE = re.compile(r"(?<=[^\W_])[@$!€|](?=[^\W_])")


def folded(text: str) -> str:
    """text, character by character, with disguises of letters undone; the length stays."""
    low = text.lower()
    if len(low) != len(text):  # a few letters have longer lower cases
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    if not low.isascii() or any(d in low for d in DIGITS):
        low = low.translate(_TABLE)
    return _INSIDE.sub(lambda m: SYMBOLS[m[0]], low)


@dataclass
class Model:
    lexicon: dict[str, tuple[float, bool]]  #: term -> weight, whether it is the start of a word only
    exceptions: tuple[str, ...]
    curve: tuple[float, ...]  #: bias and weights of the features


class Matcher:
    def __init__(self, lexicon: dict[str, tuple[float, bool]], exceptions: tuple[str, ...]):
        import ahocorasick

        self.terms = ahocorasick.Automaton()
        for term, (weight, start) in lexicon.items():
            self.terms.add_word(term, (len(term), weight, start, term))
        for phrase in exceptions:
            if not any(phrase == t for t in lexicon):
                self.terms.add_word(phrase, (len(phrase), None, False, phrase))
        if len(self.terms):
            self.terms.make_automaton()

    def hits(self, low: str) -> list[tuple[int, int, str, float]]:
        """(start, end, term, weight) of counted hits; at one place the longest term counts."""
        found: dict[int, tuple[int, int, str, float]] = {}
        harmless = []
        if not len(self.terms):
            return []
        for last, (size, weight, start, term) in self.terms.iter(low):
            a, b = last + 1 - size, last + 1
            if (a and low[a - 1].isalnum()) or (not start and b < len(low) and low[b].isalnum()):
                continue
            if weight is None:
                harmless.append((a, b))
            elif a not in found or found[a][1] < b:
                found[a] = a, b, term, weight
        return sorted(h for h in found.values() if not any(a <= h[0] and h[1] <= b for a, b in harmless))


def features(hits: list[tuple[int, int, str, float]], length: int) -> list[float]:
    total = sum(h[3] for h in hits)
    words = max(length / 6, 1)
    return [math.log1p(max(total, 0)), math.log1p(100 * max(total, 0) / words), math.log1p(len({h[2] for h in hits})), max((h[3] for h in hits), default=0.0)]


def probability(curve: tuple[float, ...], x: list[float]) -> float:
    z = curve[0] + sum(a * b for a, b in zip(curve[1:], x, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a small ridge."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + 0.05 * np.r_[0, w[1:]]
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


#: Used where there are no labels to fit on.
PLAIN_CURVE = (-4.0, 2.0, 0.8, 0.5, 0.5)


def chosen(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, tuple[float, bool]]:
    """Terms from (toxic, clean) document counts; keys '=w' are whole words, '<w' starts of words."""
    if not toxic or not clean:
        return {}
    base = math.log(toxic / clean)
    scored = []
    for key, (a, b) in counts.items():
        share = a / (a + b)
        weight = math.log((a + 0.5) / (b + 0.5)) - base
        if a >= MIN_DOCS and share >= max(MIN_SHARE, min(0.95, 3 * toxic / (toxic + clean))):
            scored.append((key, weight, a))
    starts = {k[1:]: (w, n) for k, w, n in scored if k[0] == "<"}
    out: dict[str, tuple[float, bool]] = {}
    for key, weight, n in sorted(scored, key=lambda x: (len(x[0]), x[0])):
        term, start = key[1:], key[0] == "<"
        if any(term[:k] in out and out[term[:k]][1] for k in range(1, len(term) + (not start))):
            continue  # a shorter start already covers it
        if start and any(len(t) > len(term) and t.startswith(term) and starts[t][1] >= 0.9 * n and starts[t][0] >= weight for t in starts):
            continue  # a longer start says as much, more exactly
        if term not in out:
            out[term] = weight, start
    return out


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """Lexicon and curve from at most train_rows labelled rows (those with the smallest hash of their id).

    Which rows may be learned from is the caller's choice. Rows with a null id or label are not used; an id that
    is labelled twice counts with its highest label, one with several texts with the least of them. Without labelled rows the seed list and a fixed curve remain.
    """
    picked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    train = id_text(documents, id_col, text_col).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).persist()  # train_rows small rows are broadcast, as many texts come back
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for batch in it:
            for text, y in zip(batch.column(1), batch.column(2), strict=True):
                words = set(_WORD.findall(folded(text.as_py() or "")))
                terms = {f"={w}" for w in words} | {f"<{w[:k]}" for w in words for k in PREFIXES if k < len(w)}
                terms.add("")
                seen[y.as_py() > 0].update(terms)
        yield from batches(((t, seen[1][t], seen[0][t]) for t in seen[0].keys() | seen[1].keys() if seen[1][t] or t == "" or seen[0][t]), schema, 50_000)

    counted = train.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    kept = counted.filter((F.col("toxic") >= MIN_DOCS) & (F.col("toxic") >= MIN_SHARE * (F.col("toxic") + F.col("clean"))) | (F.col("term") == "")).collect()  # at most train_rows x words of a row
    counts = {r.term: (r.toxic, r.clean) for r in kept}
    toxic, clean = counts.pop("", (0, 0))
    lexicon = {t: (w, False) for t, w in SEED.items()} | chosen(counts, toxic, clean)
    model = Model(lexicon, EXCEPTIONS, PLAIN_CURVE)
    if toxic and clean:
        schema_x = pa.schema([("x", pa.list_(pa.float64())), ("y", pa.int32())])

        def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(model.lexicon, model.exceptions)
            for batch in it:
                yield from batches(((features(matcher.hits(folded(t)), len(t)), int(y.as_py() > 0)) for t, y in zip((t.as_py() or "" for t in batch.column(1)), batch.column(2), strict=True)), schema_x)

        measured = train.mapInArrow(measure, "x array<double>, y int").collect()
        model.curve = fitted(np.array([r.x for r in measured]), np.array([r.y for r in measured], float))
    train.unpersist()
    return model


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, hits array<struct<start, end, term, weight>> of each whole text.

    A null or empty text has no hits and the score of a text without hits. Null ids and repeated rows stay: one
    row out for each row in. Narrow: no shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("weight", pa.float64())])))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.lexicon, model.exceptions)

        def out():
            for batch in it:
                for k, text in rows(batch):
                    text = text or ""
                    hits = matcher.hits(folded(text))
                    yield k, probability(model.curve, features(hits, len(text))), [{"start": a, "end": b, "term": t, "weight": w} for a, b, t, w in hits]

        yield from batches(out(), schema)

    return id_text(documents, id_col, text_col).mapInArrow(run, "doc_id long, score double, hits array<struct<start:int,end:int,term:string,weight:double>>")


def keep(documents: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """documents, all columns, without those that score threshold or more. Narrow: rows are dropped where they are read.

    A null or empty text scores as one without hits. Ids are not looked at: null ones stay, and repeated rows go or stay
    each by its text.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.lexicon, model.exceptions)
        for batch in it:
            texts = (t.as_py() or "" for t in batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array([probability(model.curve, features(matcher.hits(folded(t)), len(t))) < threshold for t in texts], pa.bool_()))

    small_batches(documents.sparkSession)
    return documents.mapInArrow(run, documents.schema)
