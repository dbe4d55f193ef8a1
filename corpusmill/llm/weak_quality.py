"""Quality by weak labels: overlapping heuristic labellers, expectation-maximisation, a hashed linear scorer.

Each labeller votes good, bad or nothing on a document, from one measure with a bound on either side; several look at
the same fault from different sides, and they contradict each other. The corpus is summed up as counts of vote patterns
over all documents. Expectation-maximisation on those counts, started from the share of good votes, estimates how often
each labeller is right on good and on bad documents, and the posterior of every pattern; a missing vote says nothing.
The posteriors then label a bounded sample, on which a linear scorer over hashed features (kinds of characters in
threes, repeated words and lines) is trained; it scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, id_text, rows
from .shingles import word_hashes

BUCKETS = 4096
TRAIN_ROWS = 3000  #: bound on the weakly labelled rows that the scorer is fitted on
BAD, NONE, GOOD = 0, 1, 2
KINDS = 8  #: of bad documents that may be added to the first
STARTS = (1, 4, 16)  #: powers of the share of good votes that expectation-maximisation starts from
#: Labellers: bounds of the measure up to which and from which on it votes; (bad below, good from, good up to, bad above).
LABELLERS = {
    "symbols": (None, 0.0, 0.03, 0.08),  # characters that are no letter, digit, space or common mark
    "letters": (0.8, 0.9, 1.0, None),  # letters and spaces
    "runs": (None, 0.0, 0.03, 0.2),  # words with a mark twice or more in a row
    "plain_words": (0.7, 0.9, 1.0, None),  # words with letters and at most one other character
    "lone_marks": (None, 0.0, 0.02, 0.1),  # words without a letter or digit
    "capitals": (None, 0.0, 0.15, 0.5),  # of the letters of A to Z
    "lower_starts": (0.3, 0.7, 1.0, None),  # words that begin with a to z or a letter beyond ASCII
    "exclaims": (None, 0.0, 0.05, 0.3),  # exclamation marks a word
    "stops": (1 / 120, 1 / 40, 1 / 4, 2 / 3),  # sentence ends a word
    "bars": (None, 0.0, 0.01, 0.15),  # vertical bars a word
    "same_words": (None, 0.0, 0.05, 0.25),  # words that repeat the one before
    "word_runs": (None, 0.0, 0.02, 0.15),  # words that repeat the two before
    "variety": (2.5, 4.0, None, None),  # distinct words, by the root of all words
    "pairs": (0.3, 0.7, 1.0, None),  # distinct pairs of words
    "lines": (None, 0.0, 0.1, 0.4),  # lines that stand there twice
    "word_length": (2.0, 3.0, 10.0, 15.0),  # bytes
}

_KIND = np.arange(256, dtype=np.int64)
_KIND[97:123] = 97
_KIND[65:91] = 65
_KIND[48:58] = 48
_KIND[128:192] = 0  # the rest of a character outside ASCII
_KIND[192:] = 97
_USUAL = np.array([32, 10, 9, 13, 46, 44, 39, 45, *range(48, 58)], np.uint8)


def measured(data: bytes) -> tuple[list[float | None], np.ndarray, np.ndarray]:
    """Each labeller's measure of one UTF-8 text, None where there is too little text for it; kinds of bytes; the last features."""
    x = np.frombuffer(data, np.uint8)
    kind = _KIND[x]
    n = max(len(x), 1)
    words, starts, ends, _ = word_hashes([data])
    w = len(words)
    lower, upper = kind == 97, kind == 65
    beyond = kind == 0
    beyond &= x >= 128
    letter = lower | upper | beyond
    symbols = n - int(letter.sum()) - int(np.isin(x, _USUAL).sum())
    upper_n, lower_n = int(upper.sum()), int(lower.sum())
    letters_before = np.r_[0, np.cumsum(letter)]
    twice_marks = np.r_[0, np.cumsum(np.r_[False, (x[1:] == x[:-1]) & ~letter[1:] & (x[1:] > 32)])] if len(x) else np.zeros(1, np.int64)
    own = letters_before[ends] - letters_before[starts]
    digits_before = np.r_[0, np.cumsum(kind == 48)]
    plain, bare = (own > 0) & (ends - starts - own <= 1), (own == 0) & (digits_before[ends] == digits_before[starts])
    same = float((words[1:] == words[:-1]).mean()) if w > 1 else 0.0
    distinct = len(np.unique(words)) if w else 0
    lines = [s for s in data.split(b"\n") if s.strip()]
    twice = 1 - len(set(lines)) / len(lines) if lines else 0.0
    bars, exclaims = int((x == 124).sum()) / max(w, 1), int((x == 33).sum()) / max(w, 1)
    with np.errstate(over="ignore"):
        pairs = len(np.unique(words[1:] + words[:-1] * np.uint64(0x9E3779B97F4A7C15))) / (w - 1) if w > 1 else 1.0
    some = lambda value, least=8: float(value) if w >= least else None
    values = [
        symbols / n if w else None, some((letter.sum() + np.isin(x, (32, 10)).sum()) / n, 1), some((twice_marks[ends] > twice_marks[starts + 1]).sum() / max(w, 1)), some(plain.sum() / max(w, 1)), some(bare.sum() / max(w, 1)),
        some(upper_n / max(upper_n + lower_n, 1)), some((lower[starts] | beyond[starts]).sum() / max(w, 1)), some(exclaims), some(np.isin(x, (46, 33, 63)).sum() / max(w, 1), 40), some(bars), some(same, 4), some(((words[2:] == words[1:-1]) & (words[2:] == words[:-2])).mean() if w > 2 else 0, 6),
        some(distinct / np.sqrt(max(w, 1)), 40), some(pairs, 20), twice if len(lines) > 3 else None, some((ends - starts).mean() if w else 0),
    ]
    last = np.array([same, 1 - distinct / max(w, 1), twice, min(bars, 1), min(exclaims, 1), symbols / n, upper_n / max(upper_n + lower_n, 1), 1 if w < 3 else 0], np.float32)
    return values, kind, last


def votes_of(values: list[float | None]) -> list[int]:
    out = []
    for value, (low, least, most, high) in zip(values, LABELLERS.values(), strict=True):
        bad = value is not None and ((low is not None and value < low) or (high is not None and value > high))
        good = value is not None and value >= least and (most is None or value <= most)
        out.append(BAD if bad else GOOD if good else NONE)
    return out


def measures(data: bytes) -> tuple[list[int], np.ndarray]:
    """Votes, and the hashed features (they sum up to about 1 a family), of one UTF-8 text."""
    values, kind, last = measured(data)
    features = np.zeros(BUCKETS, np.float32)
    if len(kind) >= 3:
        key = (kind[:-2] * 65599 + kind[1:-1]) * 65599 + kind[2:]
        features += np.bincount((key * 0x9E3779B1 >> 7) % (BUCKETS - 8), minlength=BUCKETS).astype(np.float32) / np.float32(len(key))
    features[-8:] = last
    return votes_of(values), features


@dataclass
class Accuracies:
    """What expectation-maximisation has found of good documents (class 0) and of one or more kinds of bad ones."""

    share: np.ndarray  #: of documents, by class
    says_good: np.ndarray  #: class x labeller, the share of its votes that say good

    @property
    def prior(self) -> float:
        return float(self.share[0])

    @property
    def good(self) -> np.ndarray:
        """By labeller, how often it is right on good documents."""
        return self.says_good[0]

    @property
    def bad(self) -> np.ndarray:
        """By labeller, how often it is right on bad documents."""
        return 1 - self.share[1:] @ self.says_good[1:] / self.share[1:].sum()

    def logs(self, pattern: np.ndarray) -> np.ndarray:
        """Log probability of rows of votes with each class; no vote says nothing."""
        return np.log(self.share) + (pattern == GOOD) @ np.log(self.says_good).T + (pattern == BAD) @ np.log(1 - self.says_good).T

    def shares(self, pattern: np.ndarray) -> np.ndarray:
        log = self.logs(pattern)
        p = np.exp(log - log.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Of rows of votes: how likely each is good."""
        return self.shares(pattern)[:, 0] if len(pattern) else np.zeros(0)

    def likelihood(self, pattern: np.ndarray, count: np.ndarray) -> float:
        return float(count @ np.logaddexp.reduce(self.logs(pattern), axis=1))


def maximised(pattern: np.ndarray, count: np.ndarray, shares: np.ndarray, rounds: int = 500) -> Accuracies:
    """Expectation-maximisation from shares of the classes in each pattern. Each rate counts half a vote for either side, so that none is 0 or 1."""
    says_good, says_bad = (pattern == GOOD).astype(float), (pattern == BAD).astype(float)
    model = None
    for _ in range(rounds):
        weight = shares * count[:, None]
        new = Accuracies((weight.sum(0) + 0.5) / (count.sum() + 0.5 * shares.shape[1]), (weight.T @ says_good + 0.5) / (weight.T @ (says_good + says_bad) + 1))
        done = model is not None and np.abs(new.share - model.share).max() + np.abs(new.says_good - model.says_good).max() < 1e-9
        model = new
        if done:
            break
        shares = model.shares(pattern)
    return model


def estimated(pattern: np.ndarray, count: np.ndarray) -> Accuracies:
    """Accuracies from vote patterns and their counts, without any label.

    Expectation-maximisation starts from powers of the share of good votes of each pattern; the likeliest end counts.
    Faults exclude each other, so bad documents may be of several kinds: while documents that count as good show two
    bad votes or more, those that the model finds most surprising start another kind, which stays if the log likelihood
    gains more than one for each of its rates. Without a pattern, all rates are a half.
    """
    k = pattern.shape[1]
    if not len(pattern):
        return Accuracies(np.full(2, 0.5), np.full((2, k), 0.5))
    goods, bads = (pattern == GOOD).sum(1), (pattern == BAD).sum(1)
    share = (goods + 0.5) / (goods + bads + 1)
    model = max((maximised(pattern, count, np.stack([share**start, 1 - share**start], 1)) for start in STARTS), key=lambda m: m.likelihood(pattern, count))
    for _ in range(KINDS):
        log = np.logaddexp.reduce(model.logs(pattern), axis=1)
        seeds = np.where((model.posterior(pattern) > 0.5) & (bads >= 2), -log * count, 0)
        if not seeds.max() > 0:
            break
        shares = np.c_[model.shares(pattern), np.zeros(len(pattern))]
        alike = ((pattern == BAD) & (pattern[seeds.argmax()] == BAD)).sum(1) >= 2
        shares[alike] = np.r_[np.full(shares.shape[1] - 1, 0.01), 1]
        more = maximised(pattern, count, shares / shares.sum(1, keepdims=True))
        if more.likelihood(pattern, count) <= model.likelihood(pattern, count) + k + 1:
            break
        model = more
    return model


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    scale: np.ndarray

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + (features * self.scale) @ self.weights, -30, 30))))


def fitted(x: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.5, ridge: float = 1e-3) -> Scorer:
    """Logistic regression on soft labels by accelerated gradient steps; columns are scaled to unit size."""
    scale = (1 / np.maximum(np.sqrt((x**2).mean(0)), 1e-3)).astype(np.float32)
    x = x * scale / np.float32(np.sqrt(x.shape[1]) / 8)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, vb = w.copy(), 0.0
    balance = np.where(y > 0.5, 0.5 / max((y > 0.5).mean(), 0.02), 0.5 / max((y <= 0.5).mean(), 0.02)).astype(np.float32)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        e = (p - y) * balance
        v = 0.9 * v - rate * (x.T @ e / np.float32(len(y)) + np.float32(ridge) * w)
        vb = 0.9 * vb - rate * float(e.mean())
        w, b = w + v, b + vb
    return Scorer(w / np.float32(np.sqrt(x.shape[1]) / 8), b, scale)


@dataclass
class Model:
    accuracies: Accuracies
    scorer: Scorer


def training_rows(docs: DataFrame, train_rows: int) -> DataFrame:
    """doc_id, votes, x of at most train_rows rows of docs (doc_id, text), whatever their order: the ids of the smallest
    hashes, ties to the smaller id, and of the rows that share one the row with the least votes and features. Ids that
    are null give none."""
    picked = docs.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    schema_x = pa.schema([("doc_id", pa.int64()), ("votes", pa.string()), ("x", pa.binary())])

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for batch in it:
                for doc, text in rows(batch):
                    votes, x = measures((text or "").encode())
                    yield doc, "".join(map(str, votes)), x.astype(np.float16).tobytes()

        yield from batches(out(), schema_x)

    measured_rows = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "text").mapInArrow(measure, "doc_id long, votes string, x binary")  # train_rows ids
    return measured_rows.groupBy("doc_id").agg(F.min(F.struct("votes", "x")).alias("r")).select("doc_id", "r.*")


def learn(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """Accuracies from the votes on all documents; the scorer from at most train_rows of them, see training_rows().

    Null and empty texts vote as the empty text: nothing. Rows with a null id vote, but train no scorer.
    """
    docs = id_text(documents, id_col, text_col)
    k = len(LABELLERS)
    schema = pa.schema([("pattern", pa.string()), ("n", pa.int64())])

    def vote(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in it:
            for _, text in rows(batch):
                key = "".join(map(str, votes_of(measured((text or "").encode())[0])))
                seen[key] = seen.get(key, 0) + 1
        yield from batches(sorted(seen.items()), schema)

    counted = docs.mapInArrow(vote, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # patterns, of which texts show few: at most 3 ** labellers
    accuracies = estimated(np.array([[int(c) for c in r.pattern] for r in counted]).reshape(-1, k), np.array([r.n for r in counted], float))

    sample = training_rows(docs, train_rows).orderBy("doc_id").collect()  # train_rows at most
    if not sample:
        return Model(accuracies, Scorer(np.zeros(BUCKETS, np.float32), 0.0, np.ones(BUCKETS, np.float32)))
    y = accuracies.posterior(np.array([[int(c) for c in r.votes] for r in sample]).reshape(-1, k)).astype(np.float32)
    return Model(accuracies, fitted(np.frombuffer(b"".join(bytes(r.x) for r in sample), np.float16).reshape(len(sample), BUCKETS).astype(np.float32), y))


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: better), posterior (of the votes alone), votes (array<string>, labeller:vote).

    A null or empty text is scored as the empty text. Null ids and repeated rows stay: one row out for each row in.
    Narrow: no shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("posterior", pa.float64()), ("votes", pa.list_(pa.string()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for batch in it:
                for k, text in rows(batch):
                    votes, x = measures((text or "").encode())
                    yield k, model.scorer.score(x), float(model.accuracies.posterior(np.array([votes]))[0]), [f"{name}:{'bad' if v == BAD else 'good'}" for name, v in zip(LABELLERS, votes, strict=True) if v != NONE]

        yield from batches(out(), schema)

    return id_text(documents, id_col, text_col).mapInArrow(run, "doc_id long, score double, posterior double, votes array<string>")
