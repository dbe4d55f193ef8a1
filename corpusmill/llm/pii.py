"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans. Base spans (email, ip, card, phone by fixed patterns) always
stay. Further candidates (national phone numbers, written-out emails, IBANs, social security numbers, IPv6
addresses, birth dates) are judged by boosted trees over features of format and context; a calibrated threshold
for each kind selects those to redact. The trees are trained here on labelled candidates made from a seeded rule.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, id_text, rows

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "national_phone", "written_email", "iban", "ssn", "ipv6", "birth_date")

#: The base patterns. Possessive runs and look-behinds only spare retries that cannot succeed.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

GENERATORS = {
    "national_phone": re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})?(?![0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9-])"),
    "ipv6": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::|[0-9A-Fa-f]{1,4})(?:[0-9A-Fa-f:]{0,20})(?![0-9A-Fa-f:])"),
    "birth_date": re.compile(r"(?<![0-9])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9])"),
}
_WRITTEN = re.compile(r"\s{0,2}[\[({]\s?(?:at|AT)\s?[\])}]\s{0,2}(?=([A-Za-z0-9-]+(?:\s?(?:\.|[\[({]\s?(?:dot|DOT)\s?[\])}])\s?[A-Za-z0-9-]+)+))")
_WRITTEN_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")

#: Words near a span that speak for its kind.
CONTEXT = {
    "national_phone": ("phone", "tel", "call", "mobile", "fax", "cell", "contact", "téléphone", "telefon", "teléfono"),
    "written_email": ("mail", "contact", "write", "reach", "address"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "ipv6": ("ip", "ipv6", "host", "address", "server"),
    "birth_date": ("born", "birth", "dob", "geboren", "né", "née", "nacido", "nacida"),
}
#: Words that speak against.
AGAINST = ("version", "isbn", "page", "figure", "order", "invoice", "part", "serial", "model", "build", "release", "updated", "published")
WINDOW = 40  #: characters of context on each side
_WORDS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches: the run of local characters before an at sign, and a domain after it."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
            at = text.find("@", floor)
        else:
            floor = at + 1  # an at sign is in no run of local characters
            at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):  # a part may have any number of leading zeros
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans of the further kinds, without judgement; they may overlap each other and base spans."""
    out = [(kind, *m.span()) for kind, p in GENERATORS.items() if kind != "ipv6" or ":" in text for m in p.finditer(text)]
    for m in _WRITTEN.finditer(text) if re.search(r"[\[({]", text) else ():
        if local := _WRITTEN_LOCAL.search(text[max(0, m.start() - 64) : m.start()]):
            out.append(("written_email", m.start() - (local.end() - local.start()), m.end(1)))
    return out


def iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s = text[start:end]
    before, after = text[max(0, start - WINDOW) : start].lower(), text[end : end + WINDOW].lower()
    near, far = set(_WORDS.findall(before)), set(_WORDS.findall(after))
    digits = [c for c in s if c.isdigit()]
    last = _WORDS.findall(before)[-1:]
    words = CONTEXT[kind]
    return [
        float(KINDS.index(kind)), float(len(s)), float(len(digits)), float(sum(c.isalpha() for c in s)), float(sum(c in " .-/()" for c in s)),
        float(len(set(digits))), float(any(w in near for w in words)), float(any(w in far for w in words)), float(bool(last) and last[0] in words),
        float(any(w in near for w in AGAINST)), float(bool(last) and last[0] in AGAINST), float(before[-1:] in ("#", "$", "=", "_", "/")), float(after[:1] in ("%", "_", "/", "=", "x")),
        float(kind == "iban" and iban_valid(s)), float(kind == "ssn" and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[-4:] != "0000"),
        float("(" in s), float(s.count(":")), float(len(set(s)) / max(len(s), 1)), float(kind == "birth_date" and 1900 <= int(re.search(r"(19|20)\d\d", s)[0]) <= 2020),
    ]


@dataclass
class Boosted:
    """Trees as (feature, threshold, left, right, value) arrays, a bias, and a threshold for each kind."""

    trees: list[list[tuple[int, float, int, int, float]]]
    bias: float
    thresholds: dict[str, float]

    def probability(self, x: list[float]) -> float:
        z = self.bias
        for tree in self.trees:
            k = 0
            while (node := tree[k])[0] >= 0:
                k = node[2] if x[node[0]] <= node[1] else node[3]
            z += node[4]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def grown(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> list[tuple[int, float, int, int, float]]:
    """One tree by second-order gain over quantile cuts."""
    tree: list = []

    def node(own: np.ndarray, depth: int) -> int:
        k = len(tree)
        tree.append(None)
        total_g, total_h = g[own].sum(), h[own].sum()
        best = (1e-3, -1, 0.0)
        if depth:
            for f in range(x.shape[1]):
                v = x[own, f]
                for cut in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 12), method="lower")):
                    left = v <= cut
                    if 8 <= left.sum() <= len(own) - 8:
                        gl, hl = g[own][left].sum(), h[own][left].sum()
                        gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                        if gain > best[0]:
                            best = float(gain), f, float(cut)
        if best[1] < 0:
            tree[k] = (-1, 0.0, 0, 0, float(-rate * total_g / (total_h + 1)))
        else:
            left = x[own, best[1]] <= best[2]
            a, b = node(own[left], depth - 1), node(own[~left], depth - 1)
            tree[k] = (best[1], best[2], a, b, 0.0)
        return k

    node(np.arange(len(x)), depth)
    return tree


def boosted(x: np.ndarray, y: np.ndarray, kinds: list[str], rounds: int = 30, depth: int = 3, rate: float = 0.3, precision: float = 0.95) -> Boosted:
    """Logistic gradient boosting on two thirds; thresholds on the rest: the lowest that reaches the precision for its kind."""
    held = np.arange(len(x)) % 3 == 2
    p0 = y[~held].mean()
    model = Boosted([], float(np.log(p0 / (1 - p0))), {})
    z = np.full(len(x), model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z[~held]))
        tree = grown(x[~held], p - y[~held], p * (1 - p), depth, rate)
        model.trees.append(tree)
        one = Boosted([tree], 0.0, {})
        z += np.array([math.log(q / (1 - q)) for q in (one.probability(r) for r in x)])
    p = 1 / (1 + np.exp(-z))
    for kind in sorted(set(kinds)):
        own = held & (np.array(kinds) == kind)
        cuts = [t for t in np.unique(p[own]) if y[own & (p >= t)].mean() >= precision]
        model.thresholds[kind] = float(max(0.3, min(cuts))) if cuts else 0.99
    return model


def labelled(seed: int = 7, each: int = 300) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label): candidates from a seeded rule, half personal data and half look-alikes."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(("an", "to", "re", "mi", "le", "ka", "der", "on", "sa")) for _ in range(r.randint(1, 4)))
    filler = lambda: " ".join(word() for _ in range(r.randint(2, 6)))

    def iban(ok: bool) -> str:
        country, account = r.choice(("DE", "FR", "ES", "GB")), d(18)
        check = 98 - int(account + "".join(str(int(c, 36)) for c in country) + "00") % 97
        return f"{country}{(check if ok else (check + r.randint(1, 95)) % 97):02d}{account}"

    made = {
        "national_phone": lambda ok: r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}")) if ok else r.choice((f"{d(3)} {d(3)} {d(3)}", f"{d(2)}.{d(3)}.{d(2)}", f"{d(4)}-{d(3)}-{d(3)}")),
        "written_email": lambda ok: f"{word()}{r.choice(('.', '_', ''))}{word()} {r.choice(('[at]', '(at)'))} {word()} {r.choice(('[dot]', '(dot)'))} {r.choice(('com', 'org', 'net'))}" if ok else f"{word()} (at) {d(2)}.{d(2)}",
        "iban": iban,
        "ssn": lambda ok: f"{r.randint(100, 665)}-{r.randint(10, 99)}-{d(3)}{r.randint(1, 9)}" if ok else f"{r.choice(('000', '666', '9' + d(2)))}-{d(2)}-{d(4)}",
        "ipv6": lambda ok: ":".join(f"{r.randrange(65536):x}" for _ in range(8)) if ok else ":".join(d(2) for _ in range(r.randint(4, 6))),
        "birth_date": lambda ok: f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{r.randint(1930, 2010)}",
    }
    out = []
    for kind, f in made.items():
        n = 0
        while n < 2 * each:
            ok = n % 2 == 0
            lead = r.choice(CONTEXT[kind]) if ok and (kind == "birth_date" or r.random() < 0.8) else r.choice(AGAINST) if r.random() < 0.5 else word()
            head = f"{filler()} {lead}{r.choice((':', '', ' is', ' no.'))} "
            text = f"{head}{f(ok)} {filler()}"
            n += 1
            for k, a, b in candidates(text):
                if k == kind:
                    out.append((text, kind, a, b, int(ok)))
                    break
    r.shuffle(out)
    return out


@lru_cache(1)
def trained() -> Boosted:
    found = labelled()
    x = np.array([features(t, k, a, b) for t, k, a, b, _ in found])
    return boosted(x, np.array([y for *_, y in found], float), [k for _, k, *_ in found])


class Taken:
    """Places that spans cover, as disjoint sorted intervals."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def take(self, a: int, b: int) -> bool:
        """Whether a to b was free; if so, it is taken now."""
        i = bisect.bisect_left(self.starts, b)  # those before i start before b; the last of them ends last
        if i and self.ends[i - 1] > a:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


def spans(text: str, model: Boosted) -> list[tuple[str, int, int, float]]:
    """All chosen spans by start, then kind as listed: base spans, and further ones that clear their threshold
    and touch no base span; of overlapping further ones the likeliest stays, of equally likely ones the first, then
    the first kind as listed."""
    base = base_spans(text)
    chosen = [(k, a, b, 1.0) for k, a, b in base]
    further = [(p, k, a, b) for k, a, b in candidates(text) if (p := model.probability(features(text, k, a, b))) >= model.thresholds.get(k, 0.99)]
    if further:
        taken = Taken((a, b) for _, a, b in base)
        chosen += [(k, a, b, p) for p, k, a, b in sorted(further, key=lambda x: (-x[0], x[2], KINDS.index(x[1]))) if taken.take(a, b)]
    return sorted(chosen, key=lambda x: (x[1], KINDS.index(x[0])))


def find(df: DataFrame, model: Boosted | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, score>>, redacted: personal data in each whole text.

    Places are code points, end exclusive; base spans have score 1. In redacted each span reads [kind]. A null or
    empty text has no spans; redacted stays null or empty. Null ids and repeated rows stay: one row out for each
    row in. Narrow: no shuffle.
    """
    model = model or trained()
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))), ("redacted", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for batch in it:
                for k, text in rows(batch):
                    found = spans(text or "", model)
                    pieces, at = [], 0
                    for kind, a, b, _ in found:
                        if b > at:
                            pieces += [text[at : max(a, at)], f"[{kind}]"]
                            at = b
                    yield k, [{"kind": kind, "start": a, "end": b, "score": p} for kind, a, b, p in found], "".join([*pieces, text[at:]]) if found else text

        yield from batches(out(), schema)

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>, redacted string")
