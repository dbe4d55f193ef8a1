"""Relevance of a text to a query, from 0 to 1: phrases, words, near words, related words and intents.

relevance() is the whole score, as an Arrow function over two columns. phrase_score() and word_hits() are its
exact arms as built-in columns, for plans that need no near words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import lexicon as L
from .distance import edit_distance, remember
from .text import AB

NEAR_WORDS = 30  #: words of the text that a query word is held against
_SPLIT = re.compile(r"[^A-Za-z0-9_\s]")
_PROJECT = re.compile(r"projet\s+personnel|projets\s+personnels|project\s+personnel|projects\s+personnels")
_PROJECT_LOOSE = re.compile(r"(?i)projet\s+personn?el|projets\s+personn?els|project\s+personnel|projects\s+personnels")
_CONTEXT_TIME = re.compile(r"jours?\s+\d+|de\s+\d+h\d+|à\s+\d+h\d+")


@lru_cache(4096)
def query_words(query: str) -> list[str]:
    """ASCII words of two or more characters that are no stop words; without any, the cleaned query as one."""
    clean = _SPLIT.sub(" ", query.lower())
    return [w for w in clean.split() if len(w) > 1 and w not in L.STOP_WORDS] or [clean.strip()]


@lru_cache(4096)
def word_pattern(word: str) -> re.Pattern:
    return re.compile(rf"\b{re.escape(word)}\b", re.ASCII)


@lru_cache(16)
def words_of(low: str) -> tuple[frozenset[str], dict[str, list[tuple[str, frozenset[str]]]], dict[tuple[str, bool], tuple[float, float]]]:
    """A text's ASCII words, the first NEAR_WORDS of them for each first letter, and the weights of query words so far;
    one text meets many queries in a row, and queries share words."""
    words = _SPLIT.sub(" ", low).split()
    by_letter: dict[str, list[tuple[str, frozenset[str]]]] = {}
    for w in words:
        if len(w) > 1 and w not in L.STOP_WORDS and len(held := by_letter.setdefault(w[0], [])) < NEAR_WORDS:
            held.append((w, frozenset(w)))
    return frozenset(words), by_letter, {}


def near_word(word: str, low: str) -> float | None:
    """Likeness of the first near word of the text: 0 stands for one that contains the other; None if there is none."""
    letters = frozenset(word)
    for other, others in words_of(low)[1].get(word[0], ()):
        longest, gap = max(len(word), len(other)), abs(len(word) - len(other))
        if gap > 0.5 * longest:
            continue
        if word in other or other in word:
            return 0.0
        most = int(0.25 * longest)  # edits that a near word may take; letters that only one has cost one each
        if gap <= most and len(letters - others) <= most and len(others - letters) <= most and (likeness := 1 - edit_distance(word, other) / longest) >= 0.75:
            return likeness
    return None


def prepare(queries: Iterable[str], texts: Iterable[str]) -> None:
    """Counts the edit distances that the near words of these queries in these texts need, all at once."""
    own = {w for q in queries for w in query_words(q)}
    remember(own, {o for t in texts for held in words_of(t.lower())[1].values() for o, _ in held}, 0.25)


@lru_cache(4096)
def phrases(low_query: str, project: bool) -> list[str]:
    out = list(L.PROJECT_PHRASES) if project else list(L.STAFF_PHRASES) if "personnel" in low_query else []
    for triggers, group in L.KEY_PHRASES:
        if any(t in low_query for t in triggers):
            out += group
    return out


def word_weight(word: str, low: str, project: bool) -> tuple[float, float]:
    """What one query word adds to the exact and to the partial matches."""
    active, common = word in L.ACTIVITY_WORDS, word in L.COMMON_WORDS
    if project and word in ("personnel", "personnels"):
        return (2.0 if _PROJECT.search(low) else 0.1), 0.0
    if word in words_of(low)[0] or (" " in word and word_pattern(word).search(low)):
        return (3.0 if active else 0.3 if common else 1.0), 0.0
    if len(word) <= 2 or common:
        return 0.0, 0.1 * (word in low)
    if (likeness := near_word(word, low)) is not None:
        return 0.0, (1.5 if active else 0.5 * likeness) if likeness else (1.2 if active else 0.4)
    if word == "directice":
        return (1.5, 0.0) if word_pattern("directrice").search(low) else (0.0, 0.7 * ("directrice" in low or "directice" in low))
    if word == "project" and project:
        return 2.0 * bool(re.search(r"projet\s+personnel|project\s+personnel", low)), 0.0
    return 0.0, 0.3 * (word in low)


def word_matches(words: list[str], low: str, project: bool) -> tuple[float, float]:
    """Weights of exact and of partial word matches."""
    exact = partial = 0.0
    known = words_of(low)[2]
    for word in words:
        if (own := known.get((word, project))) is None:
            own = known[word, project] = word_weight(word, low, project)
        exact += own[0]
        partial += own[1]
    return exact, partial


def related_matches(words: list[str], low: str) -> int:
    n = 0
    for word in words:
        n += any(word_pattern(r).search(low) for r in L.RELATED.get(word, ()))
        n += word in ("directice", "directrice") and bool(re.search("directr?ice", low))
    return n


def activity_bonus(low_query: str, low: str) -> float:
    """For a named activity: its place in the text and what stands around it; else for activities in general."""
    if not any(t in low_query for t in L.ACTIVITY_INTENT):
        return 0.0
    named = next((a for a in L.ACTIVITIES if a in low_query), None) or (m[1] if (m := re.search(rf"\b({L.ACTIVITIES_LOOSE})\b", low_query, re.ASCII)) else None)
    if named and (at := re.search(re.sub(r"\s+", r"[\\s-]+", named), low)):
        around = low[max(0, at.start() - 150) : at.start() + 300]
        return 1.0 + 0.4 * ("responsable" in around) + 0.3 * bool(_CONTEXT_TIME.search(around))
    return 0.2 * bool(re.search("responsable.*activité|activité.*responsable", low)) + 0.15 * bool(re.search(r"(?:bazar|expo|science|vert|robotique|improvisation).*\d{4}[-–]\d{4}", low))


@lru_cache(64)
def intent_pattern(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.I)


@lru_cache(4096)
def intents(low_query: str) -> list[tuple[re.Pattern, float, float]]:
    """The rules that a query sets off."""
    rules = [*L.INTENTS, *L.INTENTS_STAFF]
    if "projet personnel" not in low_query:
        rules += L.INTENTS_BUT_PROJECT
        if "projets personnels" not in low_query:
            rules += L.INTENTS_STAFF
    return [(intent_pattern(pattern), bonus, most) for triggers, pattern, bonus, most in rules if any(t in low_query for t in triggers)]


def project_bonus(text: str) -> float:
    """For a text that names personal projects, and more for one that has them as a heading."""
    if "proje" not in text.lower():
        return 0.0
    return 1.0 * bool(_PROJECT_LOOSE.search(text)) + 0.2 * bool(re.search(r"(?:\A|\n)(?:projet\s+personnel|projets\s+personnels)", text.lower().strip()))


def intent_bonus(low_query: str, text: str, project: bool) -> float:
    total = 0.0
    for p, bonus, most in intents(low_query):
        total += min(bonus * (sum(1 for _ in p.finditer(text)) if most > bonus else bool(p.search(text))), most)
    return total + project_bonus(text) if project else total


def relevance_of(query: str, text: str) -> float:
    low_query, low = query.lower(), text.lower()
    project = any(p in low_query for p in L.PROJECT)
    words = query_words(query)
    exact, partial = word_matches(words, low, project)
    said = sum(p in low for p in phrases(low_query, project))
    related = related_matches(words, low)
    bonus = intent_bonus(low_query, text, project) + activity_bonus(low_query, low)
    n = max(len(words), 1)
    if project and _PROJECT.search(low):
        return min(bonus + 0.3 + 0.1 * (0.8 * exact + 0.2 * partial) / n, 1.0)
    if project:
        return min(bonus + 0.2 * (low_query in low) + min(0.15 * said, 0.2) + 0.1 * (0.6 * exact + 0.15 * partial) / n + min(0.03 * related, 0.03), 0.4)
    return min(bonus + 0.3 * (low_query in low) + min(0.2 * said, 0.25) + 0.15 * (0.8 * exact + 0.2 * partial) / n + min(0.05 * related, 0.05), 1.0)


def plain_relevance_of(query: str, text: str) -> float:
    """phrase_score() and word_hits() together, to nine places."""
    words, low = query_words(query), text.lower()
    own = words_of(low)[0]
    hits = sum(w in own or (" " in w and f" {w} " in f" {' '.join(_SPLIT.sub(' ', low).split())} ") for w in words)
    return round(0.3 * (query.lower() in low) + 0.15 * 0.8 * hits / max(len(words), 1), 9)


@F.pandas_udf(DoubleType())
def relevance(query: pd.Series, text: pd.Series) -> pd.Series:
    """The whole score; a null on either side scores 0."""
    prepare(query.dropna().unique(), text.dropna().unique())
    return pd.Series([0.0 if q is None or t is None else relevance_of(q, t) for q, t in zip(query, text, strict=True)])


def words_column(query: Column) -> Column:
    """query_words(), built in."""
    clean = F.regexp_replace(F.lower(query), r"[^A-Za-z0-9_\s]", " ")
    words = F.filter(F.split(clean, r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*L.STOP_WORDS))
    return F.when(F.size(words) == 0, F.array(F.trim(clean))).otherwise(words)


def phrase_score(query: Column, text: Column) -> Column:
    return F.when(F.contains(F.lower(text), F.lower(query)), 0.3).otherwise(0.0)


def padded_words(text: Column) -> Column:
    """The ASCII words of a text in lower case, each between spaces; made once a text, before queries meet it."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^A-Za-z0-9_]+", " "), F.lit(" "))


def word_hits(words: Column, padded: Column) -> Column:
    """How many of the words stand in the text (as padded_words()) on ASCII word boundaries."""
    return F.size(F.filter(words, lambda w: F.contains(padded, F.concat(F.lit(" "), w, F.lit(" ")))))


def boundary(query: Column, text: Column) -> Column:
    """Where a text holds the query's longer words: start, end, both, middle or none."""
    low, n = F.lower(text), F.length(text)
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.length(w) > 3)
    edge = F.greatest(F.lit(200), F.floor(n * 0.15).cast("int"))
    count = lambda part: F.size(F.filter(words, lambda w: F.contains(part, w)))
    needed = F.greatest(F.lit(1), F.floor(F.size(words) * 0.3).cast("int"))
    middle_end = F.greatest(edge, n - edge)
    first = count(F.substr(low, F.lit(1), edge)) >= needed
    last = count(F.substr(low, F.greatest(F.lit(1), n - edge + 1), edge)) >= needed
    middle = count(F.substr(low, edge + 1, middle_end - edge)) >= needed
    return F.when(F.size(words) == 0, "none").when(first & last, "both").when(first & ~middle, "start").when(last & ~middle, "end").when(middle, "middle").otherwise("none")
