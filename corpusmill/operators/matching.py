"""Nearest dictionary words for OCR text, and text files to their PDFs."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import OCR_WORDS
from ..functions.distance import edit_distance

_SPLIT_LETTER = re.compile(r"([A-Za-zÀ-ſ])\s*\(\s*([A-Za-zÀ-ſ]{3,})")
_TOKENS = re.compile(r"(\s+|[^A-Za-z0-9_\sÀ-ſ])")
_ODD = re.compile(r"[a-zà-ſ][A-ZÀ-ſ]")
_ODD_ASCII = re.compile(r"[a-zà-ſ][A-ZÀ-Þ]")
_MARKS = re.compile(r"[^A-Za-z0-9_À-ſ]")


SHORT = 16  #: characters of an entry that is found by deletions; longer ones are found by their parts


def shortened(word: str, most: int) -> set[str]:
    """deletions() of one word."""
    out = last = {word}
    for _ in range(most):
        last = {w[:k] + w[k + 1 :] for w in last for k in range(len(w))}
        out = out | last
    return out


@lru_cache(8)
def neighbourhood(dictionary: tuple[str, ...], most: int) -> tuple[list[str], dict[str, list[int]], list[int]]:
    """A dictionary's words without marks, the places of those of up to SHORT characters by what deletions leave of them, and
    the places of the longer ones."""
    plain = [_MARKS.sub("", entry.lower()) for entry in dictionary]
    by_rest: dict[str, list[int]] = {}
    for k, w in enumerate(plain):
        if len(w) <= SHORT:
            for rest in shortened(w, most):
                by_rest.setdefault(rest, []).append(k)
    return plain, by_rest, [k for k, w in enumerate(plain) if len(w) > SHORT]


@lru_cache(20_000)
def nearest(word: str, dictionary: tuple[str, ...], most: int = 2) -> str | None:
    """The first dictionary word at the least edit distance, up to `most`. Words meet on what deletions leave of both."""
    plain = _MARKS.sub("", word.lower())
    entries, by_rest, long = neighbourhood(dictionary, most)
    near = {k for rest in shortened(plain, most) for k in by_rest.get(rest, ())} if len(plain) <= SHORT + most else set()
    near.update(k for k in long if abs(len(entries[k]) - len(plain)) <= most)
    least, k = min(((edit_distance(plain, entries[k]), k) for k in near), default=(most + 1, -1))
    return dictionary[k] if least <= most else None


def corrected(text: str, dictionary: tuple[str, ...] = OCR_WORDS, accents: bool = True) -> str:
    odd = _ODD if accents else _ODD_ASCII
    text = _SPLIT_LETTER.sub(lambda m: nearest(m[1] + m[2], dictionary) or m[0], text)
    out = []
    for token in _TOKENS.split(text):
        if len(token) > 1 and odd.match(token) and (found := nearest(token, dictionary)):
            token = found[0].upper() + found[1:] if token[0] == token[0].upper() else found
        out.append(token)
    return "".join(out)


def ocr_corrected(text: Column, dictionary: tuple[str, ...] = OCR_WORDS, accents: bool = True) -> Column:
    """accents=False spares words whose second letter has an accent."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else corrected(t, dictionary, accents))

    return run(text)


def deletions(word: Column, most: int) -> Column:
    """A word and all that is left of it after up to `most` characters are deleted."""
    one = lambda w: F.transform(F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    out = last = F.array(word)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, one)))
        out = F.concat(out, last)
    return F.array_distinct(out)


def parts_of(size: Column, most: int) -> Column:
    """Start and length of the most + 1 nearly equal parts of a string of a size."""
    bound = lambda k: F.floor(size * k / (most + 1)).cast("int")
    return F.array(*(F.struct(F.lit(k).alias("part"), (bound(k) + 1).alias("at"), (bound(k + 1) - bound(k)).alias("long")) for k in range(most + 1)))


def nearest_words(words: DataFrame, dictionary: DataFrame, word: str = "word", entry: str = "entry", most: int = 2, short: int = SHORT) -> DataFrame:
    """word, entry, distance: the nearest dictionary entry of each word, built in; the entry settles ties.

    Words and entries meet on strings that both become by up to `most` deletions; of the entries of more than short
    characters, one of most + 1 parts stands in the word, moved by at most `most`. Both are exact: no pair within the
    distance is missed, and words that share but a length never meet. Nulls meet nothing.
    """
    w = words.select(F.col(word).alias("word")).filter("word is not null").distinct()
    d = dictionary.select(F.col(entry).alias("entry")).filter("entry is not null").distinct()
    size = F.length("word")
    little = w.filter(size <= short + most).select("word", F.explode(deletions(F.col("word"), most)).alias("key"))
    little = little.join(d.filter(F.length("entry") <= short).select("entry", F.explode(deletions(F.col("entry"), most)).alias("key")), "key")
    held = d.filter(F.length("entry") > short).select("entry", F.length("entry").alias("size"), F.explode(parts_of(F.length("entry"), most)).alias("p")).select("entry", "size", "p.part", F.expr("substr(entry, p.at, p.long)").alias("key"))
    sought = w.filter(size > short - most).select("word", F.explode(F.sequence(F.greatest(size - most, F.lit(short + 1)), F.greatest(size + most, F.lit(short + 1)))).alias("size"))
    sought = sought.select("word", "size", F.explode(parts_of(F.col("size"), most)).alias("p")).select("word", "size", "p.*", F.explode(F.sequence(F.col("p.at") - most, F.col("p.at") + most)).alias("from"))
    sought = sought.filter("from >= 1 and from + long - 1 <= length(word)").select("word", "size", "part", F.expr("substr(word, from, long)").alias("key")).distinct()
    large = sought.join(held, ["size", "part", "key"]).select("word", "entry")
    near = little.select("word", "entry").unionByName(large).withColumn("distance", F.levenshtein("word", "entry", most)).filter("distance >= 0")
    return near.groupBy("word").agg(F.min(F.struct("distance", "entry")).alias("m")).select("word", "m.entry", "m.distance")


PIECE = 12  #: characters of a part that a join is on


def contains(whole: DataFrame, part: DataFrame) -> DataFrame:
    """Pairs of rows where whole's part contains part's part, other columns of both. The first PIECE characters of a part, or all of
    a shorter one, meet the pieces of the names that are as long: an equality join, then the test. An empty part is in every
    name."""
    size = F.length("part")
    sizes = sorted(r.n for r in part.filter("part is not null").select(F.least(F.lit(PIECE), size).alias("n")).distinct().collect())  # PIECE + 1 numbers at most
    held = whole.filter("part is not null").withColumn("_n", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>"))).filter(F.col("_n") <= size)
    held = held.withColumn("_at", F.explode(F.sequence(F.lit(1), F.when(F.col("_n") == 0, 1).otherwise(size - F.col("_n") + 1))))
    held = held.withColumn("_piece", F.substr(F.col("part"), F.col("_at"), F.col("_n"))).drop("_n", "_at").distinct().withColumnRenamed("part", "_whole")
    sought = part.filter("part is not null").withColumn("_piece", F.substring("part", 1, PIECE))
    return held.join(sought, "_piece").filter(F.contains("_whole", "part")).drop("_piece", "_whole", "part")


def first_match(asked: DataFrame, names: DataFrame, both: bool) -> DataFrame:
    """word, pdf_file: the first PDF of names (part, pdf_file) whose part contains a word of asked (word), or (both) is
    contained in it. Each word is asked once, and of names that are equal the first alone, so texts never meet PDFs."""
    words = asked.filter("word is not null").distinct().select("word", F.col("word").alias("part"))
    own = names.filter("part is not null").groupBy("part").agg(F.min("pdf_file").alias("pdf_file"))
    found = contains(own, words)
    if both:
        found = found.unionByName(contains(words, own), allowMissingColumns=True)
    return found.groupBy("word").agg(F.min("pdf_file").alias("pdf_file"))


def pdf_matches(texts: DataFrame, pdfs: DataFrame, text_file: str = "text_file", pdf_file: str = "pdf_file") -> DataFrame:
    """text_file, pdf_file, strategy: each text's PDF. Names without the last part contain each other; else a word of
    over four characters does; else a PDF's name has a word of over three. The first word, then the first PDF wins.

    Each strategy asks for the first PDF of every distinct head or word, and joins that to the texts.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    stem = F.regexp_replace(F.element_at(F.split(text_file, "/"), -1), r"\.txt$", "")
    t = texts.select(F.col(text_file).alias("text_file"), F.split(stem, "_").alias("parts")).withColumn("head", F.when(F.size("parts") >= 2, F.array_join(F.slice("parts", 1, F.size("parts") - 1), "_")))
    p = pdfs.filter(F.col(pdf_file).endswith(".pdf")).select(F.col(pdf_file).alias("pdf_file"), F.lower(F.regexp_replace(pdf_file, r"\.pdf$", "")).alias("name"))
    plains, stems = p.select("pdf_file", plain(F.col("name")).alias("part")), p.select("pdf_file", F.col("name").alias("part"))
    words = lambda source, most: t.select("text_file", F.posexplode(F.filter(source, lambda w: F.length(w) > most)).alias("word_at", "word")).withColumn("word", F.lower("word"))
    ways = (
        (t.select("text_file", F.lit(0).alias("word_at"), plain(F.col("head")).alias("word")), plains, True),
        (words(F.split("head", "_"), 4), stems, True),
        (words(F.col("parts"), 3), stems, False),
    )
    found = [asked.join(first_match(asked.select("word"), names, both), "word").select("text_file", "pdf_file", F.lit(k).alias("strategy"), "word_at") for k, (asked, names, both) in enumerate(ways, 1)]
    return reduce(DataFrame.unionByName, found).groupBy("text_file").agg(F.min(F.struct("strategy", "word_at", "pdf_file")).alias("m")).select("text_file", "m.pdf_file", "m.strategy")
