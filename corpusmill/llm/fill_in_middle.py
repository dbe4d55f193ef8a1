"""Fill-in-middle texts by escaped marker injection, in SQL functions alone.

A text's delimiter is escaped, regexp_replace appends the delimiter after every unit, its count is the number of units,
and substring_index takes the units of a rank range out; then delimiters go and the escape is undone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITER, ESCAPE = "\x1f", "\x1e"
LINES = r"[^\n]*\n|[^\n]+"  #: units: lines with their line feeds


@dataclass(frozen=True)
class Markers:
    """Strings that stand before the three parts. Each starts with a character that it holds nowhere else, so that a
    text without markers can't make one together with a marker's end."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        own = (self.prefix, self.suffix, self.middle)
        if len(set(own)) < 3 or not all(own) or len({m[0] for m in own}) > 1 or any(m[0] in m[1:] for m in own) or any(a != b and a in b for a in own for b in own):
            raise ValueError("markers differ, start with one character that is in them once, and none holds another")


def escaped(text: Column) -> Column:
    """text without DELIMITER: ESCAPE becomes ESCAPE e, DELIMITER becomes ESCAPE d."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}e")), F.lit(DELIMITER), F.lit(f"{ESCAPE}d"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(f"{ESCAPE}d"), F.lit(DELIMITER)), F.lit(f"{ESCAPE}e"), F.lit(ESCAPE))


def delimited(text: Column, unit: str = LINES) -> Column:
    """text, escaped, with DELIMITER after every match of unit; what no match covers joins the unit that follows."""
    return F.regexp_replace(escaped(text), unit, f"$0{DELIMITER}")


def count_of(marked: Column) -> Column:
    return (F.length(marked) - F.length(F.replace(marked, F.lit(DELIMITER), F.lit("")))).cast("long")


def cut(marked: str, count: str) -> Column:
    return F.expr(f"substring_index({marked}, '{DELIMITER}', cast({count} as int))")


def bare(part: Column) -> Column:
    return unescaped(F.replace(part, F.lit(DELIMITER), F.lit("")))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """h1 to h4: the first four groups of eight digits of the hex sha256 of seed:doc_id; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 7, rate: int = 100, spm_rate: int = 50, unit: str = LINES, markers: Markers = Markers()
) -> DataFrame:
    """doc_id, text, n, form, prefix, middle, suffix, output: every text, of which rate in a hundred take the
    fill-in-middle form, and of these spm_rate in a hundred the form with the suffix first (spm, else psm).

    The two cuts are drawn from the id among the n + 1 places between n units. A text that is empty or holds a marker
    stays plain, and its parts are null. A null text counts as empty; a null id draws as the empty one; rows that share an
    id draw alike; extra columns are not read. Narrow: no shuffle, no Python.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    drawn = docs.select("doc_id", "text", *(h.alias(f"_h{k}") for k, h in enumerate(draws(F.col("doc_id"), seed), 1)), delimited(F.col("text"), unit).alias("_marked"))
    counted = drawn.withColumn("n", count_of(F.col("_marked")))
    one, two = F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)
    plain = (F.col("text") == "") | (F.col("_h3") % 100 >= rate)
    for m in (markers.prefix, markers.suffix, markers.middle):
        plain = plain | F.contains("text", F.lit(m))
    placed = counted.withColumns({"_a": F.least(one, two), "_b": F.greatest(one, two), "form": F.when(plain, "plain").when(F.col("_h4") % 100 < spm_rate, "spm").otherwise("psm")})
    part = lambda x: F.when(F.col("form") != "plain", bare(x))
    parts = placed.withColumn("_first", cut("_marked", "_b")).select(
        "doc_id", "text", "n", "form", part(cut("_marked", "_a")).alias("prefix"),
        part(cut("_first", "_a - _b")).alias("middle"), part(cut("_marked", "_b - n - 1")).alias("suffix"),
    )
    p, s, m = F.lit(markers.prefix), F.lit(markers.suffix), F.lit(markers.middle)
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    return parts.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm))


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text that transform() had, from its output and form alone."""
    p, s, m = markers.prefix, markers.suffix, markers.middle
    before, after = (lambda x, mark: F.substring_index(x, mark, 1)), (lambda x, mark: F.substring_index(x, mark, -1))
    psm = F.concat(before(after(output, p), s), after(output, m), before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), after(output, m), before(after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
