"""Chunking into overlapping pieces by sections, and splitting by a budget of bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .lexicon import LOWER, UPPER

SIZE, OVERLAP = 1500, 300
MAX_BYTES = 409_600
TRUNCATED = "\n\n[Content truncated - see chunks for full text]"

SPACE = re.compile(r"\s*")
_HEADING_STRICT = re.compile(f"[{UPPER}][{UPPER}\\s:]+\\Z")
_MEMBERS = re.compile("membres (?:du|de la|élèves)", re.I)
_ITEM = re.compile(f"[-•*]\\s|[{UPPER}][{LOWER}]+,\\s|[{UPPER}][{LOWER}]+\\s+[{UPPER}]")
_YEARS = re.compile(r"\d{4}[-–]\d{4}")
_CELL = re.compile(f"\\|\\s*[A-Z]|\\t[A-Z]|[{UPPER}][{LOWER}]+.*\\d{{4}}")


def units(sections: list[str]) -> list[tuple[str, bool]]:
    """Sections, with a heading and the list or table rows below it as one; the flag says which."""
    out, k = [], 0
    while k < len(sections):
        head = sections[k]
        k += 1
        heading = _HEADING_STRICT.match(head) or _MEMBERS.match(head)
        if not (heading and k < len(sections) and _ITEM.match(sections[k])):
            out.append((head, False))
            continue
        rows = [head]
        while k < len(sections) and (_ITEM.match(sections[k]) or (_YEARS.search(sections[k]) and _CELL.search(sections[k]))):
            rows.append(sections[k])
            k += 1
        out.append(("\n\n".join(rows), True))
    return out


def tail(done: str, overlap: int, is_list: bool) -> str:
    """What of a finished chunk opens the next: after the first sentence end in its last characters; for plain
    sections else after a paragraph break, else after the first white space that leads to a word."""
    if overlap <= 0 or len(done) <= overlap:
        return ""
    end = done[-overlap:]
    if m := re.search(r"[.!?]\s+", end):
        return end[m.end() :]
    if not is_list:
        if (at := end.find("\n\n")) >= 0:
            return end[at + 2 :]
        if (m := re.search(r"\s+[A-Za-z0-9_]", end)) and m.start() > 0:
            return end[m.start() + 1 :]
    return ""


def chunk(text: str, size: int = SIZE, overlap: int = OVERLAP, separator: str = r"\n\s*\n") -> list[str]:
    """Sections packed into chunks of about size characters; a section is never cut."""
    sections = [s for s in (x.strip() for x in re.split(separator, text)) if s]
    if not sections:
        return [text.strip()]
    out, held = [], ""
    for unit, is_list in units(sections):
        if held and len(held) + 2 + len(unit) > size:
            out.append(held.strip())
            kept = tail(held, overlap, is_list)
            found = kept or (overlap > 0 and len(held) > overlap and re.search(r"[.!?]\s+\Z", held[-overlap:]))
            held = f"{kept}\n\n{unit}" if found else unit
        else:
            held = f"{held}\n\n{unit}" if held else unit
    if held.strip():
        out.append(held.strip())
    return out or [text.strip()]


def pieces(text: str, most: int) -> Iterator[str]:
    """Pieces of at most `most` UTF-8 bytes, cut after a paragraph, a line or a sentence near half of it, else there.

    Each step looks at the next `most` characters at most: the work grows with the text, and a caller may stop early.
    """
    at, end, left = 0, len(text), len(text.encode())  # left: bytes of text[at:end]
    near = most // 2
    while at < end:
        if left <= most:
            yield text[at:end]
            return
        cut = 0
        for mark in ("\n\n", "\n", ". "):
            found = text.rfind(mark, at, min(at + near + len(mark), end)) - at
            if found > near / 4:
                cut = found + len(mark)
                break
        cut = min(cut or near, end - at)
        if len(text[at : at + cut].encode()) > most:
            cut = len(text[at : at + most].encode()[:most].decode(errors="ignore"))
        cut = cut or 1  # a budget below one character: the piece is over it
        yield text[at : at + cut]
        if at == 0:
            bare = len(text.rstrip())  # what follows a piece is stripped
            left, end = left - len(text[bare:end].encode()), bare
        start = SPACE.match(text, at + cut, end).end() if at + cut < end else end
        left -= len(text[at:start].encode())
        at = start


def byte_pieces(text: str, most: int) -> list[str]:
    return list(pieces(text, most)) or [text]


def chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP, separator: str = r"\n\s*\n") -> Column:
    @F.pandas_udf(ArrayType(StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else chunk(t, size, overlap, separator))

    return run(text)


def split_bytes(text: Column, most: int) -> Column:
    """Texts within the budget stay in the JVM's hands: only longer ones are cut."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else byte_pieces(t, most))

    return run(text)


def first_bytes(text: Column, most: int) -> Column:
    """The first piece of a text; what follows is not cut."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else next(pieces(t, most), t))

    return run(text)


def sections(text: Column, separator: str = r"\n\s*\n") -> Column:
    """The sections that chunking packs, built in."""
    return F.filter(F.transform(F.split(text, separator), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def chunk_table(documents: DataFrame, separator: str = r"\n\s*\n", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """text, source, index, pdf_url: the chunks of documents (source_id, content, pdf_url)."""
    return documents.select(F.posexplode(chunks("content", size, overlap, separator)).alias("index", "text"), F.col("source_id").alias("source"), "pdf_url").select("text", "source", "index", "pdf_url")


def capped(text: Column, most: int = MAX_BYTES) -> Column:
    """A document over the budget keeps its first piece and a note."""
    return F.when(F.octet_length(text) > most, F.concat(first_bytes(text, most - 200), F.lit(TRUNCATED))).otherwise(text)


def cut_chunks(chunked: DataFrame, most: int) -> DataFrame:
    """document_id, chunk_index, piece, text of chunks, oversized ones in pieces."""
    return chunked.select("document_id", "chunk_index", F.posexplode(F.when(F.octet_length("text") <= most, F.array("text")).otherwise(split_bytes("text", most))).alias("piece", "text"))


def skipped_pieces(chunked: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """document_id, chunk_index, size, chars of the pieces that split_chunks() drops."""
    return cut_chunks(chunked, most).filter(F.octet_length("text") > most).select("document_id", "chunk_index", F.octet_length("text").alias("size"), F.length("text").alias("chars"))


def split_chunks(chunked: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """(document_id, chunk_index, text) with oversized chunks split and every document's chunks numbered anew.

    Pieces still over the budget are dropped; skipped_pieces() reports them. The numbers come from a window over a document's chunks.
    """
    from pyspark.sql import Window as W

    pieces = cut_chunks(chunked, most).filter(F.octet_length("text") <= most)
    number = F.row_number().over(W.partitionBy("document_id").orderBy("chunk_index", "piece")) - 1
    return pieces.select("document_id", number.cast("int").alias("chunk_index"), "text")
