"""Column functions over text: predicates, labels, clean-up and reply parsing, all built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

#: Word boundary between ASCII word characters, whatever the letters around it.
AB = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sanitize(c: Column) -> Column:
    """Without control characters but tab, line feed and carriage return."""
    return F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")


def quotient(n: Column, d: int) -> Column:
    """n / d in whole numbers, rounded down, of a long that is not negative."""
    return ((n - n % d) / d).cast("long")


def decimal_label(size: Column, unit: int, places: int) -> Column:
    """size / unit with so many decimals, halves rounded up; in whole numbers throughout, so that no tie is lost."""
    scale = 10**places
    n = quotient(size.cast("long") * (2 * scale) + unit, 2 * unit)
    return F.concat(quotient(n, scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), places, "0")) if places else n.cast("string")


def size_label(size: Column) -> Column:
    """A number of bytes: B, KB with one decimal or MB with two."""
    return F.when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit(" B"))).when(size < 1048576, F.concat(decimal_label(size, 1024, 1), F.lit(" KB"))).otherwise(F.concat(decimal_label(size, 1048576, 2), F.lit(" MB")))


def text_size_label(c: Column) -> Column:
    """A text's bytes (B, whole KB, or MB with two decimals) and characters, these with commas from a KB on."""
    size, chars = F.octet_length(c), F.length(c)
    many = F.concat(F.format_number(chars, 0), F.lit(" chars"))
    small = F.concat(size.cast("string"), F.lit("B / "), chars.cast("string"), F.lit(" chars"))
    return F.when(size < 1024, small).when(size < 1048576, F.concat(decimal_label(size, 1024, 0), F.lit("KB / "), many)).otherwise(F.concat(decimal_label(size, 1048576, 2), F.lit("MB / "), many))


def is_non_content(source: Column, text: Column) -> Column:
    """Style sheets and scripts, by name or by what the text starts with; without a source never."""
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 200))
    by_text = (F.regexp_count(head, F.lit("[{;}]")) > 10) | head.contains("@charset") | head.contains("@media") | head.startswith("@")
    return F.when(F.coalesce(source, F.lit("")) == "", F.lit(False)).otherwise(any_of(F.lower(source), L.NON_CONTENT_SOURCES) | by_text)


def language_vote(c: Column) -> Column:
    """'en' if strictly more English hints (at most two count) than French ones occur as substrings."""
    low = F.lower(c)
    hits = lambda words: F.least(F.lit(2), sum((low.contains(w).cast("int") for w in words), F.lit(0)))
    return F.when(hits(L.ENGLISH_HINTS) > hits(L.FRENCH_HINTS), "en").otherwise("fr")


def message(language: Column, kind: str) -> Column:
    return F.when(language == "en", L.MESSAGES["en"][kind]).otherwise(L.MESSAGES["fr"][kind])


def with_general(subjects: Column) -> Column:
    """general joins a list that lacks it; three are kept."""
    return F.slice(F.when(F.array_contains(subjects, "general"), subjects).otherwise(F.array_append(subjects, "general")), 1, 3)


def keyword_subjects(query: Column) -> Column:
    """Up to three subjects by keyword; [general, other] without any. A pattern is only tried on texts that hold one of its words as a
    string, or a letter that lower case does not bring to that of a word but that patterns without case take for it. The lambdas
    make the text in lower case and the hits once."""

    def hits(low: Column) -> Column:
        tried = lambda words: any_of(low, tuple(words.split("|"))) | any_of(low, tuple("ſıİK"))
        return F.array_compact(F.array(*(F.when(tried(words) & low.rlike(f"(?iu){AB}(?:{words}){AB}"), subject) for subject, words in L.SUBJECT_WORDS)))

    named = lambda found: F.when(F.size(found) == 0, F.array(F.lit("general"), F.lit("other"))).otherwise(with_general(found))
    return F.element_at(F.transform(F.transform(F.array(F.lower(query)), hits), named), 1)


def needs_translation(query: Column) -> Column:
    return any_of(F.lower(query), L.TRANSLATE_HINTS) | (query.rlike(r"^[A-Za-z\s?]+$") & (F.length(query) < 100))


def reply_subject(reply: Column) -> Column:
    """Subject of a model's JSON reply, bare or within prose; unreadable or unknown gives general, under 0.5 low_confidence."""
    schema = "category string, confidence double"
    whole, inner = F.from_json(reply, schema), F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), schema)
    parsed = F.when(strip(reply).startswith("{") & whole["category"].isNotNull(), whole).otherwise(inner)
    category = strip(F.lower(parsed["category"]))
    return F.when(~F.coalesce(category.isin(*L.SUBJECTS), F.lit(False)), "general").when(F.coalesce(parsed["confidence"], F.lit(1.0)) < 0.5, "low_confidence").otherwise(category)


def reply_subjects(reply: Column, query: Column) -> Column:
    """Subjects of a comma-separated reply; without any, those of the query's keywords."""
    named = F.filter(F.transform(F.split(F.lower(strip(reply)), ","), strip), lambda x: x.isin(*(s for s in L.SUBJECTS if s != "low_confidence")))
    return F.when(F.size(named) == 0, keyword_subjects(query)).otherwise(with_general(named))


def query_subjects(query: Column, *replies: Column) -> Column:
    """Subjects of a query by the first provider that replied; a provider that failed gives null. Without a reply, by keywords."""
    return reply_subjects(F.coalesce(*replies, F.lit("")), query) if replies else keyword_subjects(query)


def cleaned_expansion(expansion: Column) -> Column:
    """Without quotes at the ends and a leading label."""
    c = strip(F.regexp_replace(strip(expansion), "^[\"']|[\"']$", ""))
    return strip(F.regexp_replace(c, r"(?i)^(?:output|terms|expansion)[:\s]+", ""))


def expanded(query: Column, expansion: Column) -> Column:
    """query, and the expansion where it says more."""
    c = F.coalesce(cleaned_expansion(expansion), F.lit(""))
    return F.when((c != "") & (c != query), strip(F.concat_ws(" ", query, c))).otherwise(query)


def expanded_and_translated(query: Column, translated: Column, terms: Column) -> Column:
    """Original, translation where it differs, and terms."""
    return F.concat_ws(" ", query, F.when((translated != "") & (translated != query), translated), F.when(cleaned_expansion(terms) != "", cleaned_expansion(terms)))


_LETTER = r"a-zA-ZÀ-ſ"


def is_suspicious(word: Column, accents: bool = True) -> Column:
    """Looks like an OCR fault. accents=False: an accented second letter alone does not count."""
    w = F.regexp_replace(word, r"^[^\wÀ-ſ]+|[^\wÀ-ſ]+$", "")
    second = r"[A-ZÀ-ſ]" if accents else r"[A-ZÀ-Þ]"
    inner = f"[{_LETTER}]\\s*\\([^)]*\\)\\s*[{_LETTER}]|[{_LETTER}]\\s+[{_LETTER}]|[{_LETTER}][^\\w\\u00C0-\\u017F]+[{_LETTER}]|^[a-z\\u00E0-\\u017F]{second}"
    return (F.length(w) >= 2) & w.rlike(inner)


def normalized_word(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"[^\wÀ-ſ]", "")


def retry_delay_ms(message: Column) -> Column:
    """Milliseconds that an error asks to wait, and one second more; null if it does not say."""
    s = F.regexp_extract(message, r"(?i)please retry in ([\d.]+)s", 1)
    return F.when(s != "", F.ceil(s.try_cast("double") * 1000) + 1000).cast("long")


def is_rate_limit(message: Column) -> Column:
    return message.rlike("429|quota|rate limit")


def link_spans(c: Column) -> Column:
    """Links in an answer, and the text that stands for each."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(/api/pdf/[^\s)]+|https?://[^\s)]+)"), F.lit(1)), lambda u: F.struct(u.alias("url"), F.when(u.startswith("/api/pdf/"), F.replace(u, F.lit("/api/pdf/"), F.lit(""))).otherwise(u).alias("label")))


def url_filename(url: Column, extension: str = ".txt") -> Column:
    """Safe file name of a URL: its path, cut, and the start of its md5."""
    path = F.try_parse_url(url, F.lit("PATH"))
    name = F.substring(F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), "^/", ""), "[^A-Za-z0-9_-]", "_"), 1, 200)
    whole = F.concat(F.when(name == "", "index").otherwise(name), F.lit("_"), F.substring(F.md5(url), 1, 8), F.lit(extension))
    return F.when(F.try_parse_url(url, F.lit("HOST")).isNull(), F.concat(F.lit("file_"), F.substring(F.md5(url), 1, 16), F.lit(extension))).otherwise(whole)


def upload_folder(key: Column, name: Column) -> Column:
    low = F.lower(name)
    return F.when(key.contains("pdf-texts"), "pdf-texts").when(key.contains("pages"), "pages").when(key.contains("external"), "external").when(low.contains("pdf") | low.rlike(r"_[a-f0-9]+\.txt$"), "pdf-texts").otherwise("pages")


def safe_name(key: Column, name: Column) -> Column:
    return F.regexp_replace(F.when(key.contains("/"), F.coalesce(F.nullif(F.element_at(F.split(key, "/"), -1), F.lit("")), name)).otherwise(name), "[^A-Za-z0-9._-]", "_")


def servable_pdf(name: Column) -> Column:
    return name.endswith(".pdf") & ~name.contains("..") & ~name.contains("/")


def normalized_url(url: Column) -> Column:
    """Without fragment; an address without a path gets one."""
    bare = F.regexp_replace(url, "#.*$", "")
    return F.when(bare.rlike(r"^https?://[^/?]+$"), F.concat(bare, F.lit("/"))).otherwise(bare)


def file_type(url: Column) -> Column:
    """pdf, excel, the ending of another document, or null."""
    path = F.lower(F.try_parse_url(url, F.lit("PATH")))
    return F.when(path.endswith(".pdf"), "pdf").when(path.rlike(r"\.xlsx?$"), "excel").when(path.rlike(r"\.(doc|docx|ppt|pptx|txt|csv)$"), F.regexp_extract(path, r"\.([a-z]+)$", 1))


def cache_key(path: Column, modified_ms: Column, size: Column) -> Column:
    return F.md5(F.concat_ws(":", path, modified_ms.cast("string"), size.cast("string")))


def joined_pages(pages: Column) -> Column:
    """Pages of a PDF as one text."""
    return F.array_join(F.transform(pages, lambda p, i: F.concat(F.lit("[Page "), (i + 1).cast("string"), F.lit("]\n"), p)), "\n\n---\n\n")
