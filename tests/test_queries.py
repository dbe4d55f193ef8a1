"""Every query with SQL gives DuckDB's rows; the others those of the functions beneath, row by row."""

import hashlib

import duckdb
import pytest

from corpusmill.functions import chunking, scoring
from corpusmill.operators import html, matching, retrieval
from corpusmill.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(frame, columns):
    def plain(v):
        if v is None or str(v) in ("nan", "<NA>", "NaT"):
            return None
        kind = type(v).__name__
        return round(float(v), 6) if "float" in kind else int(v) if "int" in kind else str(v)

    return sorted(repr([plain(v) for v in r]) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


# Queries without SQL: their rows against the functions that tests hold to literal cases, run here row by row.


def collected(spark, sf, name):
    return sorted(tuple(r) for r in QUERIES[name](spark, sf).collect())


def md5(t):
    return hashlib.md5(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def lines(spark, sf):
    """Chunks as the queries see them: source, index, text, pdf_url."""
    out = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        pdf = f"file://pdfs/{r.source}.pdf" if r.doc_id % 7 == 0 else None
        out += [(f"file://pages/{r.doc_id}", k, t, pdf) for k, t in enumerate(x for x in (y.strip() for y in r.text.split("\n")) if x)]
    return out


@pytest.fixture(scope="module")
def pages(spark, sf):
    return {r.page_id: (r.html, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}


@pytest.fixture(scope="module")
def items(spark, sf):
    return {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}


def test_chunk_pack(spark, sf, docs):
    got = {(r.source, r.chunk_index): (r.size, r.md5) for r in QUERIES["chunk_pack"](spark, sf).collect()}
    assert got == {(f"file://pages/{k}", i): (len(c), md5(c)) for k, t in docs.items() for i, c in enumerate(chunking.chunk(t, separator="\n"))}


def test_byte_split(spark, sf, docs):
    want = [(k, i, len(p.encode()), md5(p)) for k, t in docs.items() for i, p in enumerate([t] if len(t.encode()) <= 4096 else chunking.byte_pieces(t, 4096))]
    assert collected(spark, sf, "byte_split") == sorted(want) and any(i for _, i, *_ in want)


def test_pieces_over_the_budget_are_reported(spark):
    rows = spark.createDataFrame([(1, 0, "ab"), (1, 1, "é"), (2, 0, "xyé")], "document_id long, chunk_index int, text string")
    assert [(r.document_id, r.chunk_index, r.text) for r in chunking.split_chunks(rows, 1).orderBy("document_id", "chunk_index").collect()] == [(1, 0, "a"), (1, 1, "b"), (2, 0, "x"), (2, 1, "y")]
    assert sorted(tuple(r) for r in chunking.skipped_pieces(rows, 1).collect()) == [(1, 1, 2, 1), (2, 0, 2, 1)]


def test_doc_cap(spark, sf, docs):
    want = [(k, len(t.encode()) if len(t.encode()) <= 8192 else len((chunking.byte_pieces(t, 7992)[0] + chunking.TRUNCATED).encode())) for k, t in docs.items()]
    assert collected(spark, sf, "doc_cap") == sorted(want) and any(len(t.encode()) > 8192 for t in docs.values())


def test_page_queries(spark, sf, pages):
    whole = {k: html.extracted(t, u, True) for k, (t, u) in pages.items()}
    bare = {k: html.extracted(t, u, False) for k, (t, u) in pages.items()}
    assert dict(collected(spark, sf, "page_text")) == {k: x["text"] for k, x in whole.items()}
    assert collected(spark, sf, "page_links") == sorted((k, u) for k, x in bare.items() for u in x["links"])
    assert collected(spark, sf, "page_files") == sorted((k, len(x["images"]), sum(u.split("?")[0].lower().endswith((".pdf", ".xls", ".xlsx", ".doc", ".docx", ".ppt", ".pptx", ".txt", ".csv")) for u in x["files"])) for k, x in bare.items())
    assert collected(spark, sf, "crawl_totals") == [(len(bare), sum(len(x["links"]) for x in bare.values()), sum(len(x["files"]) for x in bare.values()), 0)]


def test_ocr_correct(spark, sf, items):
    assert dict(collected(spark, sf, "ocr_correct")) == {k: matching.corrected(f"F (aise pOmme {t}") for k, t in items.items()}


def ranked(lines, query, k=5):
    """The best chunks of a query by the whole relevance, from all chunks, and their scores."""
    scored = sorted(((-scoring.relevance_of(query, t), s, i, t, pdf) for s, i, t, pdf in lines))
    some = [r for r in scored[:k] if r[0] < 0]
    return some or scored[:3]


def edge(query, text):
    """Where a text holds the words of over three characters of a query."""
    words = [w for w in query.lower().split() if len(w) > 3]
    low, size = text.lower(), max(200, int(len(text) * 0.15))
    needed = max(1, int(len(words) * 0.3))
    count = lambda part: sum(w in part for w in words)
    first, last, middle = count(low[:size]) >= needed, count(low[max(0, len(low) - size) :]) >= needed, count(low[size : max(size, len(low) - size)]) >= needed
    return "none" if not words else "both" if first and last else "start" if first and not middle else "end" if last and not middle else "middle" if middle else "none"


def widened(lines, query, k=5):
    by_place = {(s, i): (t, pdf) for s, i, t, pdf in lines}
    out = []
    for score, s, i, t, _ in ranked(lines, query, k):
        if len(out) >= k + 3 or (s, i) in out:
            continue
        at = edge(query, t) if score < 0 else "none"
        before, after = (s, i - 1), (s, i + 1)
        own = [before] * (at in ("start", "both") and before in by_place) + [(s, i)] + [after] * (at in ("end", "both") and after in by_place)
        out += [x for x in own if x not in out]
    return sorted((s, i, *by_place[s, i]) for s, i in out)


def test_neighbour_and_retrieve_context(spark, sf, lines, items):
    want = {k: widened(lines, q) for k, q in items.items()}
    got = collected(spark, sf, "neighbour_context")
    assert got == sorted((k, s, i, len(t)) for k, rows in want.items() for s, i, t, _ in rows)
    texts = {}
    for k, rows in want.items():
        pdfs = list(dict.fromkeys(pdf for *_, pdf in rows if pdf))
        parts = [f"[Context {n}]\n{t}" + (f"\n[Source PDF: {pdf}]" if pdf else "") for n, (_, _, t, pdf) in enumerate(rows, 1)]
        names = [u.replace("file://", "").split("/")[-1] for u in pdfs]
        more = "\n\n---\n\n[PDF Documents disponibles:]\n" + "".join(f"{n}. {x}\n   Lien de téléchargement: /api/pdf/{x}\n" for n, x in enumerate(names, 1))
        whole = "\n\n---\n\n".join(parts) + (more if pdfs else "")
        texts[k] = (len(whole), md5(whole), len(pdfs))
    assert {k: tuple(v) for k, *v in collected(spark, sf, "retrieve_context")} == texts


def test_best_of_equals_all_scores(spark):
    """Null queries and texts, ties, repeated rows, styles and blocks of queries."""
    rows = [("b", 1, "zebra crossing", None), ("a", 2, "zebra crossing", "u"), ("a", 2, "zebra crossing", "u"), ("a", 1, "a zebre", None), ("c", 1, None, None), ("d.css", 1, "zebra crossing", None), (None, None, "zebra crossing", None)]
    chunks = spark.createDataFrame(rows, "source string, index int, text string, pdf_url string").repartition(3)
    asked = spark.createDataFrame([(1, "zebra crossing"), (2, None), (3, "nothing here"), (4, "zebra")], "query_id long, query string")
    plain = lambda df: sorted(((r.query_id, r.rank, r.source, r["index"], round(r.score, 9)) for r in df.collect()), key=str)
    want = plain(retrieval.top_k(retrieval.scored(chunks, asked), 3, ["source", "index"]))
    assert plain(retrieval.best_of(chunks, asked, 3)) == want and len(want) == 12
    assert retrieval.best_of(chunks.limit(0), asked, 3).count() == retrieval.best_of(chunks, asked.limit(0), 3).count() == 0


def test_every_query_is_held_against_something():
    here = set(open(__file__).read().replace("_", "").split('"'))
    assert all(n.replace("_", "") in here or n in SQL for n in QUERIES)


def matched(name, listing):
    """(pdf, strategy) of a text file's name, by a loop over the listing."""
    stems = [(p, p.removesuffix(".pdf").lower()) for p in listing]
    plain = lambda x: "".join(c for c in x.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    parts = name.removesuffix(".txt").split("_")
    if len(parts) >= 2:
        head = plain("_".join(parts[:-1]))
        for p, stem in stems:
            if plain(stem) in head or head in plain(stem):
                return p, 1
        for word in (w.lower() for w in parts[:-1] if len(w) > 4):
            for p, stem in stems:
                if word in stem or stem in word:
                    return p, 2
    for word in (w.lower() for w in parts if len(w) > 3):
        for p, stem in stems:
            if word in stem:
                return p, 3
    return None


def test_fuzzy_match_over_all_items(spark, sf):
    got = {r.item_id: (r.text_file, r.pdf_file, r.strategy) for r in QUERIES["fuzzy_pdf_match_all"](spark, sf).collect()}
    ids = [r.item_id for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id").collect()]
    names = {k: (f"Report_{k}_final_0af.txt", f"Report_{k}_0af.txt", f"item_chapter{k}_0af.txt", f"note{k}.txt")[k % 4] for k in ids}
    listing = sorted((f"report {k} FINAL.pdf", f"report {k}x.pdf", f"chapter{k} plan.pdf", f"my note{k}.pdf")[k % 4] for k in ids)
    assert got == {k: (names[k], *matched(names[k], listing)) for k in ids}
    assert {x[2] for x in got.values()} == {1, 2, 3}
    assert got[1][1] == "report 12 FINAL.pdf"  # the first of those that contain report1


def test_counts_of_hits_equal_all_pairs(spark):
    """Null and empty texts and queries, words said twice, stop words alone, phrases at edges, and no row a pair on the way."""
    texts = ["a red fox ran", "Red FOX, ran!", None, "", "...", "the red", "fox red fox ran on", "xred fox rany", "a b", "é red fox rané", "x a  b"]
    asked = [(1, "red fox ran"), (2, "red red"), (3, None), (4, ""), (5, "a b"), (6, "le fox"), (7, "ran!"), (8, "le"), (9, "red, fox")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, query string")
    words = scoring.words_column(retrieval.F.col("query"))
    pairs = docs.crossJoin(queries).select("query_id", retrieval.F.coalesce(scoring.phrase_score(retrieval.F.col("query"), retrieval.F.col("text")) > 0, retrieval.F.lit(False)), scoring.word_hits(words, scoring.padded_words(retrieval.F.col("text"))), retrieval.F.col("query").isNull())
    want = {}
    for q, phrase, hits, null in pairs.collect():
        key = (q, phrase, None if null else hits)
        want[key] = want.get(key, 0) + 1
    counts = retrieval.hit_counts(docs, queries)
    assert {(r.query_id, r.phrase, r.hits): r.n for r in counts.collect()} == want and sum(want.values()) == len(texts) * len(asked)
    plan = QUERIES["score_phrase_words"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.fixture(scope="module")
def revisited(spark, sf, tmp_path_factory):
    """Pages of which many share an address, some of them within one category, and with DuckDB's view of them."""
    folder = tmp_path_factory.mktemp("revisited")
    url = retrieval.F.expr("case when page_id % 4 = 0 then url else concat('http://h.example/p', cast(page_id % 9 as string)) end")
    spark.read.parquet(f"{sf}/pages.parquet").withColumn("url", url).write.parquet(f"{folder}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", ["page_file_index", "processed_files", "pdf_text_cache", "seen_pages"])
def test_pages_that_share_an_address(spark, revisited, name):
    folder, c = revisited
    got, want = QUERIES[name](spark, folder).toPandas(), c.sql(SQL[name]).df()
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


def test_pages_leave_no_memory_behind(spark):
    """A tree of a page has no cycles, which only a collection would free, and pages come in small batches."""
    import gc

    page = "<body><article><h1>A</h1>" + "<p>paragraph of words <b>bold<li>item of some words</ul></p>" * 50
    html.extracted(page, "http://a.b/", True)
    gc.collect()
    gc.disable()
    try:
        html.extracted(page, "http://a.b/", True)
        assert gc.collect() == 0
    finally:
        gc.enable()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    html.extract(retrieval.F.col("html"), retrieval.F.col("url"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
