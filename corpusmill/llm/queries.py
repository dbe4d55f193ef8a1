"""The queries of this subpackage: thin contracts over the operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio_columns, decontaminate, fill_in_middle, importance, jaccard_join, language_id, packing, pii, secret_scan, suffix_dedup, toxicity, weak_quality
from .common import crc_mod, table
from .sentencepiece_codec import encode

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def with_sql(sql: str) -> Callable[[Callable], Callable]:
    """A query with the DuckDB SQL that gives the same rows."""

    def keep(f: Callable) -> Callable:
        ORACLE_SQL[f.__name__] = sql
        return query(f)

    return keep


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ids_as_text=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(documents, labels.filter(crc_mod(F.col("doc_id"), 3) != 1))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("hits").alias("n_hits"))


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    found = language_id.identify(documents, language_id.learn(documents.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), F.col("lang").alias("lang_pred"), "score", F.size("spans").alias("n_spans"))


@query
def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = audio_columns.media_columns(table(spark, sf_dir, "documents"))
    size = F.length("payload")
    return media.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.col("payload").substr(size - 15, F.lit(16))).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.concat_ws(";", "summary", F.concat(F.lit("tensors="), F.sha2("tensors", 256))).alias("feature"),
    )


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents")).drop("redacted")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).documents.select("doc_id", "n_shingles", "component_id")


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = weak_quality.score(documents, weak_quality.learn(documents))
    return scored.select("doc_id", "score", "posterior", (F.col("score") >= 0.5).alias("keep"), F.size("votes").alias("n_votes"))


_DRAWS = ", ".join(f"('0x' || substr(sha256('7:' || doc_id), {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))


@with_sql(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_DRAWS} FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS units FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM f""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(fill_in_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_UTF8 = "flatten(list_transform(string_split(gram, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] WHEN ord(c) < 2048 THEN [192 | (ord(c) >> 6), 128 | (ord(c) & 63)] WHEN ord(c) < 65536 THEN [224 | (ord(c) >> 12), 128 | ((ord(c) >> 6) & 63), 128 | (ord(c) & 63)] ELSE [240 | (ord(c) >> 18), 128 | ((ord(c) >> 12) & 63), 128 | ((ord(c) >> 6) & 63), 128 | (ord(c) & 63)] END))"
#: crc32 bit by bit: each byte enters at the first of eight steps
_BUCKET = f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform({_UTF8}, lambda b: [b::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295) % 10000"


@with_sql(f"""WITH texts AS (SELECT 's' AS side, doc_id, {_WORDS} AS ws FROM documents UNION ALL SELECT 't', NULL, {_WORDS} FROM benchmark),
ids AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM texts),
w AS (SELECT rid, side, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM ids),
l AS (SELECT rid, side, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
g AS MATERIALIZED (SELECT rid, side, unnest([a, a || ' ' || b, a || ' ' || b || ' ' || c]) AS gram FROM l),
k AS MATERIALIZED (SELECT gram, {_BUCKET} AS bucket FROM (SELECT DISTINCT gram FROM g WHERE gram IS NOT NULL)),
f AS MATERIALIZED (SELECT g.rid, g.side, k.bucket, count(*) AS n FROM g JOIN k USING (gram) GROUP BY ALL),
n AS (SELECT coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM f),
b AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM f GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((b.t + 1) * (n.s + 10000) / ((b.s + 1) * (n.t + 10000))))::BIGINT AS gain FROM b, n),
d AS (SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN gain USING (bucket) WHERE side = 's' GROUP BY rid),
e AS (SELECT doc_id, len(ws) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || left(sha256('42:' || doc_id), 8))::BIGINT AS h FROM ids LEFT JOIN d USING (rid) WHERE side = 's'),
x AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score, words >= 20 AS able FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, (SELECT count(*) FROM x WHERE able) * 5 // 100 AS drawn FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= drawn THEN place END AS rank FROM r""")
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
