"""The pipeline's stages one after another against what each is for, and the guard around the optional parts."""

import hashlib
import itertools
import random
import re
import subprocess
import sys

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from corpusmill.llm import decontaminate, secret_scan, toxicity
from corpusmill.llm.common import crc_mod, table


def components(sets, least):
    """Smallest id that links reach, by all pairs."""
    label = {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    return label


def word_sets(docs, k):
    out = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def test_run_equals_brute_force(spark, sf):
    """Each stage over all documents by loops: scores of single texts, all pairs of sets, all items against all texts, one text's findings, the library."""
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    labels = table(spark, sf, "labels").filter(crc_mod(F.col("doc_id"), 3) != 1)
    model = toxicity.learn(table(spark, sf, "documents"), labels)
    matcher = toxicity.Matcher(model.lexicon, model.exceptions)
    docs = {k: t for k, t in docs.items() if toxicity.probability(model.curve, toxicity.features(matcher.hits(toxicity.folded(t)), len(t))) < 0.7}
    label = components(word_sets(docs, 5), 80)
    docs = {k: t for k, t in docs.items() if label[k] == k}
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    docs = {k: t for k, t in docs.items() if not any(holds(t, item) for item in items)}
    found = {k: {} for k in docs}
    rows = spark.createDataFrame([(r.doc_id, docs[r.doc_id], r.source) for r in table(spark, sf, "documents").collect() if r.doc_id in docs], "doc_id long, text string, source string")
    for r in secret_scan.scan(rows).collect():
        found[r.doc_id][r.start - 1] = (r.candidate, r.is_secret)
    for k, places in found.items():
        secrets = {c for c, bad in places.values() if bad}
        for at, (c, _) in sorted(places.items(), reverse=True):
            if c in secrets:
                docs[k] = docs[k][:at] + "[SECRET]" + docs[k][at + len(c) :]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {k: (",".join(map(str, ids)), hashlib.sha256(lib.decode(ids).encode()).hexdigest()) for k, ids in ((k, lib.encode(t)) for k, t in docs.items())}
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in out.collect()}
    assert got == want and len(got) == out.count()


def holds(text, item):
    """Whether a text holds an item: the whole text aligned with it, where they share three words in a row."""
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    a, b = words(item), words(text)
    if len(a) < 5 or not {tuple(a[k : k + 3]) for k in range(len(a) - 2)} & {tuple(b[k : k + 3]) for k in range(len(b) - 2)}:
        return False
    number = {w: k for k, w in enumerate(set(a) | set(b))}
    return decontaminate.align(np.array([number[w] for w in a]), np.array([number[w] for w in b]))[0] >= decontaminate.THRESHOLD * 2 * len(a)


def test_stages_keep_columns(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == table(spark, sf, "documents").columns


def shingles(t, k):
    w = t.split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def similarity(a, b, k):
    return len(shingles(a, k) & shingles(b, k)) / len(shingles(a, k) | shingles(b, k))


def test_near_duplicates_are_those_of_five_words(spark, sf):
    r = random.Random(8)
    docs = {}
    for g in range(12):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([8, 60, 90, 150, 900]))]
        for _ in range(r.choice([1, 4, 8])):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, 3, len(base) // 40])):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
            docs[len(docs)] = " ".join(own)
    label = {k: k for k in docs}
    missed = 0
    for a, b in itertools.combinations(docs, 2):
        if similarity(docs[a], docs[b], 5) >= 0.8:
            missed += similarity(docs[a], docs[b], 3) < 0.9
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    assert missed
    left = corpus_pipeline.no_near_duplicates(spark, spark.createDataFrame(list(docs.items()), "doc_id long, text string"), sf)
    assert sorted(x.doc_id for x in left.collect()) == sorted(set(label.values()))


def test_names_of_queries():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_rest_imports_without_the_optional_parts():
    code = "import sys; sys.modules['corpusmill.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'doc_count' in e.queries() and 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__spark_entry__.__file__.rsplit("/", 1)[0], check=False).returncode == 0
