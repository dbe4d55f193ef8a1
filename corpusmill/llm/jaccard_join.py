"""Jaccard join of word-shingle sets by token-combination prefixes.

Equal sets are one class. Tokens are ordered by how many sets hold them, rarest first, as counted over all documents
in a table of COUNTERS; the order only affects speed. In it, two sets that link share at least two tokens among their
first |x| - ceil(t |x|) + 2, t the least similarity of a link: the extended prefix. A prefix token that one class alone
has goes at once. The short list of a rare token gives its pairs where it is gathered, and each pair is kept once, however
many lists it is in. Tokens with long lists are indexed by classes of sizes, and those whose lists are long within a class
of sizes in combination with another: a pair that shares no token with a shorter list shares two frequent ones.

A pair has to be allowed by sizes; by the places of the token (what comes before the first shared one differs); and by
parity signatures (a token in one set only turns one bit). Not all pairs that may link are verified. First each class
meets the two of its pairs that are in most pairs, and of its long lists the hubs that most of them name: the classes
whose prefixes are commonest (edited copies surround them) and the smallest. Verified links form components; then
pairs of short lists in different components are verified, and the class with most links is the hub of each long list
that is still open, one whose members are in different components. Only what is left open gives pairs of members of
different components. Links inside a component are implied. Every link is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, chunks, id_text, packed, unpacked, written
from .components import components
from .shingles import names_of, shingle_sets

LEAST, DENOMINATOR = 90, 100  #: similarity from which on two sets link, unless given
COUNTERS = 1 << 22  #: of the order of tokens; a token's counter is an upper bound of its count
PARTS = 1024  #: pieces in which the counters travel
HOT = 4096  #: sets, or four times the mean counter if that is more, from which on a token's list is never gathered in one place
LONG = 64  #: classes up to which a token's list gives its pairs at once; a longer one is split by sizes
SPLIT = 1024  #: members beyond which a part of a split list is combined with another
PARITY = 8  #: words of 64 bits of a parity signature
FINE, FINE_FROM = 64, 1000  #: words of the finer signature, and the set size from which on it is kept
EARLIER = 8  #: tokens before it that a member of a list names, so that two members skip all lists but the first they share
BROADCAST = 1_000_000  #: rows of two ids up to which a side is broadcast; beyond, a shuffle join


def level_of(counts: np.ndarray) -> np.ndarray:
    """Counts up to 32 as they are, above in eighths of a doubling."""
    return np.where(counts < 32, counts, np.minimum(255, 32 + np.floor(8 * np.log2(np.maximum(counts, 32) / 32)))).astype(np.uint8)


def token_levels(docs: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """The level of each counter, over the distinct sets of each task, and the level from which on tokens are hot.

    A task adds its tokens to counters of its own; the sums are taken piece by piece. The driver gets COUNTERS bytes.
    """
    schema = pa.schema([("part", pa.int32()), ("sums", pa.binary())])
    width = COUNTERS // PARTS
    shift = np.uint64(64 - (COUNTERS.bit_length() - 1))

    def piece(part: int, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], schema=schema)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, np.uint32)
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def added() -> None:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            table[at] += n.astype(np.uint32)
            held.clear()

        for chunk in chunks(it):
            for s in shingle_sets([t for _, t in chunk], k):
                if len(s) and (name := names_of(s)[0]) not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(name)
                    held.append((s >> shift).astype(np.uint32))
                    size += len(s)
            if size >= 1_000_000:
                added()
                size = 0
        if held:
            added()
        for part in range(PARTS):
            own = table[part * width : (part + 1) * width]
            if own.any():
                yield piece(part, packed(own))

    def total(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = unpacked(data.as_py(), np.uint32)
                sums[part] = sums[part] + own if part in sums else own.astype(np.uint64)
        for part, own in sums.items():
            yield piece(part, int(own.sum()).to_bytes(8, "little") + level_of(own).tobytes())

    levels, members = np.zeros(COUNTERS, np.uint8), 0
    for r in docs.mapInArrow(count, "part int, sums binary").repartition("part").mapInArrow(total, "part int, sums binary").collect():  # PARTS rows
        members += int.from_bytes(r.sums[:8], "little")
        levels[r.part * width : (r.part + 1) * width] = np.frombuffer(r.sums, np.uint8, offset=8)
    return levels, int(level_of(np.array([max(HOT, 4 * members / COUNTERS)]))[0])


def signature(s: np.ndarray, words: int) -> np.ndarray:
    """Parity of the members in each of 64 * words classes, as signed words."""
    return np.packbits((np.bincount((s % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1).astype(bool)).view(np.int64)


BITS = [f"p{i}" for i in range(PARITY)]
MADE = f"doc_id long, cls long, other long, n int, cold int, weight float, keys array<long>, {', '.join(f'{p} long' for p in BITS)}, fine array<long>"


def prefixes(docs: DataFrame, k: int, shared: Broadcast, hot: int, least: int) -> DataFrame:
    """One row a document: its class with a second name, and, once a task, the class's prefix tokens in order (the first
    cold of them are not hot), how common they are, and signatures."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("cls", pa.int64()), ("other", pa.int64()), ("n", pa.int32()), ("cold", pa.int32()), ("weight", pa.float32()), ("keys", longs), *((p, pa.int64()) for p in BITS), ("fine", longs)])
    shift = np.uint64(64 - (COUNTERS.bit_length() - 1))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        seen: set[int] = set()
        for chunk in chunks(it):
            out = []
            for (doc, _), s in zip(chunk, shingle_sets([t for _, t in chunk], k), strict=True):
                n, (cls, other) = len(s), names_of(s)
                row = [doc, cls, other, n, None, None, None, *[None] * PARITY, None]
                if n and cls not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(cls)
                    level = levels[s >> shift]
                    first = np.argsort(level, kind="stable")[: n - -(-n * least // DENOMINATOR) + 2]
                    row[4:] = int((level[first] < hot).sum()), float(level[first].mean()), s[first].view(np.int64), *signature(s, PARITY).tolist(), signature(s, FINE) if n >= FINE_FROM else None
                out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, MADE)


def may_link(a: str, b: str, least: int) -> Column:
    """Sizes that allow a link."""
    return DENOMINATOR * F.least(a, b) >= least * F.greatest(a, b)


def difference_allows(differ: Column, least: int) -> Column:
    """A least difference of sets of n_a and n_b tokens that allows a link."""
    return (least + DENOMINATOR) * differ <= (DENOMINATOR - least) * (F.col("n_a") + F.col("n_b"))


def bits_differ() -> Column:
    return sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in BITS), F.lit(0))


def signed(classes: DataFrame, x: str) -> DataFrame:
    return classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), *(F.col(p).alias(f"{p}_{x}") for p in BITS))


def keyed(made: DataFrame, least: int) -> DataFrame:
    """(key, cls, n, pos, others): prefix tokens that two classes or more may share. others: in a short list the classes before
    it, by size, that sizes and places allow a link; null in lists that are long or hot.

    The list of a token that is not hot is gathered by its key, since its counter bounds it. A member may share one token
    before this one, of a long list; a pair that shares two of long lists meets there.
    """
    posts = made.filter("keys is not null").select("cls", "n", "cold", F.posexplode("keys").alias("pos", "key"))
    by_key = Window.partitionBy("key")
    cold = posts.filter("pos < cold").withColumn("before", F.lag("cls").over(by_key.orderBy("cls"))).filter("before is null or before <> cls")
    cold = cold.withColumn("m", F.count("*").over(by_key)).filter("m > 1")
    smaller = F.collect_list(F.struct("cls", "n", "pos")).over(by_key.orderBy("n", "cls").rowsBetween(-LONG, -1))  # all, where the list is short
    allows = lambda o: (DENOMINATOR * o["n"] >= least * F.col("n")) & ((least + DENOMINATOR) * (o["pos"] + F.col("pos") - 2) <= (DENOMINATOR - least) * (o["n"] + F.col("n")))
    others = F.transform(F.filter("smaller", allows), lambda o: o["cls"])
    cold = cold.withColumn("smaller", smaller).select("key", "cls", "n", "pos", F.when(F.col("m") <= LONG, others).alias("others"))
    hot = posts.filter("pos >= cold").dropDuplicates(["key", "cls"]).select("key", "cls", "n", "pos", F.lit(None).cast("array<bigint>").alias("others"))
    return cold.filter("others is null or size(others) > 0").unionByName(hot)


def long_lists(listed: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, cls, n, pos, m, hi, lo): members of lists that are long or hot, with the length of the list and its hubs, the class
    of the commonest prefix and the smallest one."""
    members = listed.filter("others is null").select("key", "cls", "n", "pos").join(classes.select("cls", "weight"), "cls")
    ends = members.groupBy("key").agg(F.count("*").alias("m"), F.max(F.struct("weight", "n", "cls")).alias("hi"), F.min(F.struct("n", "cls")).alias("lo"))
    return members.join(ends.filter("m > 1"), "key").select("key", "cls", "n", "pos", "m", F.struct("hi.n", "hi.cls").alias("hi"), "lo")


def nearest_hubs(near: DataFrame) -> DataFrame:
    """Of pairs (a, b), those of each class with the two classes that are in more pairs than it, and in most: (a, b), the hub first."""
    degree = near.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("degree"))
    of = lambda x: degree.select(F.col("cls").alias(x), F.struct("degree", F.col("cls")).alias(f"of_{x}"))
    ends = near.join(of("a"), "a").join(of("b"), "b").select(F.greatest("of_a", "of_b").alias("hub"), F.least("of_a", "of_b").alias("own"))
    ranked = ends.select("hub", F.col("own.cls").alias("b")).withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("hub"))))
    return ranked.filter("rank <= 2").select(F.col("hub.cls").alias("a"), "b")


def crossing(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Of pairs (a, b), those between different components."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    marked = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return marked.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def most_named(met: DataFrame, least: int) -> DataFrame:
    """(a, b, n_a, n_b) of (cls, n, hub): each class with the two hubs that most of its lists name, at sizes that allow a link."""
    met = met.select("cls", "n", F.col("hub.cls").alias("a"), F.col("hub.n").alias("n_a")).filter("cls <> a").filter(may_link("n", "n_a", least))
    ranked = met.groupBy("cls", "n", "a", "n_a").count().withColumn("rank", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("count"), "a")))
    return ranked.filter("rank <= 2").select("a", F.col("cls").alias("b"), "n_a", F.col("n").alias("n_b"))


def open_lists(listed: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings of lists whose members are in different components, with each member's component."""
    few = labels.count() <= BROADCAST
    labels = labels.withColumnRenamed("node", "cls")
    marked = listed.join(F.broadcast(labels) if few else labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    differ = marked.groupBy("key").agg(F.min("label").alias("first"), F.max("label").alias("last")).filter("first <> last").select("key")
    return marked.join(differ, "key")


def apart(members: DataFrame, more: Column, least: int) -> DataFrame:
    """(a, b) of members (key, cls, n, label, place, own, earlier, signature) of one list in different components that the bounds let link.

    Two members with one of their earlier tokens in common meet in its list as well, at lower places, and are left to that one.
    """
    kept = lambda x: ["key", F.col("cls").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "label", "place", "earlier", *BITS))]
    one, two = members.filter("own").select(*kept("a")), members.select(*kept("b")).withColumnRenamed("key", "key_b")
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    return one.join(two, (F.col("key") == F.col("key_b")) & ordered & (F.col("label_a") != F.col("label_b")) & may_link("n_a", "n_b", least) & more & difference_allows(bits_differ(), least) & ~F.arrays_overlap("earlier_a", "earlier_b")).select("a", "b")


def room(n: str, place: str, least: int) -> Column:
    """least times the size of the largest set that may link with one of n tokens, of which those before place are in it only."""
    return DENOMINATOR * F.col(n) - (least + DENOMINATOR) * F.col(place)


def with_partners(members: DataFrame, least: int) -> DataFrame:
    """Of members (key, cls, n, label, place, ...) of lists those that some member of another component could link with, by its
    component's least size and most room in the list. A list whose members are in one component goes as a whole.

    Neither member of a pair that links is missing from the first two lists that the pair shares, however often this is done.
    """
    of = members.groupBy("key", "label").agg(F.min("n").alias("n"), F.max(room("n", "place", least)).alias("room"))
    ends = of.groupBy("key").agg(F.min(F.struct("n", "label")).alias("small"), F.max(F.struct("room", "label")).alias("wide"))
    elsewhere = lambda end, c: F.when(F.col("label") != F.col(f"{end}.label"), F.col(c))
    seconds = of.join(ends, "key").groupBy("key", "small", "wide").agg(F.min(elsewhere("small", "n")).alias("n_second"), F.max(elsewhere("wide", "room")).alias("room_second"))
    n_other = F.coalesce(elsewhere("small", "small.n"), "n_second")
    room_other = F.coalesce(elsewhere("wide", "wide.room"), "room_second")
    return members.join(seconds, "key").filter((room("n", "place", least) >= least * n_other) & (room_other >= least * F.col("n"))).select(*members.columns)


def rest(opened: DataFrame, classes: DataFrame, least: int, keep: Scratch) -> DataFrame:
    """(a, b): pairs from open lists, by tokens in a class of sizes, and by combinations of two where the class is still long."""
    before = Window.partitionBy("cls").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keep.written(opened.withColumn("place", F.col("pos") - F.count("*").over(before)))
    signatures = classes.select("cls", *BITS)
    first_shared = (room("n_a", "place_a", least) >= least * F.col("n_b")) & (room("n_b", "place_b", least) >= least * F.col("n_a"))  # tokens before the first shared one, but those of open lists, are in one set only

    # a pair meets in the class of the smaller one's size: the larger one goes to its own class and to the next lower
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DENOMINATOR / least)) + 1e-9).cast("int")
    both = F.explode(F.array(F.struct(size.alias("size"), F.lit(True).alias("own")), F.struct((size - 1).alias("size"), F.lit(False).alias("own")))).alias("c")
    by_size = ranked.select(F.col("key").alias("token"), "cls", "n", "label", "pos", "place", both).select("*", "c.*").drop("c").withColumn("key", F.xxhash64("token", "size"))
    had, left = None, by_size.count()
    while had is None or 2 * left < had:  # those that go may have been partners of others
        by_size = keep.written(with_partners(by_size, least), "partners")
        had, left = left, by_size.count()
    by_size = keep.written(by_size.join(by_size.groupBy("key").agg(F.count("*").alias("m")), "key"), "by-size")
    last = Window.partitionBy("cls", "size").orderBy("pos").rowsBetween(-EARLIER, -1)
    short = by_size.filter(F.col("m") <= SPLIT).withColumn("earlier", F.collect_list("key").over(last))
    pairs = apart(short.join(signatures, "cls"), first_shared, least)

    # without a token of the other kinds in common, all tokens before the second shared one, but the first, are in one set only
    tokens = by_size.filter(F.col("m") > SPLIT).groupBy("cls", "n", "label", "size", "own").agg(F.sort_array(F.collect_set(F.struct("pos", "token"))).alias("tokens"))  # at most a prefix
    two = tokens.select("*", F.posexplode("tokens").alias("i", "one")).select("*", F.expr("posexplode(slice(tokens, i + 2, size(tokens)))").alias("j", "two"))
    earlier = F.expr(f"array_remove(slice(tokens.token, greatest(i + j + 1 - {EARLIER}, 0) + 1, least(i + j + 1, {EARLIER})), one.token)")  # with any of them, the first of the two makes a lower pair of tokens
    combined = keep.written(two.select(F.xxhash64("one.token", "two.token", "size").alias("key"), "cls", "n", "label", (F.col("two.pos") - 1).alias("place"), "own", earlier.alias("earlier")), "combined")
    differ = combined.groupBy("key").agg(F.min("label").alias("first"), F.max("label").alias("last")).filter("first <> last").select("key")
    return pairs.union(apart(combined.join(differ, "key").join(signatures, "cls"), first_shared, least)).distinct()


def finer(pairs: DataFrame, classes: DataFrame, fines: DataFrame, least: int) -> DataFrame:
    """Of pairs (a, b), those whose finer signatures, where both have one, allow a link."""
    of = lambda x: fines.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("fine").alias(f"fine_{x}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    differ = F.aggregate(F.zip_with("fine_a", "fine_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return joined.filter(F.col("fine_a").isNull() | F.col("fine_b").isNull() | difference_allows(differ, least)).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, fines: DataFrame, k: int, least: int, keep: Scratch) -> DataFrame:
    """Of pairs of classes, those that link, by the whole sets of their first documents. A text goes to its pair from where
    it is read, as long as the pairs are few enough to broadcast."""
    first = classes.select("cls", "doc_id")
    pairs = keep.written(finer(pairs, classes, fines, least).join(first.withColumnsRenamed({"cls": "b", "doc_id": "doc_b"}), "b").select("a", "b", "doc_b"), "pairs")
    hubs = keep.written(pairs.select(F.col("a").alias("cls")).distinct().join(first, "cls").select(F.col("cls").alias("a"), "doc_id"), "hubs")
    few = pairs.count() <= BROADCAST
    to = lambda side: F.broadcast(side) if few else side
    members = docs.join(to(pairs.withColumnRenamed("doc_b", "doc_id")), "doc_id").select("a", "b", F.col("text").alias("text_b"))
    texts = docs.join(to(hubs), "doc_id").select("a", F.col("text").alias("text_a"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}
        for batch in it:
            links = []
            for i in range(batch.num_rows):
                sets = []
                for j in (0, 1):
                    c = batch.column(j)[i].as_py()
                    if c not in last:
                        if len(last) > 256:
                            last.clear()
                        s = next(shingle_sets([batch.column(j + 2)[i].as_py()], k))
                        if names_of(s)[0] != c:  # another row of the same id
                            continue
                        last[c] = s
                    sets.append(last[c])
                if len(sets) == 2:
                    both = len(np.intersect1d(*sets, assume_unique=True))
                    if DENOMINATOR * both >= least * (len(sets[0]) + len(sets[1]) - both):
                        links.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(j).take(pa.array(links, pa.int64())) for j in (0, 1)], schema=schema)

    return keep.written(members.join(texts, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "links")


@dataclass
class Joined:
    documents: DataFrame  #: doc_id, n_shingles, cls, component_id
    links: DataFrame  #: a, b: verified links between classes; they connect each component
    classes: DataFrame  #: cls, doc_id: each class and its smallest document


def join(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, least: int = LEAST) -> Joined:
    """Components of documents whose sets of k-word shingles have a Jaccard similarity of least hundredths or more.

    Null and empty texts, and those without words, have no shingles and link with nothing (component: their own
    id). A row with a null id keeps a null component and takes no part. Repeated rows of one id are one node; where
    their texts differ, each text is a set of that id. Of equal counts, sizes and hubs, the smaller name goes first;
    that changes no component. An empty table gives an empty one. The three results are written tables in the
    folder of spark.checkpoint.dir; everything in between is deleted.
    """
    docs = id_text(documents, id_col, text_col)
    known = docs.filter("doc_id is not null")
    keep = Scratch(documents.sparkSession)
    levels, hot = token_levels(known, k)
    shared = documents.sparkSession.sparkContext.broadcast(levels)  # COUNTERS bytes
    made = keep.written(prefixes(known, k, shared, hot, least), "made")
    shared.destroy()
    del levels
    nodes = made.select("doc_id", "cls", "n")
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    same = F.when(F.min("other") == F.max("other"), F.min("doc_id")).otherwise(F.raise_error(F.lit("two sets have one name")))
    classes = written(made.filter("n > 0").groupBy("cls").agg(same.alias("doc_id"), first("n"), first("weight"), *map(first, BITS)), "classes")
    fines = keep.written(made.filter("fine is not null").select("cls", "n", "fine").dropDuplicates(["cls"]), "fines")
    listed = keep.written(keyed(made, least), "listed")

    def near(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those whose signatures allow a link."""
        return pairs.select("a", "b").join(signed(classes, "b"), "b").join(signed(classes, "a"), "a").filter(difference_allows(bits_differ(), least)).select("a", "b")

    def met(pairs: DataFrame) -> DataFrame:
        """Links among pairs of classes."""
        return verified(pairs.distinct(), known, classes, fines, k, least, keep)

    short = listed.filter("others is not null").select(F.explode("others").alias("a"), F.col("cls").alias("b")).distinct()
    short = keep.written(near(short), "short")
    long = keep.written(long_lists(listed, classes), "long")
    links = met(nearest_hubs(short).union(near(most_named(long.select("cls", "n", F.explode(F.array("hi", "lo")).alias("hub")), least))))
    labels = keep.written(components(links, scratch=keep), "labels")

    # the class with most links so far is the next hub of each open list
    degree = links.select(F.col("a").alias("cls")).union(links.select("b")).groupBy("cls").agg(F.count("*").alias("degree"))
    opened = keep.written(open_lists(long.drop("hi", "lo"), labels).join(degree, "cls", "left").fillna(0, ["degree"]), "open")
    hubs = opened.groupBy("key").agg(F.max(F.struct("degree", "n", "cls", "label")).alias("hub"))
    second = most_named(opened.join(hubs, "key").filter(F.col("hub.label") != F.col("label")).select("cls", "n", F.struct("hub.n", "hub.cls").alias("hub")), least)
    links = links.unionByName(met(crossing(short, labels).union(near(second))))
    labels = keep.written(components(links, scratch=keep), "labels")

    opened = open_lists(opened.drop("label", "degree"), labels)
    links = links.unionByName(verified(rest(opened, classes, least, keep), known, classes, fines, k, least, keep))
    labels = components(links, scratch=keep)

    linked = classes.select("cls", "doc_id").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    lowest = linked.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_class = linked.join(lowest, "label").select("cls", "component_id")
    placed = nodes.join(by_class, "cls", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cls")).alias("cls"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = Joined(written(placed.unionByName(without_id(docs.filter("doc_id is null"), k)), "documents"), written(links.distinct(), "links"), classes.select("cls", "doc_id"))
    keep.close()
    return out


def without_id(docs: DataFrame, k: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64()), ("component_id", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(it):
            none = pa.nulls(len(chunk), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array([len(s) for s in shingle_sets([t for _, t in chunk], k)], pa.int64()), none, none], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, cls long, component_id long")


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, least: int = LEAST) -> DataFrame:
    """documents, all columns, with one document of each component: that with the smallest id.

    Null, empty and wordless texts link with nothing and stay, as do rows with a null id and repeated rows of the id
    that stays. An empty table gives an empty one. Columns may have any names.
    """
    placed = join(documents, id_col, text_col, k, least).documents
    gone = "".join(sorted({"dropped", *documents.columns}, key=len)[-1:]) + "_"  # longer than any column's name
    dropped = written(placed.filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct(), "dropped")
    few = dropped.count() <= BROADCAST
    return documents.join(F.broadcast(dropped) if few else dropped, documents[id_col] == F.col(gone), "left_anti")
