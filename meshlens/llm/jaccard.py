"""N-gram Jaccard join with a prefix tree, and the groups that its links make.

A document is the set of its distinct ``SIZE``-word shingles (the whole sequence if it has fewer
words), as 64-bit hashes. Two documents link when ``100 * |A & B| >= 80 * |A | B|``. A document
without words links with nothing. Documents with equal sets are one class, which takes part once.

All sets follow one global order: shingles that many documents have come last (found by counting
all shingles in a fixed number of counters), otherwise by hash. By the prefix principle, linked
sets share shingles among their first ones; classes that share too few there are done. The others
meet by shared shingle, not in all pairs: first every class is compared with one class per
shingle, links are contracted to groups, and only classes of different groups are compared further,
until no two groups that share a shingle are left unchecked.

A comparison sends one class and a block of at most ``BLOCK`` others to a task. The block's sets form
a prefix tree: in lexical order, sets share the path up to their common prefix, and the overlap
counted along it; a path is left as soon as what remains of either set can't reach the bound.

NULL texts have no words. Rows that repeat stay rows; NULL ids are never the smallest id of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.llm.common import hottest, join_spread, parts, plain_words, stored

SIZE = 5
#: Similarity in hundredths.
SAME = 80
#: Hundredths of a set that a linked one shares among its first shingles.
SPARE = 10
#: Bits, as a power of two, of the bitmap that rules out shingles of one class.
MOST_BITS = 28
#: Bits of a key below the number of shingles that a class has for itself.
KEY_BITS = 53
#: Which of equally good classes a round compares with: bits that are turned over for it.
TURNS = (0, 0x15555555555555, 0x0CCCCCCCCCCCCC)
#: Counters that find common shingles, whatever the size of the input.
COUNTERS = 1 << 20
SLICES = 64
#: Sets compared with one other in one task, and shingles of these sets together (but for a single longer set).
BLOCK = 512
BLOCK_SHINGLES = 1 << 18
#: Classes with which a class is compared in a star round.
BEST_HUBS = 3
#: Classes a task remembers, so that it sends the first shingles of copies once.
MOST_SEEN = 1 << 16
#: Rounds that compare with one class a shingle, before all that is left is compared; 3 at most.
STARS = 1
#: So many ids at most are sent to all executors; more are joined by shuffle.
SENT_IDS = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending."""
    import xxhash

    own = plain_words(text)
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    width = min(size, len(own))
    out = np.full(len(own) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * _MULTIPLIER + h[k : len(h) - width + 1 + k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(44)).astype(np.int64)


def common_counters(texts: DataFrame, size: int) -> np.ndarray:
    """Which counters hold a shingle of far more documents than the average counter has."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in parts(batches):
            found = [counter(shingles(t, size)) for t in batch.column(0).to_pylist()]
            np.add.at(total, np.concatenate(found), 1)
        slices = [p.astype("<u4").tobytes() for p in np.split(total, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(slices, pa.binary())], names=["slice", "counts"])

    def summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS // SLICES, np.int64)
        for batch in batches:
            for c in batch.column("counts").to_pylist():
                total += np.frombuffer(c, "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])

    rows = (
        texts.mapInArrow(counted, "slice int, counts binary")
        .groupBy("slice")
        .applyInArrow(summed, "slice int, counts binary")
    )
    total = np.zeros(COUNTERS, np.int64)
    for r in rows.collect():  # COUNTERS numbers in all
        at = r["slice"] * (COUNTERS // SLICES)
        total[at : at + COUNTERS // SLICES] = np.frombuffer(r.counts, np.int64)
    mean = total.sum() / COUNTERS
    return total > mean + 6 * np.sqrt(mean) + 50


def ordered(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Ascending hashes in the global order: common ones last."""
    late = common[counter(tokens)]
    return np.concatenate((tokens[~late], tokens[late]))


def class_of(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    import xxhash

    digest = xxhash.xxh3_128_digest(tokens.tobytes())
    a, b = np.frombuffer(digest, "<i8").tolist()
    return a, b


def least(n: int) -> int:
    """The smallest overlap of a set of ``n`` with any set it links to."""
    return (n * SAME + 99) // 100


def first_of(n: int) -> int:
    """So many first shingles that linked sets share ``SPARE`` hundredths of the smaller one there."""
    return n - least(n) + (n * SPARE + 99) // 100


def documents(docs: DataFrame, doc_id: str, text: str, size: int, sent) -> DataFrame:
    """A row per document: id, class, number of shingles; and its first ones, once per task."""
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, k1 long, k2 long, n long, first array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in parts(batches):
            rows = []
            for t in batch.column(1).to_pylist():
                tokens = shingles(t, size)
                n, key = len(tokens), class_of(tokens)
                first = []
                if n and key not in seen:
                    if len(seen) >= MOST_SEEN:
                        seen.clear()  # a class that is sent again does no harm
                    seen.add(key)
                    first = ordered(tokens, sent.value)[: first_of(n)].view(np.int64)
                rows.append((*key, n, first))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "k1", "k2", "n", "first"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def alike(found: DataFrame) -> DataFrame:
    """Classes that share enough of their first shingles with others to have a link.

    ``room``: so many of a class's shingles at most are shared with any other class.
    """
    first = found.select("k1", F.explode("first").alias("token"))
    shared = first.groupBy("token").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low != high")
    shared = stored(shared.select("token"), "jaccard-shared")
    # a class may stand there once for each task that met it: count each shingle once
    few = likely(found, shared).join(shared, "token", "left_semi").distinct()
    counted = few.groupBy("k1", "k2", "n").agg(F.count("*").alias("shared"))
    enough = counted.where(f"shared * 100 >= n * {SPARE * SAME // 100}")
    room = F.expr(f"(n * {SAME} + 99) div 100 - (n * {SPARE} + 99) div 100 + shared")  # n - first_of(n) + shared
    return enough.select("k1", "k2", "n", room.alias("room"))


def likely(found: DataFrame, shared: DataFrame) -> DataFrame:
    """``k1, k2, n, token`` of the first shingles that a bitmap of bounded size doesn't rule out."""
    bits = min(MOST_BITS, max(16, (16 * shared.count()).bit_length()))
    slices = 1 << 6
    shift = np.uint64(64 - bits)

    def marked(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((1 << bits) // slices, bool)
        for batch in batches:
            at = batch.column("token").to_numpy(zero_copy_only=False).view(np.uint64) >> shift
            own[(at & np.uint64(len(own) - 1)).astype(np.int64)] = True
        arrays = [pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(own).tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["slice", "bits"])

    slice_of = F.shiftrightunsigned("token", 64 - 6).alias("slice")
    rows = shared.select("token", slice_of).groupBy("slice").applyInArrow(marked, "slice long, bits binary")
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    size = len(bitmap) // slices
    for r in rows.collect():  # 2 ** MOST_BITS bits in all
        bitmap[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r.bits, np.uint8)
    sent = found.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column("first")
            tokens = first.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), first.value_lengths().to_numpy(zero_copy_only=False))
            at = (tokens.view(np.uint64) >> shift).astype(np.int64)
            keep = (sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            rows = pa.array(row[keep])
            arrays = [batch.column(c).take(rows) for c in ("k1", "k2", "n")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(tokens[keep])], names=["k1", "k2", "n", "token"])

    return found.select("k1", "k2", "n", "first").mapInArrow(run, "k1 long, k2 long, n long, token long")


def sets(docs: DataFrame, doc_id: str, text: str, size: int, sent, found: DataFrame, few: DataFrame) -> DataFrame:
    """Whole sets of the classes in ``few``: ``key, k1, k2, n, room, tokens`` in the global order.

    Keys are numbers given as the table is written, and so fixed from then on. The fewer shingles
    a class has for itself, the smaller its key: such classes are good ones to compare with.
    """
    own = found.where("n > 0").join(few, ["k1", "k2", "n"])
    ids = own.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.max("room").alias("room"))
    ids = stored(ids, "jaccard-ids")
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["id"])).select("k1", "k2", "room", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = []
            for k1, k2, room, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = shingles(t, size)
                if class_of(tokens) == (k1, k2):  # rows that repeat an id may have other texts
                    rows.append((k1, k2, len(tokens), room, ordered(tokens, sent.value).tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "n", "room", "tokens"])

    made = texts.mapInArrow(run, "k1 long, k2 long, n long, room long, tokens binary").dropDuplicates(["k1", "k2"])
    alone = F.shiftleft(F.least(F.col("n") - F.col("room"), F.lit(1023)), KEY_BITS)
    return stored(made.withColumn("key", alone + F.monotonically_increasing_id()), "jaccard-sets")


def postings(whole: DataFrame) -> DataFrame:
    """``token, key, n, room`` for the first shingles of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            n = np.array(batch.column("n").to_pylist(), np.int64)
            first = [np.frombuffer(t, np.int64)[: first_of(k)] for t, k in zip(batch.column("tokens").to_pylist(), n.tolist(), strict=True)]
            row = pa.array(np.repeat(np.arange(len(n)), [len(f) for f in first]))
            arrays = [batch.column(c).take(row) for c in ("key", "n", "room")]
            tokens = pa.array(np.concatenate(first) if first else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([tokens, *arrays], names=["token", "key", "n", "room"])

    return whole.select("key", "n", "room", "tokens").mapInArrow(run, "token long, key long, n long, room long")


def overlap_links(query: np.ndarray, others: list[tuple[int, np.ndarray]]) -> list[int]:
    """Keys of the sets that link with ``query``, by one walk over the prefix tree of ``others``.

    Sets are in the global order. Sorted by it, each shares the path of its predecessor up to their
    common prefix; ``counted`` holds the overlap with ``query`` along that path.
    """
    universe = np.unique(np.concatenate([query, *(t for _, t in others)]))
    inside = np.zeros(len(universe), bool)
    inside[np.searchsorted(universe, query)] = True
    # Big-endian numbers: bytes sort as the paths do.
    paths = sorted((np.searchsorted(universe, t).astype(">u4").tobytes(), key) for key, t in others)
    links = []
    before = np.zeros(0, np.int64)
    counted = np.zeros(1, np.int64)  # overlap after 0, 1, ... steps of the path before
    for packed, key in paths:
        path = np.frombuffer(packed, ">u4").astype(np.int64)
        n = len(path)
        need = -(-SAME * (n + len(query)) // (100 + SAME))
        share = 0
        known = min(len(counted) - 1, len(before), n)
        if known:
            differ = np.nonzero(path[:known] != before[:known])[0]
            share = int(differ[0]) if len(differ) else known
        steps = np.arange(share + 1)
        got = counted[: share + 1]
        rest = np.minimum(n - steps, len(query) - got)
        if (got + rest < need).any():
            counted, before = got, path  # the whole subtree below is out of reach for this length
            continue
        at = share
        while at < n:
            stop = min(n, at + 128)
            more = got[-1] + np.cumsum(inside[path[at:stop]])
            got = np.concatenate((got, more))
            at = stop
            if got[-1] + min(n - at, len(query) - got[-1]) < need:
                break
        counted, before = got, path
        if at == n and got[-1] >= need:
            links.append(key)
    return links


def verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """Of the pairs (``hub, key, n``), those that link, as ``a, b``."""
    salt = F.xxhash64("key")
    size = pairs.groupBy("hub").agg(F.count("*").alias("n"), F.sum("n").alias("shingles"))
    size = stored(size, "jaccard-hubs")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("blocks")
    dealt = join_spread(pairs.select("hub", "key"), size.select("hub", blocks), ["hub"], hottest(size, ["hub"]))
    dealt = dealt.withColumn("block", F.pmod(salt, F.col("blocks")).cast("int"))
    hubs = dealt.select("hub", "block").distinct().select("hub", "block", F.col("hub").alias("key"))
    members = dealt.select("hub", "block", "key").unionByName(hubs)
    rows = members.join(whole.select("key", "tokens"), "key")

    def compare(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = group[0].as_py()
        query, others = None, []
        for batch in batches:
            for key, tokens in zip(batch.column("key").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if key == hub:
                    query = np.frombuffer(tokens, np.uint64)
                else:
                    others.append((key, np.frombuffer(tokens, np.uint64)))
        found = overlap_links(query, others) if query is not None and others else []
        arrays = [pa.array([hub] * len(found), pa.int64()), pa.array(found, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

    return rows.groupBy("hub", "block").applyInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``key, root`` for the ends of links ``a, b``: the smallest key that is connected."""
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    edges = stored(both.toDF("u", "v"), "jaccard-edges")
    roots = edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("key"), F.least("u", "v").alias("root"))
    roots = stored(roots, "jaccard-roots")
    while True:
        near = (
            edges.join(roots.toDF("v", "root"), "v").groupBy("u").agg(F.min("root").alias("near")).withColumnRenamed("u", "key")
        )
        step = roots.join(near, "key").select("key", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = step.select(F.col("key").alias("root"), F.col("root").alias("top"))
        after = step.join(jump, "root").select("key", "old", F.least("root", "top").alias("root"))
        after = stored(after, "jaccard-roots")
        if after.where("old != root").isEmpty():
            return after.select("key", "root")
        roots = after.select("key", "root")


def linked_groups(whole: DataFrame) -> DataFrame:
    """All groups of linked classes: ``key, root``. Classes without a link are left out."""
    spark = whole.sparkSession
    classes = whole.select("key", "n", "room")
    open_rows = postings(whole).withColumn("root", F.col("key"))
    # empty tables of Spark's own: those made from Python rows start workers that stay beside the others
    empty = spark.range(0).where("false")
    links, checked, groups = (empty.selectExpr(f"id AS {x}", f"id AS {y}") for x, y in ("ab", ("low", "high"), ("key", "root")))
    for turn in range(STARS + 1):
        # shingles that classes of several groups share; the others are done
        turned = F.col("key").bitwiseXOR(F.lit(TURNS[turn]))
        tokens = open_rows.groupBy("token").agg(
            F.min(turned).bitwiseXOR(F.lit(TURNS[turn])).alias("hub"), F.min("root").alias("r0"), F.max("root").alias("r1")
        )
        tokens = tokens.where("r0 != r1").select("token", "hub")
        rows = stored(open_rows.join(tokens, "token"), "jaccard-open")
        met = against_hubs(rows, classes, groups) if turn < STARS else against_all(rows)
        low, high = F.least("hub", "key").alias("low"), F.greatest("hub", "key").alias("high")
        pairs = met.select("hub", "key", "n", low, high).dropDuplicates(["low", "high"])
        pairs = stored(pairs.join(checked, ["low", "high"], "left_anti"), "jaccard-pairs")
        if not pairs.isEmpty():
            checked = checked.union(pairs.select("low", "high"))
            found = stored(verified(pairs, whole), "jaccard-links")
            links = links.union(found)
            if turn == STARS:
                break
            groups = components(links)
        open_rows = rows.select("token", "key", "n", "room").join(groups, "key", "left")
        open_rows = open_rows.withColumn("root", F.coalesce("root", "key"))
    return components(links)


#: Sizes, shingles shared with anyone and group of two classes that may link.
_MAY_LINK = (
    f"least(m, n) * 100 >= greatest(m, n) * {SAME} AND least(top_room, room) * {100 + SAME} >= {SAME} * (m + n) AND root != top"
)
#: Linked sets share so many of their first shingles: the one whose first shingles end earlier has all it
#: shares among them in the other's, and lacks no more of the other than its size less the overlap of a link.
_ENOUGH = (
    f"shared >= ({SAME} * (m + n) + {99 + SAME}) div {100 + SAME}"
    f" - (greatest(m, n) * {SAME} + 99) div 100 + (greatest(m, n) * {SPARE} + 99) div 100"
)


def against_hubs(rows: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """Classes with those that most of their shingles name, where a link is likely.

    Shingles that name another class are not counted here, and a class meets its best hubs only, so
    this may miss links: the round behind it is whole.
    """
    counted = rows.where("key != hub").groupBy("hub", "key", "n").agg(F.count("*").alias("shared"))
    # the other set has at least SAME hundredths of this one's size
    counted = counted.where(f"shared * 10000 >= n * {SPARE * SAME}").drop("n")
    best = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("shared", F.negative("hub").alias("other"))))), 1, BEST_HUBS)
    counted = counted.groupBy("key").agg(best.alias("b")).select("key", F.explode("b").alias("b"))
    counted = counted.select("key", F.negative("b.other").alias("hub"), "b.shared")
    info = classes.join(groups, "key", "left").withColumn("root", F.coalesce("root", "key"))
    near = stored(counted.join(info, "key"), "jaccard-near")
    hot = hottest(near.groupBy("hub").agg(F.count("*").alias("n")), ["hub"])
    both = join_spread(near, info.toDF("hub", "m", "top_room", "top"), ["hub"], hot)
    return both.where(f"{_ENOUGH} AND {_MAY_LINK}")


def against_all(rows: DataFrame) -> DataFrame:
    """All classes of different groups that share a shingle, where a link is possible."""
    other = rows.select("token", F.col("key").alias("hub"), F.col("n").alias("m"), F.col("room").alias("top_room"), F.col("root").alias("top"))
    own = rows.select(F.col("token").alias("same"), "key", "n", "room", "root")
    met = other.join(own, F.expr(f"token = same AND hub < key AND {_MAY_LINK}"))
    return met.groupBy("hub", "key", "m", "n").agg(F.count("*").alias("shared")).where(_ENOUGH)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row; the latter is the smallest id reachable."""
    texts = docs.select(text)
    sent = docs.sparkSession.sparkContext.broadcast(common_counters(texts, size))  # COUNTERS flags
    found = stored(documents(docs, doc_id, text, size, sent), "jaccard-documents")
    few = stored(alike(found), "jaccard-classes")
    whole = sets(docs, doc_id, text, size, sent, found, few)
    groups = linked_groups(whole).join(whole.select("key", "k1", "k2"), "key").select("k1", "k2", F.col("root"))
    named = found.where("n > 0").select("doc_id", "k1", "k2")
    classes = named.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"))
    grouped = classes.join(groups, ["k1", "k2"])
    alone = classes.join(groups, ["k1", "k2"], "left_anti").select("k1", "k2", F.col("id").alias("component_id"))
    tops = grouped.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = grouped.join(tops, "root").select("k1", "k2", "component_id").unionByName(alone)
    full = found.where("n > 0").join(of_class, ["k1", "k2"])
    bare = found.where("n = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    return full.select(*columns).unionByName(bare.select(*columns))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """The document of the smallest id of each group, with the columns of ``docs``.

    Rows of equal id count as one document; the smallest text of them stays. Rows without an id
    stay as they are.
    """
    found = stored(join(docs, doc_id, text, size).where(F.col("doc_id").isNotNull()), "jaccard-groups")
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    if found.where("doc_id != component_id").count() <= SENT_IDS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, F.col(doc_id) == F.col("__gone"), "left_anti")
    twice = found.groupBy(F.col("doc_id").alias("__twice")).count().where("count > 1").select("__twice")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, F.col(doc_id) == F.col("__twice"), "left_anti")
    again = kept.join(twice, F.col(doc_id) == F.col("__twice"), "left_semi")
    rest = [c for c in docs.columns if c not in (doc_id, text)]
    again = again.groupBy(doc_id).agg(F.min(F.struct(text, *rest)).alias("__row"))
    return once.unionByName(again.select(doc_id, "__row.*").select(*docs.columns))
