"""N-gram Jaccard join by vertical partitioning.

All shingles have one global order: classes of their estimated frequency, rare
ones first, then hashes. The order is cut into fragments. Within a fragment,
documents meet through the shingles of their prefixes (two sets that reach the
threshold share one of these); for the pairs that meet, overlaps are counted
fragment by fragment and summed per pair.

* Documents of equal sets are one class and are joined once.
* A class leaves a list (the classes that share a prefix shingle) in which it can reach
  nobody: sizes and places in the sets bound the overlap of each two members. So lists of
  passages that many otherwise different documents share vanish before any pair is made.
* Sets have a parity sketch: each shingle flips one of its bits. Two sketches differ in no
  more bits than the sets do in shingles, which rules pairs out without their sets.
* Lists are not unfolded into all pairs. Each round pairs every member with the pivot of its
  lists that it is most alike, verifies, and joins components; lists within one component
  are done. The pivot is the member of most lists, as an original is that its copies differ from.
  Rounds go on while each halves the components that meet in lists. Of what is left then,
  the members outside their list's largest component meet its other components, and all
  pairs that sketches and places allow are verified. Pairs inside a component need no look,
  as the result is components; no link between components is lost.
* The frequency estimate comes from a counter array of fixed size over shingles
  that repeat within a task. It only orders; any order gives the same links.

Links: 100 * intersection >= 75 * union. A text without words has no shingles
and links with nothing; null counts as empty. Rows of equal id are documents of
their own. An empty table gives an empty result. Shingles are 56-bit hashes and
classes 64-bit hashes of whole sets; collisions are taken as impossible.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefuse.llm.common import forget, joined, kept, slices, text_bytes
from tidefuse.llm.components import connected

WORDS = 5
COUNTERS = 1 << 20
#: Shingles seen at least so often in a task are counted for the order.
REPEATS = 3
#: Tasks count this many shingles together.
COUNTED = 1 << 22
FRAGMENTS = 8
#: Bits of the filter of documents whose sets are compared.
BITS = 1 << 23
HASH_BITS = 56
#: 64-bit words of a sketch; two of them can rule out sets of up to 1,790 shingles whatever they hold.
SKETCH_WORDS = 16
#: Sets from this size on have a longer sketch too, for sets of up to 14,300 shingles.
LONG, LONG_WORDS = 1200, 128
#: Shingles of this frequency class and above are known to be shared; their lists are spread over this many keys.
OFTEN, SPREAD = 10, 64

M1, M2, M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, M3, np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and the text each word is in."""
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + np.uint8(32), data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~space
    begins[1:] &= space[:-1] | np.isin(np.arange(1, len(data)), offsets[1:-1])
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = np.cumsum(begins)
    place = np.arange(len(data)) - starts[np.maximum(word, 1) - 1]
    place[space] = 0
    terms = mixed(data.astype(np.uint64) + M3) * powers(int(place.max()) + 1)[place]
    terms[space] = 0
    return mixed(np.add.reduceat(terms, starts)), np.searchsorted(offsets, starts, side="right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles per text, as (text, hash) sorted by both."""
    words, text = word_hashes(data, offsets)
    count = np.bincount(text, minlength=len(offsets) - 1)
    factors = mixed(np.arange(1, WORDS + 1, dtype=np.uint64) * M3) | np.uint64(1)
    full = max(0, len(words) - WORDS + 1)
    hashes = np.zeros(full, np.uint64)
    for k in range(WORDS):
        hashes += words[k:k + full] * factors[k]
    whole = text[:full] == text[WORDS - 1:] if full else np.zeros(0, bool)
    hashes, owner = hashes[whole], text[:full][whole]
    few = np.flatnonzero((count > 0) & (count < WORDS))
    if len(few):
        first = np.searchsorted(text, few)
        short = np.zeros(len(few), np.uint64)
        for k in range(WORDS - 1):
            has = count[few] > k
            short[has] += words[first[has] + k] * factors[k]
        hashes = np.concatenate([hashes, short + count[few].astype(np.uint64)])
        owner = np.concatenate([owner, few])
    hashes = mixed(hashes) >> np.uint64(64 - HASH_BITS)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[first], owner[first]
    return owner, hashes


def set_digests(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and digest of each text's set. The digest of an empty set is 0."""
    sizes = np.bincount(owner, minlength=n)
    digest = np.zeros(n, np.uint64)
    if len(hashes):
        full = np.flatnonzero(sizes)
        digest[full] = mixed(np.add.reduceat(mixed(hashes + M3), (np.cumsum(sizes) - sizes)[full])
                             + sizes[full].astype(np.uint64) * M1)
    return sizes.astype(np.int64), digest.view(np.int64)


def parities(owner: np.ndarray, hashes: np.ndarray, n: int, words: int) -> np.ndarray:
    """For each set the parity of its shingles on each of its bits, as words."""
    bits = 64 * words
    at = owner * bits + (mixed(hashes ^ M2) >> np.uint64(32)).astype(np.int64) % bits
    return np.packbits((np.bincount(at, minlength=n * bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def sketches(owner: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """A sketch of each set, and the longer one of large sets (null for others)."""
    n = len(sizes)
    words = parities(owner, hashes, n, SKETCH_WORDS)
    short = pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, SKETCH_WORDS, dtype=np.int32)), pa.array(words))
    large = sizes >= LONG
    rank = np.cumsum(large) - 1
    use = large[owner]
    words = parities(rank[owner[use]], hashes[use], int(large.sum()), LONG_WORDS)
    ends = np.concatenate([[0], np.cumsum(large)]).astype(np.int32) * LONG_WORDS
    long = pa.ListArray.from_arrays(pa.array(ends), pa.array(words), mask=pa.array(~large))
    return short, long


def batch_sets(batch: pa.RecordBatch, text: int):
    data, offsets = text_bytes(batch.column(text))
    owner, hashes = shingles(data, offsets)
    return (*set_digests(owner, hashes, batch.num_rows), owner, hashes)


def profiles(documents: DataFrame) -> DataFrame:
    """Rows of two kinds: a document (0, doc_id, size, digest, sketches), or a counter (1, number, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def counters() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            often = counts >= REPEATS
            number, place = np.unique(values[often] & np.uint64(COUNTERS - 1), return_inverse=True)
            total = np.bincount(place, counts[often], minlength=len(number)).astype(np.int64)
            n = len(number)
            none = pa.nulls(n, pa.list_(pa.int64()))
            return rows(1, pa.array(number.astype(np.int64)), total, pa.nulls(n, pa.int64()), none, none)

        def rows(kind, a, b, c, sketch, fine) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), a, pa.array(b), c, sketch, fine],
                                              ["kind", "a", "b", "c", "sketch", "fine"])

        for batch in slices(batches):
            sizes, digest, owner, hashes = batch_sets(batch, 1)
            yield rows(0, batch.column(0), sizes, pa.array(digest), *sketches(owner, hashes, sizes))
            held.append(hashes)
            n_held += len(hashes)
            if n_held >= COUNTED:
                yield counters()
                held, n_held = [], 0
        yield counters()

    return chosen(documents).mapInArrow(run, "kind int, a long, b long, c long, sketch array<long>, fine array<long>")


def chosen(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def frequency_classes(profile: DataFrame) -> np.ndarray:
    """Class 0 to 63 of every counter; the array has a fixed size at any input."""
    counted = profile.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).toArrow()
    classes = np.zeros(COUNTERS, np.uint64)
    classes[counted["a"].to_numpy()] = 1 + np.log2(counted["n"].to_numpy()).astype(np.uint64)
    return classes


def ordered(owner: np.ndarray, hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Keys whose order is the global one, sorted within each text."""
    keys = ((classes[hashes & np.uint64(COUNTERS - 1)] << np.uint64(HASH_BITS)) | hashes).astype(np.int64)
    return keys[np.lexsort((keys, owner))]


def fragment(keys: np.ndarray) -> np.ndarray:
    """Number of the piece of the global order that each key lies in; frequent shingles are the last one."""
    rare = (keys >> (HASH_BITS - 10)) * (FRAGMENTS - 1) >> 10
    return np.where(keys >> HASH_BITS, FRAGMENTS - 1, rare)


def postings(documents: DataFrame, classes) -> DataFrame:
    """Prefix shingles of each class: shingle, node (the set's digest), size, place in the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            sizes, digest, owner, hashes = batch_sets(batch, 1)
            keys = ordered(owner, hashes, classes.value)
            fresh = np.zeros(len(sizes), bool)
            for k in np.flatnonzero(sizes).tolist():
                if (d := int(digest[k])) not in seen:
                    seen.add(d)
                    fresh[k] = True
            place = np.arange(len(keys)) - (np.cumsum(sizes) - sizes)[owner]
            prefix = sizes - -(-3 * sizes // 4) + 1
            use = fresh[owner] & (place < prefix[owner])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[use]), pa.array(digest[owner[use]]), pa.array(sizes[owner[use]].astype(np.int32)),
                 pa.array(place[use].astype(np.int32))], ["shingle", "node", "size", "place"])

    return chosen(documents).mapInArrow(run, "shingle long, node long, size int, place int")


def with_digest(documents: DataFrame, digest: str, size: str) -> DataFrame:
    """``documents`` with the digest and the size of each text's shingle set."""
    place = documents.columns.index("text")
    schema = T.StructType([*documents.schema.fields, T.StructField(digest, T.LongType()),
                           T.StructField(size, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, digests, *_ = batch_sets(batch, place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests), pa.array(sizes)],
                                             [*batch.schema.names, digest, size])

    return documents.mapInArrow(run, schema)


def bitmap(wanted: DataFrame, column: str) -> np.ndarray:
    """Bits of the last digits of a number, of a fixed size; other numbers may share a bit."""
    bit = F.col(column).bitwiseAND(BITS - 1)
    words = wanted.where(F.col(column).isNotNull()).groupBy(F.shiftright(bit, 5).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 31 AS int))")).alias("b")).toArrow()
    bits = np.zeros(BITS // 32, np.int64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy()
    return bits


def holds(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    return bits[(values & (BITS - 1)) >> 5] >> (values & 31) & 1 == 1


def segments(documents: DataFrame, wanted: DataFrame, classes) -> DataFrame:
    """node, fragment, shingles of each wanted node (node, doc_id), once per task that holds a document of it.

    Nodes that share a bit with a wanted one may come along.
    """
    # Texts stay where they are: tasks leave out most other documents, by their ids before they are cut
    # into shingles, and by their sets after that. Two bitmaps of a fixed 2 MB; rows without an id are all cut.
    sent = documents.sparkSession.sparkContext.broadcast((bitmap(wanted, "node"), bitmap(wanted, "doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        nodes, ids = sent.value
        for batch in slices(batches):
            absent = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(absent | holds(ids, batch.column(0).fill_null(0).to_numpy())))
            if not batch.num_rows:
                continue
            sizes, digest, owner, hashes = batch_sets(batch, 1)
            hit = (sizes > 0) & holds(nodes, digest)
            for k in np.flatnonzero(hit).tolist():
                hit[k] = (d := int(digest[k])) not in seen
                seen.add(d)
            owner, hashes = owner[hit[owner]], hashes[hit[owner]]
            if not len(owner):
                continue
            keys = ordered(owner, hashes, classes.value)
            part = fragment(keys)
            first = np.ones(len(keys), bool)
            first[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
            starts = np.flatnonzero(first)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)).astype(np.int32)), pa.array(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest[owner[starts]]), pa.array(part[starts].astype(np.int32)), lists],
                ["node", "fragment", "shingles"])

    return chosen(documents).mapInArrow(run, "node long, fragment int, shingles array<long>")


def linked(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b, size_a, size_b) that reach the threshold: partial overlaps per fragment, summed.

    Both joins have the keys by which copies from several tasks are reduced to one, so that
    segments are shuffled once.
    """
    parts = parts.repartition("node", "fragment").dropDuplicates(["node", "fragment"])
    pairs = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    left, right = (parts.select(F.col("node").alias(end), "fragment", F.col("shingles").alias(f"shingles_{end}"))
                   for end in ("a", "b"))
    met = joined(joined(pairs, left, ["a", "fragment"]), right, ["b", "fragment"])
    partial = met.select("a", "b", "size_a", "size_b", F.size(F.array_intersect("shingles_a", "shingles_b")).alias("n"))
    total = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n"))
    return total.where("100 * n >= 75 * (size_a + size_b - n)").select("a", "b")


def farthest(size: str, place: str) -> Column:
    """The largest partner that a member can reach with the shingles from its place on."""
    return F.floor(7 * (F.col(size) - F.col(place)) / 3) - F.col(size)


def apart(a: str, b: str) -> Column:
    """Bits in which two sketches differ, of the longer ones if both have them; the sets differ in as many shingles."""
    short = sum((F.bit_count(F.col(f"sketch{a}")[k].bitwiseXOR(F.col(f"sketch{b}")[k])) for k in range(SKETCH_WORDS)), F.lit(0))
    each = F.zip_with(f"fine{a}", f"fine{b}", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.coalesce(F.aggregate(each, F.lit(0), lambda n, x: n + x), short)


def reachable(a: str, b: str) -> Column:
    """Whether sizes and places of two members (columns with these suffixes) allow a link."""
    size_a, size_b = F.col(f"size{a}"), F.col(f"size{b}")
    rest = F.least(size_a - F.col(f"place{a}"), size_b - F.col(f"place{b}"))
    return 7 * rest >= 3 * (size_a + size_b)


def alike(a: str, b: str) -> Column:
    """Whether the sketches of two sets allow a link: that many shingles at most may be in one of them only."""
    return 7 * apart(a, b) <= F.col(f"size{a}") + F.col(f"size{b}")


def shared_lists(documents: DataFrame, classes) -> DataFrame:
    """shingle, node, size, place of the members that may reach another member of their list.

    In a list of two that is exact, in a longer one it follows from the smallest size and the farthest reach.
    """
    often = F.col("shingle") >= F.lit(OFTEN << HASH_BITS)
    found = postings(documents, classes).withColumns({
        "_reach": farthest("size", "place"),
        "_salt": F.when(often, F.pmod(F.xxhash64("node"), F.lit(SPREAD))).otherwise(0)})
    same = Window.partitionBy("shingle", "_salt")
    found = found.repartition("shingle", "_salt").withColumns({
        "_n": F.count(F.lit(1)).over(same), "_low": F.min("node").over(same), "_high": F.max("node").over(same), "_least": F.min("size").over(same), "_most": F.max("_reach").over(same),
        "_sizes": F.sum("size").over(same), "_reaches": F.sum("_reach").over(same)})
    two = (F.col("_sizes") - F.col("size") <= F.col("_reach")) & (F.col("size") <= F.col("_reaches") - F.col("_reach"))
    more = (F.col("_least") <= F.col("_reach")) & (F.col("size") <= F.col("_most"))
    met = often | (F.when(F.col("_n") == 2, two).otherwise(more) & (F.col("_low") < F.col("_high")))
    # Several tasks can each have a copy of a class.
    return found.where(met).select("shingle", "node", "size", "place").distinct()


def component_of(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return nodes.withColumn("root", F.col("node"))
    named = roots.select("node", F.col("root").alias("_root"))
    return joined(nodes, named, "node", "left").withColumn("root", F.coalesce("_root", "node")).drop("_root")


def meeting(lists: DataFrame) -> DataFrame:
    """Members of lists that more than one component meets in, with their list's pivot, and its largest component."""
    member = [F.col(c) for c in ("node", "size", "place", "root")]
    turn = F.struct(F.when(F.col("used"), 0).otherwise(1), "degree", F.xxhash64("node"), *member)
    groups = lists.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"), F.max(turn).alias("first"))
    each = groups.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("roots"), F.max("first").alias("first"), F.max(F.struct("n", "root")).alias("largest"))
    each = each.where("roots > 1").select(
        "shingle", "roots", F.col("largest.root").alias("largest"),
        *[F.col(f"first.{c}").alias(f"{c}_p") for c in ("node", "size", "place", "root")])
    found = joined(lists, each, "shingle")
    return found.withColumn("used", F.col("used") | (F.col("node") == F.col("node_p")))


def link_components(documents: DataFrame, profile: DataFrame) -> DataFrame:
    """node, root for all classes that link with another."""
    spark = documents.sparkSession
    classes = spark.sparkContext.broadcast(frequency_classes(profile))  # a fixed 8 MB
    found = kept(shared_lists(documents, classes), "postings")
    degrees = found.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    sets = profile.where("kind = 0 AND b > 0").groupBy(F.col("c").alias("node")).agg(
        F.min("a").alias("doc_id"), F.any_value("sketch").alias("sketch"), F.any_value("fine").alias("fine"))
    named = kept(joined(degrees, sets, "node"), "members")
    lists = joined(found, named.select("node", "degree"), "node").withColumns({"root": F.col("node"), "used": F.lit(False)})
    links, roots, before = [], None, None

    def sketch(end: str) -> DataFrame:
        return named.select(F.col("node").alias(end), F.col("sketch").alias(f"sketch_{end}"), F.col("fine").alias(f"fine_{end}"))

    while True:
        now = kept(meeting(lists), "lists")
        forget(found)
        found = now
        groups = now.select("shingle", "roots").distinct().agg(F.sum(F.col("roots") - 1)).first()[0]
        if not groups:
            break
        rounds = before is None or 2 * groups <= before
        before = groups
        if rounds:
            # The alikest pivot alone: at most one pair per class.
            met = now.where((F.col("root") != F.col("root_p")) & reachable("", "_p")).select(
                F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("node_p").alias("a"),
                F.col("size_p").alias("size_a")).distinct()
            met = joined(joined(met, sketch("a"), "a"), sketch("b"), "b").where(alike("_a", "_b"))
            best = met.groupBy("b", "size_b").agg(F.min(F.struct(apart("_a", "_b").alias("apart"), "a", "size_a")).alias("m"))
            pairs = best.select("m.a", "b", "m.size_a", "size_b")
        else:
            side = ["node", "size", "place", "root", "sketch", "fine"]
            drawn = joined(now, named.select("node", "sketch", "fine"), "node")
            outer = drawn.where("root <> largest").select(F.col("shingle").alias("_list"), *[F.col(c).alias(f"{c}_a") for c in side])
            every = drawn.select("shingle", "largest", *[F.col(c).alias(f"{c}_b") for c in side])
            # Two members outside the largest component meet from one end only.
            once = (F.col("root_b") == F.col("largest")) | (F.col("node_a") < F.col("node_b"))
            met = joined(outer, every, (F.col("_list") == F.col("shingle")) & once & (F.col("root_a") != F.col("root_b"))
                         & reachable("_a", "_b") & alike("_a", "_b"))
            pairs = met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "size_a", "size_b").distinct()
        pairs = kept(pairs, "pairs")
        if not pairs.isEmpty():
            ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
            wanted = kept(joined(ends, named.select("node", "doc_id"), "node"), "ends")
            links.append(kept(linked(pairs, segments(documents, wanted, classes)), "links"))
            forget(wanted)
        forget(pairs)
        if not rounds:
            break
        if links:
            old, roots = roots, kept(connected(reduce(DataFrame.union, links)), "components")
            forget(*[old] if old is not None else [])
        lists = component_of(now.select("shingle", "node", "size", "place", "degree", "used"), roots)
    forget(found, named)
    return connected(reduce(DataFrame.union, links)) if links else profile.where("1 = 0").select(
        F.col("c").alias("node"), F.col("c").alias("root"))


def components(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, node (digest of its set)."""
    profile = kept(profiles(documents), "profiles")
    roots = link_components(documents, profile)
    members = profile.where("kind = 0").select(
        F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("node"))
    nodes = members.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    nodes = kept(component_of(nodes, kept(roots, "components")), "classes")
    named = joined(nodes, nodes.groupBy("root").agg(F.min("first").alias("component_id")), "root").select(
        "node", "component_id")
    return joined(members, named, "node", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "node")
