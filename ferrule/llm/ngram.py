"""N-gram Jaccard join by T-occurrence search.

Two texts link when ``100 * |A & B| >= 80 * |A | B|`` on their sets of distinct five-word shingles (held as 64-bit
hashes). Such a pair shares at least ``T = ceil(0.8 n)`` shingles of either set (n: its size). As in DivideSkip, the
inverted lists of a set are divided: the ``T - c`` lists of the shingles that are most frequent over all documents are
the long ones, the other ``n - T + c`` the short ones. Short lists are merged (Spark's external sort brings a list's
entries together, however long it is, and the counts of common entries are summed), a pair must meet on c of
them, and what is left is probed by binary search in the sorted long rest, until the required overlap is
reached or out of reach.

Equal sets are one node, whatever the number of copies. A group of thousands of near copies would still meet
in n*n pairs, so the work takes two rounds. The first keeps the groups small: each entry of a list is tried against its
neighbour and the head of the list (linear), and pairs that these links already connect need no test for the classes.
The second is the search for all remaining pairs, exactly. A set that still shares a list with another component is
open; open sets lie in blocks of bounded size beside the largest component they share a list with, and a block keeps
whole sets. An open set goes as a query to every block that holds at least c of its short lists with larger components
in them, never pair by pair; there DivideSkip divides its lists anew by their length in the block, merges the short
ones (sorted runs into one, whose equal entries are counted) and probes the long ones in those candidates that can still
reach their overlap.

An entry of a list is two numbers. The key of a set is 56 bits of its hash and 8 bits of its size's logarithm; sets
that share a key with another (a handful, whatever the input: n * n / 2**57 pairs of n sets) are found and get another.
The place of a list is 52 bits of its shingle's hash and 12 bits of salt: lists of more than ``LIST`` entries are
dealt over several places. Lists that share a place only cost time. So does the order of frequency, which comes from
counters over all shingles of all documents in a table of fixed size, since any order common to all sets is right.

Defined results: a null or empty text, or one without words, has no shingles, links with nothing and is its own
component; fewer than five words make one shingle; repeated rows stay, each with its class; a row of null doc_id
links like any other, keeps its row and takes the component of its class (null if none of its class has an id). Extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.llm.common import SPACED, Scratch, blobs, chunks, components, hash_words, if_small, mix, prepare, row_of, shingle_hashes, summed, tidy

#: Words of a shingle, per cent of similarity, lists beyond the necessary ones (c).
WORDS, PERCENT, EXTRA = 5, 80, 4
#: Partners that a set meets in one task at most, about; entries of a list in one place; sets that ask a block in one task.
FAN, LIST, ASKS = 4096, 4096, 1024
#: Rows whose sets go out at once, and their part of all sets in per cent: what needs more goes in several passes.
PART_ROWS, PART_PERCENT = 3 << 18, 75
#: Shingles of the sets of one block, about; weight of the longest list in dividing short lists from long ones.
BLOCK, MU = 1 << 20, 0.1
#: Counters of shingle frequency: 2**BITS in slices of 2**SLICE. Bits of the filter of wanted rows: FILTER_EACH a row, 2**FILTER_MOST at most.
BITS, SLICE, FILTER_EACH, FILTER_MOST = 20, 16, 16, 27
SALT_BITS, SIZE_BITS, STEP = 12, 8, 8


def shingle_sets(column: pa.Array, words: int = WORDS):
    """Row and sorted distinct shingle hashes of each text that has words."""
    for i, _, buf, offs in chunks(column):
        h, first, _, _ = hash_words(buf, offs, SPACED)
        g = shingle_hashes(h, words)
        for k in range(len(offs) - 1):
            a, b = first[k], first[k + 1]
            if b - a >= words:
                own = np.sort(g[a : b - words + 1])
                yield i + k, own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif b > a:
                yield i + k, shingle_hashes(h[a:b], b - a)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a sorted set."""
    with np.errstate(over="ignore"):
        a, b = mix(s ^ np.uint64(0x1234567)).sum(dtype=np.uint64), mix(s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def required(n, percent: int = PERCENT):
    return -(-n * percent // 100)


def size_class(n: int) -> int:
    return min(255, int(STEP * math.log2(n) + 1e-9))


def key_of(s: np.ndarray, twins: frozenset = frozenset()) -> int:
    """The key of a set; of sets whose first 56 bits are those of another, by other bits."""
    k1, k2 = set_key(s)
    low = (1 << SIZE_BITS) - 1
    return ((k2 if k1 & ~low in twins else k1) & ~low) | size_class(len(s))


def _digest(batches):
    counts = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        n = batch.num_rows
        size, k1, k2, valid = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        pile, held = [], 0
        for row, s in shingle_sets(batch.column(3)):
            size[row], valid[row] = len(s), True
            k1[row], k2[row] = set_key(s)
            pile.append(s)
            held += len(s)
            if held > 1 << 18:
                counts += np.bincount((np.concatenate(pile) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
                pile, held = [], 0
        if pile:
            counts += np.bincount((np.concatenate(pile) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size), pa.array(k1, mask=~valid), pa.array(k2, mask=~valid), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["doc_id", "rid", "th", "n", "k1", "k2", "slice", "counts"])
    for part in blobs(counts, 1 << SLICE):
        none = pa.nulls(part.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, none, *part.columns], ["doc_id", "rid", "th", "n", "k1", "k2", "slice", "counts"])


def frequency_levels(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each counter, one byte for the order (0 for usual counts, then one more for each doubling) and the places its lists are dealt over."""
    usual = 2 * total.mean() + 32
    places = np.minimum(-(-total // LIST), (1 << SALT_BITS) - 1)
    return np.ceil(np.log2(np.maximum(total / usual, 1))).astype(np.uint8), np.where(total > LIST, places, 0).astype(np.uint16)


def _short_lists(levels, twins, percent, extra):
    """Entries (place, key) of the short lists of each distinct set of a task."""

    def run(batches):
        seen: set = set()
        level, places = levels.value
        for batch in batches:
            out = [[], []]
            for _, s in shingle_sets(batch.column(0)):
                key = key_of(s, twins)
                if key in seen:
                    continue
                seen.add(key)
                n = len(s)
                t = required(n, percent)
                at = (s >> np.uint64(64 - BITS)).astype(np.int64)
                rare = level[at]
                short = np.argsort(rare, kind="stable")[: n - t + min(extra, t)] if rare.any() else np.arange(n - t + min(extra, t))
                s, over = s[short], places[at[short]]
                salt = np.zeros(len(s), np.uint64)
                hot = np.flatnonzero(over)
                if len(hot):
                    # Each list deals its sets out in a way of its own.
                    salt[hot] = 1 + mix(s[hot] ^ np.uint64(key & (1 << 64) - 1)) % over[hot].astype(np.uint64)
                low = np.uint64(SALT_BITS)
                out[0].append((s >> low << low | salt).view(np.int64))
                out[1].append(np.full(len(s), key, np.int64))
            if out[0]:
                cols = [np.concatenate(x) for x in out]
                for i in range(0, len(cols[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in cols], ["place", "key"])

    return run


def wanted_filter(ids: DataFrame) -> np.ndarray:
    """Bits that are set for every id (and some others): FILTER_EACH for each of them up to 2**FILTER_MOST, 16 MB."""
    bits = min(FILTER_MOST, max(16, math.ceil(math.log2(max(1, ids.count()) * FILTER_EACH))))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    size = 1 << SLICE + 3
    found = np.zeros(1 << bits - 3, np.uint8)
    # Each distinct bit once, in slices that hold the bits of one range; no task and no row gathers them all.
    rows = ids.select(place.alias("p")).distinct().select(F.floor(F.col("p") / size).cast("int").alias("slice"), "p")
    for r in rows.repartition(max(1, (1 << bits) // size), "slice").mapInArrow(tidy(_bit_slices(size)), "slice int, bits binary").collect():
        part = found[r.slice * size // 8 : (r.slice + 1) * size // 8]
        part |= np.frombuffer(r.bits, np.uint8)[: len(part)]
    return found


def _bit_slices(size):
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            part, p = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for k in np.unique(part).tolist():
                total.setdefault(k, np.zeros(size, bool))[p[part == k] - k * size] = True
        for k, bits in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["slice", "bits"])

    return run


def _sets_of(wanted, twins):
    def run(batches):
        bits = wanted.value
        seen: set = set()
        for batch in batches:
            place = np.asarray(batch.column(1))
            batch = batch.filter(pa.array((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)))
            if not batch.num_rows:
                continue
            ids, found = batch.column(0).to_pylist(), []
            for row, s in shingle_sets(batch.column(2)):
                # A row that is repeated within the task, however often, gives its set once.
                mark = (ids[row], key := key_of(s, twins))
                if mark not in seen:
                    seen.add(mark)
                    found.append((ids[row], key, s.tobytes()))
            for i in range(0, len(found), 256):
                a, b, c = zip(*found[i : i + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], ["id", "key", "set"])

    return run


def probe(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Binary-probe the smaller sorted set in the larger one, in steps, until the required overlap is certain or lost."""
    if len(a) > len(b):
        a, b = b, a
    need = -(-percent * (len(a) + len(b)) // (100 + percent))
    if need > len(a):
        return False
    hits = 0
    for i in range(0, len(a), 1024):
        part = a[i : i + 1024]
        at = np.searchsorted(b, part)
        hits += int((b[np.minimum(at, len(b) - 1)] == part).sum())
        if hits >= need:
            return True
        if hits + len(a) - i - len(part) < need:
            return False
    return hits >= need


def _verify(percent):
    """Rows come by (a, salt), the set of a first, then those of its partners; one set is held at a time."""

    def run(batches):
        group, hub = None, None
        for batch in batches:
            a, b = [], []
            for grp, salt, key, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(blob, np.uint64)
                if key == grp:
                    group, hub = (grp, salt), own
                elif group == (grp, salt) and probe(hub, own, percent):
                    a.append(grp)
                    b.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


class Lists:
    """Inverted lists over the whole sets of one block."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.sets, self.percent = sets, percent
        self.n = np.array([len(x) for x in sets], np.int64)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.n)[order]
        self.token, first = np.unique(tokens[order], return_index=True)
        self.first = np.append(first, len(tokens))

    def search(self, own: np.ndarray, among: np.ndarray):
        """Positions in the block, of those marked in among, whose sets are similar enough to own; likeliest first.
        Marks that are taken away between two results count."""
        at = np.minimum(np.searchsorted(self.token, own), len(self.token) - 1)
        there = self.token[at] == own
        t, known = required(len(own), self.percent), own[there]
        if len(known) < t:
            return
        low = self.first[at[there]]
        length = self.first[at[there] + 1] - low
        order = np.argsort(length, kind="stable")
        long = min(t - 1, int(t / (MU * np.log2(length.max() + 1) + 1)))
        short = order[: len(order) - long]
        size = length[short]
        places = np.repeat(low[short] - np.cumsum(size) + size, size) + np.arange(size.sum())
        # Each short list is an ascending run of owners; the stable sort merges the runs, equal owners come to lie together.
        merged = np.sort(self.owner[places], kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1]))) if len(merged) else merged
        met = np.zeros(len(self.sets), np.int64)
        met[merged[edge]] = np.diff(np.append(edge, len(merged)))
        need = -(-self.percent * (len(own) + self.n) // (100 + self.percent))
        left = np.flatnonzero(among & (need <= np.minimum(len(own), self.n)) & (met + long >= need))
        rest = known[order[len(order) - long :]]
        for k in left[np.argsort(-met[left], kind="stable")].tolist():
            if not among[k]:
                continue
            other = self.sets[k]
            spot = np.minimum(np.searchsorted(other, rest), len(other) - 1)
            if met[k] + int((other[spot] == rest).sum()) >= need[k]:
                yield k


def _search(percent):
    """Rows come by (block, salt), the sets of the block first, then the queries, which are met one by one.

    Two components that earlier links of the block join are one: no pair of theirs is tried.
    """

    def run(batches):
        at, held, lists = None, [], None
        for batch in batches:
            a, b = [], []
            for block, salt, query, key, comp, size, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (block, salt):
                    at, held, lists = (block, salt), [], None
                own = np.frombuffer(blob, np.uint64)
                if not query:
                    held.append((key, comp, size, own))
                    continue
                if not held:
                    continue
                if lists is None:
                    keys, comps, sizes, sets = zip(*held, strict=True)
                    comps, sizes, lists = np.array(comps, np.int64), np.array(sizes, np.int64), Lists(list(sets), percent)
                    label, above = comps.copy(), {}
                mine = comp
                while mine in above:
                    mine = above[mine]
                among = ((sizes > size) | ((sizes == size) & (comps > comp))) & (label != mine)
                for k in lists.search(own, among):
                    a.append(key)
                    b.append(keys[k])
                    other = int(label[k])
                    above[other] = mine
                    joined = label == other
                    among &= ~joined
                    label[joined] = mine
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def row_keys(doc_id="doc_id", text="text") -> tuple[Column, Column]:
    """What a row is fetched by: its id, or a hash of its text where it has none; and another hash of its text."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.col(text).cast("string"))), F.xxhash64(F.lit("text"), F.col(text).cast("string"))


def classes(docs: DataFrame, scratch: Scratch, percent: int, extra: int) -> DataFrame:
    """doc_id, rid, th, n, comp (null without shingles), component_id of every row of docs (columns doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rid, th = row_keys()
    docs = docs.withColumns({"rid": rid, "th": th})
    schema = "doc_id long, rid long, th long, n long, k1 long, k2 long, slice int, counts binary"
    digest = scratch.keep(docs.select("doc_id", "rid", "th", "text").mapInArrow(tidy(_digest), schema), "digest")
    rows = digest.where("slice is null").select("doc_id", "rid", "th", "n", "k1", "k2")
    total = summed(digest.where("slice is not null").select("slice", "counts"), 1 << BITS, 1 << SLICE)
    levels = spark.sparkContext.broadcast(frequency_levels(total))
    high = ~((1 << SIZE_BITS) - 1)
    reps = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("rid").alias("id"), F.min("doc_id").alias("least"), F.max("n").alias("n"))
    reps = scratch.keep(reps.withColumn("base", F.col("k1").bitwiseAND(F.lit(high))), "reps")
    twins = frozenset(r.base for r in reps.groupBy("base").count().where("count > 1").select("base").collect())  # n * n / 2**57 of n sets
    step = F.least(F.lit(255), F.floor(F.lit(STEP) * F.log2("n") + 1e-9))
    own_bits = F.when(F.col("base").isin(sorted(twins)), F.col("k2")).otherwise(F.col("k1")) if twins else F.col("k1")
    one = reps.select("k1", "k2", "id", "least", own_bits.bitwiseAND(F.lit(high)).bitwiseOR(step.cast("long")).alias("key"))

    def size_of(key) -> Column:
        return F.col(key).bitwiseAND(F.lit((1 << SIZE_BITS) - 1))

    apart = math.ceil(STEP * math.log2(100 / percent))  # classes between sizes that can be similar enough

    def near(a, b) -> Column:
        return F.abs(size_of(a) - size_of(b)) <= apart

    def least_c(size) -> Column:
        """Lists that a set of this class meets a partner on, at least."""
        return F.least(F.lit(extra), F.ceil(F.floor(F.pow(F.lit(2.0), size / STEP) + 1e-6) * percent / 100))

    entries = docs.select("text").mapInArrow(tidy(_short_lists(levels, twins, percent, extra)), "place long, key long")
    # Each place has an order of its own, so that a set of a large group meets other neighbours in every list. Of equal
    # entries, which lie together, the last one counts.
    by_hash = Window.partitionBy("place").orderBy(F.xxhash64("place", "key"), "key")
    lists = entries.withColumns({"next": F.lead("key").over(by_hash), "head": F.first("key").over(by_hash)})
    lists = lists.where("(next is null or next <> key) and (next is not null or head <> key or place % 4096 <> 0)".replace("4096", str(1 << SALT_BITS)))
    lists = lists.select("place", "key", F.when(near("key", "next"), F.col("next")).alias("next"), F.when((F.col("head") != F.col("key")) & near("key", "head"), F.col("head")).alias("head"))
    lists = scratch.keep(lists, "lists")

    def with_sets(need: DataFrame) -> DataFrame:
        """Adds to need (id, key and others) the set of each row."""
        found = wanted_filter(need.select("id"))
        bits = spark.sparkContext.broadcast(found)
        sets = docs.select("rid", F.pmod(F.xxhash64("rid"), F.lit(8 * len(found))).alias("p"), "text").mapInArrow(tidy(_sets_of(bits, twins)), "id long, key long, set binary")
        return sets.join(if_small(need), ["id", "key"])

    everything = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def links_in(need: DataFrame, group: list[str], columns: list[str], order: Column | str, run) -> DataFrame:
        """Links (a, b) that run finds in the groups of need, whose rows (id, key and others) get their sets.

        A group stays whole, but the groups go out in as many parts as keep the shuffle files small: those of one part
        are gone before the next one's are written, and a part's rows are few enough to be broadcast.
        """
        rows, sent = need.agg(F.count("*"), F.coalesce(F.sum(F.pow(F.lit(2.0), size_of("key") / STEP)), F.lit(0.0))).first()
        parts = max(1, math.ceil(rows / PART_ROWS), math.ceil(100 * sent / max(1, PART_PERCENT * everything)))
        found = []
        for k in range(parts):
            part = need.where(F.pmod(F.xxhash64(F.lit("part"), *group), F.lit(parts)) == k) if parts > 1 else need
            met = with_sets(part).select(*group, *columns, "set").repartition(*group).sortWithinPartitions(*group, order)
            found.append(scratch.keep(met.mapInArrow(tidy(run), "a long, b long").distinct(), "links"))
        if parts == 1:
            return found[0]
        out = scratch.keep(reduce(DataFrame.union, found), "links")
        scratch.drop(*found)
        return out

    def tested(pairs: DataFrame) -> DataFrame:
        """The pairs of keys (a, b) whose sets are similar enough."""
        ids = one.select("key", "id")
        pairs = scratch.keep(pairs, "pairs")
        # A set with many partners is dealt out with FAN of them at a time.
        fan = pairs.groupBy("a").agg((F.count("*") / FAN).cast("int").alias("fan"))
        dealt = pairs.join(fan, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("fan") + 1).cast("int").alias("salt"))
        hubs = dealt.select(F.col("a").alias("key"), F.col("a").alias("grp"), "salt").distinct()
        need = scratch.keep(hubs.union(dealt.select("b", "a", "salt")).join(ids, "key"), "need")
        scratch.drop(pairs)
        out = links_in(need, ["grp", "salt"], ["key"], F.col("key") != F.col("grp"), _verify(percent))
        scratch.drop(need)
        return out

    def searched(comp: DataFrame) -> DataFrame:
        """Links (a, b) between components: of any two that similar sets join, directly or over others."""
        large = comp.join(comp.groupBy("comp").agg(F.count("*").alias("size")), "comp").select(F.col("node").alias("key"), "comp", "size")
        own = lists.select("place", "key").join(if_small(scratch.keep(large, "large")), "key", "left").withColumns({"comp": F.coalesce("comp", "key"), "size": F.coalesce("size", F.lit(1).cast("long"))})
        token = F.expr(f"shiftright(place, {SALT_BITS})").alias("token")
        # Lists in one place hold LIST entries or a few times that; those of several places meet as sums.
        whole = Window.partitionBy("place")
        seen = {"lo": F.min("comp"), "hi": F.max("comp"), "top": F.max(F.struct("size", "comp"))}
        usual = own.where(f"place % {1 << SALT_BITS} = 0").withColumns({k: v.over(whole) for k, v in seen.items()}).where("lo <> hi").select(token, "key", "comp", "size", "top")
        hot = own.where(f"place % {1 << SALT_BITS} <> 0").select(token, "key", "comp", "size")
        span = hot.groupBy("token").agg(*[v.alias(k) for k, v in seen.items()]).where("lo <> hi").select("token", "top")
        own = scratch.keep(usual.union(hot.join(span, "token").select("token", "key", "comp", "size", "top")), "open")
        scratch.drop(lists)
        place = own.groupBy("key").agg(F.first("comp").alias("comp"), F.first("size").alias("size"), F.max("top").alias("home"))
        place = scratch.keep(place, "place")
        parts = place.groupBy("home").agg(F.ceil(F.sum(F.pow(F.lit(2.0), size_of("key") / STEP)) / BLOCK).alias("parts"))
        blocks = place.join(parts, "home").select("key", "comp", "size", F.xxhash64("home", F.pmod(F.xxhash64("key"), "parts")).alias("block"))
        blocks = scratch.keep(blocks, "blocks")
        scratch.drop(place)
        met = scratch.keep(own.select("token", "key", F.struct("size", "comp").alias("mine")).join(if_small(blocks.select("key", "block")), "key"), "met")
        scratch.drop(own)
        size = size_of("key")
        held = met.groupBy("token", "block").agg(F.max("mine").alias("above"), F.min(size).alias("lo"), F.max(size).alias("hi"))
        close = (size <= F.col("hi") + apart) & (size >= F.col("lo") - apart)
        enough = F.col("met") >= least_c(F.least(size_of("key"), F.col("lo")))
        asks = met.drop("block").join(held, "token").where("mine < above").where(close)
        asks = asks.groupBy("key", "block").agg(F.count("*").alias("met"), F.min("lo").alias("lo")).where(enough)
        asks = scratch.keep(asks.select("key", "block"), "asks")
        # Likewise, of a block's sets only those take part that hold enough of the lists of its queries.
        asked = met.drop("block").join(if_small(asks), "key").groupBy("token", "block").agg(F.min("mine").alias("below"), F.min(size).alias("lo"), F.max(size).alias("hi"))
        takes = met.join(asked, ["token", "block"]).where("mine > below").where(close)
        takes = scratch.keep(takes.groupBy("key", "block").agg(F.count("*").alias("met"), F.min("lo").alias("lo")).where(enough).select("key"), "takes")
        scratch.drop(met)
        # A block that many sets ask is dealt out with ASKS queries at a time.
        salts = asks.groupBy("block").agg((F.floor(F.count("*") / ASKS) + 1).alias("salts"))
        kept = blocks.join(takes, "key").join(salts, "block").select("key", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("query"), "comp", "size")
        sent = asks.join(salts, "block").join(blocks.select("key", "comp", "size"), "key").select("key", "block", F.pmod(F.xxhash64("key"), "salts").alias("salt"), F.lit(True).alias("query"), "comp", "size")
        need = scratch.keep(kept.union(sent).join(one.select("key", "id"), "key"), "need")
        scratch.drop(asks, takes, blocks)
        out = links_in(need, ["block", "salt"], ["query", "key", "comp", "size"], "query", _search(percent))
        scratch.drop(need)
        return out

    # First round: neighbours and heads of lists.
    tries = lists.where("next is not null").select(F.col("next").alias("x"), F.col("key").alias("y")).union(lists.where("head is not null").select("head", "key"))
    tries = tries.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("met"))
    links = tested(tries.where(F.col("met") >= F.least(least_c(size_of("a")), least_c(size_of("b")))).select("a", "b"))
    comp = scratch.keep(components(scratch, links), "comp")

    # Second round: whatever no link connects yet.
    more = searched(comp)
    scratch.drop(comp)
    comp = scratch.keep(components(scratch, links.union(more)), "comp")
    scratch.drop(links, more)

    # Classes of equal sets, then components; the smallest doc_id names each.
    name = one.join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    least = name.groupBy("comp").agg(F.min("least").alias("component_id"))
    name = scratch.keep(name.join(least, "comp").select("k1", "k2", "comp", "component_id"), "names")
    scratch.drop(comp, reps)
    full = rows.where("k1 is not null").join(name, ["k1", "k2"]).select("doc_id", "rid", "th", "n", "comp", "component_id")
    empty = rows.where("k1 is null").select("doc_id", "rid", "th", "n", F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("component_id"))
    scratch.at_exit()
    return full.union(empty)


def jaccard_links(docs: DataFrame, percent: int = PERCENT, extra: int = EXTRA) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (columns doc_id, text)."""
    found = classes(docs, Scratch(docs.sparkSession, "ngram"), percent, extra)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, percent: int = PERCENT, extra: int = EXTRA) -> DataFrame:
    """Of each component of docs the row of smallest doc_id (rows without one come last), with all its columns.

    Rows without words are linked with nothing and stay. Rows that repeat both an id (or null) and a text are one: the
    smallest, column by column (any of them, where a column has no order).
    """
    scratch = Scratch(docs.sparkSession, "ngram")
    found = classes(docs, scratch, percent, extra)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "rid", "th")).alias("f")
    stay = found.where("comp is not null").groupBy("comp").agg(first).select("f.rid", "f.th").union(found.where("comp is null").select("rid", "th").distinct())
    stay = scratch.keep(stay, "stay")
    rid, th = row_keys("row.doc_id", "row.text")
    rows = row_of(docs).withColumns({"rid": rid, "th": th})
    # Repeated rows go before the shuffle, task by task; the join finds the rows dealt out as it needs them.
    ordered = not re.search("map<|variant|calendar", docs.schema.simpleString())
    rows = rows.groupBy("rid", "th").agg((F.min if ordered else F.first)("row").alias("row"))
    return rows.join(stay, ["rid", "th"], "left_semi").select("row.*")
