"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows are its runs of ``window`` words (an item of fewer words is one window). A window is the set of
its shingles; containment needs all of them, so the necessary prefix is one: its rarest shingle, in the order of
counts over all documents. Documents are joined on those prefix shingles alone. A meeting gives the only place
where the window can lie (positional bound), which must fit in the text (length bound); there the words are
compared exactly, bytes and all.

Items come in blocks of at most ``block_bytes`` of text, each an index of sorted arrays (some 60 bytes a word) that is
sent to the executors and dropped after use; more items mean more blocks, each a pass over all rows that adds what it
finds to them. Rows keep
all their columns on the way, so a stage that drops rows needs no join.

Defined results: a null or empty text has no words and is clean; items that are null, without words or without
id never occur; an item_id on several rows counts once; repeated documents stay; a null doc_id keeps its row; an empty
table gives an empty one; further columns of documents, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ferrule.llm.common import ALNUM, Scratch, chunks, field, hash_words, mix, prepare, row_of, shingle_hashes, tidy

WINDOW, SHINGLE, MIN_ITEMS, BLOCK_BYTES = 8, 4, 2, 8 << 20
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Positions of x that are among the keys: a 16-bit table of leading bits turns most away before the binary search."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    top = np.zeros(1 << 16, bool)
    top[(sorted_keys >> np.uint64(48)).astype(np.int64)] = True
    at = np.flatnonzero(top[(x >> np.uint64(48)).astype(np.int64)])
    y = x[at]
    k = np.minimum(np.searchsorted(sorted_keys, y), len(sorted_keys) - 1)
    return at[sorted_keys[k] == y]


def ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges laid end to end: which one each number is of, and the number."""
    size = stop - start
    which = np.repeat(np.arange(len(start)), size)
    return which, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + start[which]


class Index:
    """Distinct windows of one block of items: where their words lie in the items' text, who owns them, their prefix."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        data = [t.encode() for _, t in items]
        self.low = b"".join(data).lower()
        offs = np.concatenate(([0], np.cumsum([len(x) for x in data]))).astype(np.int64)
        h, first, self.s, self.e = hash_words(np.frombuffer(self.low, np.uint8), offs, ALNUM)
        self.items = sorted({i for i, _ in items})
        rank = {x: k for k, x in enumerate(self.items)}
        n = np.diff(first)
        k = np.minimum(n, window)
        item, start = ranges(first[:-1], np.where(n > 0, first[1:] - k + 1, first[:-1]))
        size, owner = k[item], np.array([rank[i] for i, _ in items], np.int64)[item]
        # Two hashes of 64 bits tell windows apart; what they find is compared word by word.
        a, b = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
        for m in np.unique(size).tolist():
            at = size == m
            a[at], b[at] = shingle_hashes(h, m)[start[at]], shingle_hashes(mix(h ^ np.uint64(0x5851F42D4C957F2D)), m)[start[at]]
        order = np.lexsort((owner, b, a))
        a, b, start, size, owner = a[order], b[order], start[order], size[order], owner[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
        self.hash, self.start, self.size = a[new], start[new], size[new]
        self.owner, self.own = owner, np.append(np.flatnonzero(new), len(owner))
        self.length = np.minimum(self.size, shingle)  # of its shingles, in words
        self.grams = {g: shingle_hashes(h, g) for g in np.unique(self.length).tolist()}
        self.tokens = {}
        for g in self.grams:
            w = np.flatnonzero(self.length == g)
            _, at = ranges(self.start[w], self.start[w] + self.size[w] - g + 1)
            self.tokens[g] = np.unique(self.grams[g][at])

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Choose each window's prefix: its rarest shingle, the first of equally rare ones."""
        self.prefix = {}
        for g, tokens in self.tokens.items():
            w = np.flatnonzero(self.length == g)
            which, at = ranges(self.start[w], self.start[w] + self.size[w] - g + 1)
            n = counts[g][np.searchsorted(tokens, self.grams[g][at])]
            best = np.lexsort((at, n, which))
            best = best[np.concatenate(([True], np.diff(which[best]) > 0))]  # the first row of each window
            at = at[best]
            key = self.grams[g][at]
            by = np.argsort(key, kind="stable")
            self.prefix[g] = key[by], (at - self.start[w])[by].astype(np.int32), w[by].astype(np.int32)
        self.grams = self.tokens = None  # have done their work; not sent on
        for k in ("s", "e", "start", "size", "own", "owner", "length"):
            setattr(self, k, getattr(self, k).astype(np.int32))

    def words(self, w: int) -> list[bytes]:
        i = int(self.start[w])
        return [self.low[self.s[j] : self.e[j]] for j in range(i, i + int(self.size[w]))]

    def find(self, buf: np.ndarray, h: np.ndarray, first: np.ndarray, s: np.ndarray, e: np.ndarray):
        """(text, first word, end, window) of every occurrence, arrays."""
        hits = []
        for g, (keys, offset, window) in self.prefix.items():
            x = shingle_hashes(h, g)
            at = member(keys, x)
            which, entry = ranges(np.searchsorted(keys, x[at]), np.searchsorted(keys, x[at], "right"))
            a, w = at[which] - offset[entry], window[entry]
            b = a + self.size[w]
            doc = np.searchsorted(first, at[which], "right") - 1
            fits = (a >= first[doc]) & (b <= first[doc + 1])
            doc, a, b, w = doc[fits], a[fits], b[fits], w[fits]
            same = np.zeros(len(a), bool)
            for k in np.unique(self.size[w]).tolist():
                own = np.flatnonzero(self.size[w] == k)
                same[own] = shingle_hashes(h, k)[a[own]] == self.hash[w[own]]
            hits.append(np.stack([doc[same], a[same], b[same], w[same]], 1))
        hits = np.concatenate(hits) if hits else np.zeros((0, 4), np.int64)
        if len(hits):
            low = buf.tobytes().lower()
            known: dict[int, list[bytes]] = {}
            right = []
            for _, a, b, w in hits.tolist():
                if w not in known:
                    known[w] = self.words(w)
                right.append([low[s[i] : e[i]] for i in range(a, b)] == known[w])
            hits = hits[right]
        return hits[np.lexsort((hits[:, 1], hits[:, 0]))]

    def items_of(self, windows: np.ndarray) -> list[str]:
        _, at = ranges(self.own[windows], self.own[windows + 1])
        return [self.items[k] for k in np.unique(self.owner[at])]


def _count(index):
    def run(batches):
        tokens = index.value.tokens
        total = {g: np.zeros(len(v), np.int64) for g, v in tokens.items()}
        for batch in batches:
            for _, _, buf, offs in chunks(batch.column(0)):
                h, first, _, _ = hash_words(buf, offs, ALNUM)
                for g, keys in tokens.items():
                    x = shingle_hashes(h, g)
                    at = member(keys, x)
                    doc_end = first[1:][np.searchsorted(first[1:], at, "right")] if len(at) else at
                    total[g] += np.bincount(np.searchsorted(keys, x[at[at + g <= doc_end]]), minlength=len(keys))
        for g, n in total.items():
            hit = np.flatnonzero(n)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), g), pa.int32()), pa.array(hit, pa.int32()), pa.array(n[hit])], ["g", "token", "n"])

    return run


def merged(flat: list[int]) -> tuple[int, list[int]]:
    """Numbers covered by spans (start, end, start, end, ...), and the spans without overlaps, in order."""
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return sum(out[1::2]) - sum(out[::2]), out


def _scan(index, more: bool, last: bool, min_items: int):
    """more: the rows hold what earlier blocks found. last: no block follows."""

    def run(batches):
        x: Index = index.value
        for batch in batches:
            n = batch.num_rows
            words = np.zeros(n, np.int64)
            items: list[list[str]] = batch.column("items").to_pylist() if more else [[] for _ in range(n)]
            spans: list[list[int]] = batch.column("spans").to_pylist() if more else [[] for _ in range(n)]
            for i, j, buf, offs in chunks(field(batch, "text", pa.string())):
                h, first, s, e = hash_words(buf, offs, ALNUM)
                words[i:j] = np.diff(first)
                hits = x.find(buf, h, first, s, e)
                cut = np.searchsorted(hits[:, 0], np.arange(j - i + 1))
                for d in np.unique(hits[:, 0]).tolist():
                    own = hits[cut[d] : cut[d + 1]]
                    items[i + d] = sorted({*items[i + d], *x.items_of(np.unique(own[:, 3]))})
                    spans[i + d] = merged(spans[i + d] + (own[:, 1:3] - first[d]).ravel().tolist())[1]
            row = batch.column("row")
            if not last:
                yield pa.RecordBatch.from_arrays([row, pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32()))], ["row", "items", "spans"])
                continue
            cols = [pa.array(words), pa.array([merged(v)[0] for v in spans], pa.int64()), pa.array([len(v) for v in items], pa.int64()), pa.array([hashlib.sha256(",".join(v).encode()).hexdigest() for v in items], pa.string()), pa.array([len(v) >= min_items for v in items], pa.bool_())]
            yield pa.RecordBatch.from_arrays([row, *cols], ["row", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return run


def blocks_of(items: DataFrame, block_bytes: int):
    """Items in blocks of bounded text size; the split is by hash of the item's id and text."""
    items = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-size // max(1, block_bytes // 2)) if size > block_bytes else 1
    for k in range(n):
        yield k + 1 == n, [(r.item, r.text) for r in (items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items).collect()]


def flagged(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, min_items: int = MIN_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of docs as the struct row, with n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "decontam")
    rows, own, kept = row_of(docs), StructField("row", docs.schema), None
    found = StructType.fromDDL("items array<string>, spans array<int>").fields
    # One block's index at a time, here and on the executors.
    for last, block in blocks_of(items, block_bytes):
        index = Index(block, window, shingle)
        counts = {g: np.zeros(len(v), np.int64) for g, v in index.tokens.items()}
        if len(index.hash):
            shared = spark.sparkContext.broadcast(index)
            for r in docs.select(F.col("text").cast("string")).mapInArrow(tidy(_count(shared)), "g int, token int, n long").groupBy("g", "token").agg(F.sum("n").alias("n")).toLocalIterator():  # at most the block's shingles
                counts[r.g][r.token] = r.n
            shared.destroy()
        index.order(counts)
        shared = spark.sparkContext.broadcast(index)
        schema = StructType([own, *(StructType.fromDDL(RESULT).fields if last else found)])
        rows = rows.mapInArrow(tidy(_scan(shared, kept is not None, last, min_items)), schema)
        if not last:
            rows, before = scratch.keep(rows, "rows"), kept
            kept = rows
            shared.destroy()
            if before is not None:
                scratch.drop(before)
    if kept is not None:
        scratch.at_exit()
    return rows


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return flagged(docs, items, **options).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def decontaminated(docs: DataFrame, items: DataFrame, min_items: int = 1, **options) -> DataFrame:
    """The rows of docs that hold windows of fewer than min_items items."""
    return flagged(docs, items, min_items=min_items, **options).where("not contaminated").select("row.*")
