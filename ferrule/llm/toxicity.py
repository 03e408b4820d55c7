"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, from a block-max inverted index.

Terms are words (runs of letters, A-Z lower-cased) and the first ``PREFIXES`` bytes of longer ones. Examples and documents
are unit vectors of ``(1 + ln tf) * idf`` over all their terms, ``idf = ln((1 + N) / (1 + df))`` with N and df counted over
all documents. A term that no example has is counted 0; it meets nothing and is only part of the document's length.

The index lists, for each term, its weights in the examples. Like examples lie together in blocks of ``BLOCK``. Long lists
(terms of more than one in ``COMMON`` examples) are stored by block, with the largest weight of each block beside them;
the others are plain posting lists. A query's short lists are merged first. The sum they give at most within a block, with the
query's long lists' block maxima, bounds every score of the block. Blocks with the highest bounds are scored first, in
batches of queries of the same kind; a block is left out where its bound does not reach any query's k-th score so far, so
the k nearest are exact. Votes are weighted by cosine; the raw vote becomes a probability by a monotone step function,
fitted on the votes that examples (one in ``JUDGED``) get from the others.

The labelled sample has about ``SAMPLE`` rows (by hash of the id; all, if there are fewer): a documented bound of
what is learned from; every document is scored by its whole text.

Defined results: null, empty and wordless texts have no terms and get the score of "no neighbours"; of equally near
examples the first in the index counts; repeated rows stay; labels that are null or of null doc_id are not learned
from; several labels of one id count as their largest; without labels all scores are 0; an empty table gives an empty
one; further columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import Scratch, blobs, chunks, hash_words, mix, prepare, summed, tidy
from ferrule.llm.langid import LETTERS

SAMPLE, K, BLOCK, COMMON, SMOOTH, PREFIXES = 6000, 40, 128, 24, 0.05, (4, 6)
CUT, SLICE, BATCH, JUDGED = 0.7, 1 << 16, 64, 2


def terms_of(buf, offs):
    """Hashes of all words of a chunk and of the prefixes of longer ones, with the number of the word; first word of each text."""
    h, first, s, e = hash_words(buf, offs, LETTERS)
    low = LETTERS[buf].astype(np.uint64)
    term, place = [h], [np.arange(len(h))]
    for n in PREFIXES:
        long = np.flatnonzero(e - s > n)
        p = np.full(len(long), n, np.uint64)
        for j in range(n):
            p = p * np.uint64(257) + low[s[long] + j]
        term.append(mix(p + np.uint64(0x5851F42D4C957F2D)))
        place.append(long)
    return np.concatenate(term), np.concatenate(place), first


def per_text(column):
    """Row, distinct terms in order, their counts, of each text that has words."""
    for i, j, buf, offs in chunks(column):
        term, place, first = terms_of(buf, offs)
        order = np.argsort(place, kind="stable")
        term, place = term[order], place[order]
        at = np.searchsorted(place, first)
        for d in range(j - i):
            if at[d + 1] > at[d]:
                yield i + d, *np.unique(term[at[d] : at[d + 1]], return_counts=True)


def _sample_terms(batches):
    for batch in batches:
        tox, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for row, term, n in per_text(batch.column(2)):
            one = [pa.array([tox[row]], pa.int32()), pa.array([ids[row]], pa.int64()), pa.array([term.view(np.int64)], pa.list_(pa.int64())), pa.array([n.astype(np.int32)], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(one, ["toxic", "doc_id", "terms", "counts"])


def _document_counts(keys):
    def run(batches):
        known = keys.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, term, _ in per_text(batch.column(0)):
                at = np.minimum(np.searchsorted(known, term), len(known) - 1)
                total[at[known[at] == term]] += 1
        yield from blobs(total, SLICE)

    return run


class Index:
    """Examples as unit vectors over ``keys`` (sorted term hashes)."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, n_docs: int):
        self.keys, self.idf = keys, np.log((1 + n_docs) / (1 + df)).astype(np.float32)
        self.unseen = float(np.log(1 + n_docs))
        self.steps = (np.array([-np.inf]), np.array([0.0]))

    def weigh(self, term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions among the keys and unit weights of a text's distinct terms; what lies outside only shortens them."""
        at = np.minimum(np.searchsorted(self.keys, term), len(self.keys) - 1) if len(self.keys) else np.zeros(len(term), np.int64)
        known = self.keys[at] == term if len(self.keys) else np.zeros(len(term), bool)
        tf = 1 + np.log(n)
        w = tf * np.where(known, self.idf[at] if len(self.keys) else 0.0, self.unseen)
        return at[known], (w[known] / max(float(np.sqrt((w * w).sum())), 1e-9)).astype(np.float32)

    def build(self, bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, ids: np.ndarray) -> None:
        """bags: positions among the keys and counts of each example."""
        n = len(bags)
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in bags)])
        count = np.concatenate([np.zeros(0, np.int64), *(c for _, c in bags)])
        owner = np.repeat(np.arange(n), [len(t) for t, _ in bags])
        # Like examples share blocks: each goes to the nearest of some of them, by what is in many.
        often = np.flatnonzero(np.bincount(term, minlength=len(self.keys)) * COMMON > n)
        dense = np.zeros((n, len(often)), np.float32)
        long = np.isin(term, often)
        dense[owner[long], np.searchsorted(often, term[long])] = (1 + np.log(count[long])) * self.idf[term[long]]
        leaders = dense[np.linspace(0, n - 1, min(n, 64)).astype(int)] if n else dense
        leaders = leaders / np.maximum(np.sqrt((leaders * leaders).sum(1, keepdims=True)), 1e-9)
        order = np.lexsort((ids, (dense @ leaders.T).argmax(1))) if n else np.zeros(0, np.int64)
        self.toxic, self.ids, self.n = toxic[order].astype(np.float32), ids[order], n
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        owner = place[owner]
        by = np.lexsort((owner, term))
        self.first = np.searchsorted(term[by], np.arange(len(self.keys) + 1)).astype(np.int32)
        self.owner, self.count = owner[by].astype(np.int16 if n < 1 << 15 else np.int32), count[by].astype(np.uint8 if count.max(initial=0) < 256 else np.int32)
        self._open()

    def __getstate__(self):
        # Sent as counts; weights and blocks are made where it is used.
        return {k: v for k, v in self.__dict__.items() if k not in ("weight", "short", "column", "long", "highest")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._open()

    def close(self) -> None:
        """Drop what is made from the rest: the driver has sent it and needs it no more."""
        self.__dict__ = self.__getstate__()

    def _open(self) -> None:
        n, df = self.n, np.diff(self.first)
        term = np.repeat(np.arange(len(self.keys)), df)
        weight = (1 + np.log(self.count.astype(np.float32))) * self.idf[term]
        weight /= np.maximum(np.sqrt(np.bincount(self.owner, weight.astype(float) ** 2, n)), 1e-9).astype(np.float32)[self.owner]
        often = df * COMMON > n
        self.column = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)  # of the long lists, -1 for the others
        self.n_blocks = -(-n // BLOCK)
        self.long = np.zeros((self.n_blocks, int(often.sum()), BLOCK), np.float32)
        long = often[term]
        self.long[self.owner[long] // BLOCK, self.column[term[long]], self.owner[long] % BLOCK] = weight[long]
        self.highest = np.ascontiguousarray(self.long.max(2).T)
        self.weight = weight

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = K, skip: np.ndarray | None = None):
        """Positions and cosines of the k nearest examples of each query, nearest first; a cosine of 0 is no neighbour.

        ``skip`` names a position that is no neighbour of each query.
        """
        n, size = len(queries), self.n_blocks * BLOCK
        who, cos = np.full((n, k), -1), np.zeros((n, k), np.float32)
        if not n or not size:
            return who, cos
        rows = np.repeat(np.arange(n), [len(t) for t, _ in queries])
        term, weight = np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries])
        column = self.column[term]
        long = column >= 0
        q = np.zeros((n, len(self.highest)), np.float32)
        q[rows[long], column[long]] = weight[long]
        # The short lists, one after the other, merged by place.
        rows, term, weight = rows[~long], term[~long], weight[~long]
        length = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - np.cumsum(length) + length, length) + np.arange(length.sum())
        scores = np.bincount(np.repeat(rows, length) * size + self.owner[at], np.repeat(weight, length) * self.weight[at], n * size).astype(np.float32).reshape(n, size)
        if skip is not None:
            scores[np.arange(n), skip] = -np.inf
        blocks = scores.reshape(n, self.n_blocks, BLOCK)
        used = np.flatnonzero(q.any(0))
        q = np.ascontiguousarray(q[:, used])
        bound = q @ self.highest[used] + np.maximum(blocks.max(2), 0)
        done = np.zeros(self.n_blocks, bool)

        def add(which):
            for b in which:
                blocks[:, b] += q @ self.long[b][used]
            done[which] = True

        few = max(-(-2 * k // BLOCK), self.n_blocks // 4)
        add(np.argsort(-bound.sum(0), kind="stable")[:few])

        def floor():
            own = scores.reshape(n, self.n_blocks, BLOCK)[:, done].reshape(n, -1)
            return -np.partition(-own, k - 1, 1)[:, k - 1] if own.shape[1] >= k else np.full(n, -np.inf)

        least = floor()
        rest = np.flatnonzero(~done & (bound >= np.maximum(least - 1e-5, 1e-9)[:, None]).any(0))
        if len(rest):
            add(rest)
            least = floor()
        blocks[:, ~done] = 0  # out of reach
        r, c = np.nonzero(scores >= np.maximum(least, 1e-9)[:, None])
        s = scores[r, c]
        order = np.lexsort((c, -s, r))
        r, c, s = r[order], c[order], s[order]
        i = np.arange(len(r)) - np.searchsorted(r, np.arange(n))[r]
        r, c, s, i = (x[i < k] for x in (r, c, s, i))
        who[r, i], cos[r, i] = c, s
        return who, cos

    def raw(self, who: np.ndarray, cos: np.ndarray) -> np.ndarray:
        """Distance-weighted vote; -1 where there is no neighbour."""
        near = who >= 0
        votes = (cos * near * self.toxic[np.maximum(who, 0)]).sum(1) if len(self.toxic) else np.zeros(len(who))
        return np.where(near.any(1), votes / ((cos * near).sum(1) + SMOOTH), -1.0)

    def calibrate(self, raw: np.ndarray, toxic: np.ndarray) -> None:
        """Pool adjacent violators: a monotone step function from votes to the part of toxic rows."""
        order = np.argsort(raw, kind="stable")
        levels: list[list[float]] = []
        for v, y in zip(raw[order], toxic[order], strict=True):
            if levels and levels[-1][0] == v:
                levels[-1][1] += y
                levels[-1][2] += 1
            else:
                levels.append([v, float(y), 1.0])
        pools: list[list[float]] = []
        for v, y, n in levels:
            pools.append([v, y, n])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                _, y2, n2 = pools.pop()
                pools[-1][1] += y2
                pools[-1][2] += n2
        self.steps = (np.array([-np.inf] + [p[0] for p in pools[1:]]), np.array([(p[1] + 0.02) / (p[2] + 0.1) for p in pools]))

    def score(self, raw: np.ndarray) -> np.ndarray:
        at, p = self.steps
        return np.clip(p[np.searchsorted(at, raw + 1e-12, "right") - 1], 0, 1)


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> Index | None:
    """Learn from labels (doc_id, toxic) of docs; idf from all docs. The sample's terms reach the driver, nothing else that grows."""
    spark = docs.sparkSession
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = labels.count()
    if not total:
        return None
    few = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1, sample / total)) + (total <= sample))
    few = scratch.keep(few, "few")  # of bounded size: about `sample` rows
    # A row that is repeated is one example.
    rows = scratch.keep(docs.join(F.broadcast(few), "doc_id").select("toxic", "doc_id", "text").distinct(), "sample")
    sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if not sums.n:
        return None
    found = rows.mapInArrow(tidy(_sample_terms), "toxic int, doc_id long, terms array<long>, counts array<int>").toArrow().combine_chunks()
    found = found.sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    toxic, ids = (np.asarray(found.column(c)) for c in ("toxic", "doc_id"))
    cuts = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.list_value_length(found.column("terms"))).astype(np.int64))))
    counts = np.asarray(pa.compute.list_flatten(found.column("counts")))
    keys, terms = np.unique(np.asarray(pa.compute.list_flatten(found.column("terms"))).view(np.uint64), return_inverse=True)
    del found
    terms = terms.astype(np.int32)
    shared = spark.sparkContext.broadcast(keys)
    df = summed(docs.select("text").mapInArrow(tidy(_document_counts(shared)), "slice int, counts binary"), len(keys), SLICE) if len(keys) else np.zeros(0)
    shared.destroy()
    index = Index(keys, df, docs.count())
    bags = [(terms[a:b], counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    index.build(bags, toxic, ids)
    del terms, counts
    # One of ``JUDGED`` examples is judged by all others.
    place = np.empty(len(ids), np.int64)
    place[np.lexsort((np.arange(len(ids)), ids))] = np.argsort(index.ids, kind="stable")
    judged = np.flatnonzero(mix(ids.astype(np.uint64)) % np.uint64(JUDGED) == 0) if len(ids) > 1000 else np.arange(len(ids))
    judged = judged[np.argsort(place[judged])]
    raw = np.zeros(len(judged))
    for i in range(0, len(judged), BATCH):
        part = judged[i : i + BATCH]
        raw[i : i + BATCH] = index.raw(*index.nearest([index.weigh(keys[bags[j][0]], bags[j][1]) for j in part], skip=place[part]))
    # Rows without any term have no vector: they are the pool of "no neighbours".
    blank, blank_toxic = sums.n - len(ids), sums.t - int(toxic.sum())
    index.calibrate(np.concatenate((raw, np.full(blank, -1.0))), np.concatenate((toxic[judged], np.arange(blank) < blank_toxic)))
    return index


def _judge(index, evidence):
    def run(batches):
        x: Index = index.value
        for batch in batches:
            n = batch.num_rows
            raw, near = np.full(n, -1.0), [[] for _ in range(n)]
            rows, vectors = [], []
            for row, term, count in per_text(batch.column(1)):
                rows.append(row)
                vectors.append(x.weigh(term, count))
            # Queries of one kind go together, so that they need the same blocks.
            kind = []
            for t, w in vectors:
                c = x.column[t] if len(x.keys) else t
                kind.append(int((w[c >= 0] @ x.highest[c[c >= 0]]).argmax()) if (c >= 0).any() else -1)
            by = np.argsort(np.array(kind), kind="stable") if kind else []
            for i in range(0, len(by), BATCH):
                part = by[i : i + BATCH]
                who, cos = x.nearest([vectors[j] for j in part])
                at = [rows[j] for j in part]
                raw[at] = x.raw(who, cos)
                if evidence:
                    for r, own in zip(at, who, strict=True):
                        near[r] = x.ids[own[own >= 0]].tolist()
            score = x.score(raw)
            cols, names = [batch.column(0), pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(near, pa.list_(pa.int64()))] if evidence else cols, [*names, "evidence"] if evidence else names)

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, evidence: bool = True) -> DataFrame:
    """doc_id, score, predicted and, if asked for, evidence (doc_ids of the nearest examples) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(spark, "toxicity")
    index = fit(docs, labels, scratch, sample)
    scratch.at_exit()
    more = ", evidence array<long>" if evidence else ""
    if index is None:
        none = [F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.expr("cast(array() as array<bigint>)").alias("evidence")]
        return docs.select("doc_id", *none[: 2 + evidence])
    shared = spark.sparkContext.broadcast(index)
    index.close()
    return docs.mapInArrow(tidy(_judge(shared, evidence)), f"doc_id long, score double, predicted int{more}")


def held_out(column: str = "doc_id"):
    return F.coalesce(F.expr(f"crc32(cast({column} as string)) % 3 = 1"), F.lit(False))
