"""Exact kNN, post-filter, BM25 blend, MMR selection, ranks.

A single query is folded into the plan as a literal, so the top k is TakeOrderedAndProject: one pass, k rows a task.
A query set is sent to the executors in blocks of bounded size; matrix products keep k rows of each query and task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import text as T

FETCH_K, FILTERED_FETCH = 50, 200
#: Bytes of a block of queries; queries of one matrix product.
QUERY_BYTES, QUERIES = 64 << 20, 256


def fetch_size(limit: int, filtered: bool) -> int:
    n = max(limit, min(FETCH_K, 100))
    return max(n, FILTERED_FETCH) if filtered else n


def knn(items: DataFrame, query: list[float], k: int, metric: str = "cosine", vector: str = "embedding", key: str = "item_id") -> DataFrame:
    """The k nearest items with column distance; ties go to the smaller key. Items without a distance (no vector, no length) are no hits."""
    q = F.array(*[F.lit(float(v)) for v in query])
    d = T.distance(F.col(vector), q, metric)
    if metric not in ("l1", "l2"):  # the query's norm is known: leave it out of the rows' work
        norm = sum(float(v) ** 2 for v in query) ** 0.5
        x = F.col(vector).cast("array<double>")
        dot = F.aggregate(F.zip_with(x, q, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        own = F.sqrt(F.aggregate(F.transform(x, lambda a: a * a), F.lit(0.0), lambda s, v: s + v))
        d = 1 - F.try_divide(dot, own * F.lit(norm))
    return items.withColumn("distance", d).where("distance is not null").orderBy("distance", key).limit(k)


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l1":
        return np.stack([np.abs(x - v).sum(1) for v in q])
    if metric == "l2":
        return np.stack([np.sqrt(((x - v) ** 2).sum(1)) for v in q])
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - (q @ x.T) / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None])


def _nearest(shared, k: int, metric: str):
    """The k nearest of a task's items to each query: matrix products of Arrow batches, k rows a query held."""

    def best(rows, keys, d):
        order = np.lexsort((keys, d, rows))
        rows, keys, d = rows[order], keys[order], d[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        return rows[keep], keys[keep], d[keep]

    def run(batches):
        ids, q = shared.value
        held = None
        floor = np.full(len(q), np.inf)
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            size = np.asarray(pa.compute.list_value_length(batch.column(1)).fill_null(-1))
            fits = np.flatnonzero((size == q.shape[1]) & ~np.asarray(batch.column(0).is_null()))
            keys = np.array(batch.column(0).take(pa.array(fits)).to_pylist())
            flat = pa.compute.list_flatten(batch.column(1).take(pa.array(fits))).cast(pa.float64()).fill_null(np.nan)
            x = np.asarray(flat).reshape(len(fits), q.shape[1])
            for i in range(0, len(q), QUERIES):
                d = _distances(q[i : i + QUERIES], x, metric)
                d[np.isnan(d)] = np.inf
                least = np.minimum(floor[i : i + QUERIES], np.partition(d, k - 1, 1)[:, k - 1] if d.shape[1] > k else np.inf)
                r, c = np.nonzero((d <= least[:, None]) & (d < np.inf))
                if not len(r):
                    continue
                new = (r + i, keys[c], d[r, c])
                rows, found, dist = best(*(new if held is None else [np.concatenate(p) for p in zip(held, new, strict=True)]))
                held = rows, found, dist
                full = np.flatnonzero(np.bincount(rows, minlength=len(q)) == k)
                floor[full] = dist[np.searchsorted(rows, full, "right") - 1]
        if held is not None:
            rows, found, dist = held
            yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in rows], type=shared.kind), pa.array(found.tolist(), type=kind), pa.array(dist)], ["query_id", "key", "distance"])

    return run


class _Queries:
    """A block of queries as the tasks see it: ids and a matrix."""

    def __init__(self, spark, ids, matrix, kind):
        self.sent, self.kind = spark.sparkContext.broadcast((ids, matrix)), kind

    @property
    def value(self):
        return self.sent.value


def knn_batch(items: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "item_id", block_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, key, distance, rank of the k nearest items of each query (query_id, query).

    Queries go out in blocks of at most ``block_bytes``; each block reads the items once, key and vector alone. A task holds
    k rows a query, and a window merges the tasks' rows.
    """
    spark = items.sparkSession
    queries = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).where("query_id is not null and query is not null")
    sizes = queries.agg(F.count("*").alias("n"), F.max(F.size("query")).alias("dim")).first()
    n = max(1, -(-sizes.n * (sizes.dim or 0) * 8 // block_bytes))
    kinds = dict(queries.dtypes)["query_id"], dict(items.dtypes)[key]
    out = spark.createDataFrame([], f"query_id {kinds[0]}, key {kinds[1]}, distance double")
    for b in range(n):
        rows = (queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b)).toArrow()
        for dim in sorted({len(v) for v in rows.column("query").to_pylist()} - {0}):
            part = [(i, v) for i, v in zip(rows.column("query_id").to_pylist(), rows.column("query").to_pylist(), strict=True) if len(v) == dim]
            shared = _Queries(spark, [i for i, _ in part], np.array([v for _, v in part], float), rows.schema.field("query_id").type)
            found = items.select(key, F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_nearest(shared, k, metric), out.schema)
            out = out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "key"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("key", key)


def filtered(hits: DataFrame, where: dict | None) -> DataFrame:
    """Equality conditions {field: value} or {field: {"$eq": value}}, all of them."""
    for field, v in (where or {}).items():
        hits = hits.where(F.col(field) == (v["$eq"] if isinstance(v, dict) else v))
    return hits


def _statistics(sized: DataFrame, terms: list[str], epsilon: float) -> DataFrame:
    """One row: n_docs, avg_size, least (epsilon times the mean idf of all terms), and the documents of each term (n0, n1, ...).

    One pass: a row of a document's size goes with its distinct words through one aggregation by word.
    """
    size_row = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size("_words").cast("long").alias("size")))
    word_rows = F.transform(F.array_distinct("_words"), lambda w: F.struct(w.alias("term"), F.lit(0).cast("long").alias("size")))
    by_word = sized.select(F.explode(F.concat(size_row, word_rows)).alias("w")).groupBy("w.term").agg(F.count("*").alias("n"), F.sum("w.size").alias("size"))
    # Words by how many documents have them: few rows, whatever the corpus, beside the row of totals.
    total = F.col("term").isNull()
    own = [F.max(F.when(F.col("term") == t, F.col("n"))).alias(f"n{i}") for i, t in enumerate(terms)]
    by_n = by_word.groupBy("n", total.alias("whole")).agg(F.count("*").alias("words"), F.max("size").alias("size"), *own)
    every = Window.partitionBy()
    rows = by_n.withColumns({"n_docs": F.max(F.when(F.col("whole"), F.col("n"))).over(every), "avg_size": F.max(F.when(F.col("whole"), F.col("size") / F.col("n"))).over(every)})
    idf = F.when(~F.col("whole"), F.ln((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    mean = F.try_divide(F.sum(idf * F.col("words")), F.sum(F.when(~F.col("whole"), F.col("words"))))
    return rows.agg(F.max("n_docs").alias("n_docs"), F.max("avg_size").alias("avg_size"), (mean * epsilon).alias("least"), *[F.max(f"n{i}").alias(f"n{i}") for i in range(len(terms))])


def bm25(candidates: DataFrame, terms: list[str], key: str = "item_id", document: str = "document", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """key, bm25 of each candidate; all statistics come from the candidates.

    ``idf = ln((N - n + .5) / (n + .5))``, a negative one replaced by epsilon times the mean over all terms. Two scans:
    one for the statistics, one for the scores, which are made row by row.
    """
    return with_bm25(candidates.select(key, document), terms, document, k1, b, epsilon).select(key, "bm25")


def with_bm25(candidates: DataFrame, terms: list[str], document: str = "document", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """Adds bm25 to the candidates."""
    asked = list(dict.fromkeys(terms))
    sized = candidates.withColumn("_words", T.tokens(document))
    if not asked:
        return candidates.withColumn("bm25", F.lit(0.0))
    rows = sized.withColumns({"_size": F.size("_words"), "_words": F.filter("_words", lambda w: w.isin(asked))}).crossJoin(F.broadcast(_statistics(sized.select("_words"), asked, epsilon)))
    score = F.lit(0.0)
    for i, t in enumerate(asked):
        tf, n = F.size(F.filter("_words", F.lit(t).eqNullSafe)), F.col(f"n{i}")
        raw = F.ln((F.col("n_docs") - n + 0.5) / (n + 0.5))
        idf = F.when(raw < 0, F.col("least")).otherwise(raw)
        score = score + F.when(tf > 0, terms.count(t) * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_size") / F.col("avg_size")))).otherwise(0.0)
    return rows.select(*candidates.columns, score.alias("bm25"))


def hybrid(hits: DataFrame, terms: list[str], alpha: float = 0.7, key: str = "item_id", document: str = "document") -> DataFrame:
    """Distance becomes 1 - (alpha * clipped similarity + (1 - alpha) * bm25 / largest bm25). Input order if nothing is to blend.

    hits are the k rows of a search: they are brought together once, and all statistics read them there.
    """
    if alpha >= 1 or not terms:
        return hits
    scored = with_bm25(hits.repartition(1), terms, document)
    top = F.max("bm25").over(Window.partitionBy())
    share = F.col("bm25") / F.when(top > 0, top).otherwise(1.0)
    score = alpha * F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("distance"))) + (1 - alpha) * share
    return scored.withColumn("distance", 1 - score).drop("bm25")


def mmr_order(documents: list[set], distances: list[float], limit: int, lam: float) -> list[int]:
    """Positions in order of selection: relevance against likeness to what is chosen already. Scores below -1 count as -1; of equals the first."""
    left, chosen = list(range(len(documents))), []
    likeness = [0.0] * len(documents)
    while left and len(chosen) < limit:
        best = max(left, key=lambda i: (max(-1.0, lam * (1 - distances[i]) - (1 - lam) * likeness[i]), -i))
        left.remove(best)
        chosen.append(best)
        for i in left:
            both = len(documents[i] & documents[best])
            likeness[i] = max(likeness[i], both / max(1, len(documents[i] | documents[best])))
    return chosen


def mmr(hits: DataFrame, limit: int, lam: float = 0.7, key: str = "item_id", document: str = "document", group: str | None = None) -> DataFrame:
    """Greedy selection with column rank. hits are the rows of a top-k search (of each group, if given): all of them take part."""
    by = [group] if group else []
    order = Window.partitionBy(*by).orderBy("distance", key)
    ranked = hits.withColumn("_at", F.row_number().over(order))
    if lam >= 1:
        return ranked.where(F.col("_at") <= limit).withColumnRenamed("_at", "rank")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        chosen = list(range(len(rows))) if len(rows) <= limit else mmr_order([set(w) for w in rows["_words"]], rows["distance"].tolist(), limit, lam)
        return rows.iloc[chosen][["_at", *by]].assign(rank=range(1, len(chosen) + 1))

    kind = f", {group} {dict(hits.dtypes)[group]}" if group else ""
    ranks = ranked.select("_at", "distance", T.tokens(document).alias("_words"), *by).groupBy(*by).applyInPandas(pick, f"_at int{kind}, rank int")
    return ranked.join(ranks, ["_at", *by]).drop("_at")


def formatted(hits: DataFrame, key: str = "item_id") -> DataFrame:
    """Adds rank (kept, where MMR set it) and relevance."""
    if "rank" not in hits.columns:
        hits = hits.withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))  # k rows
    return hits.withColumn("relevance", T.relevance("distance"))


def search(items: DataFrame, query: list[float], text: str, limit: int = 10, where: dict | None = None, alpha: float = 0.7, use_mmr: bool = True, lam: float = 0.7, metric: str = "cosine", prefilter: bool = False, key: str = "item_id") -> DataFrame:
    """kNN, filter, hybrid, MMR or cut, format."""
    import re

    terms = [t for t in re.split(r"\s+", re.sub(r"[^\w\s]", " ", text.lower())) if len(t) > 1]
    if prefilter:
        hits = knn(filtered(items, where), query, fetch_size(limit, bool(where)), metric, key=key)
    else:
        hits = filtered(knn(items, query, fetch_size(limit, bool(where)), metric, key=key), where)
    hits = hybrid(hits, terms, alpha, key)
    hits = mmr(hits, limit, lam, key) if use_mmr else hits.orderBy("distance", key).limit(limit)
    return formatted(hits, key)


def by_object(items: DataFrame, name: str, limit: int, key: str = "item_id") -> DataFrame:
    """Exact name, distance 0."""
    return formatted(items.where(F.col("object_name") == name).orderBy(key).limit(limit).withColumn("distance", F.lit(0.0)), key)
