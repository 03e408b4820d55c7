"""Mixing sources to target weights by soft membership, in DataFrame operations alone.

A classifier learned from a labelled table (naive Bayes over 2**BITS hashed words; a table of so many rows,
whatever the input) gives each document d posteriors p[d, k] over the domains k. With n[d] words and T words in
all, rates r[d] >= 0 are sought whose expected domain totals ``s[k] = sum(r[d] * n[d] * p[d, k]) / T`` meet
the targets t: least squares ``(s - t)' W (s - t)`` by projected gradient,

    r[d] <- max(0, r[d] - p[d] . W (s - t)),

where W is the inverse of ``G[k, l] = sum(n[d] * p[d, k] * p[d, l]) / T``. In the metric that weighs documents by
their words this is a step of length 1 = 1 / L. A step is one pass over the table of posteriors that sums as many
numbers as there are domains; the rates of the last steps are written to the shared folder every few steps. The fit ends
when the targets are met, when a step changes no share any more (they can't be met: the least squares are reached) or
after ``STEPS``; where they are not met, it warns and tells the shares it has.

Words are runs without space, A-Z lower-cased by the session's lower(). Defined results: null, empty and wordless
texts have no words and the prior's posteriors; their rate follows from them alone. Repeated rows stay, with equal
rates. Targets are scaled to sum 1; a domain without labelled rows has posterior 0 and its target can't be met;
without any labelled row all rates are 1 and the domain is null; an empty table gives an empty one; texts of any length
count whole; further columns don't matter.
"""

from __future__ import annotations

import warnings
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import Scratch, row_of

BITS, SAMPLE, STEPS, WRITE_EVERY, TOLERANCE = 13, 5000, 60, 8, 1e-7


def _words(docs: DataFrame, *keep) -> DataFrame:
    """A row a word (empty ones too): bucket, whether it is a word, whether it is the row's first."""
    text = F.coalesce(F.lower("text"), F.lit(""))
    words = docs.select(*keep, F.posexplode(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ", -1)).alias("pos", "word"))
    return words.withColumns({"real": F.when(F.col("word") != "", 1).otherwise(0), "head": F.when(F.col("pos") == 0, 1).otherwise(0), "bucket": F.when(F.col("word") != "", F.pmod(F.xxhash64("word"), F.lit(1 << BITS)))})


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE):
    """Table bucket, l0, l1, ... of log-probabilities, and the log-priors. About ``sample`` labelled rows are learned from."""
    domain = F.col("domain")
    labelled = labelled.select("doc_id", "domain").where("doc_id is not null").where(domain.isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sizes = {r.domain: r.n for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return None, None
    part = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1, sample / total)) + (total <= sample))
    words = _words(docs.where("doc_id is not null").join(part, "doc_id"), "domain").where("real = 1")
    counts = words.groupBy("bucket").agg(*[F.sum(F.when(domain == d, 1.0).otherwise(0.0)).alias(f"c{k}") for k, d in enumerate(domains)])
    totals = counts.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0.0)).alias(f"c{k}") for k in range(len(domains))]).first()
    smooth = 0.5
    table = counts.select("bucket", *[F.log((F.col(f"c{k}") + smooth) / (totals[k] + smooth * (1 << BITS))).alias(f"l{k}") for k in range(len(domains))])
    unseen = [float(np.log(smooth / (totals[k] + smooth * (1 << BITS)))) for k in range(len(domains))]
    priors = [float(np.log(sizes[d] / total)) if d in sizes else float("-inf") for d in domains]
    return table, (priors, unseen)


def posteriors(docs: DataFrame, model, domains: list[str]) -> DataFrame:
    """doc_id, h (hash of the text), copies, n (words) and p0, p1, ... of each distinct document."""
    table, (priors, unseen) = model
    words = _words(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), "doc_id", "h")
    ks = range(len(domains))
    scored = words.join(F.broadcast(table), "bucket", "left")
    sums = scored.groupBy("doc_id", "h").agg(
        F.sum("head").alias("copies"), F.sum("real").alias("n"), *[F.sum(F.when(F.col("real") == 1, F.coalesce(F.col(f"l{k}"), F.lit(unseen[k]))).otherwise(0.0)).alias(f"s{k}") for k in ks]
    )
    sums = sums.select("doc_id", "h", "copies", (F.col("n") / F.col("copies")).cast("long").alias("n"), *[(F.col(f"s{k}") / F.col("copies") + F.lit(priors[k])).alias(f"s{k}") for k in ks])
    most = F.greatest(*[F.col(f"s{k}") for k in ks]) if len(domains) > 1 else F.col("s0")
    sums = sums.select("doc_id", "h", "copies", "n", *[F.exp(F.col(f"s{k}") - most).alias(f"e{k}") for k in ks])
    whole = sum((F.col(f"e{k}") for k in ks), F.lit(0.0))
    return sums.select("doc_id", "h", "copies", "n", *[(F.col(f"e{k}") / whole).alias(f"p{k}") for k in ks])


class Report(NamedTuple):
    """How a fit ended: steps taken, and the domains' shares of all words, expected and asked for."""

    steps: int
    shares: list[float]
    targets: list[float]

    @property
    def met(self) -> bool:
        return max((abs(a - b) for a, b in zip(self.shares, self.targets, strict=True)), default=0.0) < 100 * TOLERANCE


def fit_rates(table: DataFrame, targets: list[float], scratch: Scratch, steps: int = STEPS) -> tuple[DataFrame, Report]:
    """The table with column rate, and how the fit ended. Sums over documents are made by the executors; only D and D * D numbers return."""
    ks = range(len(targets))
    weight = F.col("n") * F.col("copies")
    pairs = [(k, j) for k in ks for j in ks if j >= k]
    first = table.agg(F.coalesce(F.sum(weight), F.lit(0)).cast("double").alias("t"), *[F.coalesce(F.sum(weight * F.col(f"p{k}") * F.col(f"p{j}")), F.lit(0.0)).alias(f"g{k}_{j}") for k, j in pairs]).first()
    total = first.t
    table = table.withColumn("rate", F.lit(1.0))
    goal = np.array(targets) / sum(targets)
    if not total:
        return table, Report(0, [0.0] * len(targets), goal.tolist())
    g = np.zeros((len(targets), len(targets)))
    for k, j in pairs:
        g[k, j] = g[j, k] = first[f"g{k}_{j}"] / total
    inverse = np.linalg.pinv(g, rcond=1e-9)
    last = written = None
    for step in range(steps + 1):
        s = np.array(table.agg(*[F.sum(weight * F.col("rate") * F.col(f"p{k}")).alias(f"s{k}") for k in ks]).first()) / total
        if step == steps or np.abs(s - goal).max() < TOLERANCE or last is not None and np.abs(s - last).max() < TOLERANCE / 100:
            break
        last = s
        pull = (inverse @ (s - goal)).tolist()
        move = sum((F.col(f"p{k}") * F.lit(pull[k]) for k in ks), F.lit(0.0))
        table = table.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - move))
        if (step + 1) % WRITE_EVERY == 0:
            table, old = scratch.keep(table, "rates"), written
            written = table
            if old is not None:
                scratch.drop(old)
    return table, Report(step, s.tolist(), goal.tolist())


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], sample: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """doc_id, h, copies, n_words, domain (likeliest), rate of each distinct document (doc_id, text). Warns if the targets are not met."""
    scratch = Scratch(docs.sparkSession, "mixing")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    domains = sorted(targets)
    model = classifier(docs, labelled, domains, sample)
    if model[0] is None:
        rows = docs.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
        n = F.size(F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", "     "), " ", -1), "")).cast("long")
        return rows.select("doc_id", "h", "copies", n.alias("n_words"), F.lit(None).cast("string").alias("domain"), F.lit(1.0).alias("rate"))
    table = scratch.keep(posteriors(docs, model, domains), "posteriors")
    scratch.at_exit()
    table, report = fit_rates(table, [float(targets[d]) for d in domains], scratch, steps)
    if not report.met:
        warnings.warn(f"after {report.steps} steps the shares of {domains} are {report.shares}, not {report.targets}", stacklevel=2)
    most = F.greatest(*[F.col(f"p{k}") for k in range(len(domains))]) if len(domains) > 1 else F.col("p0")
    domain = F.coalesce(*[F.when(F.col(f"p{k}") == most, F.lit(d)) for k, d in enumerate(domains)])
    return table.select("doc_id", "h", "copies", F.col("n").alias("n_words"), domain.alias("domain"), "rate", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(domains)])


def mixed(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """The rows of docs as often as their rates say: the whole part, and once more where a hash of the id falls below the rest."""
    times = F.floor("rate") + F.when(F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1_000_000)) < (F.col("rate") - F.floor("rate")) * 1_000_000, 1).otherwise(0)
    times = rates.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), times.cast("int").alias("_times")).where("_times > 0")
    rows = row_of(docs).join(times, F.col("row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("_h")))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("row.*")


#: Domains of the labelled table and the weights that the query and the pipeline ask for.
TARGETS = {"good": 0.88, "low": 0.08, "toxic": 0.04}


def labelled_domains(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.expr("case when toxic = 1 then 'toxic' when quality = 0 then 'low' when quality = 1 then 'good' end").alias("domain"))
