"""Upserts and usages over a stream of records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions import text as T
from ferrule.operators.graph import upsert
from ferrule.plans.index import Folder

#: Parts that a table's keys are dealt over.
PARTS = 64


def latest(stream: DataFrame, keys: list[str], value: str, seq: str, late: str = "10 minutes") -> DataFrame:
    """A stateful last-writer-wins table of a stream; run with output mode update or complete."""
    if dict(stream.dtypes)[seq] == "timestamp_ntz":  # no watermark without a time zone: the session's
        stream = stream.withColumn(seq, F.col(seq).cast("timestamp"))
    return stream.withWatermark(seq, late).groupBy(*keys).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def usages(stream: DataFrame, name: str, text: str = "text") -> DataFrame:
    """Rows whose text uses the name: stateless, so any output mode will do."""
    return stream.where(F.col(text).rlike(T.usage_pattern(name)))


def merge_batches(target: str, keys: list[str], seq: list[str], parts: int = PARTS):
    """For foreachBatch: each batch merged into a table dealt over parts by its keys.

    A batch writes the parts it touches, beside the old ones, and then takes them up in ``manifest.json`` in one step; a batch
    that runs again after that changes nothing, one that broke off before is written anew. Old parts go.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark, folder = batch.sparkSession, Folder(batch.sparkSession, target)
        known = json.loads(folder.text("manifest.json") or '{"epoch": -1, "parts": {}}')
        if epoch <= known["epoch"]:
            return
        batch = batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).persist()
        touched = {str(r.part) for r in batch.select("part").distinct().collect()}  # at most `parts` numbers
        old = {k: e for k, e in known["parts"].items() if k in touched}
        rows = batch
        for k, e in old.items():
            rows = rows.unionByName(spark.read.parquet(f"{target}/v{e}/part={k}").withColumn("part", F.lit(int(k))), allowMissingColumns=True)
        upsert(rows, [*keys, "part"], seq).write.mode("overwrite").partitionBy("part").parquet(f"{target}/v{epoch}")
        folder.swap("manifest.json", json.dumps({"epoch": epoch, "parts": known["parts"] | dict.fromkeys(touched, epoch)}))
        for k, e in old.items():
            folder.delete(f"v{e}/part={k}")
        batch.unpersist()

    return run


def merged(spark: SparkSession, target: str) -> DataFrame | None:
    """The table that ``merge_batches`` keeps; None before its first batch."""
    known = json.loads(Folder(spark, target).text("manifest.json") or "{}")
    paths = [f"{target}/v{e}/part={k}" for k, e in known.get("parts", {}).items()]
    return spark.read.parquet(*paths) if paths else None
