"""From source trees to tables: extracted rows, items with vectors, nodes, edges.

Every table is a set of Parquet folders, one a source and version; the file ``manifest.json`` names those that count. A
build writes fresh folders, then swaps the manifest, so readers see either the old index or the new one whole, sources that
are not rebuilt stay as they are, and the folders of the version before remain as its backup. A build that broke off goes
on with its version: folders that are complete are not written again.
"""

from __future__ import annotations

import json
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions import text as T
from ferrule.operators import documents, graph
from ferrule.plans.settings import Settings
from ferrule.sources import files

EXTRACTED, ITEMS, GRAPH = ("methods", "objects", "forms"), ("code", "metadata", "form_items"), ("nodes", "edges")
#: Names of the items' tables for readers.
COLLECTIONS = {"code": "code", "metadata": "metadata", "forms": "form_items"}


def sources(spark: SparkSession, main: str, extensions: list[str] = ()) -> list[dict]:
    """The plan: the main root, then the extensions; each root once."""
    out = []
    for i, root in enumerate([main, *extensions]):
        if root.lower() in [s["config_root"].lower() for s in out]:
            continue
        info = files.dump_info(spark, root).first()
        out.append(files.source_of(info.configuration_name, root, i > 0))
    return out


def extract(spark: SparkSession, plan: list[dict]) -> dict[str, DataFrame]:
    """methods, objects, forms of all sources, with provenance."""

    def every(scan):
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [documents.with_source(scan(spark, s["config_root"]), s) for s in plan])

    return {"methods": every(files.all_methods), "objects": every(files.objects), "forms": every(files.forms)}


def items(tables: dict[str, DataFrame], settings: Settings = Settings(), embedder=T.toy_embedding) -> dict[str, DataFrame]:
    return {
        "code": documents.embedded(documents.code_chunks(tables["methods"], settings.chunk_chars, settings.overlap_chars), embedder),
        "metadata": documents.embedded(documents.object_items(tables["objects"]), embedder),
        "form_items": documents.embedded(documents.form_items(tables["forms"]), embedder),
    }


class Folder:
    """Files under a root in any store Hadoop reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path("").getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        return self._fs().exists(self._path(name))

    def delete(self, name: str = "") -> None:
        self._fs().delete(self._path(name), True)

    def size(self, name: str = "") -> int:
        return self._fs().getContentSummary(self._path(name)).getLength()

    def text(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        return self.spark.read.text(f"{self.root}/{name}", wholetext=True).first().value

    def swap(self, name: str, text: str) -> None:
        """Write beside it, then take its place in one step."""
        new = self._path(f".{name}.new")
        out = self._fs().create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self.conf)
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context.rename(self._fs().makeQualified(new), self._fs().makeQualified(self._path(name)), options)


class Manifest:
    """Which folders make up the index: table -> source -> folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.folder = Folder(spark, root)
        found = json.loads(self.folder.text("manifest.json") or "{}")
        self.version, self.backup, self.tables = found.get("version"), found.get("backup"), found.get("tables", {})

    def read(self, table: str) -> DataFrame | None:
        where = self.tables.get(table)
        if not where:
            return None
        spark = self.folder.spark
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(f"{self.folder.root}/{p}") for p in where.values()])

    def written(self, df: DataFrame, table: str, source: str, version: str) -> str:
        """Folder of one source's rows; one that is complete is left as it is."""
        path = f"{table}/{source}/{version}"
        if not self.folder.exists(f"{path}/_SUCCESS"):
            df.write.mode("overwrite").parquet(f"{self.folder.root}/{path}")
        return path

    def take_up(self, tables: dict, version: str) -> None:
        """Make a version the one that counts; folders that neither it nor the version before names go."""
        before = self.tables
        self.folder.swap("manifest.json", json.dumps({"version": version, "backup": {"version": self.version, "tables": before}, "tables": tables}))
        old = (self.backup or {}).get("tables", {})
        named = {p for t in (before, tables) for own in t.values() for p in own.values()}
        for own in old.values():
            for path in own.values():
                if path not in named:
                    self.folder.delete(path)
        self.version, self.backup, self.tables = version, {"version": self.version, "tables": before}, tables


def build(spark: SparkSession, root: str, main: str, extensions: list[str] = (), settings: Settings = Settings(), embedder=T.toy_embedding, only: list[str] | None = None, version: str | None = None) -> dict:
    """Index the sources (``only`` some of them, by source_id) under root. ``version`` goes on with a build of that name."""
    began = time.time()
    plan = [s for s in sources(spark, main, list(extensions)) if only is None or s["source_id"] in only]
    version = version or time.strftime("%Y%m%d_%H%M%S") + f"_{time.time_ns() % 10**6:06d}"
    m = Manifest(spark, root)
    tables = {t: dict(own) for t, own in m.tables.items()}
    for s in plan:
        own, sid = {}, s["source_id"]
        for name, df in extract(spark, [s]).items():
            tables.setdefault(name, {})[sid] = path = m.written(df, name, sid, version)
            own[name] = spark.read.parquet(f"{m.folder.root}/{path}")  # scanned once, read by all that follows
        for name, df in items(own, settings, embedder).items():
            tables.setdefault(name, {})[sid] = m.written(df, name, sid, version)
    m.tables, before = tables, m.tables
    nodes, edges = graph.build(m.read("objects"), m.read("methods"), m.read("forms"))
    for name, df in (("nodes", nodes), ("edges", edges)):
        tables[name] = {"": m.written(df, name, "all", version)}
    m.tables = before
    m.take_up(tables, version)
    counts = {f"{name}_count": df.count() for name, df in read(spark, root).items()}
    return counts | {"version": version, "size_mb": round(m.folder.size() / 2**20, 1), "elapsed_sec": round(time.time() - began, 2)}


def restore(spark: SparkSession, root: str) -> str | None:
    """Go back to the version before; its name, or None if there is none."""
    m = Manifest(spark, root)
    if not m.backup or not m.backup["tables"]:
        return None
    m.folder.swap("manifest.json", json.dumps({"version": m.backup["version"], "backup": {"version": m.version, "tables": m.tables}, "tables": m.backup["tables"]}))
    return m.backup["version"]


def stage_csv(nodes: DataFrame, edges: DataFrame, root: str) -> dict:
    """Exchange format: all fields as text, quoted; counts beside them in staging_meta.json."""
    counts = {}
    for name, df in (("nodes", nodes), ("edges", edges)):
        rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
        rows.write.mode("overwrite").option("quoteAll", "true").option("escape", '"').option("emptyValue", "").option("header", "true").csv(f"{root}/{name}")
        counts[f"{name}_count"] = df.count()
    Folder(nodes.sparkSession, root).swap("staging_meta.json", json.dumps(counts))
    return counts


def read_staged(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of the exchange format, empty strings for empty fields."""
    found = []
    for name in ("nodes", "edges"):
        if not Folder(spark, root).exists(name):
            raise FileNotFoundError(f"no staged {name} under {root}")
        rows = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(f"{root}/{name}")
        found.append(rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns]))
    return found[0], found[1]


def rebuild(spark: SparkSession, staging: str, root: str) -> dict:
    """A new version of the graph from staged files; the one before stays as its backup."""
    began = time.time()
    m = Manifest(spark, root)
    version = time.strftime("%Y%m%d_%H%M%S") + f"_{time.time_ns() % 10**6:06d}"
    nodes, edges = read_staged(spark, staging)
    edges = graph.upsert(graph.checked_edges(edges), ["source", "target", "edge_type"], ["extra"])
    nodes = graph.upsert(graph.checked_nodes(nodes), ["id"], ["node_type", "name", "extra"])
    tables = {t: dict(own) for t, own in m.tables.items()}
    for name, df in (("nodes", nodes), ("edges", edges)):
        tables[name] = {"": m.written(df, name, "all", version)}
    m.take_up(tables, version)
    found = read(spark, root)
    return {"nodes_count": found["nodes"].count(), "edges_count": found["edges"].count(), "backup": m.backup["version"], "size_mb": round(m.folder.size() / 2**20, 1), "elapsed_sec": round(time.time() - began, 1)}


def read(spark: SparkSession, root: str) -> dict[str, DataFrame | None]:
    """The tables of the index; a missing one is None."""
    m = Manifest(spark, root)
    return {**{name: m.read(table) for name, table in COLLECTIONS.items()}, **{name: m.read(name) for name in GRAPH}}


def clear(spark: SparkSession, root: str) -> None:
    """Remove all tables under root."""
    Folder(spark, root).delete()
