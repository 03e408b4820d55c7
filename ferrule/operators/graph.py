"""Typed nodes and edges: keyed upsert, endpoint checks, neighbours, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import constants as K
from ferrule.functions import text as T

NODE = "id string, node_type string, name string, object_type string, object_name string, synonym string, extra string"
EDGE = "source string, target string, edge_type string, extra string"


def checked_nodes(nodes: DataFrame) -> DataFrame:
    """Strings never null, no row without id, known types only."""
    nodes = nodes.select(*[F.coalesce(F.col(c.split()[0]), F.lit("")).alias(c.split()[0]) for c in NODE.split(", ")], *[c for c in nodes.columns if c not in NODE])
    return nodes.where((F.col("id") != "") & F.col("node_type").isin(K.NODE_TYPES))


def checked_edges(edges: DataFrame) -> DataFrame:
    edges = edges.select(*[F.coalesce(F.col(c.split()[0]), F.lit("")).alias(c.split()[0]) for c in EDGE.split(", ")], *[c for c in edges.columns if c not in EDGE])
    return edges.where((F.col("source") != "") & (F.col("target") != "") & F.col("edge_type").isin(K.EDGE_TYPES))


def upsert(rows: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """Last writer wins; max_by pre-aggregates, so a hot key never moves more than one row a task."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*seq)).alias("_v")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def upsert_nodes(nodes: DataFrame, seq: str = "seq") -> DataFrame:
    """Last writer wins on id; the last non-empty synonym stays."""
    rest = ["node_type", "name", "object_type", "object_name", "extra"]
    synonym = F.max_by(F.col("synonym"), F.when(F.col("synonym") != "", F.col(seq)))
    out = nodes.groupBy("id").agg(F.max_by(F.struct(*rest), seq).alias("v"), F.coalesce(synonym, F.lit("")).alias("synonym"))
    return out.select("id", "v.node_type", "v.name", "v.object_type", "v.object_name", "synonym", "v.extra")


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def matches(raw: str, strict: bool = False) -> Column:
    """Nodes that an identifier names, in any spelling; not strict: the short name of anything counts too."""
    raw = raw.strip()
    if not raw:
        raise ValueError("blank object identifier")
    parts = raw.split(":", 2)
    if len(parts) == 3 and parts[0] == "metadata":
        kind, name = parts[1], parts[2]
    else:
        kind, _, name = raw.partition(".") if "." in raw else (None, "", raw)
    rule = F.col("id") == raw
    if kind:
        rule = rule | (F.col("id") == f"metadata:{kind}:{name}") | ((F.col("object_type") == kind) & (F.col("name") == name))
    if not kind or not strict:
        rule = rule | (F.col("object_name") == name) | (F.col("name") == name)
    return rule


def clamped(limit, default: int = 100, most: int = 500) -> int:
    try:
        return min(max(1, int(limit)), most)
    except (TypeError, ValueError):
        return default


def neighbours(nodes: DataFrame, edges: DataFrame, raw: str, incoming: bool, limit=100, strict: bool = False, ranked: bool = False) -> DataFrame:
    """object, node_id, edge_type (and rank) one step away. The matched nodes filter the edges first; Spark sizes the joins itself."""
    here, there = ("target", "source") if incoming else ("source", "target")
    found = nodes.where(matches(raw, strict)).select(F.col("id").alias(here))
    near = edges.join(found, here, "left_semi").select(F.col(there).alias("id"), "edge_type")
    near = near.join(nodes, "id").select("id", "name", "object_type", "object_name", "edge_type").distinct()
    label = F.concat("object_type", F.lit("."), F.coalesce(F.nullif(F.col("object_name"), F.lit("")), F.col("name")))
    order = ["edge_type", "name", "id"]
    near = near.orderBy(*order).limit(clamped(limit))
    rank = [F.row_number().over(Window.orderBy(*order)).alias("rank")] if ranked else []  # at most 500 rows
    return near.select(label.alias("object"), F.col("id").alias("node_id"), "edge_type", *rank)


def counts(rows: DataFrame, column: str) -> DataFrame:
    """kind, n, and a row of kind '' for the whole."""
    return rows.rollup(column).agg(F.count("*").alias("n")).select(F.coalesce(column, F.lit("")).alias("kind"), "n")


def admissible(refs: DataFrame, known: DataFrame) -> DataFrame:
    """References to known objects (ref_type, ref_name), and all those of the types that are trusted unseen."""
    flag = known.select(F.col("object_type").alias("ref_type"), F.col("name").alias("ref_name")).distinct().withColumn("_known", F.lit(True))
    return refs.join(flag, ["ref_type", "ref_name"], "left").where(F.col("_known") | F.col("ref_type").isin(K.FALLBACK_TYPES)).drop("_known")


def object_node(kind, name, synonym=None) -> Column:
    kind, name = T._c(kind), T._c(name)
    return F.struct(F.concat(F.lit("metadata:"), kind, F.lit(":"), name).alias("id"), F.lit("Metadata").alias("node_type"), name.alias("name"), kind.alias("object_type"), name.alias("object_name"), (synonym if synonym is not None else F.lit("")).alias("synonym"), F.lit("").alias("extra"))


def build(objects: DataFrame, methods: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of extracted tables, upserted and free of dangling edges.

    objects: object_type_dir, name, synonym, kind, granted_objects, owner_type, owner_name, template_name;
    methods: object_type, object_name, module_name, method_name, signature, code; forms: object_type, object_name, form_name, elements_count.
    """
    kept = objects.where(F.col("name").isNotNull())
    own = kept.select(F.lit(3).alias("seq"), object_node("object_type_dir", "name", F.coalesce("synonym", F.lit(""))).alias("n")).select("seq", "n.*")
    mid = F.concat_ws(":", F.lit("method"), "object_type", "object_name", "module_name", "method_name")
    m = methods.withColumn("mid", mid).withColumn("oid", F.concat_ws(":", F.lit("metadata"), "object_type", "object_name"))
    method_nodes = m.select(F.lit(2).alias("seq"), F.col("mid").alias("id"), F.lit("Method").alias("node_type"), F.col("method_name").alias("name"), "object_type", "object_name", F.lit("").alias("synonym"), F.to_json(F.struct(F.col("module_name").alias("module"), "signature")).alias("extra"))
    owners = m.select("object_type", "object_name").union(forms.select("object_type", "object_name")).distinct()
    owner_nodes = owners.select(F.lit(1).alias("seq"), object_node("object_type", "object_name").alias("n")).select("seq", "n.*")
    refs = m.select("oid", F.explode(T.code_references("code")).alias("r")).select("oid", "r.*").where("ref_type is not null")
    refs = admissible(refs, kept.select(F.col("object_type_dir").alias("object_type"), "name"))
    ref_nodes = refs.select(F.lit(0).alias("seq"), object_node("ref_type", "ref_name").alias("n")).select("seq", "n.*")
    fid = F.concat_ws(":", F.lit("form"), "object_type", "object_name", "form_name")
    form_nodes = forms.select(F.lit(2).alias("seq"), fid.alias("id"), F.lit("Form").alias("node_type"), F.col("form_name").alias("name"), "object_type", "object_name", F.lit("").alias("synonym"), F.to_json(F.struct("elements_count")).alias("extra"))
    me = F.concat_ws(":", F.lit("metadata"), "object_type_dir", "name")
    grants = kept.select(me.alias("source"), F.explode("granted_objects").alias("g")).select("source", F.col("g.name").alias("ref"), F.array_join("g.rights", ",").alias("rights"), T.rights_target(F.col("g.name")).alias("t")).where("t.object_type is not null and t.object_name <> ''")
    grant_nodes = grants.select(F.lit(0).alias("seq"), object_node(F.col("t.object_type"), F.col("t.object_name")).alias("n")).select("seq", "n.*")
    templates = kept.where("coalesce(owner_type, '') <> '' and coalesce(owner_name, '') <> ''")
    template_nodes = templates.select(F.lit(0).alias("seq"), object_node("owner_type", "owner_name").alias("n")).select("seq", "n.*")
    nodes = own
    for more in (method_nodes, owner_nodes, ref_nodes, form_nodes, grant_nodes, template_nodes):
        nodes = nodes.unionByName(more)
    nodes = upsert_nodes(checked_nodes(nodes))
    edges = m.select(F.col("oid").alias("source"), F.col("mid").alias("target"), F.lit("HAS_METHOD").alias("edge_type"), F.lit("").alias("extra"))
    edges = edges.unionByName(refs.select(F.col("oid").alias("source"), F.concat_ws(":", F.lit("metadata"), "ref_type", "ref_name").alias("target"), F.lit("USES_IN_CODE").alias("edge_type"), F.lit("").alias("extra")))
    edges = edges.unionByName(forms.select(F.concat_ws(":", F.lit("metadata"), "object_type", "object_name").alias("source"), fid.alias("target"), F.lit("HAS_FORM").alias("edge_type"), F.lit("").alias("extra")))
    edges = edges.unionByName(grants.select("source", F.concat_ws(":", F.lit("metadata"), "t.object_type", "t.object_name").alias("target"), F.lit("HAS_RIGHT").alias("edge_type"), F.to_json(F.struct("rights", "ref")).alias("extra")))
    edges = edges.unionByName(templates.select(F.concat_ws(":", F.lit("metadata"), "owner_type", "owner_name").alias("source"), me.alias("target"), F.lit("HAS_TEMPLATE").alias("edge_type"), F.to_json(F.struct(F.col("template_name").alias("template"))).alias("extra")))
    edges = upsert(checked_edges(edges), ["source", "target", "edge_type"], ["extra"])
    return nodes, drop_dangling(edges, nodes)
