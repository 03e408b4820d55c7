"""Scans of a source tree. A file is a row; paths are told apart by their parts below the root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions import constants as K
from ferrule.functions import text as T
from ferrule.sources import parse_code, parse_xml


def tree(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """file_path, rel (below the root), text of the files whose name fits."""
    root = root.rstrip("/")
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    path = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", "^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    base = root.removeprefix("file://")
    whole = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n?", "\n")
    return raw.select(path.alias("file_path"), whole.alias("text")).withColumn("rel", F.substr("file_path", F.length(F.lit(base)) + 2))


def modules(spark: SparkSession, root: str) -> DataFrame:
    """Source modules with object_type, object_name, module_name."""
    return tree(spark, root, "*.bsl").withColumn("p", T.path_parts("rel")).select("file_path", "rel", "p.*", "text")


def module_list(spark: SparkSession, root: str) -> DataFrame:
    return modules(spark, root).select("file_path", F.concat_ws(".", "object_type", "object_name").alias("object"))


def all_methods(spark: SparkSession, root: str) -> DataFrame:
    return parse_code.methods(modules(spark, root))


def _first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def _named(xml: DataFrame, dirs: list[str]) -> DataFrame:
    """Descriptors X.xml and X/X.xml of the folders: dir, stem; the shallow one first."""
    parts = F.split("rel", "/")
    x = xml.withColumn("parts", parts).withColumn("dir", F.col("parts")[0]).where(F.col("dir").isin(dirs))
    x = x.withColumn("stem", F.regexp_replace(F.element_at("parts", -1), r"\.xml$", "")).withColumn("depth", F.size("parts"))
    x = x.where((F.col("depth") == 2) | (F.col("depth") == 3) & (F.get("parts", F.lit(1)) == F.col("stem")))
    return _first(x, ["dir", "stem"], "depth", "rel").drop("parts", "depth")


def objects(spark: SparkSession, root: str) -> DataFrame:
    """Metadata objects, roles, rights templates and templates in one table."""
    xml = tree(spark, root, "*.xml")
    plain = _named(xml, K.OBJECT_DIRS).withColumn("o", parse_xml.object_of(F.col("text"), F.col("stem"))).where("o is not null")
    here = tree(spark, root, "*.bsl").select(F.regexp_replace("rel", "/[^/]*$", "").alias("folder"), F.regexp_extract("rel", "([^/]*)$", 1).alias("file"))
    kinds = T.literal_map({"МодульОбъекта.bsl": "ObjectModule", "МодульМенеджера.bsl": "ManagerModule", "МодульНабораЗаписей.bsl": "RecordSetModule", "МодульКоманды.bsl": "CommandModule", "Module.bsl": "Module"})
    here = here.groupBy("folder").agg(F.sort_array(F.collect_set(F.try_element_at(kinds, F.col("file")))).alias("has_modules"))
    plain = plain.withColumn("folder", F.regexp_replace("rel", "/[^/]*$", "")).join(here, "folder", "left")
    plain = plain.select(F.col("dir").alias("object_type_dir"), "file_path", "o.*", F.coalesce("has_modules", F.expr("cast(array() as array<string>)")).alias("has_modules"))
    out = plain.unionByName(roles(spark, root, "Roles"), allowMissingColumns=True).unionByName(roles(spark, root, "RoleTemplates"), allowMissingColumns=True)
    return out.unionByName(templates(spark, root), allowMissingColumns=True)


def roles(spark: SparkSession, root: str, folder: str = "Roles") -> DataFrame:
    xml = tree(spark, root, "*.xml")
    rights = xml.where(F.col("rel").rlike(f"^{folder}/[^/]+/Ext/Rights\\.xml$")).select(F.split("rel", "/")[1].alias("stem"), parse_xml.rights_of(F.col("text")).alias("granted_objects"))
    own = _named(xml, [folder]).withColumn("o", parse_xml.object_of(F.col("text"), F.col("stem"))).where("o is not null")
    kind = "Role" if folder == "Roles" else "RoleTemplate"
    own = own.join(rights, "stem", "left").withColumn("granted_objects", F.coalesce("granted_objects", F.expr(f"cast(array() as {parse_xml.RIGHTS})")))
    return own.select(F.col("dir").alias("object_type_dir"), F.lit(kind).alias("kind"), "file_path", "o.name", "o.type", "o.synonym", "o.comment", "granted_objects", F.size("granted_objects").alias("granted_count"))


def templates(spark: SparkSession, root: str) -> DataFrame:
    """Ext/Template.xml, and Ext/Template.bin where there is no such XML; owner from the path, the rest from the descriptor."""
    xml = tree(spark, root, "*.xml")
    files = xml.where(F.col("rel").rlike(r"(^|/)Ext/Template\.xml$")).withColumn("bin", F.lit(False))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "Template.bin").load(root).select(F.col("_metadata.file_path").alias("path"))
    path = F.url_decode(F.replace(F.regexp_replace("path", "^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    binary = raw.select(path.alias("file_path")).withColumn("rel", F.substr("file_path", F.length(F.lit(root.rstrip("/").removeprefix("file://"))) + 2)).where(F.col("rel").rlike(r"(^|/)Ext/Template\.bin$"))

    def folder(df):
        return df.withColumn("folder", F.regexp_replace("rel", r"/?Ext/Template\.\w+$", ""))

    files = folder(files)
    binary = folder(binary).join(files.select("folder"), "folder", "left_anti").withColumns({"text": F.lit(None).cast("string"), "bin": F.lit(True)})
    every = files.unionByName(binary)
    # The descriptor lies beside the template's folder, or in it under its name.
    name = F.regexp_extract("folder", "([^/]*)$", 1)
    d = xml.withColumn("near", F.regexp_replace("rel", r"\.xml$", "")).select("near", F.col("text").alias("descriptor"))
    every = every.withColumn("template_name", name).join(d.withColumnRenamed("near", "folder").withColumnRenamed("descriptor", "d1"), "folder", "left")
    every = every.join(d.select(F.regexp_replace("near", "/[^/]*$", "").alias("folder"), F.regexp_extract("near", "([^/]*)$", 1).alias("template_name"), F.col("descriptor").alias("d2")), ["folder", "template_name"], "left")
    every = every.withColumn("o", parse_xml.object_of(F.coalesce("d1", "d2"), F.col("template_name")))
    declared = F.coalesce("o.template_type", F.lit(""))
    every = every.withColumn("t", parse_xml.template_of(F.col("text"), declared)).where("bin or t is not null")
    parts = F.split("folder", "/")
    at = F.array_position(parts, "Templates")
    owned = at > 2
    unique = F.when(owned, F.concat_ws(".", parts[0], parts[1], "template_name")).otherwise(F.col("template_name"))
    out = every.select(
        F.lit("Templates").alias("object_type_dir"), F.when(F.col("bin"), "BinaryData").otherwise(F.col("t.kind")).alias("kind"), "file_path", unique.alias("name"), F.lit("Template").alias("type"), F.coalesce("o.synonym", F.lit("")).alias("synonym"), F.coalesce("o.comment", F.lit("")).alias("comment"),
        "t.queries", "t.data_sets", "t.fields", "t.parameters", "t.named_areas", "t.cell_texts", "t.body_text", F.when(owned, parts[0]).otherwise("").alias("owner_type"), F.when(owned, parts[1]).otherwise("").alias("owner_name"), "template_name",
    )
    return _first(out, ["name"], "file_path")


def report_schemas(spark: SparkSession, root: str) -> DataFrame:
    """The templates that are report schemas."""
    return templates(spark, root).where("kind = 'DataCompositionSchema'")


def forms(spark: SparkSession, root: str) -> DataFrame:
    xml = tree(spark, root, "Form.xml").where(F.col("rel").rlike(r"(^|/)Forms/[^/]+/(Ext/)?Form\.xml$"))
    parts = F.split("rel", "/")
    name = F.regexp_extract("rel", r"Forms/([^/]+)/", 1)
    out = xml.select("file_path", name.alias("form_name"), F.when(F.size(parts) > 2, parts[0]).alias("object_type"), F.when(F.size(parts) > 2, parts[1]).alias("object_name"), parse_xml.form_of(F.col("text")).alias("elements"))
    return out.where("elements is not null").withColumn("elements_count", F.size("elements"))


def dump_info(spark: SparkSession, root: str) -> DataFrame:
    """One row: whether Configuration.xml at the root is valid, what it says, the parser's complaint. A missing one is not valid."""
    text = tree(spark, root, "Configuration.xml").where("rel = 'Configuration.xml'").select(parse_xml.root_of(F.col("text")).alias("o"))
    none = F.struct(F.lit(False).alias("valid"), F.lit(False).alias("is_extension"), F.lit("").alias("configuration_name"), F.lit("").alias("root_element"), F.lit(None).cast("string").alias("error"))
    one = text.agg(F.coalesce(F.first("o"), none).alias("o"))
    return one.select(F.lit(root).alias("config_root"), "o.*")


def split_paths(text: str | None) -> list[str]:
    """Paths parted by ; or line ends; the first of each, whatever its case."""
    import re

    seen: dict[str, str] = {}
    for p in re.split(r"[;\r\n]+", text or ""):
        if p.strip():
            seen.setdefault(p.strip().rstrip("/\\").lower(), p.strip())
    return list(seen.values())


def extension_roots(spark: SparkSession, folder: str, main: str = "") -> list[str]:
    """Children that hold a Configuration.xml, by lower-cased name, but for the main root."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/*/Configuration.xml")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    roots = [f.getPath().getParent().toString().removeprefix("file:") for f in found]
    return sorted((r for r in roots if r.lower() != main.rstrip("/").lower()), key=str.lower)


def source_of(config_name: str, root: str, is_extension: bool) -> dict:
    import re

    folder = root.rstrip("/").rpartition("/")[2]
    clean = [re.sub(r"[^\w-]+", "_", x).strip("_") for x in (config_name, folder) if x]
    sid = ("ext_" + "_".join(c for c in clean if c))[:64] if is_extension else "main"
    return {"index_source": "extension" if is_extension else "main", "source_id": sid, "configuration_name": config_name, "config_root": root, "is_extension": is_extension}
