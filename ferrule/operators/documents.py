"""Texts to embed, ids and provenance of code chunks, objects and forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions import constants as K
from ferrule.functions import text as T
from ferrule.operators.lines import method_chunks

SOURCE = ["index_source", "source_id", "configuration_name", "config_root", "is_extension"]


def with_source(df: DataFrame, source: dict) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in source.items()})


def code_chunks(methods: DataFrame, most: int = 844, overlap: int = 165) -> DataFrame:
    """A row a chunk, with item_id and document; comments go with the first chunk alone."""
    parts = methods.withColumn("parts", method_chunks("code", most, overlap)).withColumn("total_chunks", F.size("parts"))
    parts = parts.drop("code").select("*", F.posexplode("parts").alias("chunk_index", "code")).drop("parts")
    first = F.when(F.col("chunk_index") == 0, F.nullif(F.array_join("comments", "\n"), F.lit("")))
    prefix = T.source_prefix(F.col("source_id"), F.col("index_source")) if "source_id" in methods.columns else F.lit("main")
    item = F.concat_ws("_", prefix, F.lit("code"), "object_type", "object_name", "module_name", "method_name", F.col("chunk_index").cast("string"))
    return parts.withColumns({"document": F.concat_ws("\n", first, F.nullif(F.col("signature"), F.lit("")), "code"), "item_id": item})


def _list(label: str, values: Column, sep: str = ", ", cap: int = 0) -> Column:
    x = F.slice(values, 1, cap) if cap else values
    return F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(x, sep)))


def _fields(name: str) -> Column:
    return F.transform(name, lambda a: F.concat(a["name"], F.lit(" ("), a["type"], F.lit(")")))


def object_document() -> Column:
    """The description of an object, role or template: a label and value a line, absent ones left out."""
    col = F.col
    lines = [F.concat(F.lit(label), F.coalesce(col(c), F.lit(""))) for label, c in (("Тип: ", "type"), ("Имя: ", "name"), ("Синоним: ", "synonym"), ("Комментарий: ", "comment"))]
    lines += [_list("Реквизиты: ", _fields("attributes")), _list("Измерения: ", _fields("dimensions")), _list("Ресурсы: ", _fields("resources"))]
    inner = F.transform("tabular_sections", lambda s: F.when(F.size(s["attributes"]) > 0, F.concat(s["name"], F.lit("("), F.array_join(F.transform(s["attributes"], lambda a: F.concat(a["name"], F.lit(" ("), a["type"], F.lit(")"))), ", "), F.lit(")"))).otherwise(s["name"]))
    lines += [_list("Табличные части: ", inner, "; "), _list("Команды: ", col("commands"))]
    role = col("kind").isin("Role", "RoleTemplate") | (F.size("granted_objects") > 0)
    granted = F.transform("granted_objects", lambda g: F.when(F.size(g["rights"]) > 0, F.concat(g["name"], F.lit(" ("), F.array_join(g["rights"], ", "), F.lit(")"))).otherwise(g["name"]))
    n = F.coalesce(F.when(F.size("granted_objects") >= 0, F.size("granted_objects")), F.lit(0)).cast("string")
    lines += [F.when(role, F.when(col("kind") == "RoleTemplate", "Шаблон прав").otherwise("Роль")), F.when(role, F.concat(F.lit("Объектов с правами: "), n)), F.when(role, _list("Права: ", granted, "; ", 80))]
    template = (col("object_type_dir") == "Templates") | col("kind").isin(list(K.TEMPLATE_KINDS)) | (F.size("queries") > 0) | (F.size("cell_texts") > 0) | (F.coalesce("body_text", F.lit("")) != "")
    kinds = T.literal_map({k: v for k, v in K.TEMPLATE_KINDS.items() if k != "Template"})
    owner = F.when(F.concat("owner_type", "owner_name") != "", F.concat(F.lit("Владелец: "), "owner_type", F.lit(" "), "owner_name"))
    own = [F.coalesce(F.try_element_at(kinds, col("kind")), F.lit("Макет 1С")), owner, F.when(col("template_name") != "", F.concat(F.lit("Макет: "), "template_name"))]
    own += [_list("Наборы данных: ", col("data_sets"), cap=30), _list("Параметры: ", col("parameters"), cap=30), _list("Поля: ", col("fields"), cap=40), _list("Области: ", col("named_areas"), cap=40), _list("Текст ячеек: ", col("cell_texts"), "; ", 80), F.nullif(col("body_text"), F.lit(""))]
    own.append(F.when(F.size("queries") > 0, F.array_join(F.transform("queries", lambda q, i: F.concat(F.lit("Запрос "), (i + 1).cast("string"), F.lit(": "), q)), "\n")))
    lines += [F.when(template, x) for x in own]
    return F.concat_ws("\n", *lines)


def object_items(objects: DataFrame) -> DataFrame:
    prefix = T.source_prefix(F.col("source_id"), F.col("index_source")) if "source_id" in objects.columns else F.lit("main")
    return objects.withColumns({"document": object_document(), "item_id": F.concat_ws("_", prefix, F.lit("metadata"), "object_type_dir", "name"), "object_type": F.col("object_type_dir"), "object_name": F.col("name")})


def form_items(forms: DataFrame) -> DataFrame:
    """First 20 elements; the id names the type too, so forms of like-named objects stay apart."""
    prefix = T.source_prefix(F.col("source_id"), F.col("index_source")) if "source_id" in forms.columns else F.lit("main")
    document = F.concat_ws("\n", F.concat(F.lit("Форма: "), "form_name"), F.concat(F.lit("Объект: "), "object_name"), F.concat(F.lit("Элементы: "), F.array_join(F.slice("elements", 1, 20), ", ")))
    return forms.withColumns({"document": document, "item_id": F.concat_ws("_", prefix, F.lit("form"), "object_type", "object_name", "form_name")})


def embedded(items: DataFrame, embedder=T.toy_embedding) -> DataFrame:
    """One row an item_id, with its vector; the embedder is any Column -> Column.

    Of rows that share an item_id the one of greatest (file_path, document) stays, whatever the order they come in.
    """
    rest = [c for c in items.columns if c != "item_id"]
    order = F.struct(*[F.coalesce(F.col(c), F.lit("")) for c in ("file_path", "document") if c in rest])
    rows = items.groupBy("item_id").agg(F.max_by(F.struct(*rest), order).alias("v")).select("item_id", "v.*")
    return rows.withColumn("embedding", embedder(F.col("document")))
