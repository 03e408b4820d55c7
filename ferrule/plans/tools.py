"""The query tools: each takes a store and parameters and returns a DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions import constants as K
from ferrule.functions import text as T
from ferrule.operators import graph, lines, search
from ferrule.plans import index
from ferrule.plans.settings import Settings
from ferrule.sources import files


CODE = "rank int, relevance double, object string, module string, method string, signature string, is_export boolean, code string, file_path string, directive string"
METADATA = "rank int, relevance double, type string, name string, synonym string, description string, has_modules array<string>, attributes_count int, file_path string, tabular_sections array<string>, has_dimensions boolean, has_resources boolean, commands_count int"
FORMS = "rank int, relevance double, form_name string, object string, elements_count int, file_path string"
SOURCE = ", index_source string, source_id string, configuration_name string, config_root string, is_extension boolean"
CODE, METADATA, FORMS = CODE + SOURCE, METADATA + SOURCE, FORMS + SOURCE
NEAR = "object string, node_id string, edge_type string"
USAGE = "object string, module string, in_method string, line_number int, line_content string, code_context string, file_path string, source string, index_source string, configuration_name string, config_root string, edge_type string, node_id string"
# What is asked of the code index for usages, and what the assistant is told.
USAGE_QUERY = "вызов {}"
NOTHING_FOUND = "(По запросу ничего не найдено в векторной базе и графе.)"
SYSTEM_PROMPT = (
    "Ты — ассистент-аналитик по конфигурации 1С. Отвечай на русском языке. Используй ТОЛЬКО предоставленный ниже контекст из векторной базы и графа зависимостей конфигурации. "
    "Если данных в контексте недостаточно для ответа, прямо сообщи об этом и не выдумывай. Указывай конкретные объекты метаданных, модули и пути к файлам, на которые опираешься. Фрагменты кода оформляй в блоках ```bsl```."
)


class Tool(NamedTuple):
    """A tool as callers see it: the method it runs, its parameters as (type, default, least, most), the ones it must have."""

    method: str
    parameters: dict[str, tuple]
    required: tuple[str, ...] = ()

    def schema(self) -> dict:
        """JSON schema of the parameters."""
        out = {}
        for name, (kind, default, least, most) in self.parameters.items():
            more = {"default": default, "minimum": least, "maximum": most}
            out[name] = {"type": kind} | {k: v for k, v in more.items() if v is not None}
            if name == "object_type":
                out[name]["enum"] = ["all", *K.TYPE_FILTER]
        return {"type": "object", "properties": out} | ({"required": list(self.required)} if self.required else {})


_QUERY, _NAME = ("string", None, None, None), ("string", None, None, None)
TOOLS = {
    "search_1c_code": Tool("search_code", {"query": _QUERY, "limit": ("integer", 5, 1, 20), "only_export": ("boolean", False, None, None)}, ("query",)),
    "search_1c_metadata": Tool("search_metadata", {"query": _QUERY, "object_type": ("string", "all", None, None), "limit": ("integer", 5, 1, 20)}, ("query",)),
    "search_1c_forms": Tool("search_forms", {"query": _QUERY, "limit": ("integer", 5, 1, 20)}, ("query",)),
    "find_1c_method_usage": Tool("method_usage", {"method_name": _NAME, "limit": ("integer", 10, 1, 50)}, ("method_name",)),
    "get_vectordb_stats": Tool("stats", {}),
    "search_by_object_name": Tool("object_with_code", {"object_name": _NAME, "include_code": ("boolean", True, None, None)}, ("object_name",)),
    "graph_dependencies": Tool("graph_dependencies", {"object_name": _NAME, "limit": ("integer", 100, None, None)}, ("object_name",)),
    "graph_references": Tool("graph_references", {"object_name": _NAME, "limit": ("integer", 100, None, None)}, ("object_name",)),
    "graph_stats": Tool("graph_stats", {}),
    "get_analyst_instructions": Tool("instructions", {"path": ("string", None, None, None)}),
}


class Store:
    """Tables of an index, and the roots whose files grep reads."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | None], roots: list[dict] = (), settings: Settings = Settings(), embed_query=None):
        self.spark, self.tables, self.roots, self.settings = spark, tables, list(roots), settings
        self.embed_query = embed_query or (lambda text: spark.range(1).select(T.toy_embedding(F.lit(text)).alias("v")).first().v)

    @classmethod
    def open(cls, spark: SparkSession, root: str, **more) -> Store:
        return cls(spark, index.read(spark, root), **more)

    def _search(self, table: str, query: str, limit: int, where: dict | None = None) -> DataFrame | None:
        if not query.strip():
            raise ValueError("blank query")
        df, s = self.tables.get(table), self.settings
        if df is None:
            return None
        return search.search(df, self.embed_query(query), query, max(1, int(limit)), where, s.hybrid_alpha, s.use_mmr, s.mmr_lambda, s.distance_metric)

    def search_code(self, query: str, limit: int = 10, only_export: bool = False) -> DataFrame:
        out = self._search("code", query, limit, {"is_export": True} if only_export else None)
        if out is None:
            return self.spark.createDataFrame([], CODE)
        return _shaped(out.withColumns({"object": F.concat_ws(".", "object_type", "object_name"), "module": F.col("module_name"), "method": F.col("method_name")}), CODE).orderBy("rank")

    def search_metadata(self, query: str, object_type: str = "all", limit: int = 10) -> DataFrame:
        kind = K.TYPE_FILTER.get(object_type, object_type)
        out = self._search("metadata", query, limit, None if kind in ("", "all") else {"object_type": kind})
        if out is None:
            return self.spark.createDataFrame([], METADATA)
        out = out.withColumns({"type": F.col("object_type"), "description": F.col("comment"), "tabular_sections": F.transform("tabular_sections", lambda x: x["name"]), "has_dimensions": F.size("dimensions") > 0, "has_resources": F.size("resources") > 0, "commands_count": F.size("commands")})
        return _shaped(out, METADATA).orderBy("rank")

    def search_forms(self, query: str, limit: int = 10) -> DataFrame:
        out = self._search("forms", query, limit)
        if out is None:
            return self.spark.createDataFrame([], FORMS)
        return _shaped(out.withColumn("object", F.concat_ws(".", "object_type", "object_name")), FORMS).orderBy("rank")

    def search_code_by_object(self, name: str, query: str = "", limit: int = 20) -> DataFrame:
        code = self.tables["code"]
        if not query.strip():
            return search.by_object(code, name, limit)
        hits = search.knn(code, self.embed_query(query), max(limit, search.FILTERED_FETCH), self.settings.distance_metric)
        return search.formatted(hits.where(F.col("object_name") == name).orderBy("distance", "item_id").limit(limit))

    def find_method_usage(self, name: str, limit: int = 50) -> DataFrame:
        """Usages (columns of USAGE) by grep of all roots in order; from the code index where no root is at hand."""
        name = name.strip()
        if not name:
            raise ValueError("blank method name")
        if not self.roots:
            hits = self._search("code", USAGE_QUERY.format(name), limit * 2)
            if hits is None:
                return self.spark.createDataFrame([], USAGE)
            short = F.when(F.length("document") > 500, F.concat(F.substring("document", 1, 500), F.lit("..."))).otherwise(F.col("document"))
            hits = hits.where(F.contains(F.lower("document"), F.lit(name.lower()))).orderBy("rank").limit(limit)
            found = hits.select(F.concat_ws(".", "object_type", "object_name").alias("object"), F.col("module_name").alias("module"), F.col("method_name").alias("in_method"), short.alias("code_context"), "file_path", F.lit("vector").alias("source"))
            return _shaped(found, USAGE)
        every = None
        for i, s in enumerate(self.roots):
            own = files.modules(self.spark, s["config_root"]).withColumns({"root_seq": F.lit(i), **{k: F.lit(s[k]) for k in ("config_root", "index_source", "configuration_name")}})
            every = own if every is None else every.unionByName(own)
        found = lines.grep(every, name, limit=limit, order=["root_seq", "file_path"])
        return _shaped(found.withColumns({"object": F.concat_ws(".", "object_type", "object_name"), "module": F.col("module_name"), "source": F.lit("grep")}), USAGE)

    def graph_related(self, name: str, usages: DataFrame, limit: int = 20) -> DataFrame:
        """Graph neighbours of the name that are not among the callers found."""
        return self.graph_dependencies(name, limit).join(usages.select("object").distinct(), "object", "left_anti")

    def method_usage(self, method_name: str, limit: int = 10) -> DataFrame:
        """Usages and, of source ``graph``, the related objects that none of them names: one table with columns of USAGE."""
        usages = self.find_method_usage(method_name, limit)
        related = self.graph_related(method_name, usages).withColumn("source", F.lit("graph"))
        return usages.unionByName(_shaped(related, USAGE))

    def _near(self, name: str, incoming: bool, limit, ranked: bool = False) -> DataFrame:
        nodes, edges = self.tables.get("nodes"), self.tables.get("edges")
        if nodes is None or edges is None:
            return self.spark.createDataFrame([], NEAR + ", rank int" * ranked)
        return graph.neighbours(nodes, edges, name, incoming, limit, ranked=ranked)

    def graph_dependencies(self, object_name: str, limit=100) -> DataFrame:
        return self._near(object_name, True, limit)

    def graph_references(self, object_name: str, limit=100) -> DataFrame:
        return self._near(object_name, False, limit)

    def graph_stats(self) -> DataFrame:
        nodes, edges = self.tables.get("nodes"), self.tables.get("edges")
        if nodes is None or edges is None:
            return self.spark.createDataFrame([("nodes", "", 0), ("edges", "", 0)], "part string, kind string, n long")
        return graph.counts(nodes, "node_type").select(F.lit("nodes").alias("part"), "kind", "n").union(graph.counts(edges, "edge_type").select(F.lit("edges"), "kind", "n"))

    def stats(self) -> DataFrame:
        """Rows of each collection, 0 for a missing one, and the whole."""
        out = None
        for name in ("code", "metadata", "forms"):
            df = self.tables.get(name)
            one = (df if df is not None else self.spark.range(0)).agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n")
            out = one if out is None else out.union(one)
        return out.rollup("collection").agg(F.sum("n").alias("n")).select(F.coalesce("collection", F.lit("total")).alias("collection"), "n")

    def search_by_object_name(self, name: str, with_code: bool = True) -> tuple[DataFrame, DataFrame | None]:
        """The nearest object, and its code: by exact name, or among the nearest hundred."""
        found = self._search("metadata", name, 1)
        if found is None:
            return self.spark.createDataFrame([], METADATA), None
        top = found.first()
        if top is None or not with_code or self.tables.get("code") is None:
            return found, None
        code = search.by_object(self.tables["code"], top["name"], 200)
        if not code.take(1):
            code = self._search("code", name, 100).where(F.col("object_name") == top["name"])
        return found, code

    def object_with_code(self, object_name: str, include_code: bool = True) -> DataFrame:
        """The nearest object and its code in one table: part, rank, the row as JSON."""
        found, code = self.search_by_object_name(object_name, include_code)
        out = None
        for part, df in (("object", found), ("code", code)):
            if df is not None:
                plain = df.drop("embedding")
                own = plain.select(F.lit(part).alias("part"), "rank", F.to_json(F.struct(*plain.columns)).alias("row"))
                out = own if out is None else out.union(own)
        return out

    def instructions(self, path: str = "") -> DataFrame:
        """A text file, whole."""
        return self.spark.read.text(path or f"{self.settings.config_path}/README.md", wholetext=True).select(F.col("value").alias("instructions"))

    def call(self, tool: str, arguments: dict | None = None) -> tuple[DataFrame | None, str | None]:
        """The result of a tool by name, or what is wrong with the call. Numbers are brought within their bounds."""
        known = TOOLS.get(tool)
        if known is None:
            return None, f"unknown tool: {tool}"
        given = {}
        for name, (kind, default, least, most) in known.parameters.items():
            v = (arguments or {}).get(name, default)
            if kind == "string" and isinstance(v, str):
                v = v.strip()
            if name in known.required and v in (None, ""):
                return None, f"{name} is required and may not be blank"
            if kind == "integer" and v is not None:
                v = graph.clamped(v, default, most or 500)
                v = max(v, least) if least is not None else v
            if v is not None:
                given[name] = v
        try:
            return getattr(self, known.method)(**given), None
        except ValueError as e:
            return None, str(e)

    def respond(self, tool: str, arguments: dict | None = None) -> str:
        """What a tool answers, as JSON: its rows (as many as its limit at most), their number and the arguments, or an error."""
        df, error = self.call(tool, arguments)
        if error is not None:
            return json.dumps({"error": error}, ensure_ascii=False)
        rows = [json.loads(v) for v in df.drop("embedding").toJSON().collect()]
        return json.dumps({**(arguments or {}), "total_results": len(rows), "results": rows}, ensure_ascii=False, indent=2)

    def gathered(self, question: str, limit: int = 5, use_graph: bool | None = None) -> dict:
        """What an answer may rest on: hits of the three searches and, if the question asks for links, the graph around the first named object."""
        if use_graph is None:
            use_graph = any(m in question.lower() for m in K.INTENT_MARKERS)
        found = {"code": self.search_code(question, limit), "metadata": self.search_metadata(question, limit=limit), "forms": self.search_forms(question, max(3, limit // 2)), "graph": None, "graph_object": None, "use_graph": use_graph}
        if use_graph:
            named = found["metadata"].where(F.trim(F.coalesce("name", F.lit(""))) != "").orderBy("rank").select(F.trim("name").alias("name")).first()
            if named:
                near = [self._near(named.name, incoming, 100, True).withColumn("side", F.lit(side)) for incoming, side in ((True, "dependencies"), (False, "references"))]
                found |= {"graph": near[0].unionByName(near[1]).withColumn("asked", F.lit(named.name)), "graph_object": named.name}
        return found

    def context(self, question: str, limit: int = 5, use_graph: bool | None = None) -> str:
        """The context of a question; empty where nothing is found."""
        g = self.gathered(question, limit, use_graph)
        one = {k: g[k].withColumn("question_id", F.lit(0)) if g[k] is not None else None for k in ("metadata", "code", "forms", "graph")}
        row = context(one["metadata"], one["code"], one["forms"], one["graph"]).first()
        return row.context if row else ""

    def ask(self, question: str, chat: Callable[[list[dict]], str], limit: int = 5, use_graph: bool | None = None) -> dict:
        """Search, context and the answer of ``chat``, any function of messages."""
        text = self.context(question, limit, use_graph)
        user = f"Вопрос пользователя:\n{question}\n\nКонтекст из конфигурации 1С:\n{text if text.strip() else NOTHING_FOUND}"
        answer = chat([{"role": "system", "content": SYSTEM_PROMPT}, {"role": "user", "content": user}])
        return {"answer": answer, "has_context": bool(text.strip()), "context": text}


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    """The columns of the schema, null where df has none; provenance that is empty is null, so that JSON leaves it out."""
    fields = [f.strip().split() for f in schema.split(",")]
    named = {f.split()[0] for f in SOURCE.split(",")[1:]} - {"is_extension"}
    columns = {n: F.col(n) if n in df.columns else F.lit(None) for n, _ in fields}
    return df.select(*[(F.nullif(columns[n], F.lit("")) if n in named else columns[n]).cast(kind).alias(n) for n, kind in fields])


# The sections of a context, what their lines hold and how many there are.
OBJECTS_HEAD, CODE_HEAD, FORMS_HEAD, GRAPH_HEAD = "== ОБЪЕКТЫ МЕТАДАННЫХ ==", "== ФРАГМЕНТЫ КОДА ==", "== ФОРМЫ ==", "== ГРАФ ЗАВИСИМОСТЕЙ для '"
SIDES = {"dependencies": "На объект ссылаются (зависят от него):", "references": "Объект ссылается на (использует):"}
OBJECTS, SNIPPETS, FORM_LINES, EACH_SIDE, SNIPPET, DESCRIPTION, BUDGET = 8, 6, 5, 25, 1200, 300, 14000


def context(objects: DataFrame, code: DataFrame, forms: DataFrame, near: DataFrame | None = None, budget: int = BUDGET, group: str = "question_id") -> DataFrame:
    """group, context: one text a group out of ranked hits; sections with their caps, then the budget.

    objects: type, name, synonym, description, file_path; code: object, module, method, signature, code, file_path; forms:
    form_name, object, elements_count; near: asked, side, object, edge_type; all with group and rank. Every list is cut by
    rank before it is collected, so a group holds a bounded number of lines.
    """

    def given(c: str, lead: str) -> Column:
        return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(lead), c))

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    def joined(df: DataFrame, cap: int, line: Column, *by: str) -> DataFrame:
        top = df.withColumn("_r", F.row_number().over(Window.partitionBy(group, *by).orderBy("rank"))).where(F.col("_r") <= cap)
        lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", line.alias("t")))), lambda x: x["t"]), "\n")
        return top.groupBy(group, *by).agg(lines.alias("t"))

    synonym = F.when(text("synonym") != "", F.concat(F.lit(" ("), "synonym", F.lit(")")))
    a = F.concat_ws("\n", F.concat(F.lit("- "), text("type"), F.lit("."), text("name"), F.coalesce(synonym, F.lit(""))), F.when(text("description") != "", F.concat(F.lit("  Описание: "), T.truncated("description", DESCRIPTION))), given("file_path", "  Файл: "))
    place = F.regexp_replace(F.concat(F.lit("- "), text("object"), F.lit(" / "), text("module"), F.lit(" / "), text("method")), "[ /]+$", "")
    snippet = F.when(text("code") != "", F.concat(F.lit("  ```bsl\n"), T.truncated("code", SNIPPET), F.lit("\n  ```")))
    b = F.concat_ws("\n", place, given("signature", "  Сигнатура: "), given("file_path", "  Файл: "), snippet)
    c = F.concat(F.lit("- "), text("form_name"), F.lit(" ("), text("object"), F.lit("), элементов: "), F.coalesce(text("elements_count"), F.lit("0")))
    parts = [joined(df, cap, line).select(group, F.lit(i).alias("i"), F.concat(F.lit(head + "\n"), "t").alias("t")) for i, (df, head, cap, line) in enumerate(((objects, OBJECTS_HEAD, OBJECTS, a), (code, CODE_HEAD, SNIPPETS, b), (forms, FORMS_HEAD, FORM_LINES, c)))]
    if near is not None:
        line = F.concat(F.lit("  - "), text("object"), F.lit(" ["), text("edge_type"), F.lit("]"))
        sides = joined(near, EACH_SIDE, line, "asked", "side").groupBy(group, "asked").pivot("side", list(SIDES)).agg(F.first("t"))
        both = F.concat_ws("\n", *[F.concat(F.lit(head + "\n"), side) for side, head in SIDES.items()])
        parts.append(sides.select(group, F.lit(3).alias("i"), F.concat(F.lit(GRAPH_HEAD), "asked", F.lit("' ==\n"), both).alias("t")))
    every = parts[0]
    for more in parts[1:]:
        every = every.union(more)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "\n\n")
    return every.groupBy(group).agg(whole.alias("t")).select(group, T.truncated("t", budget).alias("context"))
