"""Scans, parsers, graph and tools on a small tree."""

import pytest

from ferrule.operators import graph, lines
from ferrule.plans import index
from ferrule.plans.settings import Settings, parse_env
from ferrule.plans.tools import TOOLS, Store
from ferrule.sources import files
from ferrule.sources.parse_code import parse_module
from ferrule.sources.parse_xml import parse_object, parse_rights, parse_root, parse_template

MODULE = """﻿Перем Итог;
// Считает товар
&НаСервереБезКонтекста
Функция Посчитать(Ссылка, Знач) Экспорт // видна всем
\tВозврат Справочники.Товары.Найти(Ссылка) + документы.Заказ;
КонецФункции

// Процедура Старая()
Процедура Пустая()
КонецПроцедуры
"""


def test_module():
    a, b = parse_module(MODULE.replace("\n", "\r\n"))
    assert (a["method_name"], a["is_export"], a["directive"], a["params"]) == ("Посчитать", True, "НаСервереБезКонтекста", "Ссылка, Знач")
    assert a["comments"] == ["Считает товар"] and a["module_variables"] == ["Итог"] and a["code"].endswith("КонецФункции")
    assert b["method_name"] == "Пустая" and b["body"] == ""
    assert parse_module("") == [] and parse_module(None) == [] and len(parse_module("А = 1;")) == 1


OBJECT = """<?xml version="1.0"?><MetaDataObject xmlns="urn:a" xmlns:v8="urn:a"><Catalog><v8:name>Товары</v8:name><v8:synonym><v8:item><v8:presentation>Все товары</v8:presentation></v8:item></v8:synonym>
<v8:attributes><v8:name>Вес</v8:name><v8:type><v8:number/></v8:type></v8:attributes>
<v8:tabularSections><v8:name>Цены</v8:name><v8:attributes><v8:name>Цена</v8:name></v8:attributes></v8:tabularSections></Catalog></MetaDataObject>"""
ROLE = """<MetaDataObject><Role><Properties><Name>Чтение</Name><Comment>к</Comment></Properties></Role></MetaDataObject>"""
RIGHTS = "<Rights><object><name>Catalog.Товары</name><right><name>Read</name><value>true</value></right><right><name>Insert</name><value>false</value></right></object><object><name>Catalog.Нет</name><right><name>Read</name><value>false</value></right></object></Rights>"
SCHEMA = "<DataCompositionSchema><dataSet><name>Н</name><query>ВЫБРАТЬ 1</query></dataSet><parameter><name>П</name></parameter></DataCompositionSchema>"


def test_xml():
    o = parse_object(OBJECT, "x")
    assert (o["name"], o["synonym"], o["attributes_count"], o["own_attributes_count"]) == ("Товары", "Все товары", 2, 1)
    assert o["attributes"][0]["type"] == "Число" and o["tabular_sections"][0]["name"] == "Цены"
    assert parse_object("<broken", "x") is None
    assert parse_rights(RIGHTS) == [{"name": "Catalog.Товары", "rights": ["Read"]}]
    t = parse_template(SCHEMA)
    assert (t["kind"], t["data_sets"], t["queries"], t["parameters"]) == ("DataCompositionSchema", ["Н"], ["ВЫБРАТЬ 1"], ["П"])
    assert parse_template("<html><script>x</script><p>Да</html>")["body_text"] == "Да"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("dump") / "a b+c%d"
    for path, text in {
        "Configuration.xml": "<MetaDataObject><Configuration><Properties><Name>Учёт</Name></Properties></Configuration></MetaDataObject>", "Catalogs/Товары.xml": OBJECT, "Catalogs/Товары/Ext/МодульОбъекта.bsl": MODULE,
        "Roles/Чтение.xml": ROLE, "Roles/Чтение/Ext/Rights.xml": RIGHTS, "Reports/Остатки/Templates/Схема/Ext/Template.xml": SCHEMA, "Reports/Остатки/Templates/Данные/Ext/Template.bin": "x",
        "Catalogs/Товары/Forms/Список/Ext/Form.xml": '<Form xmlns="urn:f"><Item name="Поле"/><Item name="Кнопка"/></Form>',
    }.items():
        (r / path).parent.mkdir(parents=True, exist_ok=True)
        (r / path).write_text(text, encoding="utf-8")
    return str(r)


def test_index_and_tools(spark, root, tmp_path):
    out = index.build(spark, str(tmp_path / "store"), root)
    assert out["code_count"] == 2 and out["forms_count"] == 1 and out["metadata_count"] == 4
    store = Store.open(spark, str(tmp_path / "store"), roots=index.sources(spark, root))
    edges = {(r.source, r.target, r.edge_type) for r in store.tables["edges"].collect()}
    assert ("metadata:Roles:Чтение", "metadata:Catalogs:Товары", "HAS_RIGHT") in edges
    assert ("metadata:Catalogs:Товары", "metadata:Documents:Заказ", "USES_IN_CODE") in edges
    assert any(e[2] == "HAS_TEMPLATE" and e[0] == "metadata:Reports:Остатки" for e in edges)
    use = store.find_method_usage("Найти").collect()
    assert len(use) == 1 and use[0].in_method == "Посчитать"
    assert store.search_code("посчитать товар", 5).count() == 2
    assert store.search_metadata("товары", "Справочник", 5).first()["name"] == "Товары"
    assert {r.edge_type for r in store.graph_dependencies("Catalogs.Товары").collect()} >= {"HAS_RIGHT"}
    assert store.stats().where("collection = 'total'").first().n == 7
    assert Store(spark, {}).graph_dependencies("X").count() == 0
    with pytest.raises(ValueError):
        store.search_code(" ")
    # Tools by name, usages with what the graph adds, the question flow.
    import json

    assert json.loads(store.respond("nothing")) == {"error": "unknown tool: nothing"}
    assert "query" in json.loads(store.respond("search_1c_code", {"query": " "}))["error"]
    assert json.loads(store.respond("search_1c_code", {"query": "посчитать", "limit": 1}))["total_results"] == 1
    assert TOOLS["search_1c_code"].schema()["required"] == ["query"] and "enum" in TOOLS["search_1c_metadata"].schema()["properties"]["object_type"]
    rows = store.call("find_1c_method_usage", {"method_name": "Найти"})[0].collect()
    assert [(r.source, r.in_method, r.line_number) for r in rows if r.source == "grep"] == [("grep", "Посчитать", 5)]
    used = store.method_usage("Товары").collect()
    assert {r.source for r in used} >= {"grep", "graph"} and not {r.object for r in used if r.source == "graph"} & {r.object for r in used if r.source == "grep"}
    bare = Store(spark, store.tables)
    assert [r.source for r in bare.find_method_usage("Посчитать").collect()] == ["vector"]
    seen = []
    answer = store.ask("где используется товары", lambda m: seen.append(m) or "да", use_graph=None)
    assert answer["answer"] == "да" and answer["has_context"] and seen[0][0]["role"] == "system"
    assert "== ОБЪЕКТЫ МЕТАДАННЫХ ==\n- " in answer["context"] and "  ```bsl\n" in answer["context"] and "элементов: 2" in answer["context"]
    assert Store(spark, {}).context("x") == "" and Store(spark, {}).search_code("x").columns == store.search_code("x").columns
    found = json.loads(store.respond("search_by_object_name", {"object_name": "Товары"}))
    assert {"object"} <= {r["part"] for r in found["results"]} <= {"object", "code"}


def test_context(spark):
    from ferrule.plans.tools import context

    objects = spark.createDataFrame([(1, i, "Catalogs", f"О{i}", "син" if i == 1 else "", "о" * 400 if i == 1 else None, "/f" if i == 1 else "") for i in range(1, 11)], "question_id int, rank int, type string, name string, synonym string, description string, file_path string")
    code = spark.createDataFrame([(1, i, "Catalogs.А", "М" if i == 1 else "", "м" if i == 1 else None, "", "к" * 1300 if i == 1 else "", None) for i in range(1, 9)], "question_id int, rank int, object string, module string, method string, signature string, code string, file_path string")
    forms = spark.createDataFrame([(1, i, f"Ф{i}", "Catalogs.А", i) for i in range(1, 8)], "question_id int, rank int, form_name string, object string, elements_count int")
    near = spark.createDataFrame([(1, i, "О1", side, f"Documents.Д{i}", "REFERENCES") for side in ("dependencies", "references") for i in range(1, 31)], "question_id int, rank int, asked string, side string, object string, edge_type string")
    text = context(objects, code, forms, near).first().context
    assert text.startswith("== ОБЪЕКТЫ МЕТАДАННЫХ ==\n- Catalogs.О1 (син)\n  Описание: " + "о" * 297 + "...\n  Файл: /f\n- Catalogs.О2\n") and "О8" in text and "О9" not in text
    assert "== ФРАГМЕНТЫ КОДА ==\n- Catalogs.А / М / м\n  ```bsl\n" + "к" * 1197 + "...\n  ```\n- Catalogs.А\n" in text and text.count("- Catalogs.А\n") == 5
    assert "== ФОРМЫ ==\n- Ф1 (Catalogs.А), элементов: 1\n" in text and "Ф6" not in text
    assert "== ГРАФ ЗАВИСИМОСТЕЙ для 'О1' ==\nНа объект ссылаются (зависят от него):\n  - Documents.Д1 [REFERENCES]\n" in text and text.count("Д25 [") == 2 and "Д26" not in text
    assert len(context(objects, code, forms, near, budget=100).first().context) == 100
    assert "ГРАФ" not in context(objects, code, forms, near.limit(0)).first().context


def test_index_versions(spark, root, tmp_path):
    where = str(tmp_path / "store")
    first = index.build(spark, where, root, version="v1")
    again = index.build(spark, where, root, version="v1")  # goes on where it was: nothing is written anew
    assert {k: v for k, v in first.items() if k.endswith("_count")} == {k: v for k, v in again.items() if k.endswith("_count")}
    manifest = index.Manifest(spark, where)
    assert manifest.version == "v1" and manifest.tables["code"] == {"main": "code/main/v1"}
    third = index.build(spark, where, root, only=[], version="v2")  # no source: items stay, the graph is built again
    assert third["code_count"] == first["code_count"] and index.Manifest(spark, where).tables["code"] == {"main": "code/main/v1"}
    assert index.Manifest(spark, where).tables["nodes"] == {"": "nodes/all/v2"}
    assert index.restore(spark, where) == "v1" and index.Manifest(spark, where).tables["nodes"] == {"": "nodes/all/v1"}
    t = index.read(spark, where)
    staged = str(tmp_path / "staged")
    assert index.stage_csv(t["nodes"], t["edges"], staged) == {"nodes_count": first["nodes_count"], "edges_count": first["edges_count"]}
    out = index.rebuild(spark, staged, where)
    assert (out["nodes_count"], out["edges_count"], out["backup"]) == (first["nodes_count"], first["edges_count"], "v1")
    back = index.read(spark, where)
    for name in ("nodes", "edges"):
        assert sorted(map(tuple, back[name].select(*t[name].columns).collect())) == sorted(map(tuple, t[name].collect()))
    with pytest.raises(FileNotFoundError):
        index.rebuild(spark, str(tmp_path / "none"), where)
    index.clear(spark, where)
    assert index.read(spark, where)["code"] is None


def test_root_descriptor(spark, root, tmp_path):
    info = files.dump_info(spark, root).first()
    assert (info.valid, info.is_extension, info.configuration_name, info.root_element, info.error) == (True, False, "Учёт", "MetaDataObject", None)
    ext = "<MetaDataObject><ConfigurationExtension><Properties><Name>Р</Name></Properties></ConfigurationExtension></MetaDataObject>"
    assert parse_root(ext) == {"valid": True, "is_extension": True, "configuration_name": "Р", "root_element": "MetaDataObject", "error": None}
    assert parse_root("<Configuration><x/></Configuration>")["valid"] and parse_root("<a><b><ConfigurationExtension/></b></a>")["is_extension"]
    assert not parse_root("<a")["valid"] and parse_root("<a")["error"]
    assert not files.dump_info(spark, str(tmp_path)).first().valid


def test_templates():
    cells = "".join(f"<c><content>т{i}  я</content></c>" for i in range(300))
    t = parse_template(f"<document>{cells}<parameter>П</parameter><parameter>Пар</parameter><namedItem><name>Шапка</name></namedItem></document>")
    assert t["kind"] == "SpreadsheetDocument" and len(t["cell_texts"]) == 250 and t["cell_texts"][0] == "т0 я" and t["parameters"] == ["Пар"] and t["named_areas"] == ["Шапка"]
    assert parse_template("нет разметки " * 2000) | {"body_text": ""} == parse_template("x") | {"body_text": ""} and len(parse_template("нет разметки " * 2000)["body_text"]) == 8000
    assert parse_template("просто", "TextDocument")["kind"] == "TextDocument" and parse_template(" ") is None and parse_template("<DataCompositionSchema") is None
    assert parse_template("<a><b>один</b><c>два</c><c>два</c></a>")["body_text"] == "один\nдва"
    s = parse_template("<DataCompositionSchema><DataSetField><dataPath>А</dataPath><name>Б</name></DataSetField><field><name>А</name></field><calcParameter><name>П</name></calcParameter><dataSet><x/><name>1</name><name>2</name></dataSet></DataCompositionSchema>")
    assert (s["fields"], s["parameters"], s["data_sets"]) == (["А", "Б"], ["П"], ["1"])


def test_model_dimensions():
    from ferrule.operators.embed import dimension

    for name, dim in (("text-embedding-3-large", 3072), ("text-embedding-3-small", 1536), ("text-embedding-ada-002", 1536), ("Qwen3-Embedding-1.7B", 2048), ("qwen3-embedding", 2560), ("intfloat/e5-mistral-7b-instruct", 4096), ("jinaai/jina-embeddings-v3", 1024), ("cohere/embed-english-v3.0", 1024), ("ibm-granite/granite-embedding-30m-english", 384), ("something-large", 768), ("BAAI/bge-m3", 1024)):
        assert dimension(name) == dim
    assert dimension("x", 5) == 5


def test_grep_keeps_files_apart(spark):
    code = "Процедура {}()\n Вызов();\nКонецПроцедуры\r\n\r\nвызов() // и ВЫЗОВ\nНеВызов()"
    df = spark.createDataFrame([("a.bsl", code.format("Один")), ("a.bsl", code.format("Два")), ("b.bsl", "Вызов()")], "file_path string, text string")
    got = sorted((r.file_path, r.line_number, r.line_content, r.in_method) for r in lines.grep(df, "Вызов").collect())
    assert got == [("a.bsl", 2, "Вызов();", "Два"), ("a.bsl", 2, "Вызов();", "Один"), ("a.bsl", 5, "вызов() // и ВЫЗОВ", "Два"), ("a.bsl", 5, "вызов() // и ВЫЗОВ", "Один"), ("b.bsl", 1, "Вызов()", "")]
    assert "Exchange" not in lines.grep(df, "Вызов")._jdf.queryExecution().executedPlan().toString()
    assert lines.grep(df, "вызов", limit=2).count() == 2


def test_graph_rules(spark):
    nodes = spark.createDataFrame([("a", "Metadata", "A", "T", "A", "s", "", 1), ("a", "Metadata", "A2", "T", "A", "", "", 2), ("", "Metadata", "", "", "", "", "", 3), ("b", "Odd", "B", "T", "B", "", "", 4)], "id string, node_type string, name string, object_type string, object_name string, synonym string, extra string, seq int")
    kept = graph.upsert_nodes(graph.checked_nodes(nodes)).collect()
    assert [(r.id, r["name"], r.synonym) for r in kept] == [("a", "A2", "s")]
    assert graph.clamped(-5) == 1 and graph.clamped("x") == 100 and graph.clamped(10**9) == 500


def test_settings():
    assert Settings().chunk_chars == 844 and Settings().overlap_chars == 165
    assert Settings.from_env({"HYBRID_ALPHA": "1", "USE_MMR": "false"}) == Settings(hybrid_alpha=1.0, use_mmr=False)
    assert parse_env("# c\nA='1'\n") == {"A": "1"}
    assert files.split_paths("C:/a; c:/A;\n/b") == ["C:/a", "/b"]


def test_jobs_and_profiles(spark, root, tmp_path):
    import json

    from ferrule.plans import jobs
    from ferrule.plans.profiles import profiles
    from ferrule.plans.settings import profile_env

    store, staged = str(tmp_path / "store"), str(tmp_path / "staged")
    assert "error" in jobs.run(spark, ["index", "--root", store, "--config-path", str(tmp_path)])
    built = jobs.run(spark, ["index", "--root", store, "--config-path", root, "--clear"])
    assert built["code_count"] == 2
    stats = jobs.run(spark, ["stats", "--root", store])
    assert stats["total"] == 7 and stats["graph_nodes_total"] == built["nodes_count"]
    assert jobs.run(spark, ["stage", "--root", store, "--staging", staged]) == {"nodes_count": built["nodes_count"], "edges_count": built["edges_count"]}
    assert jobs.run(spark, ["rebuild", "--root", store, "--staging", staged])["edges_count"] == built["edges_count"]
    found = jobs.run(spark, ["call", "search_1c_metadata", json.dumps({"query": "товары", "object_type": "Справочник"}), "--root", store])
    assert [r["name"] for r in found["results"]] == ["Товары"] and found["results"][0]["index_source"] == "main"
    assert jobs.run(spark, ["restore", "--root", store])["version"] == built["version"]
    assert jobs.run(spark, ["clear", "--root", store]) == {"cleared": store} and files.report_schemas(spark, root).count() == 1
    for name, env in (("b", "DESCRIPTION='Б'\nHYBRID_ALPHA=0.5\n"), ("A", "PROFILE_NAME=a\n"), ("none", None)):
        (tmp_path / "p" / name).mkdir(parents=True)
        if env:
            (tmp_path / "p" / name / f"{name}.env").write_text(env)
    (tmp_path / "p" / "b" / "more.env").write_text("HYBRID_ALPHA=0.6\nX=1\n")
    (tmp_path / "p" / "b" / ".env.local").write_text("X=2\n")
    (tmp_path / "r.json").write_text(json.dumps({"profiles": [{"name": "a", "index": "/i", "env": {"USE_MMR": "false"}}, {"name": " "}, {"name": "C"}]}))
    assert profile_env(str(tmp_path / "p" / "b")) == {"DESCRIPTION": "Б", "HYBRID_ALPHA": "0.6", "X": "2"}
    listed = profiles(str(tmp_path / "p"), str(tmp_path / "r.json"))
    assert [(p.name, p.source) for p in listed] == [("a", "registry"), ("b", "profile"), ("C", "registry")]
    assert listed[1].settings.hybrid_alpha == 0.6 and not listed[0].settings.use_mmr and not listed[0].available
    assert jobs.run(spark, ["profiles", "--folder", str(tmp_path / "p")])["profiles"][1]["description"] == "Б"


def test_streaming(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from ferrule.streaming.upsert import latest, merge_batches, merged, usages

    events = spark.read.parquet(f"{sf}/events.parquet")
    src, out = tmp_path / "in", str(tmp_path / "out")
    events.repartition(3).write.parquet(str(src))

    def stream():
        return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(src))

    def ended(q):
        q.awaitTermination()
        return q

    keys, seq = ["user_id", "event_type"], ["ts", "event_id"]
    merge = merge_batches(out, keys, seq, parts=5)
    ended(stream().writeStream.foreachBatch(merge).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    want = sorted(map(tuple, graph.upsert(events, keys, seq).collect()), key=str)
    assert sorted(map(tuple, merged(spark, out).select(*graph.upsert(events, keys, seq).columns).collect()), key=str) == want
    left = sorted(p.name for v in (tmp_path / "out").glob("v*") for p in v.glob("part=*"))
    assert left == sorted(set(left)) and len(left) == 5  # one folder a part
    merge(events.limit(0), 0)  # a batch that ran before changes nothing
    assert merged(spark, out).count() == len(want) and merged(spark, str(tmp_path / "none")) is None

    ended(latest(stream(), ["user_id"], "value", "ts").writeStream.format("memory").queryName("latest_values").outputMode("complete").trigger(availableNow=True).start())
    top = events.groupBy("user_id").agg(F.max_by("value", "ts").alias("value"), F.max("ts").cast("timestamp").alias("ts"))
    assert sorted(map(tuple, spark.table("latest_values").select("user_id", "value", "ts").collect())) == sorted(map(tuple, top.collect()))

    ended(usages(stream().select("event_id", F.concat_ws(" ", "event_type", F.lit("clicks")).alias("text")), "CLICK").writeStream.format("memory").queryName("uses").trigger(availableNow=True).start())
    assert spark.table("uses").count() == events.where("event_type = 'click'").count()
