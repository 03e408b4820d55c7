"""Texts to embed, embedders, descriptors and types on small fixtures."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from ferrule.functions import text as T
from ferrule.operators import documents, embed, graph, lines
from ferrule.plans.tools import Store
from ferrule.sources import files
from ferrule.sources.parse_xml import parse_form, parse_object


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


METHOD = "object_type string, object_name string, module_name string, method_name string, signature string, code string, comments array<string>, source_id string, index_source string, file_path string"


def test_code_document(spark):
    long = "Процедура Длинная()\n" + "\n".join(f"  Строка{i} = {i};" for i in range(120)) + "\nКонецПроцедуры"
    rows = [("Catalogs", "Т", "М", "Длинная", "Процедура Длинная()", long, ["один", "два"], "", "", "a"), ("Catalogs", "Т", "М", "Короткая", "", "Ф()", [], "ext_я b", "extension", "b")]
    got = {(r.method_name, r.chunk_index): r for r in documents.code_chunks(spark.createDataFrame(rows, METHOD)).collect()}
    first, second, short = got["Длинная", 0], got["Длинная", 1], got["Короткая", 0]
    assert first.item_id == "main_code_Catalogs_Т_М_Длинная_0" and short.item_id == "ext_я_b_code_Catalogs_Т_М_Короткая_0"
    assert first.document.startswith("один\nдва\nПроцедура Длинная()\nПроцедура Длинная()\n  Строка0 = 0;") and first.code.endswith("\nКонецПроцедуры")
    assert second.document.startswith("Процедура Длинная()\nПроцедура Длинная()\n") and "один" not in second.document and second.total_chunks == first.total_chunks > 1
    assert short.document == "Ф()" and all(len(r.code) <= 844 + len("Процедура Длинная()\nКонецПроцедуры\n") for r in got.values())
    body = [x for k in range(first.total_chunks) for x in got["Длинная", k].code.split("\n")[1:-1]]
    assert list(dict.fromkeys(body)) == long.split("\n")[1:-1]  # every line, in order


def test_method_chunks_of_odd_code(spark):
    for code, parts in (("", [""]), ("a", ["a"]), ("x" * 2000, ["x" * 2000]), ("a\nb", ["a\nb"])):
        assert one(spark, lines.method_chunks(F.lit(code))) == parts


def test_embedded_keeps_one_row_an_item(spark):
    rows = [("i", f"текст {k}", f"/f{k}") for k in (2, 9, 4)] + [("j", "x", None)]
    df = spark.createDataFrame(rows, "item_id string, document string, file_path string")
    for part in (df, df.repartition(3), df.orderBy(F.desc("document"))):
        got = {r.item_id: r for r in documents.embedded(part).collect()}
        assert got["i"].document == "текст 9" and len(got) == 2 and len(got["i"].embedding) == 16


def test_embedders(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", None, "cccc", "dd.", ""])], "i int, t string").repartition(2)

    def model():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    got = df.withColumn("v", embed.from_function(model, batch=2)(F.col("t"))).orderBy("i").collect()
    assert [r.v[0] for r in got] == [1, 2, 0, 4, 3, 0]
    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(asked)
            data = [{"index": i, "embedding": [float(len(t))]} for i, t in enumerate(asked["input"])][::-1]
            body = json.dumps({"data": data}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        remote = embed.http(f"http://127.0.0.1:{server.server_port}/v1/embeddings", "m", batch=2, eos=".")
        got = df.withColumn("v", remote(F.coalesce("t", F.lit("")))).orderBy("i").collect()
    finally:
        server.shutdown()
    assert [r.v[0] for r in got] == [2, 3, 1, 5, 3, 1]
    assert all(a["model"] == "m" and len(a["input"]) <= 2 for a in seen)


def test_local_model(spark, tmp_path):
    module = tmp_path / "sentence_transformers.py"
    module.write_text("class SentenceTransformer:\n    def __init__(self, name):\n        self.name = name\n    def encode(self, texts):\n        return [[len(self.name), len(t)] for t in texts]\n")
    # The real library may be missing: a stand-in goes to the workers.
    spark.sparkContext.addPyFile(str(module))
    df = spark.createDataFrame([(1, "abc"), (2, None)], "i int, t string")
    assert [r.v for r in df.withColumn("v", embed.local("four")(F.col("t"))).orderBy("i").collect()] == [[4.0, 3.0], [4.0, 0.0]]


def test_toy_embedding(spark):
    text = "Тест пример 123"
    want = [1.0] + [0.0] * 15
    for i, c in enumerate(text):
        want[i % 16] += (ord(c) % 17) / 17
    assert one(spark, T.toy_embedding(F.lit(text))) == pytest.approx(want, abs=1e-6)


def attribute(kind):
    return f"<MetaDataObject><Catalog><Properties><Name>К</Name></Properties><attributes><name>А</name>{kind}</attributes></Catalog></MetaDataObject>"


def test_attribute_types():
    kinds = {
        "<type><typeId>CatalogRef.Х</typeId><string/></type>": "CatalogRef.Х", "<type><string/></type>": "Строка", "<type><number/></type>": "Число", "<type><date/></type>": "Дата", "<type><boolean/></type>": "Булево",
        "<type><other/></type>": "Составной тип", "": "Неопределено",
    }
    for xml, kind in kinds.items():
        assert parse_object(attribute(xml))["attributes"] == [{"name": "А", "type": kind}]
    assert parse_form('<f:Form xmlns:f="u"><f:Item name="а"/><f:Item/></f:Form>') == ["а"] and parse_form("<x") is None


@pytest.fixture
def dump(tmp_path):
    schema = "<DataCompositionSchema><dataSet><name>Н</name></dataSet></DataCompositionSchema>"
    own = "<MetaDataObject><Template><Properties><Name>{0}</Name><Synonym><item><content>син {0}</content></item></Synonym><TemplateType>SpreadsheetDocument</TemplateType></Properties></Template></MetaDataObject>"
    ext = "<MetaDataObject><ConfigurationExtension><Properties><Name>Р</Name></Properties></ConfigurationExtension></MetaDataObject>"
    for path, text in {
        "Reports/Р/Templates/Рядом.xml": own.format("Рядом"), "Reports/Р/Templates/Рядом/Ext/Template.xml": "<document><content>ячейка</content></document>",
        "Reports/Р/Templates/Внутри/Внутри.xml": own.format("Внутри"), "Reports/Р/Templates/Внутри/Ext/Template.xml": "<document/>", "Reports/Р/Templates/Без/Ext/Template.xml": schema,
        "exts/Б/Configuration.xml": ext, "exts/а/Configuration.xml": ext, "exts/none/x.txt": "", "CommonModules/М/Ext/Module.bsl": "Перем А;\nПроцедура П() Экспорт\nКонецПроцедуры", "README.md": "# Как\nискать",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_template_descriptors_and_extensions(spark, dump):
    got = {r.template_name: r for r in files.templates(spark, dump).collect()}
    assert {k: (r.kind, r.synonym, r.owner_type, r.owner_name) for k, r in got.items()} == {"Рядом": ("SpreadsheetDocument", "син Рядом", "Reports", "Р"), "Внутри": ("SpreadsheetDocument", "син Внутри", "Reports", "Р"), "Без": ("DataCompositionSchema", "", "Reports", "Р")}
    assert got["Рядом"].cell_texts == ["ячейка"] and [r.template_name for r in files.report_schemas(spark, dump).collect()] == ["Без"]
    assert [p.rpartition("/")[2] for p in files.extension_roots(spark, f"{dump}/exts")] == ["а", "Б"]
    assert len(files.extension_roots(spark, f"{dump}/exts", f"{dump}/exts/а")) == 1 and files.extension_roots(spark, f"{dump}/nothing") == []
    assert Store(spark, {}).instructions(f"{dump}/README.md").first().instructions == "# Как\nискать"
    assert [r.object for r in files.module_list(spark, dump).collect()] == ["CommonModules.М"]


def test_plain_text_columns(spark):
    assert one(spark, T.plain_xml_text(F.array(*[F.lit(x) for x in (" а  б ", "а б", "я", "вг")]))) == "а б\nвг"
    assert one(spark, T.csv_list(F.lit(" a, ,b ,"))) == ["a", "b"] and one(spark, T.csv_list(F.lit(None).cast("string"))) == []


def test_neighbours_spellings(spark):
    nodes = spark.createDataFrame([(f"metadata:Catalogs:{n}", "Metadata", n, "Catalogs", n, "", "") for n in "АБВ"], graph.NODE)
    edges = spark.createDataFrame([("metadata:Catalogs:А", "metadata:Catalogs:Б", "REFERENCES", ""), ("metadata:Catalogs:В", "metadata:Catalogs:Б", "USES_IN_CODE", "")], graph.EDGE)
    for raw in ("Б", "Catalogs.Б", "metadata:Catalogs:Б"):
        assert [r.object for r in graph.neighbours(nodes, edges, raw, True, ranked=True).orderBy("rank").collect()] == ["Catalogs.А", "Catalogs.В"]
    assert graph.neighbours(nodes, edges, "Б", True, limit=-5).count() == 1
    with pytest.raises(ValueError):
        graph.neighbours(nodes, edges, " ", True)


def test_module_info(spark, dump):
    from ferrule.sources import parse_code

    df = spark.createDataFrame([("a", "&НаСервере\nПроцедура А()\nКонецПроцедуры\n&наклиенте\n&НаСервере"), ("b", "")], "file_path string, text string")
    got = {r.file_path: r for r in parse_code.module_info(df).collect()}
    assert got["a"].directives == ["НаСервере", "наклиенте"] and got["a"].line_count == 5 and got["b"].directives == [] and got["b"]["size"] == 0
    rows = files.all_methods(spark, dump).collect()
    assert [(r.method_name, r.is_export, r.object_type) for r in rows] == [("П", True, "CommonModules")]
