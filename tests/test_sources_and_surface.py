import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import tabular
from quillspark.plans import agent, safe_sql
from quillspark.sources import files, grid, providers

GRID = "row_idx int, cells array<string>, cell_kind array<string>"


def sheet(spark, rows):
    kind = lambda c: "null" if c is None else "number" if c.replace(".", "", 1).isdigit() else "text"
    return spark.createDataFrame([(i, r, [kind(c) for c in r]) for i, r in enumerate(rows)], GRID)


def test_grid(spark):
    rows = [["Inventory", None, None, None], [None] * 4, ["Product ID", "Hand-In-\nStock", "Weird  Header (kg)", "Weird  Header (kg)"], ["P1", "5", "1.5", None], ["P2", None, "2", None], [None] * 4]
    df = grid.load_grid(sheet(spark, rows))
    assert df.dtypes == [("product_id", "string"), ("hand_in_stock", "bigint"), ("weird_header_kg", "double"), ("weird_header_kg_2", "string")]
    assert [tuple(r) for r in df.collect()] == [("P1", 5, 1.5, None), ("P2", None, 2.0, None)]
    assert df.schema["hand_in_stock"].metadata["original"] == "Hand-In-Stock"
    assert [n for n, _ in grid.column_names(spark, ["A b", "a-B", None, "(x)"])] == ["a_b", "a_b_2", "unnamed", "x"]
    with pytest.raises(ValueError, match="header"):
        grid.load_grid(sheet(spark, [["title", None], [None, None]]))


def test_text_with_commas_stays_text_and_booleans_are_numbers(spark):
    rows = [(0, ["a", "b", "c"], ["text"] * 3), (1, ["1,234", "true", "5"], ["text", "bool", "number"]), (2, ["7", "false", "6"], ["number", "bool", "number"])]
    assert grid.load_grid(spark.createDataFrame(rows, GRID)).dtypes == [("a", "string"), ("b", "bigint"), ("c", "bigint")]


def test_whole_numbers_beyond_a_double(spark):
    rows = [["Product ID", "Name", "Units"], ["9007199254740993", "9223372036854775807", "1e3"], ["-9007199254740993", "2", "7."]]
    df = grid.load_grid(spark.createDataFrame([(0, rows[0], ["text"] * 3), *[(i, r, ["number"] * 3) for i, r in enumerate(rows[1:], 1)]], GRID))
    assert [t for _, t in df.dtypes] == ["bigint"] * 3
    assert [tuple(r) for r in df.collect()] == [(9007199254740993, 9223372036854775807, 1000), (-9007199254740993, 2, 7)]


def test_header_names(spark):
    want = [("hand_in_stock", "Hand-In-Stock"), ("purchase_stock_in_n", "Purchase/Stock in (n)"), ("column", "--"), ("stock_in", "Purchase/Stock in"), ("a_xb", "a(x)b"), ("unnamed", ""), ("unnamed_2", "")]
    assert grid.column_names(spark, ["Hand-\nIn- Stock", "Purchase/ Stock   in (n)", "--", "Purchase/\nStock in", "a(x)b", " ", None]) == want


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Units</t></is></c><c r="C1" t="str"><v>Flag</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>4</v></c><c r="C2"><v>2</v></c></row>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Product ID</t></si><si><t>P9</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    assert [tuple(r) for r in grid.load_grid(grid.read_workbook(spark, str(tmp_path / "b.xlsx"))).collect()] == [("P9", 4, 2)]


def test_files(spark, tmp_path):
    for name, data in {"a.PDF": b"%PDF-1.4", "b.png": b"", "c.txt": b"x", "d.jpg": b"no image"}.items():
        (tmp_path / name).write_bytes(data)
    good, bad = files.split_errors(files.load_files(spark, str(tmp_path)))
    assert [r.name for r in good.collect()] == ["a.PDF"]
    assert {r.name: r.error for r in bad.collect()} == {"b.png": "empty file", "c.txt": "unsupported file type .txt", "d.jpg": "could not decode the file"}


STOCK = "product_id string, product_name string, opening_stock bigint, stock_in bigint, units_sold bigint, hand_in_stock bigint, cost_price_total_usd bigint"


@pytest.fixture
def stock(spark):
    return spark.createDataFrame([("P1", "Mouse", 10, 5, 3, 12, 100), ("P2", "USB Hub", 35, 12, 4, 31, 50), ("P3", "50% off_bag", 1, 1, 1, None, 7)], STOCK)


def test_consistency_and_profile(stock):
    rows = {r.product_id: r.difference for r in tabular.stock_consistency(stock).collect()}
    assert rows == {"P2": -12, "P3": None}
    assert tuple(tabular.profile(stock).first()) == (3, 43, 157, 2)
    assert tabular.profile(stock.drop("stock_in")).first().n_inconsistent is None
    with pytest.raises(ValueError, match="product_name"):
        tabular.stock_consistency(stock.drop("product_name"))


def test_semantics(spark, stock):
    df = spark.createDataFrame([(1, None, 2.0), (2, "a", None), (3, "a", 5.0)], "i int, k string, v double")
    assert [r.k for r in tabular.group_agg(df, ["k"], F.sum("v").alias("s")).collect()] == ["a"]
    assert [r.i for r in tabular.top_k(df, "v", 3, "i").collect()] == [3, 1, 2]
    assert [r.i for r in tabular.top_k(df, "v", 3, "i", largest=False).collect()] == [1, 3, 2]
    assert tabular.merge(df, df.select(F.col("k").alias("j")).distinct(), "k", "j").count() == 3
    row = spark.range(1).select(tabular.floor_div(F.lit(-7), F.lit(3)).alias("q"), tabular.modulo(F.lit(-7), F.lit(3)).alias("m")).first()
    assert (row.q, row.m) == (-3, 2)
    assert [r.product_id for r in stock.where(agent.product_filter("product_name", "50% OFF_")).collect()] == ["P3"]
    assert [r.product_id for r in stock.where(agent.product_filter("product_name", "5_%")).collect()] == []
    assert tabular.capped(df, 2)[1] and not tabular.capped(df, 3)[1]


BLOCKED = [
    "DROP TABLE df",
    "SELECT * FROM other",
    "SELECT * FROM parquet.`/etc`",
    "SELECT java_method('java.lang.System', 'exit', 1) FROM df",
    "SELECT reflect('java.lang.Runtime', 'getRuntime') FROM df",
    "INSERT INTO df SELECT * FROM df",
    "CREATE TABLE x AS SELECT * FROM df",
    "SET spark.sql.ansi.enabled=false",
    "ADD JAR 'x.jar'",
    "SELECT TRANSFORM(product_id) USING 'cat' FROM df",
    "SELECT input_file_name() FROM df",
    "SELECT * FROM range(10)",
    "SELECT (SELECT max(x) FROM secret) FROM df",
    "SELECT * FROM df WHERE product_id IN (SELECT id FROM secret)",
    "WITH t AS (SELECT * FROM hidden) SELECT * FROM t",
    "SELECT * FROM df; DROP TABLE df",
    "SHOW TABLES",
    "DESCRIBE df",
    "SELECT current_user() FROM df",
    "not sql at all",
]


@pytest.mark.parametrize("sql", BLOCKED)
def test_blocked(stock, sql):
    out = safe_sql.run(stock, sql)
    assert not out.ok and out.error and out.rows is None


def test_allowed(spark, stock):
    out = safe_sql.run(stock, "WITH t AS (SELECT * FROM df WHERE hand_in_stock > 1) SELECT product_id, sum(hand_in_stock) OVER (ORDER BY product_id) AS s FROM t ORDER BY 1")
    assert out.ok and [tuple(r) for r in out.collected] == [("P1", 12), ("P2", 43)] and not out.truncated
    many = safe_sql.run(spark.range(460).toDF("n"), "SELECT n FROM df")
    assert many.ok and many.truncated and len(many.collected) == 200
    bad = safe_sql.run(stock, "SELECT missing FROM df")
    assert not bad.ok and "missing" in bad.error.lower() and "/root" not in bad.error
    assert not safe_sql.run(stock, "SELECT 1 FROM df " + " " * 7000).ok


def test_time_limit(spark):
    slow = spark.range(60_000).toDF("n")
    out = safe_sql.run(slow, "SELECT sum(a.n % 7 * b.n % 5) FROM df a JOIN df b ON a.n <> b.n", seconds=0.5)
    assert not out.ok and "time limit" in out.error


def test_charts(stock):
    assert safe_sql.valid_chart({"kind": "bar", "x": "product_name", "y": "hand_in_stock"}, stock)
    assert not safe_sql.valid_chart({"kind": "bar", "x": "product_name", "y": "product_id"}, stock)
    assert not safe_sql.valid_chart({"kind": "map", "x": "product_name", "y": "hand_in_stock"}, stock)


def test_agent(stock):
    planner = providers.ScriptedProvider([{"intent": "data", "code": "SELECT nope FROM df"}, {"intent": "data", "code": "SELECT product_id FROM df WHERE units_sold > 3"}, {"intent": "clarify", "message": "which one?"}])
    a = agent.TableAgent(stock, planner)
    assert a.ask(" ").error and a.turns == []
    assert "P2" in a.ask("who sold most?").text and len(planner.asked) == 2
    assert a.ask("and?").text == "which one?" and "who sold most?" in planner.asked[2][1]
    assert agent.result_text(stock.where("false")) == "(no rows)"


def test_providers(spark):
    source = "array<struct<title:string,url:string,snippet:string>>"
    rows = [("q", "a", 1, None, [], "down"), ("q", "b", 2, "yes", [("T[1]", "https://x.org", "s"), ("u", "ftp://y", "")], None), ("r", "a", 1, None, [], "down"), ("r", "b", 2, None, [], "quota"), ("u", "a", 1, "none", [], None)]
    out = {r.query: r for r in providers.fallback(spark.createDataFrame(rows, f"query string, provider string, priority int, answer string, sources {source}, error string")).collect()}
    assert out["q"].provider == "b" and out["u"].answer == "none" and out["r"].error == "a: down; b: quota"
    listed = spark.createDataFrame([(out["q"].sources,)], f"s {source}").select(providers.source_list(providers.http_sources(F.col("s")))).first()[0]
    assert listed == "1. [T(1)](https://x.org)"
    assert providers.lenient_json('see ```json\n{"a": {"b": 1}}``` ok') == {"a": {"b": 1}}
    with pytest.raises(ValueError, match="JSON"):
        providers.lenient_json("[1, 2]")


def test_streamed_history(spark, tmp_path):
    from quillspark.streaming.history import streaming_history

    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(14)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv_id bigint, turn bigint, role string, text string").parquet(str(tmp_path / "in"))
    q = streaming_history(stream).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.turn: r.history for r in spark.table("kept").collect()}
    assert got[0] == "" and got[13].splitlines()[0] == "assistant: t3" and len(got[13].splitlines()) == 10


def test_settings():
    from quillspark.sources.settings import search_provider, settings

    plain = settings({})
    assert (plain.provider, plain.threshold, plain.crop_reads, plain.pdf_dpi, plain.fallback_models) == ("anthropic", 0.85, "per_field", 200, ())
    own = settings({"LLM_PROVIDER": " Gemini ", "REVIEW_THRESHOLD": "1", "LLM_FALLBACK_MODELS": "a, b,", "GEMINI_API_KEY": "k"})
    assert own.provider == "gemini" and own.fallback_models == ("a", "b") and own.keys_present["gemini"] and not own.keys_present["tavily"]
    for name, bad in (("LLM_PROVIDER", "x"), ("REVIEW_THRESHOLD", "0"), ("REVIEW_THRESHOLD", "1.5"), ("LLM_TIMEOUT_SECONDS", "0"), ("CROP_READS", "all"), ("PDF_DPI", "many")):
        with pytest.raises(ValueError, match=name):
            settings({name: bad})
    made = {n: (lambda n=n: n) for n in ("tavily", "llm", "duckduckgo")}
    assert search_provider("auto", made) == ["duckduckgo"] and search_provider("", made, "gemini") == ["llm", "duckduckgo"]
    assert search_provider("auto", made, "gemini", tavily=True) == ["tavily"] and search_provider("LLM", made, "openai") == ["llm"]
    with pytest.raises(ValueError):
        search_provider("llm", made)


def test_nullable_types():
    schema = {"type": "object", "additionalProperties": False, "properties": {"a": {"type": ["string", "null"]}, "b": {"type": "array", "items": {"type": ["null"]}}}}
    assert providers.nullable_types(schema) == {"type": "object", "properties": {"a": {"type": "string", "nullable": True}, "b": {"type": "array", "items": {"type": "string", "nullable": True}}}}
