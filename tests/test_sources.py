"""Readers, sinks, sessions and streams on small files."""

import json
import sqlite3
import zipfile
from datetime import date, datetime
from decimal import Decimal

import pytest

from granary.operators import completeness as comp
from granary.plans.session import Check, read_config
from granary.plans.sinks import base_name, plain, write_parts
from granary.plans.types import normalise
from granary.sources import stores
from granary.sources.database import Database, config_of_url, is_sql, jdbc_options
from granary.sources.files import format_of, read_csv, read_path
from granary.sources.registry import load
from granary.streaming.merge import collect_partials, merged


def test_csv_rules(spark, tmp_path):
    p = tmp_path / "ragged.csv"
    p.write_text('a,b\n1,x\n2\n3,y,z\nNA,null\n4,"q, ""r"""\n')
    got = sorted((tuple(r) for r in read_csv(spark, str(p)).collect()), key=repr)
    assert got == sorted([(1, "x"), (2, None), (None, None), (4, 'q, "r"')], key=repr)
    p.write_text("junk\nmore\na,b\n007,1.5\n8,2\n")
    df = read_csv(spark, str(p), skiprows=2)
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(7, 1.5), (8, 2.0)]
    p.write_text("col\n")
    assert read_csv(spark, str(p)).count() == 0
    p.write_text("")
    with pytest.raises(ValueError):
        read_csv(spark, str(p))


def test_folder_and_suffix(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_path(spark, str(tmp_path))
    (tmp_path / "b.csv").write_text("x\n1\n")
    (tmp_path / "a.csv").write_text("y\n1\n")
    assert read_path(spark, str(tmp_path)).columns == ["y"]
    (tmp_path / "c.txt").write_text("x")
    with pytest.raises(ValueError):
        read_path(spark, str(tmp_path / "c.txt"))
    assert [format_of(p) for p in ("a.JSON", "a.pq", "a.xls", "a")] == ["json", "parquet", "excel", "csv"]


def test_xlsx(spark, tmp_path):
    p = tmp_path / "book.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="n" sheetId="1" r:id="r1"/><sheet name="m" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>am</t></r><r><t>y</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>age</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><f>1+2</f><v>3</v></c></row><row r="4"><c r="B4"><v>5</v></c></row></sheetData></worksheet>')
    df = read_path(spark, str(p))
    assert df.columns == ["name", "age"] and sorted(map(tuple, df.collect()), key=repr) == sorted([("amy", 3), (None, 5)], key=repr)


@pytest.fixture
def sqlite(tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE items (id INTEGER PRIMARY KEY, val INTEGER, note TEXT, x REAL)")
        db.executemany("INSERT INTO items VALUES (?, ?, ?, ?)", [(i, 2 * i, None if i % 2 else f"n{i}", i / 2) for i in range(1, 2501)])
        db.execute("CREATE VIEW few AS SELECT * FROM items WHERE id < 4")
    return path


def test_sqlite(spark, sqlite):
    db = Database(spark, {"type": "sqlite", "database": sqlite})
    assert db.tables() == ["few", "items"]
    items = db.scan("items")["items"]
    assert items.count() == 2500 and [t for _, t in items.dtypes] == ["bigint", "bigint", "string", "double"]
    assert items.selectExpr("sum(val)").first()[0] == 2500 * 2501
    assert db.scan("SELECT val FROM items WHERE id <= 10")["query"].count() == 10
    assert {k: v.count() for k, v in db.scan().items()} == {"few": 3, "items": 2500}
    with pytest.raises(TypeError):
        db.scan(5)


def test_names_and_options():
    assert is_sql("select 1") and is_sql(" WITH a") and is_sql("x;") and not is_sql("selections")
    o = jdbc_options({"port": 5432, "host": "h", "username": "u", "password": "p@/", "database": "d"})
    assert o["url"] == "jdbc:postgresql://h:5432/d" and o["password"] == "p@/"
    assert jdbc_options({"type": "oracle", "port": 1521, "host": "h", "username": "u", "password": "p", "database": "s"})["url"] == "jdbc:oracle:thin:@//h:1521/s"
    with pytest.raises(ValueError):
        jdbc_options({"port": 1})
    assert stores.s3({"bucket": "b", "key": "k.csv"})[0] == "s3a://b/k.csv"
    assert stores.s3({"path": "s3://b/k", "key": "id", "secret": "x"})[1] == {"fs.s3a.access.key": "id", "fs.s3a.secret.key": "x"}
    assert stores.gcs({"bucket": "b", "blob": "k"})[0] == "gs://b/k"
    assert stores.azure({"account_name": "a", "container": "c", "blob": "k", "account_key": "z"}) == ("abfs://c@a.dfs.core.windows.net/k", {"fs.azure.account.key.a.dfs.core.windows.net": "z"})
    assert stores.hdfs({"host": "h", "hdfs_path": "/x"})[0] == "hdfs://h:8020/x"
    with pytest.raises(ValueError):
        stores.s3({})


def test_connection_strings(spark, sqlite, tmp_path):
    """A connection string alone is enough, and wins over the parts."""
    conf = {"job": {"parquet_output_dir": str(tmp_path / "out"), "chunk_rows": 1000}}
    paths = Check(spark, conf, {"type": "sqlite", "config": {"connection_string": f"sqlite:///{sqlite}"}}, {}).materialise("source", "items")
    assert [spark.read.parquet(p).count() for p in paths] == [1000, 1000, 500]
    got = config_of_url("postgresql+psycopg2://us%40er:p%2Fw@host/db")
    assert got == {"type": "postgresql", "host": "host", "port": 5432, "username": "us@er", "password": "p/w", "database": "db"}
    assert jdbc_options(config_of_url("oracle+oracledb://u:p@h:1522/?service_name=s"))["url"] == "jdbc:oracle:thin:@//h:1522/s"
    assert config_of_url("sqlite:////abs/x.db")["database"] == "/abs/x.db" and config_of_url("sqlite:///rel.db")["database"] == "rel.db"
    with pytest.raises(ValueError):
        config_of_url("nothing")
    mysql = Database(spark, {"connection_string": "mysql://u:p@h/d"})
    assert mysql.listing_sql().endswith("table_schema = database()") and "'x'" in mysql.listing_sql("x")


def test_materialise_brings_types(spark, tmp_path):
    """Bytes become text and numeric text numbers before parts are written."""
    path = str(tmp_path / "b.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (b BLOB, n TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(b"a\xffb", "007"), (b"c", "8")])
    conf = {"job": {"parquet_output_dir": str(tmp_path / "out")}}
    paths = Check(spark, conf, {"type": "sqlite", "config": {"database": path}}, {}).materialise("source", "t")
    got = spark.read.parquet(*paths)
    assert [t for _, t in got.dtypes] == ["string", "bigint"] and sorted(r["n"] for r in got.collect()) == [7, 8]


def test_parts_keep_order_and_are_full(spark, tmp_path):
    """Many tasks write, parts are full all the same; older and further parts go, an empty table is one empty part."""
    df = spark.range(0, 2600, 1, 7).selectExpr("id", "id % 10 AS k")
    paths = write_parts(df, str(tmp_path), "t", "x", 500)
    assert [[r["id"] for r in spark.read.parquet(p).collect()] for p in paths] == [list(range(a, min(a + 500, 2600))) for a in range(0, 2600, 500)]
    assert len(write_parts(df.limit(0), str(tmp_path), "t", "x", 500)) == 1 and len(list(tmp_path.glob("t_x_part_*"))) == 1
    assert spark.read.parquet(str(tmp_path / "t_x_part_1.parquet")).columns == ["id", "k"]


def test_unknown_remote_suffix(spark):
    with pytest.raises(ValueError):
        stores.read_store(spark, "s3", {"path": "s3://b/k.bin"})


@pytest.mark.parametrize("what,first", [("items", "sqlite_items_part_1"), ("SELECT * FROM items", "sqlite_query_part_1")])
def test_parts_of_a_table(spark, sqlite, tmp_path, what, first):
    conf = {"job": {"parquet_output_dir": str(tmp_path / "out"), "chunk_rows": 1000}}
    paths = Check(spark, conf, {"type": "sqlite", "config": {"database": sqlite}}, {}).materialise("source", what)
    assert len(paths) == 3 and first in paths[0]
    assert [spark.read.parquet(p).count() for p in paths] == [1000, 1000, 500]


def test_parts_of_a_file(spark, tmp_path):
    (tmp_path / "testdata.csv").write_text("id,value\n" + "".join(f"{i},{2 * i}\n" for i in range(2500)))
    conf = {"chunk_rows": 1000, "job": {"parquet_output_dir": str(tmp_path / "out")}}
    check = Check(spark, conf, {"type": "file", "config": {"path": str(tmp_path / "testdata.csv")}}, {})
    paths = check.materialise()
    assert [p.rsplit("/", 1)[1] for p in paths] == [f"file_testdata_part_{k}.parquet" for k in (1, 2, 3)]
    assert [r["value"] for r in spark.read.parquet(paths[2]).orderBy("id").collect()] == list(range(4000, 5000, 2))
    assert len(write_parts(spark.range(10).toDF("id"), str(tmp_path / "out"), "file", "testdata", 1000)) == 1
    assert len(list((tmp_path / "out").glob("file_testdata_part_*.parquet"))) == 1
    assert base_name("SQLite", "My Table") == "sqlite_my_table"


def test_session(spark, tmp_path):
    assert read_config(str(tmp_path / "none.json")) == {}
    with pytest.raises(ValueError):
        Check(spark, {}, {}, {})
    with pytest.raises(ValueError):
        load(spark, {"type": "unknown"})
    (tmp_path / "a.csv").write_text("a,b\n1,\n2,x\n")
    check = Check(spark, {}, {"type": "csv", "config": {"path": str(tmp_path / "a.csv")}}, {})
    counts = comp.merge_counts(comp.partial_counts(check.load()["file"]))
    check.add("metrics", comp.completeness_metrics(counts, "a"))
    rows = json.load(open(check.save(str(tmp_path))[0]))
    assert {"key": "n", "value": 2, "scope": {"perimeter": "dataset", "value": "a"}} in rows
    assert {r["value"] for r in rows if r["key"] == "completeness_score"} == {"1.0", "0.5"}


def test_json_values():
    got = plain({1: float("nan"), "d": date(2020, 1, 2), "t": datetime(2020, 1, 2, 3), "m": Decimal("1.5"), "n": Decimal("NaN"), "s": {3}, "b": True})
    assert got == {"1": None, "d": "2020-01-02", "t": "2020-01-02T03:00:00", "m": 1.5, "n": None, "s": [3], "b": True}


def test_normalise(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"), "007", "True", None, [1]), (None, None, "False", None, None)], "b binary, n string, t string, e string, l array<int>")
    got = normalise(df, flat=True)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", "double", "string"]
    assert tuple(got.collect()[0]) == ("a�b", 7, "True", None, "[1]")


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else "x") for i in range(40)], "a int, b string")
    for k in range(3):
        rows.filter(f"a % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    collect_partials(stream, str(tmp_path / "parts"), str(tmp_path / "check")).awaitTermination(120)
    got = merged(spark, str(tmp_path / "parts"), comp.merge_counts)
    want = comp.merge_counts(comp.partial_counts(rows))
    assert comp.dataset_completeness(got).collect() == comp.dataset_completeness(want).collect()
