import io
import json

import pytest
import yaml

from gleaner.operators import export as ex
from gleaner.operators.dataset import Dataset, Field, Partial

ROWS = [(0, "Amina রহমান", "1250.50", "true", "=cmd|x"), (1, 'He said "hi", loudly', "7", "maybe", "a|b\nc"), (2, "O'Brien <script>", "n/a", "false", ""), (3, "-5", "1e300", "", "yes")]


@pytest.fixture()
def d(spark):
    df = spark.createDataFrame(ROWS, "i long, name string, price string, ok string, note string").repartition(3)
    return Dataset.of("c", "My: Contacts!", df, "i", [Field("name"), Field("price", "currency"), Field("ok", "boolean"), Field("note")])


def written(d, kind, name=None, **options):
    out = io.BytesIO()
    result = ex.submit(ex.Request(d, kind, ex.Options(**options), name), out)
    assert result.bytes == len(out.getvalue())
    return out.getvalue().decode(), result


def test_csv_and_tsv(d):
    text, r = written(d, "CSV")
    assert text == (
        "﻿name,price,ok,note\r\nAmina রহমান,1250.50,true,\"=cmd|x\"\r\n\"He said \"\"hi\"\", loudly\",7,maybe,\"a|b\nc\"\r\n"
        "O'Brien <script>,n/a,false,\r\n\"-5\",1e300,,yes\r\n"
    )
    assert (r.records, r.filename, r.fields) == (4, "My_Contacts.csv", ("name", "price", "ok", "note"))
    text, _ = written(d, "tsv", bom=False, header=False, fields=("note", "none", "name"), null="-", record_ids=frozenset(("c-3", "c-9")))
    assert text == '"-"\tO\'Brien <script>\r\n'
    assert written(d, "csv", bom=False, delimiter=";", fields=("name",), record_ids=frozenset(("c-2",)))[0] == 'name\r\n"He said ""hi"", loudly"\r\n'


def test_json(d):
    text, _ = written(d, "json")
    rows = json.loads(text)["data"]
    assert text.startswith('{\n  "data": [\n    {"name":"Amina রহমান","price":1250.5,"ok":true,"note":"=cmd|x"},\n') and text.endswith("\n  ]\n}")
    assert rows[1] == {"name": 'He said "hi", loudly', "price": 7, "ok": "maybe", "note": "a|b\nc"} and rows[2]["price"] == "n/a" and rows[2]["note"] is None
    assert '"price":1.0E300' in text
    text, _ = written(d, "json", metadata=True, pretty=False, fields=("price",))
    assert json.loads(text)["schema"] == {"price": "currency"} and json.loads(text)["records"] == 4 and json.loads(text)["dataset"] == "My: Contacts!"
    lines = written(d, "ndjson")[0].splitlines()
    assert len(lines) == 4 and json.loads(lines[0])["price"] == 1250.5


def test_json_escapes(spark):
    s = 'q" b\\ \n\r\t\x01\x1f é'
    df = spark.createDataFrame([(0, s)], "i long, v string")
    text, _ = written(Dataset.of("x", "x", df, "i", [Field("v")]), "ndjson")
    assert json.loads(text)["v"] == s and "\\u0001" in text


def test_yaml_markdown_html_sql(d):
    text, _ = written(d, "yaml", bom=False, metadata=True)
    assert text.startswith('dataset: "My: Contacts!"\nrecords: 4\ndata:\n  - name: Amina রহমান\n    price: 1250.50\n')
    assert [r["note"] for r in yaml.safe_load(text)["data"]] == ["=cmd|x", "a|b\nc", "", "yes"]
    text, _ = written(d, "md", bom=False, fields=("name", "note"))
    assert text.startswith("# My: Contacts!\n\n| name | note |\n|---|---|\n| Amina রহমান | =cmd\\|x |\n") and "a\\|b<br>c" in text
    text, _ = written(d, "html", null="?")
    assert "<td>O'Brien &lt;script&gt;</td>" in text and '<td class="empty">?</td>' in text and "4 records · 4 fields" in text and text.endswith("</table></body></html>\n")
    text, _ = written(d, "sql", bom=False, table='t"x')
    assert 'CREATE TABLE IF NOT EXISTS "t""x" (\n  "name" TEXT,\n  "price" REAL,\n  "ok" INTEGER,\n  "note" TEXT\n);' in text
    assert "VALUES ('O''Brien <script>', 'n/a', 'false', NULL);" in text and "('-5', 1.0E300, NULL, 'yes');" in text and "1250.5, 'true'" in text


def test_validation(spark, d):
    check = lambda **k: ex.Request(**({"dataset": d, "format": "csv"} | k)).validate()
    assert check().ok and check().summary()
    assert not check(format="xlsx").ok and not check(dataset=d.filter(d.df["_pos"] < 0)).ok and not check(options=ex.Options(fields=("none",))).ok
    assert not check(options=ex.Options(record_ids=frozenset(("ghost",)))).ok and not check(filename="a/b.csv").ok and check(filename="b.csv").ok
    partial = check(dataset=d.having(d.df, partial=Partial(9, 2, 1)), options=ex.Options(fields=("name", "none")))
    assert partial.ok and len(partial.warnings) == 2
    with pytest.raises(ex.ExportError):
        ex.submit(ex.Request(d, "nope"), io.BytesIO())
    assert written(d, "csv", name="own.csv")[1].filename == "own.csv" and "4 records" in ex.Request(d, "md").describe()


@pytest.mark.parametrize("name, want", [("  ", "dataset.csv"), ("a/b c", "a_b_c.csv"), ("__x__", "x.csv"), ("é-1.2", "é-1.2.csv"), ("y" * 80, "y" * 60 + ".csv")])
def test_filename(name, want):
    assert ex.filename(name, "csv") == want


def test_own_format_and_parts(spark, d, tmp_path):
    ex.register(ex.Format("names", "Names", "txt", "text/plain", lambda d, f, o, n: ex.Rendered("", ex._lines(d, d.cells()[0]), ",", "!"), bom=False))
    try:
        assert written(d.search("o"), "names")[0].endswith("!")
    finally:
        ex.FORMATS.pop("names")
    path = str(tmp_path / "parts")
    ex.write_parts(ex.Request(d, "ndjson"), path)
    assert len([json.loads(r.value) for r in spark.read.text(path).collect()]) == 4
    with pytest.raises(ex.ExportError):
        ex.write_parts(ex.Request(d, "json"), path)
    ex.write_parquet(d, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).columns == ["name", "price", "ok", "note"]


@pytest.mark.parametrize("kind", list(ex.FORMATS))
def test_a_file_written_by_executors(d, tmp_path, kind):
    """Byte for byte what the driver would have written."""
    for options in ({}, {"metadata": True, "bom": False, "pretty": False, "null": "-"}, {"record_ids": frozenset(("c-2",))}):
        request = ex.Request(d, kind, ex.Options(**options))
        text, want = written(d, kind, **options)
        got = ex.write_file(request, f"file://{tmp_path}/out/a.{kind}")
        assert (tmp_path / "out" / f"a.{kind}").read_bytes() == text.encode() and got == want
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")] == [f"a.{kind}"]


def test_a_large_file(spark, tmp_path):
    df = spark.range(60_000).selectExpr("id", "concat('line ', id, ' é\n', repeat('x', cast(id % 50 as int))) as text").repartition(7)
    big = Dataset.of("b", "Big", df, "id", [Field("text")])
    for kind in ("json", "csv"):
        text, want = written(big, kind)
        assert ex.write_file(ex.Request(big, kind), f"file://{tmp_path}/b") == want and (tmp_path / "b").read_bytes() == text.encode()


def test_files_joined_through_a_stream(spark, d, tmp_path, monkeypatch):
    """As on a file system that can neither be written at an offset nor join files."""
    from gleaner.functions import files

    made = files._FileSystem.__init__
    monkeypatch.setattr(files._FileSystem, "__init__", lambda self, *a: (made(self, *a), setattr(self, "local", False))[0])
    text, want = written(d, "json")
    assert ex.write_file(ex.Request(d, "json"), f"file://{tmp_path}/c") == want and (tmp_path / "c").read_bytes() == text.encode()


def test_own_formats_and_refusals_by_executors(d, tmp_path):
    own = lambda line: ex.Format("own", "Own", "txt", "text/plain", lambda d, f, o, n: ex.Rendered("<", ex._lines(d, line(d)), "|", ">"), bom=False)
    try:
        ex.register(own(lambda d: ex.F.concat(d.cells()[0], ex.F.lit("é"))))
        assert written(d, "own")[0].encode() == (ex.write_file(ex.Request(d, "own"), f"file://{tmp_path}/o"), (tmp_path / "o").read_bytes())[1]
        ex.register(own(lambda d: d.cells()[0]))
        with pytest.raises(ex.ExportError, match="end alike"):
            ex.write_file(ex.Request(d, "own"), f"file://{tmp_path}/p")
    finally:
        ex.FORMATS.pop("own")
    with pytest.raises(ex.ExportError):
        ex.write_file(ex.Request(d, "xlsx"), f"file://{tmp_path}/p")
    assert not (tmp_path / "p").exists()
