import io
import zipfile

import pytest
from quillstone.functions.text import ROW_ID
from quillstone.sources import reader, sinks


def put(tmp_path, data, name="t.csv"):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def rows(loaded):
    return [tuple(r)[1:] for r in loaded.frame.orderBy(ROW_ID).collect()]


@pytest.mark.parametrize("data,name,delimiter", [("x,y\n1,2\n3,4\n", "t.csv", ","), ("x;y;z\n1;2;3\n4;5;6\n", "t.csv", ";"), ("x\ty\n1\t2\n", "t.tsv", "\t"), ("x|y\n1|2\n", "t.txt", "|")])
def test_delimiters(spark, tmp_path, data, name, delimiter):
    got = reader.read_table(spark, put(tmp_path, data, name))
    assert got.delimiter == delimiter and got.encoding == "utf-8"
    assert rows(got)[0][:2] == (1, 2)


def test_encodings(spark, tmp_path):
    got = reader.read_table(spark, put(tmp_path, "item,price\nbook,£10\n".encode("cp1252")))
    assert got.encoding == "cp1252" and rows(got) == [("book", "£10")]
    got = reader.read_table(spark, put(tmp_path, b"a,b\nx\x81\x9d,1\ny,2\n"))
    assert got.encoding == "latin-1" and any("Latin-1" in n for n in got.notes)


def test_preamble_header_and_quotes(spark, tmp_path):
    body = "".join(f'{i},"a ""q""\nb{i}",{i}.5\n' for i in range(6))
    got = reader.read_table(spark, put(tmp_path, "Title\n\nid,text,x\n" + body))
    assert got.skipped_rows == 2 and got.frame.columns == [ROW_ID, "id", "text", "x"]
    assert rows(got)[0] == (0, 'a "q"\nb0', 0.5)
    got = reader.read_table(spark, put(tmp_path, "1,a\n2,b\n3,c\n"), has_header=False)
    assert got.frame.columns[1:] == ["column_1", "column_2"]
    assert not reader.probe_header(spark, put(tmp_path, "1,a\n2,b\n3,c\n"))
    assert reader.sniff_header([["id", "x"], ["1", "2"], ["3", "4"]])


def test_nulls_types_and_decimals(spark, tmp_path):
    got = reader.read_table(spark, put(tmp_path, "a,b,c,d,e\n1,NA,True,x,\n2,3,False,?,\n"))
    assert dict(got.frame.dtypes) == {ROW_ID: "bigint", "a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "double"}
    assert rows(got) == [(1, None, True, "x", None), (2, 3.0, False, "?", None)]
    got = reader.read_table(spark, put(tmp_path, "a;b\n1,5;x\n2,25;y\n"), decimal=",")
    assert [r[0] for r in rows(got)] == [1.5, 2.25]


def test_names(spark, tmp_path):
    assert reader.unique_names(["a", "a", "a__2", "a"]) == (["a", "a__3", "a__2", "a__4"], [("a", "a__3"), ("a", "a__4")])
    got = reader.read_table(spark, put(tmp_path, "a,a\n1,2\n"))
    assert got.frame.columns[1:] == ["a", "a.1"]


def test_errors_and_notes(spark, tmp_path):
    with pytest.raises(ValueError):
        reader.read_table(spark, put(tmp_path, "x", "t.pdf"))
    with pytest.raises(ValueError):
        reader.read_table(spark, put(tmp_path, "a,b\n1,2\n1,2,3\n"))
    assert any("no rows" in n for n in reader.read_table(spark, put(tmp_path, "a,b\n")).notes)
    assert any("one column" in n for n in reader.read_table(spark, put(tmp_path, "a\n1\n")).notes)
    summary = reader.read_table(spark, put(tmp_path, "x,y\n1,2\n")).summary()
    assert (summary["rows"], summary["columns"], summary["delimiter"]) == (1, 2, "comma")


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>y</t></is></c></row><row><c r="A2"><v>1</v></c><c r="C2" t="b"><v>1</v></c></row></sheetData></worksheet>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>x</t></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", sheet)
        book.writestr("xl/worksheets/sheet2.xml", sheet)
    got = reader.read_table(spark, put(tmp_path, data.getvalue(), "b.xlsx"))
    assert got.frame.columns[1:] == ["x", "Unnamed: 1", "y"] and rows(got) == [(1, None, True)]
    assert any("2 sheets" in n for n in got.notes)


def test_parquet_and_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(1, float("nan"), [1.0]), (2, 1.0, None)], "id long, x double, v array<double>")
    frame.write.parquet(str(tmp_path / "t.parquet"))
    got = reader.from_frame(spark.read.parquet(str(tmp_path / "t.parquet")), key="id").frame
    assert [r.x for r in got.orderBy(ROW_ID).collect()] == [None, 1.0]
    sinks.write_csv(got, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["id", "x", "v"]
