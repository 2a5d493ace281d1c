"""Workbooks and CSV files as rows, at once and as a stream."""

import io
import zipfile

from pyspark.sql import functions as F

from docloom.sources import files

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(*sheets, shared=()):
    """A package with sheets of rows; a cell is (reference, type, value)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f"<workbook {MAIN}><sheets>{''.join(f'<sheet name="S{i}"/>' for i in range(len(sheets)))}</sheets></workbook>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{''.join(f'<si><r><t>{s}</t></r></si>' for s in shared)}</sst>")
        for i, rows in enumerate(sheets):
            cells = ("".join(f'<c r="{r}" t="{t}">{f"<is><t>{v}</t></is>" if t == "inlineStr" else f"<v>{v}</v>"}</c>' for r, t, v in row) for row in rows)
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f"<worksheet {MAIN}><sheetData>{''.join(f'<row>{c}</row>' for c in cells)}</sheetData></worksheet>")
    return out.getvalue()


LONG = 3 * files.SHEET_ROWS + 17


def folder(tmp_path):
    path = tmp_path / "files"
    path.mkdir()
    first = [[("A1", "s", 0), ("C1", "s", 1)], [("A2", "n", 1.5), ("B2", "inlineStr", " b "), ("C2", "s", 9)]]
    (path / "a.xlsx").write_bytes(workbook(first, [[("A1", "n", 7)]], [], shared=["Name", "Prix"]))
    (path / "long.xlsx").write_bytes(workbook([[(f"A{i + 1}", "n", i)] for i in range(LONG)]))
    (path / "no.xlsx").write_bytes(b"PK no package")
    (path / "empty.xlsx").write_bytes(b"")
    (path / "t.csv").write_bytes("﻿x, y\r\n\"1\n2\",3\r\n".encode())
    return str(path)


def test_rows_of_workbooks(spark, tmp_path):
    table = files.read_files(spark, folder(tmp_path)).where("path like '%.xlsx'").repartition(2)
    got = files.workbook_rows(table).withColumn("path", F.element_at(F.split("path", "/"), -1))
    small = sorted((r["path"], r["sheet_no"], r["sheet"], r["row_no"], r["cells"]) for r in got.where("path <> 'long.xlsx'").collect())
    assert small == [("a.xlsx", 0, "S0", 0, ["Name", "", "Prix"]), ("a.xlsx", 0, "S0", 1, ["1.5", "b", ""]), ("a.xlsx", 1, "S1", 0, ["7"])]
    long = got.where("path = 'long.xlsx'").orderBy("row_no").collect()
    assert [(r["row_no"], r["cells"]) for r in long] == [(i, [str(i)]) for i in range(LONG)]


def test_rows_of_csv(spark, tmp_path):
    table = files.read_files(spark, folder(tmp_path)).where("path like '%.csv'")
    assert [r["cells"] for r in files.csv_rows(table).orderBy("row_no").collect()] == [["x", "y"], ["1\n2", "3"]]


def test_rows_as_a_stream(spark, tmp_path):
    """Files that come later give their rows in a later batch, and once."""
    path = folder(tmp_path)
    stream = files.workbook_rows(files.read_files(spark, path, stream=True).where("path like '%.xlsx'"))
    query = stream.writeStream.format("memory").queryName("sheet_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        assert spark.table("sheet_rows").count() == 3 + LONG
        (tmp_path / "files" / "later.xlsx").write_bytes(workbook([[("A1", "n", 5)]]))
        query.processAllAvailable()
        assert spark.table("sheet_rows").count() == 4 + LONG
    finally:
        query.stop()


def test_rows_leave_one_at_a_time():
    """The first row is there before the rest of the sheet is read."""
    rows = files.xlsx_rows(workbook([[(f"A{i + 1}", "n", i)] for i in range(50)]))
    assert next(rows) == (0, "S0", 0, ["0"]) and sum(1 for _ in rows) == 49
