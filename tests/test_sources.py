import io
import zipfile
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tablepulse.config import ResourceLimits
from tablepulse.sources import errors as E
from tablepulse.sources.common import display_name
from tablepulse.sources.csv import ingest_csv, read_csv
from tablepulse.sources.ingest import analyze_upload, ingest, open_source
from tablepulse.sources.parquet import ingest_parquet, read_parquet
from tablepulse.sources.xlsx import ingest_xlsx, read_xlsx


def kinds(source):
    return [(n, source.table.dtype(i)) for i, n in enumerate(source.table.names)]


def test_csv_types_and_values(spark):
    text = 'id,x,flag,when,empty,name,big\n1,1.5,True,2024-01-02,,"a, b",18446744073709551615\n\n2,NA,FALSE,x,NaN,"",1\n 3,inf,true,2024-01-03,null,n/a,2\n'
    got = ingest_csv(spark, text.encode(), "dir/file.csv")
    assert kinds(got) == [("id", "bigint"), ("x", "double"), ("flag", "boolean"), ("when", "string"), ("empty", "double"), ("name", "string"), ("big", "decimal(20,0)")]
    rows = [tuple(r) for r in got.table.df.collect()]
    assert rows[0][:6] == (1, 1.5, True, "2024-01-02", None, "a, b") and rows[1][:6] == (2, None, False, "x", None, None) and rows[2][1] == float("inf")
    assert (got.row_count, got.source_name, got.encoding) == (3, "file.csv", "utf-8")
    assert ingest_csv(spark, b"\xef\xbb\xbfa\n1\n").encoding == "utf-8-sig"


@pytest.mark.parametrize(
    ("content", "error"),
    [
        (b"", E.EmptySource), (b" \n ", E.EmptySource), (b"a,b\n", E.NoDataRows), (b"a,b\n1\n", E.MalformedSource), (b"a,b\n1,2,3\n", E.MalformedSource), (b'a\n"x\n', E.MalformedSource),
        (b"a\n\xff\n", E.InvalidEncoding), (b"a\n\x00\n", E.UnsupportedSource), (b"a,a\n1,2\n", E.DuplicateColumns), (b"a, \n1,2\n", E.InvalidColumnNames),
        (b"a\n1\n2\n3\n", E.RowLimitExceeded), (b"a,b,c,d\n1,2,3,4\n", E.ColumnLimitExceeded), (b"a\n" + b"1" * 200 + b"\n", E.SourceTooLarge),
    ],
)
def test_csv_refusals(spark, content, error):
    with pytest.raises(error) as caught:
        ingest_csv(spark, content, limits=ResourceLimits(rows=2, columns=3, source_bytes=100))
    assert caught.value.code in str(error.__doc__).replace(" ", "_")


def test_csv_files_of_any_size(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"x, ""y"""\n2,\n\n3,z\n')
    got = read_csv(spark, str(tmp_path / "a.csv"))
    assert kinds(got) == [("id", "bigint"), ("name", "string")] and sorted(map(tuple, got.table.df.collect()), key=str) == [(1, 'x, "y"'), (2, None), (3, "z")]
    for text, error in (("a,b\n1\n", E.MalformedSource), ("a,b\n1,2,3\n", E.MalformedSource), ("a\n", E.NoDataRows), ("", E.EmptySource), ("a,a\n1,2\n", E.DuplicateColumns)):
        (tmp_path / "b.csv").write_text(text)
        with pytest.raises(error):
            read_csv(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_bytes(b"a\n\xff\n")
    with pytest.raises(E.InvalidEncoding):
        read_csv(spark, str(tmp_path / "c.csv"))


def parquet_bytes(table, **more):
    out = io.BytesIO()
    pq.write_table(table, out, **more)
    return out.getvalue()


def test_parquet(spark, tmp_path):
    table = pa.table({"n": pa.array([1, None, 3], pa.int64()), "t": pa.array(["a", "b", "a"]).dictionary_encode(), "when": pa.array([datetime(2024, 1, 1)] * 3)})
    content = parquet_bytes(table, row_group_size=2)
    got = ingest_parquet(spark, content, "x.parquet")
    assert got.table.names == ("n", "t", "when") and got.format["row_groups"] == 2 and [r._c1 for r in got.table.df.collect()] == ["a", "b", "a"]
    (tmp_path / "x.parquet").write_bytes(content)
    assert read_parquet(spark, str(tmp_path / "x.parquet")).row_count == 3 == open_source(spark, str(tmp_path / "x.parquet")).row_count
    bad = [
        (b"", {}, E.EmptySource), (b"PAR1xxxx", {}, E.MalformedParquet), (content[:-20] + content[-8:], {}, E.MalformedParquet), (content, {"parquet_metadata_bytes": 10}, E.ParquetLimitExceeded), (content, {"parquet_row_groups": 1}, E.ParquetLimitExceeded),
        (content, {"rows": 2}, E.RowLimitExceeded), (content, {"columns": 2}, E.ColumnLimitExceeded), (parquet_bytes(table.slice(0, 0)), {}, E.NoDataRows), (parquet_bytes(pa.table({"l": [[1], [2]]})), {}, E.UnsupportedParquetSchema),
        (parquet_bytes(pa.table([[1], [2]], names=["a", "a"])), {}, E.DuplicateColumns), (parquet_bytes(pa.table([[1]], names=[" "])), {}, E.InvalidColumnNames), (b"PAR1" + b"x" * 40 + b"\xff\xff\xff\x7fPAR1", {}, E.MalformedParquet),
    ]
    for data, limits, error in bad:
        with pytest.raises(error):
            ingest_parquet(spark, data, limits=ResourceLimits(**limits))


MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def workbook(sheets, types="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml", extra=(), merge="", drop=()):
    """sheets: [(name, state, rows of cells as XML)]."""
    out = io.BytesIO()
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda n, s: None if n in drop else z.writestr(n, s)
        put("[Content_Types].xml", f'<Types><Override ContentType="{types}"/></Types>')
        put("_rels/.rels", "<Relationships/>")
        put("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" state="{s}" r:id="r{i}"/>' for i, (n, s, _) in enumerate(sheets)) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Type="worksheet" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        put("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>')
        put("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/><numFmt numFmtId="165" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="14"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        for i, (_, _, rows) in enumerate(sheets):
            put(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData>{merge}</worksheet>')
        for n, s in extra:
            z.writestr(n, s)
    return out.getvalue()


ROWS = (
    '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="inlineStr"><is><t>amount</t></is></c><c r="C2" t="b"><v>1</v></c><c r="D2"><v>7</v></c></row>'
    '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>1.5</v></c><c r="C3" s="1"><v>45292</v></c><c r="D3"><f>A1+1</f><v>9</v></c></row>'
    '<row r="5"><c r="A5" t="str"><v>b</v></c><c r="C5" s="2"><v>45293.5</v></c><c r="D5" t="b"><v>0</v></c><c r="E5"/></row><row r="6"/>'
)


def test_xlsx(spark, tmp_path):
    content = workbook([("One", "visible", ROWS), ("Empty", "visible", ""), ("Hidden", "hidden", '<row><c t="inlineStr"><is><t>h</t></is></c></row><row><c><v>3</v></c></row>')])
    got = ingest_xlsx(spark, content, "b.xlsx")
    assert kinds(got) == [("name", "string"), ("amount", "double"), ("TRUE", "timestamp_ntz"), ("7", "string")]
    assert [tuple(r) for r in got.table.df.collect()] == [("rich", 1.5, datetime(2024, 1, 1), "=A1+1"), (None,) * 4, ("b", None, datetime(2024, 1, 2, 12), "FALSE")]
    assert ingest_xlsx(spark, content, worksheet="Hidden").table.df.collect() == [(3,)]
    (tmp_path / "b.xlsx").write_bytes(content)
    assert read_xlsx(spark, str(tmp_path / "b.xlsx")).row_count == 3


def test_xlsx_refusals(spark):
    one = ("One", "visible", ROWS)
    plain = workbook([one])
    cases = [
        (b"", {}, E.EmptySource), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", {}, E.UnsupportedWorkbook), (b"PK", {}, E.MalformedWorkbook), (workbook([one], types="x"), {}, E.UnsupportedWorkbook), (workbook([one], types="application/vnd.ms-excel.sheet.macroEnabled.main+xml"), {}, E.UnsupportedWorkbook),
        (workbook([one], extra=[("xl/vbaProject.bin", "x")]), {}, E.UnsupportedWorkbook), (workbook([one], extra=[("../x", "x")]), {}, E.ArchiveSafety), (workbook([one], extra=[("XL/Workbook.xml", "x")]), {}, E.ArchiveSafety), (workbook([one], extra=[("big", "0" * 10**6)]), {}, E.ArchiveSafety),
        (workbook([one], drop=["xl/workbook.xml"]), {}, E.UnsupportedWorkbook), (plain, {"archive_entries": 3}, E.WorkbookLimitExceeded), (plain, {"uncompressed_bytes": 50}, E.WorkbookLimitExceeded), (plain, {"workbook_cells": 3}, E.WorkbookLimitExceeded), (plain, {"rows": 2}, E.RowLimitExceeded),
        (plain, {"columns": 3}, E.ColumnLimitExceeded), (workbook([one, one]), {}, E.WorksheetSelectionRequired), (workbook([("x", "visible", "")]), {}, E.NoUsableWorksheet), (workbook([]), {}, E.NoUsableWorksheet),
        (workbook([one], merge='<mergeCells><mergeCell ref="A1:B2"/></mergeCells>'), {}, E.UnsupportedWorksheet), (workbook([("x", "visible", ROWS.split("</row>")[0] + "</row>")]), {}, E.NoDataRows),
        (workbook([("x", "visible", '<row><c><v>1</v></c><c><v>1</v></c></row><row><c><v>1</v></c></row>')]), {}, E.DuplicateColumns), (workbook([("x", "visible", '<row><c><v>1</v></c></row><row><c/><c><v>1</v></c></row>')]), {}, E.InvalidColumnNames),
        (workbook([("x", "visible", "<row")]), {}, E.MalformedWorkbook), (workbook([("x", "visible", "")], extra=[("xl/sharedStrings.xml2", "x")]), {"archive_entries": 100}, E.NoUsableWorksheet),
    ]
    for content, limits, error in cases:
        with pytest.raises(error):
            ingest_xlsx(spark, content, limits=ResourceLimits(**limits))
    with pytest.raises(E.WorksheetNotFound):
        ingest_xlsx(spark, plain, worksheet="one")


def test_dispatch_names_and_upload(spark):
    with pytest.raises(E.UnsupportedSource):
        ingest(spark, b"x", "a.txt")
    assert display_name("..\\a/b\x07c.csv") == "bc.csv" and len(display_name("x" * 300)) == 255 and display_name("/", "f") == "f"
    got = analyze_upload(spark, b"target,x\na,1\na,2\nb,3\n", "t.csv", target="target")
    assert got.readiness.target.minority_ratio == pytest.approx(1 / 3) and got.readiness.target.kind == "classification_candidate" and len(got.ingestion.format["sha256"]) == 64
    with pytest.raises(ValueError):
        ResourceLimits(rows=0)


def test_json_log(capsys):
    import json

    from tablepulse.sources import common

    before = common.LOG.handlers[:], common.LOG.level
    try:
        common.configure_logging("INFO")
        common.LOG.info("ingestion_completed", extra={"facts": {"rows": 3, "when": None}})
        line = json.loads(capsys.readouterr().err.strip().splitlines()[-1])
    finally:
        common.LOG.handlers[:], common.LOG.level = before
    assert (line["event"], line["level"], line["logger"], line["rows"], line["when"]) == ("ingestion_completed", "INFO", "tablepulse.ingestion", 3, None) and line["time"].endswith("+00:00")


def test_csv_folders_whose_headers_differ(spark, tmp_path):
    for folder, files in {"same": ("x,y\n1,2\n", "x,y\n3,4\n"), "swapped": ("x,y\n1,2\n", "y,x\n30,3\n"), "other": ("x,y\n1,2\n", "x,z\n3,4\n"), "wider": ("x,y\n1,2\n", "x,y,z\n3,4,5\n")}.items():
        (tmp_path / folder).mkdir()
        for k, text in enumerate(files):
            (tmp_path / folder / f"{k}.csv").write_text(text)
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "same")).table.df.collect())) == [(1, 2), (3, 4)]
    for folder in ("swapped", "other", "wider"):
        with pytest.raises(E.MalformedSource):
            read_csv(spark, str(tmp_path / folder))


def test_csv_with_the_replacement_character(spark, tmp_path):
    (tmp_path / "right.csv").write_text("x,_corrupt\na\ufffdb,1\n", encoding="utf-8")
    assert read_csv(spark, str(tmp_path / "right.csv")).table.df.first()[0] == "a\ufffdb"
    (tmp_path / "wrong.csv").write_bytes(b"x,y\na\xffb,1\n")
    with pytest.raises(E.InvalidEncoding):
        read_csv(spark, str(tmp_path / "wrong.csv"))
