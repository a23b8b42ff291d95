import io
import zipfile

import pytest

from quillspan.sources import tables, xlsx
from quillspan.streaming import daily

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, sheets, shared):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in shared) + "</sst>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
    path.write_bytes(buffer.getvalue())


ROWS = (
    '<row r="1"><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row>'
    '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>Amount (Rs)</t></is></c></row>'
    '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>1200.0</v></c></row>'
    '<row r="5"><c r="A5" t="str"><v>0042</v></c><c r="B5"><v>1</v></c><c r="C5"><v>1.25</v></c><c r="D5" t="b"><v>1</v></c></row>'
)


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"Notes": '<row r="1"><c r="A1" t="s"><v>1</v></c></row>', "Data": ROWS}, ["Work ID", "MP/1"])
    aliases = {"work": ["Work Id"], "amount": [], "absent": []}
    got = xlsx.read_workbooks(spark, str(tmp_path / "*.xlsx"), aliases, ["work", "amount"]).orderBy("source_row").collect()
    assert [(r.sheet, r.source_row, r.work, r.amount, r.absent) for r in got] == [("Data", 3, "MP/1", "1200", None), ("Data", 5, "0042", "1.25", None)]
    assert xlsx.inspect_workbooks(spark, str(tmp_path / "*.xlsx"), 1).count() == 2
    assert len(xlsx.fingerprints(spark, str(tmp_path / "*.xlsx")).first().sha256) == 64
    with pytest.raises(Exception, match="no sheet has the column"):
        xlsx.read_workbooks(spark, str(tmp_path / "*.xlsx"), {"other": []}, ["other"]).count()


def odd_workbook(path, rows, strings="", main="xl/workbook.xml", props='<workbookPr date1904="1"/>'):
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("_rels/.rels", f'<Relationships><Relationship Id="a" Type="{rel}/officeDocument" Target="/{main}"/></Relationships>')
        z.writestr(main, f'<workbook {NS} xmlns:r="{rel}">{props}<sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/><sheet name="Gone" r:id="r9"/></sheets></workbook>')
        base, leaf = main.rsplit("/", 1)
        z.writestr(f"{base}/_rels/{leaf}.rels", '<Relationships><Relationship Id="r1" Target="sheets/1.xml"/><Relationship Id="r2" Target="sheets/2.xml"/><Relationship Id="r9" Target="sheets/9.xml"/><Relationship Id="s" Target="sharedStrings.xml"/></Relationships>')
        z.writestr(f"{base}/sharedStrings.xml", f"<sst {NS}>{strings}</sst>")
        z.writestr(f"{base}/sheets/1.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr(f"{base}/sheets/2.xml", f"<worksheet {NS}><sheetData/></worksheet>")


STRINGS = '<si><t>Work</t></si><si><r><t>Rich </t></r><r><t>text</t></r><rPh sb="0" eb="1"><t>HINT</t></rPh></si><si><t>a_x000D_b_x005F_c_xD800_</t></si><si><t>Amount</t></si>'
ODD = (
    '<row><c t="inlineStr"><is><t>The title</t></is></c></row>'
    '<row><c t="s"><v>0</v></c><c t="s"><v>3</v></c><c t="inlineStr"><is><t>Day</t></is></c><c t="inlineStr"><is><t>AMOUNT (Rs)</t></is></c><c t="inlineStr"><is><t>What?</t></is></c></row>'
    '<row><c t="s"><v>1</v></c><c><v>5</v></c><c><v>45000.5</v></c></row>'
    '<row><c r="C9"><v>45001</v></c><c r="A9" t="s"><v>2</v></c><c r="B9" t="e"><v>#REF!</v></c></row>'
    '<row><c t="inlineStr"><is><t>x</t><rPh><t>no</t></rPh></is></c><c t="str"><v>7</v></c><c t="inlineStr"><is><t>45000</t></is></c></row>'
)


def test_workbook_fidelity(spark, tmp_path):
    odd_workbook(tmp_path / "o.xlsx", ODD, STRINGS, "book/main.xml")
    aliases = {"work": [], "amount": [], "day": [], "other": []}
    got = xlsx.read_workbooks(spark, str(tmp_path / "o.xlsx"), aliases, ["work", "amount"]).orderBy("source_row").collect()
    assert [(r.work, r.amount, r.day, r.numeric) for r in got] == [("Rich text", "5", "45000.5", ["amount", "day"]), ("a\rb_c\ufffd", None, "45001", ["day"]), ("x", "7", "45000", [])]
    (x,) = xlsx.workbook_layouts(spark, str(tmp_path / "o.xlsx"), aliases, ["work", "amount"]).collect()
    assert (x.sheet, x.header_row, x.title, x.unknown, x.repeated, x.absent, x.other_sheets, x.date1904) == ("One", 2, "The title", ["What?"], ["AMOUNT (Rs)"], ["other"], ["Two"], True)


def test_workbook_errors(tmp_path):
    odd_workbook(tmp_path / "o.xlsx", ODD, STRINGS)
    whole = (tmp_path / "o.xlsx").read_bytes()
    assert len(list(xlsx.Workbook(whole).rows("xl/sheets/1.xml"))) == 5
    for content, said in ((b"junk", "no workbook"), (whole[:200], "no workbook")):
        with pytest.raises(xlsx.WorkbookError, match=said):
            xlsx.Workbook(content, "f")
    odd_workbook(tmp_path / "p.xlsx", '<row><c t="s"><v>99</v></c></row>', STRINGS)
    with pytest.raises(xlsx.WorkbookError, match="no shared string 99"):
        list(xlsx.Workbook((tmp_path / "p.xlsx").read_bytes()).rows("xl/sheets/1.xml"))
    odd_workbook(tmp_path / "q.xlsx", "<row><c><v>1</v>", STRINGS)
    with pytest.raises(xlsx.WorkbookError, match="no XML"):
        list(xlsx.Workbook((tmp_path / "q.xlsx").read_bytes()).rows("xl/sheets/1.xml"))
    with pytest.raises(xlsx.WorkbookError, match="nearest is row 2 of One, which lacks price"):
        xlsx._open("f", whole, {"work": [], "price": []}, ["work", "price"])


def test_csv(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("﻿work_id,name\n1,é\n2,x\n".encode())
    (tmp_path / "w.csv").write_bytes("work_id,name\n1,é\n1,y\n".encode("cp1252"))
    assert {tuple(r) for r in tables.read_csv(spark, str(tmp_path / "u.csv")).collect()} == {("1", "é"), ("2", "x")}
    assert {tuple(r) for r in tables.read_csv(spark, str(tmp_path / "w.csv")).collect()} == {("1", "é"), ("1", "y")}
    assert tables.load_keyed(spark, str(tmp_path / "u.csv"), "work_id", ["name"]).count() == 2
    with pytest.raises(ValueError, match="repeats work_id: 1"):
        tables.load_keyed(spark, str(tmp_path / "w.csv"), "work_id")
    kept, ignored = tables.load_first_wins(spark, str(tmp_path / "w.csv"), "work_id", "name")
    assert [r.name for r in kept.collect()] == ["y"] and ignored == 1


def test_sink_and_reload(spark, tmp_path):
    df = spark.createDataFrame([(1, True, None), (2, None, "b")], "i int, f boolean, s string")
    out = str(tmp_path / "out")
    assert tables.write_csv(df, out) == {"rows": 2, "missing": {"i": 0, "f": 1, "s": 1}}
    table = tables.Reloading(spark, out, tables.read_csv)
    assert {(r.i, r.f) for r in table.get().collect()} == {("1", "1"), ("2", None)} and table.get() is table.get()
    before = table.get()
    tables.write_csv(df.limit(1), out)
    assert table.get() is not before and table.get().count() == 1
    assert [r.i for r in tables.limit_rows(df, 1, "i").collect()] == [1]


def test_stream_is_the_batch(spark):
    d = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{d}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    want = {tuple(r) for r in daily.daily_counts(batch).collect()}
    got = {tuple(r) for r in daily.run_to_table(daily.daily_counts(stream, watermark="1 day"), "days", "complete").collect()}
    assert got == want
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    months = daily.run_to_table(daily.monthly_updates(stream), "months", "complete")
    assert sum(r.events for r in months.collect()) == batch.count()
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    final = {tuple(r) for r in daily.run_to_table(daily.daily_counts(stream, watermark="1 hour"), "final").collect()}
    assert final < want or final == want  # days are given out once the watermark has passed them
