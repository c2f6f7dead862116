import io
import zipfile
from decimal import Decimal

from pyspark.sql import functions as F

from docstrata.sources import office, sinks
from docstrata.sources.tables import criteria, markdown_bundle, query_result


def book() -> bytes:
    sheet = '<worksheet xmlns="x"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1"><v>n</v></c></row><row><c r="A2" t="inlineStr"><is><t>a</t></is></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="x"><si><t>h1</t></si><si><r><t>h</t></r><r><t>2</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    return out.getvalue()


def test_workbook_honours_references(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(book())
    rows = office.workbook(spark, str(tmp_path)).collect()
    assert [(r["row"], r["cells"]) for r in rows] == [(1, {"h1": "a", "h2": "", "n": "7"})]


def test_documents_to_pages(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<d xmlns:w="w">' + "".join(f"<w:p><w:r><w:t>l{i}</w:t></w:r></w:p><w:p/>" for i in range(13)) + "</d>")
    (tmp_path / "d.docx").write_bytes(out.getvalue())
    pages = office.pseudo_pages(office.documents(spark, str(tmp_path)), "path", "k").orderBy("page").collect()
    assert [r["text"].count("\n") for r in pages] == [11, 0]


def test_markdown_bundle(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.md").write_text("---\ntitle: A\n---\nbody")
    (tmp_path / "b.md").write_text("---\ntitle: B\n---\n")
    rows = markdown_bundle(spark, str(tmp_path)).collect()
    assert [(r["meta"], r["body"]) for r in rows] == [({"title": "A"}, "body")]


def test_missing_criteria_and_failed_statement(spark, tmp_path):
    assert criteria(spark, str(tmp_path / "none.json"), "no string").count() == 0
    spark.range(3).createOrReplaceTempView("three")
    assert query_result(spark, "SELECT id FROM three ORDER BY id", 2) == {"ok": True, "columns": ["id"], "rows": [["0"], ["1"]], "row_count": 2, "truncated_at": 2}
    assert query_result(spark, "SELECT nothing FROM three")["ok"] is False


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, Decimal("1.50"), b"a\xff", 'x"y')], "id long, d decimal(5,2), b binary, s string")
    sinks.write_jsonl(d, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["d"] == 1.5
    sinks.write_index(d.withColumn("corpus", F.lit("c")), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).filter("corpus = 'c'").count() == 1
    lines = [r["value"] for r in sinks.review_lines(d, "note", ["id", "s"], ["id"]).collect()]
    assert lines == ["﻿# note", "id,s", '"1","x""y"']
    assert d.select(sinks.event_frame(F.lit("done"), F.lit("{}")).alias("f")).first()["f"] == "event: done\ndata: {}\n\n"


def test_markdown_files_in_order_with_unreadable_ones(spark, tmp_path):
    from docstrata.sources.tables import markdown_files

    (tmp_path / "b").mkdir()
    (tmp_path / "a.md").write_text("---\ntitle: one\n---\nbody\n", encoding="utf-8")
    (tmp_path / "b" / "c.md").write_bytes(b"\xff\xfe not text")
    (tmp_path / "b" / "d.md").write_text("", encoding="utf-8")
    (tmp_path / "z.md").write_text("no head", encoding="utf-8")
    (tmp_path / "x.txt").write_text("other", encoding="utf-8")
    rows = markdown_files(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r.path.rsplit("/", 1)[-1], r.place, r.readable, r.body) for r in rows] == [("a.md", 1, True, "body\n"), ("c.md", 2, False, None), ("z.md", 3, True, "no head")]
    assert rows[0].meta == {"title": "one"} and markdown_files(spark, str(tmp_path), 2).count() == 2
