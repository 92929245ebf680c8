import io
import zipfile

from pyspark.sql import functions as F

from tessella.sources import files
from tessella.streaming import folds
from tests.conftest import SF

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
BODY = (
    '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>One </w:t><w:t>two</w:t></w:r></w:p>'
    '<w:p><w:r><w:br w:type="page"/><w:t>Next</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc></w:tr><w:tr/></w:tbl>'
)


def test_files(spark, tmp_path):
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{BODY}</w:body></w:document>")
    (tmp_path / "in/deep").mkdir(parents=True)
    for name, data in {"a.TXT": b"x\xffy", "deep/b.docx": docx.getvalue(), "c.docx": b"bad", "d.pdf": b"%", "e.md": b"  \n", "f.exe": b"z"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    root = str(tmp_path / "in")
    assert [r.path.rpartition("/")[2] for r in files.document_paths(spark, root).collect()] == ["a.TXT", "c.docx", "d.pdf", "b.docx", "e.md"]
    got = {r.path.rpartition("/")[2]: r for r in files.load_documents(spark, root).collect()}
    assert got["a.TXT"].text == "xy" and got["d.pdf"].text is None and "BadZipFile" in got["c.docx"].error and "e.md" not in got
    assert got["b.docx"].text == "# Title\nOne two\n\f\nNext\n| a\\|b |\n| --- |\n|  |".replace("\n\f\nNext", "\n\f\nNext")
    (tmp_path / "q.txt").write_text(" one \n\n two\n")
    q = files.query_list(spark, str(tmp_path / "q.txt"))
    assert [r.query for r in q.collect()] == ["one", "two"]
    files.write_answers(q, str(tmp_path / "o.json"))
    assert spark.read.json(str(tmp_path / "o.json")).count() == 2


def test_spreadsheets():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = '<row><c r="A1" t="s"><v>1</v></c><c r="C1"><v>2.5</v></c></row><row><c r="A2" t="inlineStr"><is><t> </t></is></c></row><row><c r="B3" t="inlineStr"><is><t>in</t></is></c></row>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet10.xml", f"<worksheet {ns}><sheetData><row><c><v>9</v></c></row></sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    assert files.xlsx_text(data.getvalue()) == "one\t\t2.5\n\tin"


def run(spark, df, mode="complete"):
    q = df.writeStream.format("memory").queryName("t").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("t").collect()


def test_streams_equal_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = lambda: folds.event_stream(spark, str(tmp_path / "e"), e._jdf.schema().toDDL())
    batch = {(r.user_id, r.event_type): r["count"] for r in e.groupBy("user_id", "event_type").count().collect()}
    assert {(r.session, r.tool): r.calls for r in run(spark, folds.usage_counts(stream()))} == batch
    days = {(r.d, r.event_type): r["count"] for r in e.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").count().collect()}
    assert {(r.start, r.tool): r.calls for r in run(spark, folds.windowed_counts(stream(), "ts", "event_type", late="60 days"))} == days
    jobs = folds.document_progress(stream().select(F.col("user_id").alias("job"), F.lit(1).alias("doc"), F.lit("index_started").alias("stage")))
    assert {r.progress for r in run(spark, jobs)} == {85}
    firsts = run(spark, folds.first_in_window(stream(), "ts", "user_id", "60 days"), "append")
    assert len(firsts) == e.select("user_id").distinct().count()
