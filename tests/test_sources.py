from pyspark.sql import functions as F

from tallyweave.operators.merging import upsert
from tallyweave.sources import corrections, documents, sheets
from tallyweave.streaming import incremental


def test_pages_and_lines(spark):
    text = "intro\n--- OCR PAGE 1 (full) ---\nfirst  line\r\n\nsecond\n--- OCR PAGE 3 (hi) ---\nlast"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc int, text string")
    got = documents.pages(docs, ["doc"])
    assert [(r.page_no, r.text.strip()) for r in got.orderBy("page_no").collect()] == [(0, "intro"), (1, "first  line\r\n\nsecond"), (3, "last")]
    assert [(r.page_no, r.line_no, r.line) for r in documents.lines(got, ["doc", "page_no"]).orderBy("page_no", "line_no").collect()] == [(0, 0, "intro"), (1, 0, "first line"), (1, 2, "second"), (3, 0, "last")]
    seen = documents.inspected(docs).orderBy("doc").first()
    assert (seen.n_pages, seen.scanned) == (2, True)


def test_files(spark, tmp_path):
    (tmp_path / "client_2021.txt").write_text("a\nb")
    row = documents.read_texts(spark, str(tmp_path)).select("text", documents.year_in_path(F.col("path")).alias("y")).first()
    assert tuple(row) == ("a\nb", 2021)
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    assert documents.read_binaries(spark, str(tmp_path)).first().length == 4
    out = documents.extracted(documents.read_binaries(spark, str(tmp_path)), lambda it: (f.assign(text=f.content.map(len).astype(str))[["path", "text"]] for f in it), "path string, text string")
    assert out.first().text == "4"


def test_validation(spark):
    files = spark.createDataFrame([("a.PDF", 10, "application/pdf"), ("b.txt", 0, "text/plain"), (None, None, None), ("c.pdf", documents.MOST_BYTES + 1, "")], "name string, size long, mime string")
    assert [r.errors for r in documents.validated(files).collect()] == [[], ["not a pdf", "empty", "wrong type"], ["not a pdf", "empty"], ["too large"]]


def test_sheet_sinks(spark):
    cells = spark.createDataFrame([("sales", 2020, 5), ("sales", 2021, 6), ("cogs", 2021, 2)], "field_id string, year int, value long")
    catalogue = spark.createDataFrame([("sales", 5, "Sales"), ("cogs", 6, "Cost\tof goods"), ("rent", 8, "Rent")], "field_id string, row int, label string")
    wide = sheets.sheet(cells, catalogue, [2020, 2021])
    assert [r.line for r in sheets.tsv(wide, [2020, 2021], 5, 8).collect()] == ["Sales\t5\t6", "Cost of goods\t\t2", "\t\t", "Rent\t\t"]
    assert [r.line for r in sheets.markdown(wide, [2020]).collect()] == ["|  | 2020 |", "| --- | --- |", "| Sales | 5 |", "| Cost\tof goods |  |", "| Rent |  |"]
    assert '"2020":null' in sheets.json_rows(wide, [2020, 2021]).where("row = 8").first().json


def events(spark, n=40):
    rows = [(f"e{i}", f"2024-01-01 00:{i:02d}:00", f"c{i % 3}", 2020 + i % 2, "sales" if i % 5 else None, i, i * 10) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, at string, client_key string, year int, field_id string, parser_value long, corrected_value long")
    return df.withColumn("created_at", F.col("at").cast("timestamp")).drop("at").withColumn("chosen_source", F.lit("user")).withColumn("rejected", F.lit(None).cast("array<struct<value: bigint, source: string, valid: boolean>>"))


def test_correction_log_batch_equals_stream(spark, tmp_path):
    log = str(tmp_path / "log")
    for part in (0, 1):
        corrections.append(events(spark).where(f"pmod(parser_value, 2) = {part}"), log)
    table = corrections.read(spark, log)
    assert table.count() == 32 and corrections.newest(table, 4).count() == 12
    keys = ["client_key", "year", "field_id"]
    stream = incremental.latest_stream(corrections.read_stream(spark, log), keys, "corrected_value", ["created_at", "id"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = table.groupBy(*keys).agg(F.max_by("corrected_value", F.struct("created_at", "id")).alias("corrected_value"))
    assert sorted(map(str, spark.table("latest").collect())) == sorted(map(str, batch.collect()))


def test_upsert_stream_equals_batch(spark, tmp_path):
    schema = "k int, value long, confidence int, n long"
    source = str(tmp_path / "in")
    table = incremental.VersionedTable(spark, f"file://{tmp_path}/table", "k int, value long, confidence int")
    parts = [[(1, 10, 80, 1), (2, 20, 50, 2), (1, 11, 90, 3)], [(1, 12, 85, 4), (2, 21, 50, 5), (3, 30, 1, 6)], [(3, None, 99, 7), (1, 13, 90, 8)]]
    want = spark.createDataFrame([], "k int, value long, confidence int")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.upsert_stream(spark.readStream.schema(schema).parquet(source), table, ["k"], "value", "confidence", ["n"], str(tmp_path / "cp")).awaitTermination(120)
        one = spark.createDataFrame(part, schema).groupBy("k").agg(F.max_by(F.struct("value", "confidence"), F.struct("confidence", "n")).alias("w")).select("k", "w.*")
        want = upsert(want, one, ["k"])
        assert table.versions() == [v for v in (i - 1, i) if v >= 0]  # older ones are gone
    assert sorted(map(str, table.read().collect())) == sorted(map(str, want.collect()))


def test_progressive_stops(spark, tmp_path):
    calls = []

    def tier(n, fills):
        def run(missing):
            calls.append(n)
            return missing.where(F.col("k").isin(*fills)).select("k", F.lit(n).alias("value"), F.lit(90).alias("confidence"))

        return run

    state = spark.createDataFrame([(k, None, None) for k in (1, 2, 3)], "k int, value int, confidence int")
    out = incremental.progressive(state, [tier(1, [1]), tier(2, [9]), tier(3, [2, 3])], lambda s: s.where("value is null"), lambda s, new: upsert(s, new, ["k"]), incremental.VersionedTable(spark, f"file://{tmp_path}/state", "k int, value int, confidence int"))
    assert calls == [1, 2] and out.where("value is null").count() == 2


def test_templates(spark):
    layout = spark.createDataFrame([(1, "section", "Assets", None, 0), (2, "subheader", "Assets", "Current", 0), (3, "value", "Assets", "Cash", 2), (4, "value", "Assets", "Stock", 2), (5, "blank", None, None, 0)], "row int, kind string, section string, label string, indent int")
    values = spark.createDataFrame([("Assets", "Cash", "12%"), ("Other", "Stock", "9")], "section string, label string, value string")
    got = [tuple(r) for r in sheets.template_lines(layout, values, "Industry").select("line", "value").collect()]
    assert got == [("Assets\tIndustry", "Industry"), ("Current\t", ""), ("  Cash\t12%", "12%"), ("  Stock\t", ""), ("", "")]
    assert [r.line for r in sheets.table_lines(values, "Industry", [F.col("section")]).collect()] == ["Section\tLabel\tIndustry", "Assets\tCash\t12%", "Other\tStock\t9"]


def test_fixtures_and_recognition(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "top": [5, 4]},\n {"id": 2, "top": []}]')
    assert sorted((r.id, r.top) for r in documents.fixtures(spark, f"file://{tmp_path}/a.json", "id long, top array<long>").collect()) == [(1, [5, 4]), (2, [])]
    reports = spark.createDataFrame([(1, 2), (2, 9), (3, None)], "id int, n_facts int")
    got = documents.read_or_recognised(reports, F.col("n_facts") < 4, lambda df: df.select("id", (F.col("n_facts") * 10).alias("n_facts")))
    assert sorted((r.id, r.n_facts) for r in got.collect()) == [(1, 20), (2, 9), (3, None)]
