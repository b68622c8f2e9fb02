"""Files in and out, headers, catalogues, and the streaming forms."""

import base64
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import monitor
from tallyloom.sources import tables
from tallyloom.streaming import monitor as streaming


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_delimited(spark, tmp_path, sep):
    path = tmp_path / "x.csv"
    path.write_text(sep.join(("plz", "Wert", " Name ")) + "\n" + sep.join(("01067", "1.5", "ä")) + "\n")
    df = tables.lower_headers(tables.read(spark, str(path)))
    assert df.columns == ["plz", "wert", "name"] and tuple(df.first()) == ("01067", 1.5, "ä")


def test_unknown_endings_are_refused(spark):
    with pytest.raises(ValueError):
        tables.read(spark, "x.exe")


def test_first_alias_wins(spark):
    df = tables.renamed(spark.createDataFrame([(1, 2, 3, 4)], ["NR", "id", "Rabatt", "umsatz"]), tables.OFFER_ALIASES)
    assert df.columns == ["NR", "angebot_id", "rabatt_pct", "umsatz"]


def test_purchases_get_keys(spark):
    r = tables.purchases(spark.createDataFrame([("Meier AG", "Pumpe 3")], ["kunde", "produkt"])).first()
    assert (r.produkt_id, r.kunde_id, r.umsatz, r.kategorie) == ("PUMP", "MEI", 1.0, "Unbekannt")


def test_catalogue_and_preview(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x;y\n1;2\n3;4\n")
    (tmp_path / "a.csv").write_text("z\n1\n")
    (tmp_path / "b.meta.txt").write_text("Two columns\n")
    rows = [tuple(r) for r in tables.catalogue(spark, str(tmp_path)).orderBy("name").collect()]
    assert rows == [("a.csv", ["z"], "a"), ("b.csv", ["x", "y"], "Two columns")]
    head, n = tables.preview(tables.read(spark, str(tmp_path / "b.csv")), 1)
    assert head.count() == 1 and n == 2


def test_images_and_base64(spark, tmp_path):
    for label in ("normal", "defect"):
        (tmp_path / label).mkdir()
        (tmp_path / label / "a.png").write_bytes(b"png")
    (tmp_path / "note.txt").write_text("x")
    assert sorted(r.label for r in tables.images(spark, str(tmp_path)).collect()) == ["defect", "normal"]
    df = spark.createDataFrame([(base64.b64encode(b"abc").decode(),)], "b string")
    assert bytes(tables.decoded(df, "b").first().b) == b"abc"


def test_columns_by_kind(spark):
    df = spark.createDataFrame([("x", "2024-01-01", 3.0)], "name string, datum string, wert double")
    assert tables.time_column(df) == "datum" and tables.numeric_columns(df) == ["wert"]
    assert tables.time_column(df.select(F.lit("no").alias("datum"))) is None
    assert tables.freshness(df).first().datum == "2024-01-01"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    tables.write_csv(df, str(tmp_path / "out"))
    assert tuple(spark.read.option("header", True).csv(str(tmp_path / "out")).first()) == ("1", "a")
    assert tables.as_json(df).first().json == '{"x":1,"y":"a"}'


def results(spark):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp()
    rows = [(str(i), "p" if i % 2 else "q", 0.5, "NOK" if i % 4 == 1 else "OK", 1.0, at + i * 7200) for i in range(48)]
    return spark.createDataFrame(rows, "id string, project_id string, anomaly_score double, decision string, inference_ms double, created_at double")


def test_streams(spark, tmp_path):
    results(spark).repartition(4).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(results(spark).schema).parquet(str(tmp_path / "in"))
    q = streaming.daily_counts(source()).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    counts = {(str(r.tag), r.project_id): (r.total, r.nok) for r in spark.table("counts").collect()}
    assert len(counts) == 8 and counts["2024-01-01", "p"] == (6, 3) and sum(t for t, _ in counts.values()) == 48
    seen = []
    streaming.on_alert(source(), lambda rows: seen.extend(r.project_id for r in rows), str(tmp_path / "c1")).awaitTermination()
    assert set(seen) == {"p"}
    streaming.append(source(), str(tmp_path / "log"), str(tmp_path / "c2")).awaitTermination()
    assert monitor.latest(spark.read.parquet(str(tmp_path / "log")), 5).count() == 5


def test_alerts_follow_the_running_rate(spark, tmp_path):
    """Each batch alone would alert, all results so far don't; and the other way round."""
    kind = "id int, project_id string, decision string, created_at double"
    folder, seen = str(tmp_path / "in"), []

    def batch(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(kind).parquet(folder)
        streaming.on_alert(source, lambda found: seen.extend((r.project_id, r.total, r.nok_rate) for r in found), str(tmp_path / "c")).awaitTermination()

    batch([(i, "p", "OK", 1000.0 + i) for i in range(9)])
    batch([(10, "p", "NOK", 1010.0)])
    assert seen == []
    batch([(11 + i, "p", "NOK", 1011.0 + i) for i in range(2)])
    assert seen == [("p", 12, 25.0)]


def test_zipped_images(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "set.zip", "w") as z:
        for name, data in (("normal/a.PNG", b"1"), ("x/defect/b.jpg", b"22"), ("c.bmp", b"333"), ("normal/readme.txt", b"no")):
            z.writestr(name, data)
    got = sorted((r.path.split("!")[1], r.length, r.label, bytes(r.content)) for r in tables.zipped_images(spark, str(tmp_path)).collect())
    assert got == [("c.bmp", 3, "", b"333"), ("normal/a.PNG", 1, "normal", b"1"), ("x/defect/b.jpg", 2, "defect", b"22")]


def test_workbooks_read_back(spark, tmp_path):
    """Every kind of cell, over several workbooks, in rows dealt over tasks."""
    from datetime import date

    rows = [(i, f"name {i} <&> ä\n ", None if i % 3 == 0 else i / 7, i % 2 == 0, date(1999, 12, 30 if i % 2 else 31), None) for i in range(57)]
    df = spark.createDataFrame(rows, "n long, text string, x double, yes boolean, day date, none string").repartition(3)
    folder = str(tmp_path / "out.xlsx")
    assert tables.write_excel(df, folder, most=10) >= 6
    back = tables.read(spark, folder)
    assert dict(back.dtypes) == {"n": "bigint", "text": "string", "x": "double", "yes": "boolean", "day": "date", "none": "string"}
    assert sorted(back.collect(), key=lambda r: r.n) == sorted(df.collect(), key=lambda r: r.n)
    assert tables.read(spark, f"{folder}/part-00000.xlsx").count() == 10
    empty = str(tmp_path / "empty.xlsx")
    assert tables.write_excel(df.limit(0), empty) == 1 and tables.read(spark, empty).columns == df.columns and tables.read(spark, empty).count() == 0


def test_workbooks_of_other_writers(spark, tmp_path):
    """Shared and rich strings, gaps, dates by style, sheets by name and place, and workbooks of different columns together."""
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def book(path, sheet, shared=""):
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{office}"><sheets><sheet name="Other" r:id="a"/><sheet name="Data" r:id="b"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/x.xml"/><Relationship Id="b" Target="/xl/worksheets/y.xml"/></Relationships>')
            z.writestr("xl/worksheets/x.xml", f"<worksheet {ns}><sheetData/></worksheet>")
            z.writestr("xl/worksheets/y.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{shared}</sst>")
            z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="dd.mm.yyyy"/><numFmt numFmtId="171" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')

    shared = "<si><t>Id</t></si><si><r><t>Na</t></r><r><t>me</t></r></si><si><t>x</t></si>"
    book(tmp_path / "a.xlsx", '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="str"><v>Day</v></c><c r="E1" t="inlineStr"><is><t>Len</t></is></c></row><row/><row r="3"><c r="A3"><v>7</v></c><c r="C3" t="s"><v>2</v></c><c r="D3" s="1"><v>36524</v></c><c r="E3" s="2"><v>1.5</v></c></row><row><c r="A4" t="e"><v>#N/A</v></c><c r="AA4"><v>1</v></c></row>', shared)
    book(tmp_path / "b.xlsx", '<row><c t="s"><v>0</v></c><c t="str"><v>More</v></c></row><row><c><v>8</v></c><c t="b"><v>1</v></c></row>', shared)
    df = tables.read_excel(spark, f"{tmp_path}/*.xlsx", sheet="Data")
    assert set(df.columns) == {"Id", "Name", "Day", "Len", "More"}
    got = {r.Id: (r.Name, str(r.Day), r.Len, r.More) for r in df.collect()}
    assert got == {7: ("x", "1999-12-30", 1.5, None), None: (None, "None", None, None), 8: (None, "None", None, True)}
    assert tables.read_excel(spark, f"{tmp_path}/a.xlsx", sheet=0).columns == []


class FakeSession:
    """A session of a cluster without a shared folder."""

    def __init__(self, master):
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        self.conf = conf
        self.sparkContext = type("Context", (), {"master": master, "getConf": staticmethod(lambda: conf), "getCheckpointDir": staticmethod(lambda: None), "setCheckpointDir": staticmethod(lambda path: None)})


def test_a_cluster_needs_a_shared_folder():
    from tallyloom.sources import session

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(FakeSession("spark://host:7077"))
    assert session.shared_dir(FakeSession("local[2]"))


def test_days_are_read_as_days(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("datum;n\n2024-02-29;1\nkeins;2\n;3\n")
    got = tables.read(spark, str(path), dates=("datum", "fehlt")).orderBy("n").collect()
    assert [str(r.datum) for r in got] == ["2024-02-29", "None", "None"]


@pytest.mark.parametrize("cuts", [[40], [1, 2, 7, 40], [*range(3, 40, 4), 40]])
def test_state_after_each_result_is_that_of_the_whole(spark, tmp_path, cuts):
    """Whatever micro-batches the results come in: the rates of the batch query, the newest kept, and a state of bounded size."""
    import random

    rng = random.Random(5)
    rows = sorted((86_400.0 * (i // 9) + 1_000 * (i % 9) + rng.randrange(3), i, rng.choice("pq"), rng.choice(["NOK", "OK", "OK"])) for i in range(40))
    rows = [(i, p, d, at) for at, i, p, d in rows]
    kind = "id long, project_id string, decision string, created_at double"
    for n, (a, b) in enumerate(zip([0, *cuts], cuts)):
        spark.createDataFrame(rows[a:b], kind).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03}")
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = streaming.after_each(source, kept=5).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    want = monitor.running_rate(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.id, r.total, r.nok_rate, r.alarm) for r in got) == sorted((r.id, r.total, r.nok_rate, r.alarm) for r in want)
    gone = {r.gone for r in got} - {None}
    for p in "pq":
        mine = [i for i, q, _, _ in rows if q == p]
        assert set(mine) - gone == set(mine[-5:])
