"""Readers, parsers, pixels, streams."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import functions as F

from docassay.operators import pixels
from docassay.operators.rules import Rule
from docassay.sources import files, tables
from docassay.streaming import scoring


def test_csv_strips_nul_and_keeps_newlines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'document_id,v\n"doc-1","a\x00b"\n"doc-2","two\nlines ""q"""\n')
    got = {r["document_id"]: r["v"] for r in tables.read_csv(spark, str(tmp_path / "a.csv"), ["document_id", "v"]).collect()}
    assert got == {"doc-1": "ab", "doc-2": 'two\nlines "q"'}
    assert tables.read_csv(spark, str(tmp_path / "none.csv"), ["document_id"]).count() == 0


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'back\\slash "and" quote')], "document_id string, v string")
    tables.write_csv(df, str(tmp_path / "out"), compress=True)
    assert tables.read_csv(spark, str(tmp_path / "out"), ["document_id", "v"]).collect() == df.collect()


def test_zip_members_and_names(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("合同/a.pdf", b"%PDF-1.4")
        z.writestr("._b.pdf", b"no")
        z.writestr("readme.txt", b"no")
    got = files.zip_members(spark, str(tmp_path / "*.zip")).collect()
    assert [(r["member"], r["doc_type"], r["size_bytes"]) for r in got] == [("合同/a.pdf", "contract", 8)]


def test_pdf_bytes(spark):
    raw = b"%PDF-1.4\n1 0 obj /Font /JS (x) \xff\xfe stream endstream endobj startxref %%EOF startxref %%EOF /Producer"
    row = spark.createDataFrame([(bytearray(raw),)], "content binary").select(*(c.alias(k) for k, c in files.pdf_bytes("content").items())).first()
    assert (row["object_count"], row["stream_count"], row["xref_count"], row["incremental_update_count"], row["javascript_count"], row["creator_missing"], row["producer_missing"], row["pdf_version"]) == (1, 2, 2, 2, 1, 1, 0, "1.4")


def test_tool_listings(spark):
    df = spark.createDataFrame([("d", "Title: a:b\nPages:  3\n", "page num type width height\n----\n 1 0 image 2000 900 x\n 1 1 smask 10 10 x\n 2 2 image 100 100 x\n")], "document_id string, info string, images string")
    assert df.select(files.key_values(F.col("info"))["Title"], files.page_count(F.col("info"))).first()[:] == ("a:b", 3)
    got = files.image_counts(files.image_rows(df, "images")).first()
    assert (got["image_count"], got["smask_count"], got["large_image_count"], got["small_overlay_count"]) == (2, 1, 1, 1)


def test_word_listings(spark):
    xml = '<doc><page width="1"><word xMin="1" yMin="2" xMax="3" yMax="4">A&amp;B</word></page><page width="1"><word xMin="5" yMin="6" xMax="7" yMax="8">C</word></page></doc>'
    tsv = "level\n5\t1\t1\t1\t1\t1\t10\t20\t30\t40\t91.5\thello\n5\t1\t1\t1\t1\t2\t10\t20\t30\t40\t-1\t\n"
    df = spark.createDataFrame([("d", xml, tsv)], "document_id string, xml string, tsv string")
    assert [(r["page"], r["text"], r["x_min"]) for r in files.word_boxes(df, "xml").orderBy("page").collect()] == [(1, "A&B", 1.0), (2, "C", 5.0)]
    assert [(r["text"], r["conf"], r["y"]) for r in files.recognised_words(df, "tsv").collect()] == [("hello", 91.5, 20.0)]


def test_components_and_statistics(spark):
    mask = np.zeros((6, 6), bool)
    mask[0, 0] = mask[1, 1] = mask[4, 2:5] = mask[3, 4] = True
    assert sorted(pixels.components(mask)) == [(1, 0, 0, 1, 1), (1, 1, 1, 2, 2), (4, 3, 2, 5, 5)]
    assert sorted(pixels.components(mask, diagonal=True)) == [(2, 0, 0, 2, 2), (4, 3, 2, 5, 5)]
    page = np.full((64, 64, 3), 255, np.uint8)
    page[10:30, 10:30] = (200, 20, 20)
    df = spark.createDataFrame([((64, 64, 3, bytearray(page.tobytes())),), ((0, 0, 3, None),)], f"r {pixels.RASTER}")
    red, none = (r["s"] for r in df.select(pixels.raster_statistics("r").alias("s")).collect())
    assert red["red_count"] == 1 and abs(red["red"] - 400 / 4096) < 1e-9 and red["edge"] > 0
    assert none["red"] == 0


def test_stream_scores_each_file_once(spark, tmp_path):
    rows = spark.createDataFrame([("d1", 1), ("d2", 0)], "document_id string, smask_count int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = scoring.scored_stream(spark, str(tmp_path / "in"), rows.schema, [Rule("smask", F.col("smask_count") > 0, 25)])
    for _ in range(2):
        scoring.publish(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = {r["document_id"]: (r["risk_score"], r["risk_reasons"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"d1": (25, "smask"), "d2": (0, "")}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_side_texts_by_their_path_below_the_root(spark, tmp_path):
    import gzip

    root = tmp_path / "pri vate+1"
    for folder, text in (("a", "first"), ("b", "second")):
        (root / folder).mkdir(parents=True)
        (root / folder / "x.txt").write_text(text)
    with gzip.open(root / "b" / "ü %20.txt.gz", "wt") as f:
        f.write("packed")
    (tmp_path / "out.txt").write_text("outside")
    asked = [(1, "a/x.txt"), (2, "b/x.txt"), (3, "./b//./x.txt"), (4, "../out.txt"), (5, "x.txt"), (6, None), (7, str(tmp_path / "out.txt")), (8, "b/ü %20.txt.gz"), (9, "a/../b/x.txt")]
    rows = spark.createDataFrame([(i, p, "spare") for i, p in asked], "id int, path string, preview string")
    got = {r["id"]: r["text"] for r in tables.side_texts(spark, str(root), rows, "path", "preview").collect()}
    assert got == {1: "first", 2: "second", 3: "second", 4: "spare", 5: "spare", 6: "spare", 7: "spare", 8: "packed", 9: "spare"}


def test_only_a_missing_path_is_an_empty_table(spark, tmp_path):
    assert tables.read_csv(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0
    with pytest.raises(AnalysisException):
        tables.read_csv(spark, str(tmp_path / "none.csv"), ["a"], missing_ok=False)
    with pytest.raises((AnalysisException, IllegalArgumentException)):
        tables.read_csv(spark, "nosuchscheme-!://x/y.csv", ["a"])


def test_publish_replaces_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.range(3)
    tables.publish(df.write.parquet, path)
    tables.publish(spark.range(5).write.parquet, path)
    assert spark.read.parquet(path).count() == 5

    def broken(staged):
        df.write.parquet(staged)
        raise RuntimeError("half way")

    with pytest.raises(RuntimeError):
        tables.publish(broken, path)
    assert spark.read.parquet(path).count() == 5 and sorted(p.name for p in tmp_path.iterdir()) == ["table"]
    tables.write_summary(spark.createDataFrame([(2, "x")], "n int, name string"), str(tmp_path / "summary"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "summary")).collect()] == ['{"n":2,"name":"x"}']


def test_console_table_cuts_cells(spark):
    shown = tables.console(spark.createDataFrame([(1, "x" * 80), (22, None)], "id int, text string"))
    assert shown.splitlines()[0] == "id  text" and shown.splitlines()[2].endswith("x…") and len(shown.splitlines()[2]) == 4 + 54
    assert shown.splitlines()[3] == "22"


def test_printed_dates(spark):
    raws = ["Thu Jan  2 15:30:59 2020 CST", "Thu, 02 Jan 2020 15:30:59 +0800", "2 January 2020 15:30", "2020-01-02 15:30:59", "2020/01/02 15:30:59", "2020-01-02", "2020-02-31", "Thu Foo  2 15:30:59 2020", "", None, "2020-13-01 00:00:00"]
    got = [r["t"] for r in spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k int, raw string").select("k", F.date_format(files.printed_date(F.col("raw")), "yyyyMMddHHmmss").alias("t")).orderBy("k").collect()]
    assert got == ["20200102153059", "20200102153059", "20200102153000", "20200102153059", "20200102153059", "20200102000000", None, None, None, None, None]


def test_crops_sizes_and_polar_images(spark):
    rng = np.random.default_rng(0)
    page = rng.integers(0, 255, (100, 200, 3)).astype(np.uint8)
    crop = pixels.context_crop(page, 0.25, 0.5, 0.5, 0.75)
    assert crop.shape == (45, 70, 3) and (crop == page[40:85, 40:110]).all()
    assert pixels.context_crop(page, 0.9, 0.9, 1.0, 1.0).shape == (14, 24, 3)
    assert pixels.shrunk(page, 50).shape == (25, 50, 3) and pixels.shrunk(page, 400) is page
    assert (pixels.resized(page[:4, :4], 2, 2)[0, 0] == np.round(page[:2, :2].reshape(-1, 3).mean(axis=0))).all()
    assert (pixels.resized(page[:2, :2], 4, 4) == np.repeat(np.repeat(page[:2, :2], 2, 0), 2, 1)).all()
    read = pixels.reading_crop(page, 0.25, 0.5, 0.5, 0.75)
    assert read.shape == (411, 640) and read.min() == 0 and read.max() == 255
    df = spark.createDataFrame([((100, 200, 3, bytearray(page.tobytes())), (0.25, 0.5, 0.5, 0.75)), ((100, 200, 3, None), (0.0, 0.0, 1.0, 1.0)), ((1, 1, 3, bytearray(3)), (None, 0.0, 1.0, 1.0))], f"r {pixels.RASTER}, b struct<x0:double,y0:double,x1:double,y1:double>")
    got = [r["c"] for r in df.select(pixels.cropped("r", "b").alias("c")).collect()]
    assert (got[0]["h"], got[0]["w"], bytes(got[0]["data"])) == (45, 70, crop.tobytes()) and got[1]["data"] is None and got[2]["data"] is None
    y, x = np.mgrid[0:65, 0:65] - 32
    r = np.sqrt(x * x + y * y)
    ring, disc = (r > 26) & (r < 32), r < 12
    of_ring, of_disc = pixels.ring_features(ring), pixels.ring_features(disc)
    assert of_ring["ring"] > 0.4 and of_ring["center"] == 0 and of_ring["coverage"] == 1 and of_ring["uniformity"] > 0.8
    assert of_disc["ring"] == 0 and of_disc["center"] > 0.4 and of_disc["coverage"] == 0
    unrolled = pixels.polar(ring.astype(float))
    assert unrolled.shape == (64, 256) and unrolled[2:8].mean() > 0.9 and unrolled[-20:].mean() == 0
    left = np.tile(np.arange(90.0), (80, 1))
    assert pixels.dhash(left) == (1 << 64) - 1 and pixels.dhash(left[:, ::-1]) == 0


def test_rules_of_local_forensics(spark):
    from docassay.operators.rules import local_rules, reasons_of, score_of

    rows = spark.createDataFrame([(6.0, 3.5, 8), (5.9, 3.4, 7), (None, 9.0, None)], "ela_p99_ratio double, noise_peak_ratio double, copymove_offset_votes int")
    got = [(r["s"], r["r"]) for r in rows.select(score_of(local_rules()).alias("s"), reasons_of(local_rules()).alias("r")).collect()]
    assert got == [(70, ["local_ela_hotspot", "local_noise_hotspot", "copy_move_match"]), (0, []), (18, ["local_noise_hotspot"])]


def test_settings_come_from_one_object(spark, tmp_path):
    from docassay.settings import Settings

    path = tmp_path / "settings.json"
    path.write_text('{\n"seed": 7, "type_words": {"invoice": ["bill"]}, "validation_share": 0.1}')
    got = Settings.read(spark, str(path))
    assert (got.seed, got.type_words, got.validation_share, got.large_image_pixels) == (7, (("invoice", ("bill",)),), 0.1, 1_000_000)
    for bad in ('{"sed": 7}', '{"seed": "7"}', '{"folders": []}'):
        path.write_text(bad)
        with pytest.raises(ValueError):
            Settings.read(spark, str(path))


def test_private_texts_are_written_by_run(spark, tmp_path):
    df = spark.createDataFrame([("doc-1", "secret"), ("doc-2", None)], "document_id string, text string")
    tables.write_private_texts(df, str(tmp_path / "texts"), "run7")
    back = spark.read.json(str(tmp_path / "texts")).collect()
    assert {r["run_id"] for r in back} == {"run7"} and all(len(r["ref"]) == 20 and "doc" not in r["ref"] for r in back) and {r["text"] for r in back} == {"secret", None}


def test_seal_candidates_of_a_page(spark):
    from docassay.operators import candidates

    page = np.full((700, 500, 3), 250, np.uint8)
    for y in range(60, 260, 24):  # lines of text, and a rule across the page
        page[y : y + 8, 40:460:2] = 40
    page[430:433, 10:490] = 30
    y, x = np.mgrid[0:700, 0:500]
    r = np.hypot(y - 560, x - 360)
    ring = (r > 40) & (r < 47)
    page[ring] = (200, 30, 40)
    found = candidates.find(page)
    assert len(found) == 1 and abs(found[0]["x0"] - 313) < 14 and abs(found[0]["y1"] - 607) < 14 and found[0]["coverage"] == 1 and found[0]["saturation"] > 0.5
    grey = page.copy()
    grey[ring] = 110
    blank = np.full((300, 300, 3), 255, np.uint8)
    rows = [(k, (*p.shape, bytearray(p.tobytes()))) for k, p in enumerate((page, grey, blank))] + [(3, (0, 0, 3, None))]
    df = spark.createDataFrame(rows, f"page int, raster {pixels.RASTER}")
    got = {r["page"]: r for r in candidates.best_candidates(df, ["page"]).collect()}
    assert set(got) == {0, 1} and all(r["seal_class"] == "seal" and r["reason"] == "annular_stamp_geometry" and r["should_ocr"] for r in got.values())
    assert got[0]["saturation"] > 0.5 > 0.12 > got[1]["saturation"]
