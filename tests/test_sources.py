"""CSV files, forecasts, images, settings."""

import csv
import hashlib
import io
import random
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilgrid.functions import fixed
from perilgrid.plans import queries
from perilgrid.sources import forecasts, image_files, images, png, settings, tables, weather


def test_headers():
    got = tables.header_mapping(
        ["﻿분류번호", " 위험물 유형 ", "수집일자", "위도(WGS84)", "경도(WGS84)", "노드링크ID", "시작노드", "끝노드", "소재지도로명주소", "데이터기준일자"], fixed.DAMAGE_HEADERS
    )
    assert list(got.values()) == fixed.DAMAGE_COLUMNS
    assert tables.header_mapping(["id", "hazardType", "latitude", "longitude"], fixed.DAMAGE_HEADERS) == {
        "id": "category_no", "hazardType": "hazard_type", "latitude": "lat", "longitude": "lon"
    }
    assert tables.header_mapping(["lat", "위도"], fixed.DAMAGE_HEADERS) == {"lat": "lat"}  # the first wins
    assert tables.match_header("x", fixed.DAMAGE_HEADERS) is None and tables.normal_header(None) == ""


@pytest.mark.parametrize(("encoding", "name"), [("cp949", "cp949"), ("utf-8-sig", "utf-8-sig"), ("utf-8", "utf-8-sig")])
def test_encodings(spark, tmp_path, encoding, name):
    (tmp_path / "a.csv").write_bytes("분류번호,위도,경도\n1,37.4,126.9\n".encode(encoding))
    frame, used = tables.read_csv(spark, f"{tmp_path}/a.csv")
    assert used == name and frame.columns == ["_row_id", "분류번호", "위도", "경도"] and tuple(frame.first()) == (0, "1", "37.4", "126.9")


def test_undecodable(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xff\xff\xff\xff,\x81\n")
    with pytest.raises(ValueError, match="no known encoding"):
        tables.read_csv(spark, f"{tmp_path}/a.csv")


def test_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,a\n1\n"x\n""y""",NA,nan\n')
    frame, _ = tables.read_csv(spark, f"{tmp_path}/a.csv")
    assert frame.columns == ["_row_id", "a", "b", "a.1"]
    assert [tuple(r) for r in frame.orderBy("_row_id").collect()] == [(0, "1", None, None), (1, 'x\n"y"', None, None)]
    (tmp_path / "b.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(ValueError, match="expected 2 fields, saw 3"):
        tables.read_csv(spark, f"{tmp_path}/b.csv")


def hard_csv(rng, rows, width):
    """Records with line ends, quotes and commas in their fields, stray quotes, blank lines and short rows."""
    pieces = ["a", "", "x\ny", 'say "hi"', ",", "\n\n", '"', "길", "long " * 9, "\n,\n"]
    out = []
    for _ in range(rows):
        n = width if rng.random() < 0.8 else rng.randint(1, width)
        fields = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 3))) for _ in range(n)]
        out.append(",".join('"' + f.replace('"', '""') + '"' if rng.random() < 0.5 or set(f) & set('\n,"') else f for f in fields))
        if rng.random() < 0.1:
            out.append(rng.choice(["", 'p"q', '"shut"behind,' + "z"]))
    return "\n".join(out)


@pytest.mark.parametrize(("split", "encoding"), [(23, "utf-8"), (150, "cp949"), (1 << 20, "utf-8")])
def test_records_over_lines_in_any_split(spark, tmp_path, split, encoding):
    rng = random.Random(split)
    for name in ("a", "b"):
        text = 'k,"the\nvalue",c,d\n' + hard_csv(rng, 25, 4) + ("\n" if name == "a" else "")
        (tmp_path / f"{name}.csv").write_bytes(text.encode(encoding))
    def plain(name):
        return [r for r in csv.reader(io.StringIO((tmp_path / f"{name}.csv").read_bytes().decode(encoding), newline="")) if r]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        for path, names in ((f"{tmp_path}/a.csv", "a"), (str(tmp_path), "ab")):
            want = [r for n in names for r in plain(n)[1:]]
            found = tables.scan_csv(spark, path)
            assert found.frame.columns == ["_row_id", "k", "the\nvalue", "c", "d"] and found.encoding == ("cp949" if encoding == "cp949" else "utf-8-sig")
            assert found.row_count == len(want) and found.ragged_rows == sum(len(r) < 4 for r in want)
            rows = found.frame.orderBy("_row_id").collect()
            assert len({r["_row_id"] for r in rows}) == len(want)
            missing = set(fixed.NA_TOKENS)
            assert [tuple(r)[1:] for r in rows] == [tuple(None if k >= len(r) or r[k] in missing else r[k] for k in range(4)) for r in want]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_one_record_over_many_splits(spark, tmp_path):
    long = "x\n" * 5000
    (tmp_path / "a.csv").write_text(f'a,b\n1,"{long}"\n2,"{long}')  # the last quote is never closed
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
        frame, _ = tables.read_csv(spark, f"{tmp_path}/a.csv")
        assert [tuple(r)[1:] for r in frame.orderBy("_row_id").collect()] == [("1", long), ("2", long[:-1])]  # the file's last line end is none of the text
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "b.csv").write_text('a,b\n"x\n",2,3\n')
    with pytest.raises(ValueError, match="expected 2 fields, saw 3"):
        tables.read_csv(spark, f"{tmp_path}/b.csv")


def test_reports_count_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,lat,lon\n1,2,3\n\n4\n5,6\n")
    _, (report,) = tables.load_damage(spark, path=f"{tmp_path}/a.csv")
    assert (report.row_count, report.ragged_rows) == (3, 2)
    (tmp_path / "z.csv").write_text("시설명,위도,경도,시군구명\nx,37.4,126.9,안양시\ny,37.4,126.9,b\n")
    _, report = tables.load_zones(spark, f"{tmp_path}/z.csv")
    assert (report.row_count, report.ragged_rows) == (1, 0)


def test_large_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,NA\n"x\n""y""",2\n')
    rows = tables.read_large_csv(spark, f"{tmp_path}/a.csv", multi_line=True).orderBy("_row_id").collect()
    assert [(r["a"], r["b"]) for r in rows] == [("1", None), ('x\n"y"', "2")]


def test_load(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,lat,lon,extra\n1,37.4,126.9,e\n")
    (tmp_path / "b.csv").write_text("id,latitude,longitude\n1,37.4,126.9\n")
    a, b = (f"{tmp_path}/{x}.csv" for x in "ab")
    frame, reports = tables.load_damage(spark, sources=[("A", a), ("B", b), ("C", f"{tmp_path}/none.csv")])
    rows = frame.orderBy("_row_id").collect()
    assert [(r["source"], r["category_no"], r["extra"], r["hazard_type"]) for r in rows] == [("A", "1", "e", None), ("B", "1", None, None)]
    assert "hazard_type" in reports[0].missing_standard_columns and reports[0].mapped_columns["id"] == "category_no"
    frame, reports = tables.load_damage(spark, path=a)
    assert "source" not in frame.columns
    frame, reports = tables.load_damage(spark, path=f"{tmp_path}/none.csv")
    assert frame.count() == 0 and reports[0].messages and frame.columns[1:] == fixed.DAMAGE_COLUMNS
    frame, reports = tables.load_damage(spark, path=f"{tmp_path}/none.csv", sample=a)
    assert reports[0].is_sample and frame.first()["source"] == "sample"


def test_zones(spark, tmp_path):
    (tmp_path / "z.csv").write_text("시설명,위도,경도,시군구명\nx,37.4,126.9,안양시\ny,37.4,126.9,b\n")
    frame, _ = tables.load_zones(spark, f"{tmp_path}/z.csv")
    assert [r["zone_name"] for r in frame.collect()] == ["x"]
    assert tables.load_zones(spark, f"{tmp_path}/none.csv")[0].count() == 0


def items(spark, *rows):
    return spark.createDataFrame([(r, i, *x) for i, (r, *x) in enumerate(rows)], "request_id int, pos int, fcstDate string, fcstTime string, category string, fcstValue string")


def test_forecast(spark):
    rows = items(
        spark, (1, "d", "0900", "PCP", "9mm"), (1, "d", "0600", "PCP", "1mm"), (1, "d", "0600", "PCP", "3.5mm"), (1, "d", "0600", "POP", "60"), (2, "d", "0600", "POP", "30"),
        (3, "d", "0600", "TMP", "20"), (4, "d", "0600", "POP", "x"),
    )
    got = {r["request_id"]: tuple(r)[1:] for r in weather.reduce_items(rows).collect()}
    assert got == {1: (True, 3.5, 60.0, "d 0600"), 2: (True, 0.0, 30.0, "d 0600"), 3: (False, None, None, None), 4: (False, None, None, None)}


def test_payload(spark):
    text = '{"response": {"body": {"items": {"item": [{"fcstDate": "d", "fcstTime": "t", "category": "PCP", "fcstValue": "강수없음"}]}}}}'
    frame = spark.createDataFrame([(1, text), (2, "broken"), (3, "{}")], "request_id int, payload string")
    assert [tuple(r) for r in weather.reduce_items(weather.items_of_json(frame)).collect()] == [(1, True, 0.0, None, "d t")]


def test_fetch_never_raises(spark):
    assert weather.fetch(spark, None, "d", "t")["available"] is False
    assert "reason" in weather.fetch(spark, "key", "d", "t", timeout=0.01)


def exif(lat, lon, south=False, west=False):
    def dms(v):
        d, m = int(v), int(v * 60) % 60
        return struct.pack("<6I", d, 1, m, 1, round((v - d - m / 60) * 3600 * 1000), 1000)

    gps = struct.pack("<H", 4)
    base = 26 + 2 + 12 * 4 + 4
    gps += struct.pack("<HHI4s", 1, 2, 2, b"S" if south else b"N") + struct.pack("<HHII", 2, 5, 3, base)
    gps += struct.pack("<HHI4s", 3, 2, 2, b"W" if west else b"E") + struct.pack("<HHII", 4, 5, 3, base + 24) + b"\0" * 4
    return b"\xff\xd8Exif\0\0II*\0" + struct.pack("<I", 8) + struct.pack("<HHHIII", 1, 0x8825, 4, 1, 26, 0) + gps + dms(lat) + dms(lon)


def test_gps(spark, tmp_path):
    assert images.gps_of(exif(37.3943, 126.9568)) == (pytest.approx(37.3943), pytest.approx(126.9568))
    assert images.gps_of(exif(10.5, 20.25, True, True)) == (pytest.approx(-10.5), pytest.approx(-20.25))
    assert images.gps_of(b"no image") is None and images.gps_of(exif(99.0, 10.0)) is None and images.gps_of(exif(1.0, 1.0)[:60]) is None
    (tmp_path / "a.jpg").write_bytes(exif(37.5, 127.0))
    (tmp_path / "b.jpg").write_bytes(b"x")
    got = {r["path"][-5:]: r["lat"] for r in images.places(images.read_images(spark, str(tmp_path))).collect()}
    assert got["a.jpg"] == pytest.approx(37.5) and got["b.jpg"] is None


def test_mosaic_changes_its_region_only():
    image = np.arange(100 * 100 * 3, dtype=np.uint32).astype(np.uint8).reshape(100, 100, 3)
    out = images.mosaic(image, 20, 30, 25, 17)
    outside = np.ones((100, 100), bool)
    outside[30:47, 20:45] = False
    assert (out[outside] == image[outside]).all() and (out[~outside] != image[~outside]).any()
    assert (images.mosaic(image, 200, 0, 5, 5) == image).all() and images.mosaic(image, 95, 95, 20, 20).shape == image.shape
    assert len(np.unique(images.mosaic(image, 0, 0, 100, 100).reshape(-1, 3), axis=0)) <= 100


def test_covering(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 255, (20, 20, 3), np.uint8)
    rows = spark.createDataFrame([(1, [20, 20, 3], image.tobytes()), (2, [20, 20, 3], image.tobytes())], "image_id long, shape array<int>, pixels binary")
    boxes = spark.createDataFrame([(1, 2, 3, 15, 15)], "image_id long, x int, y int, w int, h int")
    images.write_images(images.cover_faces(rows, boxes), f"{tmp_path}/out")
    got = {r["image_id"]: bytes(r["pixels"]) for r in spark.read.parquet(f"{tmp_path}/out/covered").collect()}
    assert got[1] == images.mosaic(image, 2, 3, 15, 15).tobytes() != image.tobytes() and got[2] == image.tobytes()


def test_privacy_is_honest():
    image = np.zeros((10, 10, 3), np.uint8)
    assert images.anonymize(image, None) == (None, {"face_status": "unavailable", "plate_status": "not performed"})
    assert images.anonymize(image, [])[1]["face_status"] == "performed"


def test_models(spark, tmp_path):
    assert images.find_model(str(tmp_path), {}) is None
    (tmp_path / "best.pt").write_text("")
    assert images.find_model(str(tmp_path), {"MODEL_PATH": "x.bin"}).endswith("best.pt")
    (tmp_path / "best.onnx").write_text("")
    assert images.find_model(str(tmp_path), {}).endswith("best.onnx")
    assert images.class_names({"names": "{10: 'b', 2: 'a'}"}) == ["a", "b"]
    assert images.class_names({"names": "['x']"}) == ["x"] and images.class_names({}) == fixed.CLASSES == images.class_names({"names": "(("})
    rows = spark.createDataFrame([(1, [1], [0.0])], "image_id long, shape array<int>, values array<float>")
    assert tuple(images.detect(rows, None).first()) == (1, None, None)


def test_settings():
    s = settings.load({"KMA_SERVICE_KEY": " ", "CONF_THRESHOLD": "x", "STORE_ORIGINAL_IMAGE": " Yes ", "KMA_NX": "61"})
    assert (s.weather_enabled, s.confidence, s.keep_originals, s.weather_nx) == (False, 0.25, True, 61)
    assert not settings.flag({"A": "0"}, "A", True) and settings.flag({}, "A", True)


def test_folder_of_files_in_splits(spark, tmp_path):
    """Many splits, several files with a header each, and an encoding that Spark doesn't offer."""
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        lines = ["분류번호,위도,비고"] + [f'{k * 1000 + i},"37.{i}",가나 "" 다' if i % 2 else f"{k * 1000 + i},NA" for i in range(500)]
        (folder / f"part-{k}.csv").write_bytes("\r\n".join(lines).encode("cp949"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        frame, encoding = tables.read_csv(spark, str(folder))
        rows = frame.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert encoding == "cp949" and frame.columns == ["_row_id", "분류번호", "위도", "비고"] and frame.rdd.getNumPartitions() >= 3
    got = {r["분류번호"]: (r["위도"], r["비고"]) for r in rows}
    assert len(rows) == 1500 and len({r["_row_id"] for r in rows}) == 1500
    assert got["1003"] == ("37.3", '가나 "" 다') and got["2004"] == (None, None)


def test_answers_without_items(spark):
    texts = ['{"response":{"header":{"resultCode":"22","resultMsg":"LIMITED"}}}', "{}", "not json", '{"response":{"body":{"items":{"item":[]}}}}']
    rows = weather.problems(spark.createDataFrame(list(enumerate(texts)), "request_id int, payload string")).collect()
    assert [(r["request_id"], r["reason"].split(": ")[1]) for r in rows] == [(0, "22 LIMITED"), (1, "? "), (2, "? ")]


def _chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _png(width, height, depth, colour, rows, *more, interlaced=0):
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)
    return png.SIGNATURE + _chunk(b"IHDR", head) + b"".join(more) + _chunk(b"IDAT", zlib.compress(rows)[:9]) + _chunk(b"IDAT", zlib.compress(rows)[9:]) + _chunk(b"IEND", b"")


@pytest.mark.parametrize("depth", [8, 16])
@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_round_trip(depth, channels):
    rng = np.random.default_rng(depth + channels)
    for shape in ((1, 1), (1, 9), (7, 1), (13, 11)):
        image = rng.integers(0, 256, (*shape, channels)).astype(np.uint8)
        for filters in ([0], [1], [2], [3], [4], [4, 3, 2, 1, 0]):
            assert (png.decode(png.encode(image, filters, depth)) == image).all()


def test_png_depths_and_palettes():
    assert png.decode(_png(5, 2, 1, 0, b"\0\xa8\0\x50"))[:, :, 0].tolist() == [[255, 0, 255, 0, 255], [0, 255, 0, 255, 0]]
    assert png.decode(_png(3, 1, 2, 0, b"\0\x1c")).ravel().tolist() == [0, 85, 255]
    assert png.decode(_png(2, 1, 4, 0, b"\0\x1f")).ravel().tolist() == [17, 255]
    plte = _chunk(b"PLTE", bytes(range(9)))
    assert png.decode(_png(3, 1, 2, 3, b"\0\x18", plte)).tolist() == [[[0, 1, 2], [3, 4, 5], [6, 7, 8]]]
    assert png.decode(_png(3, 1, 2, 3, b"\0\x18", plte, _chunk(b"tRNS", b"\x09")))[0, :, 3].tolist() == [9, 255, 255]


def test_unreadable_images_give_messages(spark):
    good = png.encode(np.zeros((2, 2, 3), np.uint8))
    plte = _chunk(b"PLTE", bytes(3))
    bad = {
        "good": good, "null": None, "empty": b"", "jpeg": b"\xff\xd8\xff", "cut": good[:-15], "noend": good[:-12], "flip": good[:45] + bytes([good[45] ^ 1]) + good[46:], "header": _png(2, 2, 3, 0, b""), "zero": _png(0, 2, 8, 0, b""),
        "large": _png(1 << 30, 1 << 30, 8, 0, b""), "short": _png(2, 2, 8, 0, b"\0\0"), "filter": _png(1, 1, 8, 0, b"\x09\0"), "interlaced": _png(1, 1, 8, 0, b"\0\0", interlaced=1), "palette": _png(2, 1, 8, 3, b"\0\0\1", plte),
    }
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in bad.items()], "path string, content binary")
    got = {r["path"]: (r["shape"], r["message"]) for r in png.decode_images(df).collect()}
    assert got.pop("good") == ([2, 2, 3], None) and len(got) == len(bad) - 1 and all(s is None and m for s, m in got.values())
    assert png.decode_images(df.limit(0)).count() == 0


def test_forecasts_of_many_points(spark, tmp_path):
    """Stored answers in one and several files, an error, text that is no JSON, an empty folder, and a point that lacks."""
    good = '{"response": {"body": {"items": {"item": [{"fcstDate": "d", "fcstTime": "t", "category": "PCP", "fcstValue": "3.5mm"}]}}}}'
    stored = {(60, 121): [good[:40], good[40:]], (61, 121): ['{"response":{"header":{"resultCode":"03","resultMsg":"NO DATA"}}}'], (60, 122): ["<html>"], (61, 122): []}
    for (x, y), texts in stored.items():
        place = tmp_path / "base_date=20240501" / "base_time=0200" / f"nx={x}" / f"ny={y}"
        place.mkdir(parents=True)
        for i, text in enumerate(texts):
            (place / f"part-{i}").write_text(text)
        (place / "_SUCCESS").write_text("")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        rows = weather.forecasts(spark, path=path, slots="20240501T0200,20240501T0200", nx="60-61", ny="121,122-123")
        got = {(r["nx"], r["ny"]): (r["available"], r["rain_mm"], r["fcst"], r["reason"]) for r in rows.collect()}
        assert len(got) == rows.count() == 6
        assert got[60, 121] == (True, 3.5, "d t", None) and got[61, 121] == (False, None, None, fixed.BAD_ANSWER + "03 NO DATA")
        assert got[60, 122][3] == "the request failed: the answer is no JSON"
        assert {got[k] for k in ((61, 122), (60, 123), (61, 123))} == {(False, None, None, "no answer is stored")}


def test_forecast_partitions_and_options(spark):
    forecasts.register(spark)
    asked = spark.read.format("forecast").options(slots="20240501T0200,20240501T0500", nx="60-62", ny="1").load()
    assert asked.rdd.getNumPartitions() == 6 and {r["reason"] for r in asked.collect()} == {"no service key"}
    assert weather.forecasts(spark, slots="20240501T0200").first()["reason"] == "no service key"
    assert "the request failed" in weather.forecasts(spark, slots="20240501T0200", key="k", timeout=0.01, tries=2).first()["reason"]
    assert weather.forecasts(spark).count() == 0
    assert forecasts.numbers("3-5, 1,4") == [1, 3, 4, 5]
    with pytest.raises(ValueError):
        forecasts.numbers("5-3")
    with pytest.raises(ValueError):
        forecasts.ForecastReader({"slots": "20240501"})


def stored(path):
    """Files that a reader sees: nothing below hidden folders."""
    return sorted(p for p in path.rglob("*.png") if not any(part.startswith((".", "_")) for part in p.relative_to(path).parts))


def test_images_are_saved_by_content(spark, tmp_path):
    rows = [(i, None if i % 10 == 9 else bytes([i % 7]) * 50, i) for i in range(60)]
    frame = spark.createDataFrame(rows, "image_id long, content binary, name long").repartition(4)
    for path in (f"{tmp_path}/a", f"file://{tmp_path}/b"):
        names = {r["image_id"]: r["name"] for r in image_files.save(frame, path).collect()}
        assert names == {i: c and hashlib.sha256(c).hexdigest() + ".png" for i, c, _ in rows}
    for folder in ("a", "b"):
        files = stored(tmp_path / folder)
        assert {f.name for f in files} == {n for n in names.values() if n} and len(files) == 7
        assert all(hashlib.sha256(f.read_bytes()).hexdigest() == f.stem for f in files)
    image_files.save(frame.filter("image_id < 2"), f"{tmp_path}/a")
    assert len(stored(tmp_path / "a")) == 9 and len(stored(tmp_path / "b")) == 7  # a second write is one more job
    assert image_files.save(frame.limit(0), f"{tmp_path}/c").count() == 0 and not stored(tmp_path / "c")


def test_a_failing_task_leaves_no_images(spark, tmp_path):
    """One task of four fails after the others wrote: nothing is visible, and nothing hidden stays."""
    image_files.register(spark)

    def run(batches):
        for b in batches:
            if (b["image_id"] == 39).any():
                time.sleep(2)
                raise RuntimeError("a damaged image")
            yield b

    rows = spark.range(40).select(F.col("id").alias("image_id"), F.encode(F.col("id").cast("string"), "utf-8").alias("content")).repartitionByRange(4, "image_id")
    target = tmp_path / "out"
    with pytest.raises(Exception, match="a damaged image"):
        rows.mapInPandas(run, rows.schema).write.format("image_files").mode("append").option("path", str(target)).save()
    assert not [p for p in target.rglob("*") if p.is_file()] and not stored(target)
    rows.write.format("image_files").mode("append").option("path", str(target)).save()
    assert len(stored(target)) == 40
    with pytest.raises(Exception, match="only appended"):
        rows.write.format("image_files").mode("overwrite").option("path", str(target)).save()


def test_only_counted_attempts_are_committed(tmp_path):
    """Folders of attempts that Spark doesn't count, as of a lost executor, go with the commit."""
    writer = image_files.ImageWriter(str(tmp_path), "content", ".png")
    first, again, empty = (writer.write(iter(rows)) for rows in ([{"content": b"a"}], [{"content": b"a"}], [{"content": None}]))
    writer.commit([again, None, empty])
    assert [p.parent.name for p in stored(tmp_path)] == [again.folder] != [first.folder] and (again.files, again.size) == (1, 1)
    writer.abort([])
    assert len(stored(tmp_path)) == 1


def test_saved_images_are_read_by_tasks(spark, tmp_path, monkeypatch):
    """Files in several folders of an attempt come back; the driver lists folders, not files."""
    monkeypatch.setattr(image_files, "FILES", 3)
    writer = image_files.ImageWriter(str(tmp_path), "content", ".png")
    attempt = writer.write({"content": bytes([i])} for i in range(10))
    writer.commit([attempt])
    other = image_files.ImageWriter(str(tmp_path), "content", ".png")
    other.commit([other.write(iter([{"content": b"abc"}]))])
    assert len({p.parent for p in stored(tmp_path)}) == 5 and attempt.files == 10
    hidden = image_files.ImageWriter(str(tmp_path), "content", ".png")
    hidden.write(iter([{"content": b"not committed"}]))
    for path in (str(tmp_path), f"file://{tmp_path}/"):
        read = image_files.read(spark, path)
        got = {r["name"]: bytes(r["content"]) for r in read.collect()}
        assert got == {hashlib.sha256(c).hexdigest() + ".png": c for c in [*(bytes([i]) for i in range(10)), b"abc"]}
        assert not read.inputFiles()
    assert image_files.read(spark, f"{tmp_path}/none").count() == 0


def test_images_of_one_size_are_decoded_together(spark):
    """Rows of any filters side by side, one image with an unknown one, and in time: one by one, 20,000 images took some 20 s."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 4):
        for depth in (8, 16):
            images = rng.integers(0, 256, (40, 6, 5, n), dtype=np.uint8)
            made = [png.encode(x, list(rng.integers(0, 5, 6)), depth) for x in images]
            assert all((a == b).all() for a, b in zip(png.decode_all(made), images, strict=True))
    small = [_png(5, 2, 1, 0, b"\0\xa8\0\x50")] * 20 + [_png(5, 2, 1, 0, b"\0\xa8\7\x50"), b"", _png(3, 1, 2, 3, b"\0\x18", _chunk(b"PLTE", bytes(range(9))))]
    got = png.decode_all(small)
    assert got[19][:, :, 0].tolist() == [[255, 0, 255, 0, 255], [0, 255, 0, 255, 0]] and got[20:22] == ["an unknown filter", "not a PNG"] and got[22].tolist() == [[[0, 1, 2], [3, 4, 5], [6, 7, 8]]]
    items = png.encode_all(rng.integers(0, 256, (20_000, 6, 8, 3), dtype=np.uint8), [0, 1, 2, 3, 4])
    start = time.monotonic()
    assert len(png.decode_all(items)) == 20_000 and time.monotonic() - start < 6
    large = struct.pack(">II", 4000, 4000).join([bytes(16), b""])
    assert list(png._stretches([b"", large, large, b"", *[b""] * 2000])) == [slice(0, 1), slice(1, 2), slice(2, 3), slice(3, 1027), slice(1027, 2004)]


def test_saved_images_are_merged(spark, tmp_path, monkeypatch):
    """Nothing that grows with the images is broadcast, however small its files are: only names of very many images, fewer than COMMON."""
    plans = []

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    class Seen(queries.Frozen):
        def __call__(self, df, name):
            plans.append(plan(df))
            return super().__call__(df, name)

    monkeypatch.setattr(queries, "Frozen", Seen)
    monkeypatch.setattr(queries, "COMMON", 10)
    ids = [*range(200), 203, 203]
    orders = spark.createDataFrame([(i,) for i in ids], "o_orderkey long").selectExpr("*", "'1-URGENT' AS o_orderpriority", "timestamp'2024-01-01' AS o_orderdate", "1e0 AS o_totalprice", "'F' AS o_orderstatus")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = queries.saved_images(spark, str(tmp_path))
    plans.append(plan(got))
    value = {i: 1000 if i % 5 < 2 else i for i in ids}
    copies = Counter(value[i] for i in ids)
    assert sorted(map(tuple, got.collect())) == sorted((i, value[i], 96, copies[value[i]]) for i in ids)
    assert [[p.count(x) for x in ("BroadcastExchange", "SortMergeJoin")] for p in plans] == [[0, 1], [0, 1], [2, 1]]
