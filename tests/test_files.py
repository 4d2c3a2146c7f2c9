import struct
import zlib

import pytest
from pyspark.sql import functions as F

from sugarmill.operators import pictures as ops
from sugarmill.sources import files

COLOURS = [[(1, 2, 3), (255, 255, 255), (250, 128, 0)], [(255, 255, 255), (0, 0, 0), (255, 254, 255)]]  # red, green, blue


def png(lines):
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + b"".join(bytes(p) for p in line) for line in lines)
    head = struct.pack(">IIBBBBB", len(lines[0]), len(lines), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    for name, body in {"one.a.png": png(COLOURS), "two.PNG.txt": b"hello\n\n x \n", "deep/three.png": b"no picture", "deep/plain": b"x", "empty.png": b"", "_SUCCESS": b"x", "four.csv": b"1,2\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    return str(tmp_path)


def test_types(spark, folder):
    rows = lambda *types: {(r.stem, r.type, r.n_bytes) for r in files.folder_files(spark, folder, *types).collect()}
    assert rows("png") == {("one", "png", len(png(COLOURS))), ("three", "png", 10)}
    assert {r[:2] for r in rows("png", "csv")} == {("one", "png"), ("three", "png"), ("four", "csv")}
    assert {r[:2] for r in rows()} == {("one", "png"), ("three", "png"), ("four", "csv"), ("two", "txt"), ("plain", "")}
    assert rows("jpg") == set()


def test_scan_reads_no_content(spark, folder):
    plan = files.folder_files(spark, folder, "png").select("stem", "n_bytes")._jdf.queryExecution().toString()
    assert "content" not in plan.split("== Physical Plan ==")[1].split("ReadSchema")[1]


def test_pixels_of_a_picture(spark, folder):
    pictures = files.folder_pictures(spark, folder, "png").unionByName(files.folder_pictures(spark, f"{folder}/deep", "png", "jpg"))
    assert sorted((r.height, r.width) for r in pictures.collect()) == [(-1, -1), (2, 3)]
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in ops.picture_pixels(pictures, "origin").collect()}
    assert got == {(y, x): c for y, line in enumerate(COLOURS) for x, c in enumerate(line) if c != (255, 255, 255)}
    assert ops.picture_pixels(pictures, "origin", paper=None).count() == 6


@pytest.mark.parametrize("width", [3, 4, 5])
def test_round_trip(spark, tmp_path, width):
    spots = [(7, 0, 0, 1, 2, 3), (7, 1, 2, 10, 128, 255), (7, 1, 2, 10, 128, 255), (8, 0, 0, 0, 0, 0), (8, 0, 99, 1, 1, 1), (8, -1, 0, 1, 1, 1), (9, 5, 5, 1, 1, 1)]
    pixels = spark.createDataFrame(spots, "id long, y int, x int, b int, g int, r int")
    path = str(tmp_path / "out")
    drawn = ops.bitmaps(pixels, "id", width, 2).select(F.concat("id", F.lit(".bmp")).alias("file"), "picture")
    for _ in range(2):  # a second run leaves the same files
        files.write_files(drawn, path, "file", "picture")
    back = ops.picture_pixels(files.folder_pictures(spark, path, "bmp"), "stem").collect()
    assert sorted(map(tuple, back)) == [("7", 0, 0, 1, 2, 3), ("7", 1, 2, 10, 128, 255), ("8", 0, 0, 0, 0, 0)]
    assert files.folder_files(spark, path).count() == 2


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_lines(spark, tmp_path, scheme):
    rows = [("1.a.txt", "0 0.5\n  \n\n"), ("2.txt", None), ("3.txt", "ä\r\nb"), ("4.log", "no")]
    path = f"{scheme}{tmp_path}/out"
    files.write_files(spark.createDataFrame(rows, "name string, content string"), path)
    got = sorted(map(tuple, files.folder_lines(spark, path, "txt").collect()))
    assert got == [("1", ""), ("1", "  "), ("1", "0 0.5"), ("3", "b"), ("3", "ä")]
    assert files.folder_lines(spark, path, "csv").count() == 0


def test_files_of_many_folders_are_listed_by_tasks(spark, tmp_path):
    """The driver plans no file: what is scanned is the listing, whatever the number of files."""
    rows = [(f"{k // 10}/{k}.txt", f"{k}\n") for k in range(40)] + [("3/x.log", "no"), ("_h/9.txt", "no")]
    files.write_files(spark.createDataFrame(rows, "name string, content string"), str(tmp_path))
    found = files.folder_files(spark, str(tmp_path), "txt")
    assert found.count() == 40 and not any("/txt" in f or f.endswith(".txt") for f in found.inputFiles())
    assert sorted(int(r.stem) == int(r.value) and int(r.value) for r in files.folder_lines(spark, str(tmp_path), "txt", deep=True).collect()) == list(range(40))
    assert files.folder_lines(spark, str(tmp_path), "txt").count() == 0
    assert {bytes(r.content) for r in files.folder_contents(spark, str(tmp_path), "log", deep=True).collect()} == {b"no"}


@pytest.mark.parametrize("width", [3, 4, 5])
def test_bitmaps_as_the_picture_source_reads_them(spark, tmp_path, width):
    spots = spark.createDataFrame([(7, 0, 0, 1, 2, 3), (7, 1, 2, 10, 128, 255), (8, 0, 0, 0, 0, 0)], "id long, y int, x int, b int, g int, r int")
    files.write_files(ops.bitmaps(spots, "id", width, 2).select(F.concat("id", F.lit(".bmp")).alias("name"), F.col("picture").alias("content")), str(tmp_path))
    (tmp_path / "9.bmp").write_bytes(b"no picture")
    want = sorted(map(tuple, ops.picture_pixels(files.folder_pictures(spark, str(tmp_path), "bmp"), "stem", paper=None).collect()))
    assert len(want) == 4 * width
    assert sorted(map(tuple, ops.bitmap_pixels(files.folder_contents(spark, str(tmp_path), "bmp"), "stem", paper=None).collect())) == want


def bmp(width, height, colour, bits=24, tail=b""):
    line = (bytes(colour) * width).ljust((3 * width + 3) // 4 * 4, b"\0")
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 54, 40, width, height, 1, bits, 0, 0, 0, 0, 0, 0) + line * abs(height) + tail


def test_files_of_many_kinds_become_pixels_together(spark, monkeypatch):
    """Files in a row with equal headers are read at once, others apart; pictures are painted without texts of their bytes."""
    kinds = [bmp(3, 2, (1, 2, 3)), bmp(3, 2, (4, 5, 6)), bmp(2, 3, (7, 8, 9)), bmp(3, -2, (1, 1, 1)), None, b"", b"BM", bmp(3, 2, (1, 2, 3), bits=8), bmp(3, 2, (9, 9, 9))[:-12], bmp(3, 2, (255, 255, 255)), bmp(3, 2, (3, 2, 1), tail=b"x")]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(kinds * 3)], "id long, content binary").coalesce(1)
    shape = {0: (2, 3), 1: (2, 3), 2: (3, 2), 3: (2, 3), 8: (1, 3), 10: (2, 3)}
    colour = {0: (1, 2, 3), 1: (4, 5, 6), 2: (7, 8, 9), 3: (1, 1, 1), 8: (9, 9, 9), 10: (3, 2, 1)}
    want = sorted((k + 11 * n, y + (k == 8), x, *colour[k]) for n in range(3) for k, (h, w) in shape.items() for y in range(h) for x in range(w))
    for spots in (1_000_000, 5):
        monkeypatch.setattr(ops, "SPOTS", spots)
        assert sorted(map(tuple, ops.bitmap_pixels(rows, "id").collect())) == want
    plan = ops.bitmaps(ops.bitmap_pixels(rows, "id"), "id", 3, 2)._jdf.queryExecution().toString().lower()
    assert "lpad" not in plan and "map_from_entries" not in plan
