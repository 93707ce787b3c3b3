"""The source of small annotation files: tasks by bytes, pushed filters, ranges of long files, replaced files."""

import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from gaugeline.sources import scans
from gaugeline.sources.annotation_files import TASK_BYTES, AnnotationReader, Pack, Piece, deal, lines_of, lines_of_whole, pack, read_files, write_files


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("annotations")
    for i in range(600):
        folder = root / f"cam{i % 3}" / ("day" if i % 2 else "night/deep")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.{'txt' if i % 5 else 'JPG'}").write_text(f"0 0.5 0.5 0.1 0.1\n\n0 0.{i} 0.2 0.1 0.1 0.9")
    (root / "_SUCCESS").write_text("")
    (root / "cam0" / ".hidden.txt").write_text("no")
    (root / "cam1" / "empty.txt").write_text("")
    (root / "cam2" / "bytes.txt").write_bytes(b"caf\xe9\r\nlast")
    return str(root)


def scan_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_tasks_follow_bytes(spark, tree):
    whole, small = read_files(spark, tree, "text"), read_files(spark, tree, "text", taskBytes=1 << 20, openBytes=64 << 10)
    assert whole.count() == small.count() == 602
    # 602 files of 64 KiB and some bytes: fifteen in a task of one MiB
    assert whole.rdd.getNumPartitions() == 2 and small.rdd.getNumPartitions() == 41


def test_filters_on_paths_are_pushed(spark, tree):
    rows = read_files(spark, tree, "listing").filter((F.col("camera") == "cam1") & F.col("suffix").isin("jpg", "png") & F.col("rel_path").startswith("cam1/day") & (F.col("length") > 3))
    want = {f"cam1/day/{i}.JPG" for i in range(600) if i % 3 == 1 and i % 2 and i % 5 == 0}
    plan = scan_of(rows)
    assert {r["rel_path"] for r in rows.collect()} == want
    assert "EqualTo(camera,cam1)" in plan and "In(suffix, [jpg,png])" in plan and "StringStartsWith(rel_path,cam1/day)" in plan
    condition = plan.split("Condition : ")[1].splitlines()[0]
    assert "length" in condition and not any(column in condition for column in ("camera", "suffix", "rel_path"))  # Spark is left with the length


def test_other_filters_stay_with_spark(spark, tree):
    rows = read_files(spark, tree, "listing").filter((F.col("camera") != "cam0") & (F.col("suffix") == "jpg"))
    assert rows.count() == sum(1 for i in range(600) if i % 3 and i % 5 == 0)


def test_contents(spark, tree):
    lines = read_files(spark, tree, "lines")
    assert [r["value"] for r in lines.filter("rel_path = 'cam2/bytes.txt'").collect()] == ["caf�", "last"]
    assert [r["value"] for r in lines.filter("rel_path = 'cam0/night/deep/6.txt'").collect()] == ["0 0.5 0.5 0.1 0.1", "", "0 0.6 0.2 0.1 0.1 0.9"]
    assert lines.filter("rel_path = 'cam1/empty.txt'").count() == 0 and read_files(spark, tree, "text").filter("rel_path = 'cam1/empty.txt'").first()["value"] == ""
    listed = read_files(spark, "file://" + tree, "listing").filter("rel_path = 'cam1/empty.txt'").first()
    assert listed["value"] is None and listed["length"] == 0 and listed["modified"] is not None


@pytest.mark.parametrize("seed", range(30))
def test_every_line_is_in_one_range(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr("gaugeline.sources.annotation_files.READ_BYTES", rng.choice([1, 3, 7, 64]))
    data = "".join(rng.choice(["a", "b\n", "\n", "\r\n", "word ", "x" * 40]) for _ in range(rng.randrange(60))).encode()
    want = [line.removesuffix(b"\r") for line in data.split(b"\n")]
    want = want[:-1] if data.endswith(b"\n") or not data else want
    size = rng.randrange(1, 30)
    got = [line for s in range(0, len(data), size) for line in lines_of(io.BytesIO(data), s, min(s + size, len(data)))]
    assert got == want


def test_a_long_file_is_many_tasks(spark, tmp_path):
    (tmp_path / "cam").mkdir()
    (tmp_path / "cam" / "long.txt").write_text("\n".join(str(i) for i in range(50_000)))
    rows = read_files(spark, str(tmp_path), "lines", taskBytes=20_000, openBytes=0)
    assert rows.rdd.getNumPartitions() == 15
    assert rows.agg(F.count("value").alias("n"), F.sum(F.col("value").cast("long")).alias("s")).first() == (50_000, sum(range(50_000)))


def test_packs():
    piece = lambda n: Piece(str(n), n, None, 0, n)
    assert [[p.length for p in task.pieces] for task in pack([piece(n) for n in (4, 5, 20, 1, 1)], 10, 0)] == [[4, 5], [20], [1, 1]]
    assert pack([], 10, 1) == [Pack(())]


def test_folders_of_a_wide_level_are_listed_by_tasks(spark, tree):
    own, dealt = AnnotationReader({"path": tree, "kind": "lines"}), AnnotationReader({"path": tree, "kind": "lines", "driverFolders": "2"})
    assert sum(len(task.pieces) for task in own.partitions()) == 602
    assert [task.folders for task in dealt.partitions()] == [("cam0", "cam1", "cam2")] and not dealt.partitions()[0].pieces
    for kind in ("listing", "lines", "text"):
        rows = lambda **options: sorted(map(str, read_files(spark, tree, kind, **options).filter("suffix = 'txt' AND camera <> 'cam1'").collect()))
        assert rows() == rows(driverFolders=2) == rows(driverFolders=0, openBytes=TASK_BYTES)
    one = AnnotationReader({"path": tree, "driverFolders": "2"})
    assert not list(one.pushFilters([EqualTo(("camera",), "cam1")])) and {piece.rel_path[:5] for task in one.partitions() for piece in task.pieces} == {"cam1/"}
    assert [len(task.folders) for task in deal([str(i) for i in range(2000)], 4)] == [15] * 133 + [5] and len(deal(["a"] * 5, 512)) == 1


def test_whole_files_have_the_same_lines():
    for data in (b"", b"a", b"a\n", b"\n", b"a\r\n\r\nb", b"caf\xe9\n\xe2\x82\n\xe2\x82\xac\r\r\n", b"x\ry\n\n"):
        assert lines_of_whole(data) == [line.decode("utf-8", "replace") for line in lines_of(io.BytesIO(data), 0, len(data))]


def test_a_label_line_is_split_once(spark):
    texts = ["0 .1 .2 .3 .4", " 0\t.1 .2 .3 .4 .5 ", "0 1 2 3", "1 .1 .2 .3 .4", "0 .1 x .3 .4", "", "0 .1 .2 .3 .4 .5 .6", "0.9 .1 .2 .3 .4 y", None]
    boxes = scans.parse_labels(spark.createDataFrame([(t, "c") for t in texts], "value string, camera string"))
    rows = [tuple(r) for r in boxes.collect()]
    assert boxes.columns == ["camera", "xn", "yn", "wn", "hn", "conf"]
    assert rows == [("c", .1, .2, .3, .4, None), ("c", .1, .2, .3, .4, .5), ("c", .1, .2, .3, .4, None)]
    assert boxes._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_written_files_replace_themselves(spark, tmp_path):
    rows = spark.createDataFrame([("cam/a b/1%.txt", "x\ny"), ("cam/2.txt", None), ("top.txt", "é")], "rel_path string, value string")
    for _ in range(2):
        write_files(spark, rows, str(tmp_path))
    got = {r["rel_path"]: r["value"] for r in read_files(spark, str(tmp_path), "text").collect()}
    assert got == {"cam/a b/1%.txt": "x\ny", "cam/2.txt": "", "top.txt": "é"}
    for bad in ("../up.txt", "/etc/x", "", None):
        with pytest.raises(Exception, match="not a path below the root"):
            write_files(spark, spark.createDataFrame([(bad, "v")], "rel_path string, value string"), str(tmp_path))


def test_nothing_to_read(spark, tmp_path):
    assert read_files(spark, str(tmp_path), "lines").count() == 0
    assert scans.scan_images(spark, str(tmp_path)).count() == scans.scan_boundaries(spark, str(tmp_path)).count() == 0


def test_scans(spark, tree, tmp_path):
    boxes = scans.parse_labels(scans.scan_label_lines(spark, tree)).filter("camera = 'cam2'")
    assert "EqualTo(camera,cam2)" in scan_of(boxes) and boxes.count() == 2 * 200 and boxes.filter("conf = 0.9").count() == 200
    assert scans.scan_images(spark, tree, camera="cam0").count() == 40 and "EqualTo(camera,cam0)" in scan_of(scans.scan_images(spark, tree, camera="cam0"))
    texts = [("s/c/1.json", '{"width": 3,\n "boundary": [[0, 5], [1, 9.5]]}'), ("s/c/2.json", "{broken"), ("s/c/3.json", '{"boundary": [[0, 5]]}'), ("s/c/4.json", None)]
    write_files(spark, spark.createDataFrame(texts, "rel_path string, value string"), str(tmp_path))
    found = scans.scan_boundaries(spark, str(tmp_path)).collect()
    assert [(r["source"], r["camera"], r["width"], r["height"], r["top"], r["bottom"]) for r in found] == [("s", "c", 3, None, 5.0, 9.5)]
