import io
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.sources import json_files, rasters, scan, sinks
from rasterlake.streaming import manifest_stream

ROOT = Path(__file__).resolve().parent.parent


def filtered_png(image, kind):
    """A PNG whose lines all use one filter."""
    h, w, c = image.shape
    flat = image.reshape(h, w * c).astype(int)
    lines = []
    for y in range(h):
        up = flat[y - 1] if y else np.zeros(w * c, int)
        left = np.concatenate([np.zeros(c, int), flat[y, :-c]])
        corner = np.concatenate([np.zeros(c, int), up[:-c]])
        p = left + up - corner
        near = np.stack([abs(p - left), abs(p - up), abs(p - corner)])
        paeth = np.choose(near.argmin(0), [left, up, corner])
        guess = [0, left, up, (left + up) // 2, paeth][kind]
        lines.append(bytes([kind]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes())
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("channels", (1, 2, 3, 4))
def test_png_filters(kind, channels):
    image = np.random.default_rng(kind).integers(0, 256, (5, 7, channels)).astype(np.uint8)
    assert (rasters.decode_png(filtered_png(image, kind)) == image).all()


def test_png_round_trip_and_gray():
    image = np.random.default_rng(9).integers(0, 256, (4, 6, 3)).astype(np.uint8)
    assert (rasters.decode_png(rasters.encode_png(image)) == image).all()
    gray = rasters.read_gray(rasters.encode_png(np.full((2, 2, 3), 100, np.uint8)))
    assert np.allclose(gray * 255, 100)


def npy(a):
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


def test_decoders_isolate_bad_files(spark):
    good = struct.pack("<II", 2, 3) + np.arange(6, dtype="<f4").tobytes()
    df = spark.createDataFrame([(1, good), (2, good[:-1] + b""), (3, b"x")], "id int, content binary")
    out = {r["id"]: r["r"] for r in df.select("id", rasters.decoded(F.col("content"), "dat").alias("r")).collect()}
    assert out[1]["height"] == 2 and out[1]["width"] == 3 and list(out[1]["data"]) == [0, 1, 2, 3, 4, 5]
    assert out[2]["error"] and out[3]["error"]
    assert rasters.read_npy(npy(np.ones((3, 4, 1)))).shape == (3, 4, 1)
    with pytest.raises(ValueError):
        rasters.read_npy(npy(np.ones((3, 4, 2))))
    with pytest.raises(ValueError):
        rasters.read_exr(b"")


def test_depth_units(spark):
    df = spark.createDataFrame([([1.0, 2.0, -1.0],), ([1000.0, 2000.0, float("nan")],)], "d array<double>")
    out = [list(r[0]) for r in df.select(rasters.depth_in_metres(F.col("d"))).collect()]
    assert out == [[1, 2, None], [1, 2, None]]


def test_scan_prefers_and_lists(spark, tmp_path):
    for name in ("a/1_im.png", "a/Image_1.png", "b/Image_2.png", "b/note.txt", "c/x.JPG"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"" if "x" in p.stem else rasters.encode_png(np.zeros((2, 2))))
    rows = scan.files(spark, str(tmp_path))
    assert sorted(r.path for r in rows.collect()) == ["a/1_im.png", "a/Image_1.png", "b/Image_2.png"]
    assert sorted(r.path for r in scan.preferred_inputs(rows).collect()) == ["a/1_im.png", "b/Image_2.png"]
    assert [r.path for r in scan.preferred_inputs(rows, per_folder=False).collect()] == ["a/1_im.png"]
    assert sorted(r.scene for r in scan.scenes(rows).collect()) == ["a", "b"]
    assert scan.completed(rows).count() == 3 and scan.folders(rows).count() == 2
    assert scan.contents(spark, rows.filter("path = 'a/1_im.png'"), str(tmp_path)).count() == 1
    with pytest.raises(FileNotFoundError):
        scan.with_suffix(rows, "_none.png")
    shape = scan.contents(spark, rows.filter("path = 'a/1_im.png'"), str(tmp_path)).select(rasters.resized(rasters.decoded(F.col("content"), "rgb"), 4, 6).alias("r")).first()["r"]
    assert (shape["height"], shape["width"], shape["channels"]) == (4, 6, 3)


def test_json_reads(spark, tmp_path):
    (tmp_path / "m1.json").write_text('[{"relative_image_path": "a", "v": 1}, {"relative_image_path": "a", "v": 2}, {"v": 3}]')
    (tmp_path / "m2.json").write_text("not json")
    out = json_files.manifest_entries(json_files.texts(spark, str(tmp_path), "*.json")).collect()
    assert len(out) == 1 and '"v":2' in out[0]["entry"].replace(" ", "")
    one = spark.createDataFrame([('{"sample_id": "s", "image_path": "p", "physical_properties": {"albedo": "x", "roughness": 0.5, "metallic": 1}}',)], "text string")
    r = json_files.records(one).first()
    assert r["sample_id"] == "s" and r["metadata"] == {} and r["physical_properties"]["roughness"] == 0.5
    with pytest.raises(Exception, match="required key"):
        json_files.records(spark.createDataFrame([("{}",)], "text string")).collect()
    assert spark.createDataFrame([('{"seed": 1}',)], "t string").select(json_files.missing_config_keys(F.col("t"))).first()[0] == ["dataset", "model", "train", "eval", "output_dir"]
    assert json_files.split_members(spark.createDataFrame([('{"train": ["a", "b"], "val": ["a"]}',)], "text string")).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("mainaxis", 1.0), ("unknown", float("inf"))], "split string, v double")
    sinks.write_summary(df, str(tmp_path / "s"))
    assert sorted(r["v"] or -1 for r in spark.read.json(str(tmp_path / "s")).collect()) == [-1, 1]
    sinks.write_by_split(df, str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "p"), header=True).count() == 1
    sinks.append_lines(df, str(tmp_path / "l"))
    sinks.append_lines(df, str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).count() == 4
    new = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, seq int")
    sinks.rewrite_manifest(None, new, str(tmp_path / "m"), ["k"], "seq")
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [2, 3, 4]


def test_manifest_stream_survives_a_repeated_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, seq int")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = manifest_stream.start(spark.readStream.schema("k string, seq int").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), ["k"], "seq")
        q.awaitTermination(60)
    assert sorted((r.k, r.seq) for r in manifest_stream.manifest(spark, str(tmp_path / "out"), ["k"], "seq").collect()) == [("a", 3), ("b", 2)]


def test_letterbox_and_crop_columns(spark):
    df = spark.createDataFrame([(rasters.encode_png(np.full((4, 8, 3), 51, np.uint8)),), (b"bad",)], "content binary")
    boxed = df.select(rasters.letterboxed(rasters.decoded(F.col("content"), "rgb"), 16, 16).alias("b"))
    out = boxed.select("b.box", rasters.cropped_back(F.col("b.raster"), F.coalesce("b.box", F.array(*[F.lit(0)] * 4)), (16, 16), 4, 8).alias("r")).collect()
    assert list(out[0]["box"]) == [0, 4, 16, 12] and out[0]["r"]["height"] == 4 and np.allclose(out[0]["r"]["data"], 0.2)
    assert out[1]["r"]["error"]


def test_written_files_are_whole_and_written_again(spark, tmp_path):
    import pyarrow as pa

    from rasterlake.sources import files

    root = str(tmp_path / "out")
    batch = lambda names, body: pa.RecordBatch.from_pydict({"path": names, "content": [body] * len(names)})

    def broken():
        yield batch(["a/1.bin", "a/2.bin"], b"old")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        list(files.put_batches(broken(), root, "_attempts/x", True))
    # the task is run again, and once more beside itself
    for _ in range(2):
        list(files.put_batches(iter([batch(["a/1.bin", "a/2.bin"], b"new"), batch(["b/3.bin"], b"new")]), root, "_attempts/x", True))
    found = {p.relative_to(root).as_posix(): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {"a/1.bin": b"new", "a/2.bin": b"new", "b/3.bin": b"new"}
    rows = spark.createDataFrame([("a/1.bin", b"other"), ("c.bin", b"x"), ("empty.bin", None)], "path string, content binary")
    assert files.write_files(rows, root, overwrite=False) == {"files": 1, "bytes": 1, "kept": 1}
    assert (tmp_path / "out/a/1.bin").read_bytes() == b"new" and not (tmp_path / "out/empty.bin").exists()
    assert [p.name for p in (tmp_path / "out/_attempts").iterdir()] == ["x"]  # a job's own folder goes with it
    with pytest.raises(Exception, match="not below"):
        files.write_files(spark.createDataFrame([("../x", b"x")], "path string, content binary"), root)
    with pytest.raises(ValueError, match="viewfs"):
        files.write_files(rows, "viewfs://store/out")


def test_failed_task_is_run_again(tmp_path):
    """A session whose tasks may fail once: the first attempt of each task dies after its first files."""
    import subprocess
    import sys

    program = f'''
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from rasterlake.sources import files
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
def dies(batches):
    for i, b in enumerate(batches):
        if i == 2 and TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("lost")
        yield b
rows = spark.range(100).repartition(3).select(F.format_string("d%d/%d.txt", F.col("id") % 7, "id").alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
done = files.write_files(rows.mapInArrow(dies, rows.schema), {str(tmp_path / "out")!r})
assert done["files"] == 100, done
'''
    subprocess.run([sys.executable, "-c", program], check=True, timeout=300, cwd=ROOT)
    found = {p.name: p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert found == {f"{i}.txt": str(i).encode() for i in range(100)}


def test_only_chosen_files_are_opened(spark, tmp_path):
    from rasterlake.sources import scan

    for i in range(20):
        (tmp_path / f"{i}.png").write_bytes(bytes([i]))
    listed = scan.files(spark, f"file://{tmp_path}").cache()
    assert listed.count() == 20
    for i in range(20):
        if i % 5:
            (tmp_path / f"{i}.png").unlink()  # a read of it would fail
    chosen = listed.filter(F.regexp_extract("path", r"(\d+)", 1).cast("int") % 5 == 0)
    got = {r.path: r.content for r in scan.contents(spark, chosen, f"file://{tmp_path}").collect()}
    assert got == {f"{i}.png": bytes([i]) for i in range(0, 20, 5)}
    with pytest.raises(Exception, match="No such file|not exist|cannot find"):
        scan.contents(spark, listed, f"file://{tmp_path}").collect()
    assert scan.contents(spark, chosen.limit(0), f"file://{tmp_path}").count() == 0


def test_metrics_files_are_opened_once(spark, tmp_path):
    for i in range(12):
        p = tmp_path / f"g{i % 3}" / f"{i}" / "metrics.json"
        p.parent.mkdir(parents=True)
        text = '{\n"exp_group": "g%d", "run_name": "é%02d",\n "mae": %d}' % (i % 3, i, i)
        p.write_bytes(text.encode("utf-16" if i == 5 else "utf-8-sig" if i == 4 else "utf-8"))
        (p.parent / "other.json").write_text("{}")
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden/metrics.json").write_text('{"exp_group": "no"}')
    found = json_files.metrics(spark, str(tmp_path))
    for p in tmp_path.rglob("metrics.json"):
        p.unlink()  # the schema was found from these bytes; no later pass opens them again
    assert [(r.exp_group, r.run_name, r.mae) for r in found.collect()] == sorted((f"g{i % 3}", f"é{i:02d}", i) for i in range(12))


def test_files_are_made_one_at_a_time(tmp_path):
    """Each is written before the next is made, so a batch of rows costs a task the memory of one file."""
    import pyarrow as pa

    from rasterlake.sources import files

    def make(k):
        assert k == 1 or (tmp_path / f"{(k - 1) % 3}/{k - 1}.bin").stat().st_size == k - 1
        return f"{k % 3}/{k}.bin", b"x" * k

    rows = pa.RecordBatch.from_pydict({"k": list(range(1, 101))})
    done = list(files.make_batches(iter([rows]), make, str(tmp_path), "_attempts/x", True))
    assert [b.to_pylist() for b in done] == [[{"files": 100, "bytes": 5050, "kept": 0}]]


def test_listing_equals_sparks(spark, tmp_path):
    from rasterlake.sources import files

    for name in ("a/b/c/1.png", "a/2.png", "3.png", "_no/4.png", "a/.no/5.png", "a/_6.png", ".7.png", "k=1/8.png", "ä b/9%20#.png", "empty.png"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"" if p.stem == "empty" else b"x" * len(name))
    for recursive in (True, False):
        found = {(r.location, r.length) for r in files.list_files(spark, files.qualified(spark, str(tmp_path)), recursive).collect()}
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "length").collect()
        assert found == {(r.path, r.length) for r in read if recursive or r.path.endswith("/3.png")}
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path / "none"))


def test_folders_are_listed_as_they_are_read(tmp_path, monkeypatch):
    """A task never holds a folder's whole list: what goes after the first batch is not in a later one."""
    import pyarrow as pa

    from rasterlake.sources import files

    for i in range(25):
        (tmp_path / f"{i}.png").write_bytes(b"x" * (i + 1))
    monkeypatch.setattr(files, "LISTED", 10)
    folders = pa.RecordBatch.from_pydict({"location": [f"file://{tmp_path}"]})
    listed = files.list_batches(iter([folders]))
    first = next(listed).to_pylist()
    assert len(first) == 10 and all(int(r["location"].split("/")[-1][:-4]) + 1 == r["length"] and not r["folder"] for r in first)
    for p in set(map(str, tmp_path.iterdir())) - {r["location"].removeprefix("file://") for r in first}:
        (tmp_path / p).unlink()
    assert list(listed) == []


def test_listings_of_local_and_other_systems_agree(tmp_path, monkeypatch):
    import pyarrow as pa
    from pyarrow import fs as pafs

    from rasterlake.sources import files

    (tmp_path / "deep").mkdir()
    for name, size in (("a.png", 3), ("ä b.png", 2), ("empty.png", 0), (".dot.png", 1), ("_no.png", 1), ("k=1.png", 1), ("deep/c.png", 4)):
        (tmp_path / name).write_bytes(b"x" * size)
    for name, to in (("gone.png", "none"), ("link.png", "a.png"), ("folder", "deep")):
        (tmp_path / name).symlink_to(tmp_path / to)
    rows = lambda: sorted((r["location"], r["folder"], r["folder"] or r["length"]) for b in files.list_batches(iter([pa.RecordBatch.from_pydict({"location": [f"file://{tmp_path}"]})])) for r in b.to_pylist())
    local = rows()
    monkeypatch.setattr(files, "filesystem", lambda location: (pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem()), ""))
    assert rows() == local
    assert [(at.split("/")[-1], size) for at, folder, size in local if not folder] == [("a.png", 3), ("k=1.png", 1), ("link.png", 3), ("ä b.png", 2)]
    assert [at.split("/")[-1] for at, folder, _ in local if folder] == ["deep", "folder"]


def table_of_suppliers(spark, folder, n, first=0):
    k = F.col("id") + first
    spark.range(n).select(k.alias("s_suppkey"), F.format_string("Supplier#%010d", k).alias("s_name"), (k % 25).cast("int").alias("s_nationkey")).write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def in_sql(folder, name):
    import duckdb

    from rasterlake.plans.file_queries import ORACLE_SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{folder}/supplier.parquet/*.parquet'")
    return sorted(con.execute(ORACLE_SQL[name]).fetchall())


@pytest.mark.parametrize("name", ["scan_folders", "scan_preferred", "scan_scenes", "scan_preferred_staged", "scan_by_mode", "scan_with_suffix"])
def test_scans_of_names_hold_no_bytes_by_key(spark, tmp_path, name):
    """Of keys that would make files of 2 GB each."""
    from rasterlake.plans.file_queries import QUERIES

    folder = table_of_suppliers(spark, tmp_path, 60, 2_000_000_000)
    assert sorted(map(tuple, QUERIES[name](spark, folder).collect())) == in_sql(folder, name)


def test_contents_that_are_not_matched_hold_no_bytes_by_key(spark, tmp_path):
    """Keys that would make files of 2 GB each, of other extensions than the matched one, besides small ones."""
    from rasterlake.plans.file_queries import QUERIES

    k = F.when(F.col("id") < 60, F.col("id")).otherwise(F.col("id") + 2_000_000_000)
    rows = spark.range(120).select(k.alias("s_suppkey"), F.format_string("Supplier#%010d", k).alias("s_name"), (k % 25).cast("int").alias("s_nationkey"))
    rows.filter("s_suppkey < 60 or s_suppkey % 7 <> 5").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(map(tuple, QUERIES["scan_contents"](spark, str(tmp_path)).collect()))
    assert got == in_sql(tmp_path, "scan_contents") and max(len(r[1]) for r in got) == 55


def test_sized_files_are_there_a_portion_at_a_time(spark, tmp_path, monkeypatch):
    from rasterlake.plans import file_queries

    folder, roots, deleted = table_of_suppliers(spark, tmp_path, 300), [], []
    made, delete = file_queries.made_files, file_queries.delete_folder
    monkeypatch.setattr(file_queries, "PORTION", 20_000)  # of 45150 bytes
    monkeypatch.setattr(file_queries, "made_files", lambda *a: roots.append(made(*a)) or roots[-1])
    monkeypatch.setattr(file_queries, "delete_folder", lambda root: deleted.append((root, len(roots))) or delete(root))
    got = sorted(map(tuple, file_queries.QUERIES["scan_images"](spark, folder).collect()))
    assert got == in_sql(folder, "scan_images") and len(roots) == 3
    assert deleted == [(root, i + 1) for i, root in enumerate(roots[:-1])]  # each goes before the next is made
