"""Map files: hand-built bytes in, pixel tables out."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.fixtures import fits_bytes
from skymap.operators.masks import mask_from_pixels
from skymap.sources import blocks, fits, manifest


def _write(path, rows, forms, names, **keys):
    path.write_bytes(fits_bytes(rows, forms, names, **keys))


def _columns(spark, folder):
    return fits.describe_maps(fits.list_files(spark, str(folder)))


def test_sparse_fixture(spark, tmp_path):
    """Pixels 0, 3, 6, 9 of an nside-1 map; a repeated and two foreign rows."""
    rows = np.array(
        [(3, 99.0), (0, 1.0), (3, 2.0), (6, 3.0), (9, 4.0), (-1, 7.0), (12, 8.0)], dtype=[("p", ">i4"), ("v", ">f8")]
    )
    _write(tmp_path / "s.fits", rows, ["J", "D"], ["PIXEL", "SIGNAL"], NSIDE=1, ORDERING="RING", INDXSCHM="EXPLICIT")
    columns = _columns(spark, tmp_path)
    got = {r.pix: r.value for r in fits.read_maps(columns, [0]).collect()}
    assert got == {0: 1.0, 3: 2.0, 6: 3.0, 9: 4.0}
    meta = fits.map_metadata(columns).collect()
    assert len(meta) == 1 and (meta[0].nside, meta[0].indxschm, meta[0].col, meta[0].coord) == (1, "EXPLICIT", 0, "G")


def test_dense_blocks(spark, tmp_path):
    """A file cut into many row blocks gives the pixels in order."""
    n = 16
    rows = np.zeros(48, dtype=[("a", ">i2", 3), ("v", ">f4", 64), ("w", ">f8", 64)])
    rows["v"] = np.arange(3072, dtype="f4").reshape(48, 64)
    rows["w"] = -np.arange(3072).reshape(48, 64)
    _write(tmp_path / "d.fits", rows, ["3I", "64E", "64D"], ["A", "V", "W"], NSIDE=n, ORDERING="NESTED", COORDSYS="C")
    columns = _columns(spark, tmp_path)
    got = fits.read_blocks(columns, [1, 2], block_bytes=3000).toPandas()
    assert got.map_id.nunique() == 2
    for _, part in got.groupby("map_id"):
        part = part.sort_values("pix")
        assert list(part.pix) == list(range(3072)) and np.array_equal(np.abs(part.value), np.arange(3072.0))
    assert fits.map_metadata(columns).first().coord == "C"


def test_unsupported_type_fails(spark, tmp_path):
    _write(tmp_path / "x.fits", np.zeros(12, dtype=[("v", ">i2")]), ["I"], ["V"], NSIDE=1)
    with pytest.raises(Exception, match="unsupported column type"):
        fits.read_maps(_columns(spark, tmp_path), [0]).collect()


def test_mask_size_is_checked(spark, tmp_path):
    (tmp_path / "ok").mkdir(), (tmp_path / "bad").mkdir()
    for name, size in (("ok", 48), ("bad", 50)):
        rows = np.zeros(size, dtype=[("v", ">f4")])
        rows["v"][::2] = 1.0
        _write(tmp_path / name / "m.fits", rows, ["E"], ["V"], NSIDE=2)
    load = lambda c: mask_from_pixels(fits.read_maps(c, [0]), fits.map_metadata(c))
    good = load(_columns(spark, tmp_path / "ok"))
    assert good.filter("valid").count() == 24 and good.first().nside == 2
    with pytest.raises(Exception, match="invalid mask size"):
        load(_columns(spark, tmp_path / "bad")).collect()


def test_incremental(spark, tmp_path):
    """Unchanged files are skipped; a changed one is read again and replaces the old."""
    src, store = tmp_path / "in", f"file://{tmp_path}/store"
    src.mkdir()
    for name in "ab":
        _write(src / f"{name}.fits", np.ones(12, dtype=[("v", ">f8")]), ["D"], ["V"], NSIDE=1)
    assert manifest.ingest_incremental(spark, str(src), store).count() == 2
    assert manifest.ingest_incremental(spark, str(src), store).count() == 0
    _write(src / "a.fits", np.full(12, 5.0).astype([("v", ">f8")]), ["D"], ["V"], NSIDE=1)
    os.utime(src / "a.fits", (2_000_000_000, 2_000_000_000))
    assert manifest.ingest_incremental(spark, str(src), store).count() == 1
    pixels = manifest.current(spark.read.parquet(f"{store}/pixels"), spark.read.parquet(f"{store}/manifest"))
    assert sorted(r[0] for r in pixels.select("value").distinct().collect()) == [1.0, 5.0]
    assert pixels.count() == 24


def test_headers_of_new_files_only(spark, tmp_path, monkeypatch):
    src, store = tmp_path / "in", f"file://{tmp_path}/store"
    src.mkdir()
    for name in "abc":
        _write(src / f"{name}.fits", np.ones(12, dtype=[("v", ">f8")]), ["D"], ["V"], NSIDE=1)
    first = manifest.headers(spark, str(src), store)
    assert first.count() == 3
    _write(src / "d.fits", np.ones(48, dtype=[("v", ">f8")]), ["D"], ["V"], NSIDE=2)
    asked = []
    plain = manifest.describe_maps

    def counted(files):
        asked.append(files.count())
        return plain(files)

    monkeypatch.setattr(manifest, "describe_maps", counted)
    again = manifest.headers(spark, str(src), store)
    assert asked == [1] and again.count() == 4
    assert again.select("file_no").distinct().count() == 4
    assert manifest.headers(spark, str(src), store).count() == 4 and asked == [1, 0]
    (src / "a.fits").unlink()
    assert manifest.headers(spark, str(src), store).count() == 3


def test_stored_pixels_are_sorted(spark, tmp_path):
    src, store = tmp_path / "in", f"file://{tmp_path}/store"
    src.mkdir()
    rows = np.zeros(3072, dtype=[("v", ">f8")])
    _write(src / "a.fits", rows, ["D"], ["V"], NSIDE=16)
    manifest.ingest_incremental(spark, str(src), store)
    import pyarrow.parquet as pq

    for file in (tmp_path / "store" / "pixels").rglob("*.parquet"):
        pix = pq.read_table(file, columns=["pix"]).column(0).to_numpy()
        assert (np.diff(pix) > 0).all()


def test_store_has_a_folder_a_run(spark, tmp_path):
    """Folders and files of the store follow runs and tasks, not the number of maps."""
    src, store = tmp_path / "in", f"file://{tmp_path}/store"
    src.mkdir()
    for i in range(40):
        _write(src / f"m{i:02d}.fits", np.full(12, float(i)).astype([("v", ">f8")]), ["D"], ["V"], NSIDE=1)
    assert manifest.ingest_incremental(spark, str(src), store).count() == 40
    assert manifest.ingest_incremental(spark, str(src), store).count() == 0
    folder = tmp_path / "store" / "pixels"
    assert len([f for f in folder.iterdir() if f.is_dir()]) == 1
    assert len(list(folder.rglob("*.parquet"))) < 40
    pixels = manifest.current(spark.read.parquet(f"{store}/pixels"), spark.read.parquet(f"{store}/manifest"))
    assert sorted((r.pix, r.value) for r in pixels.collect()) == [(p, float(v)) for p in range(12) for v in range(40)]


def test_lost_job_is_repeated(spark, tmp_path, monkeypatch):
    """A job lost after its pixels, and one lost after its sketches: repeated, every pixel and map counts once."""
    src, store = tmp_path / "in", f"file://{tmp_path}/store"
    src.mkdir()
    for name in "ab":
        _write(src / f"{name}.fits", np.arange(12.0).astype([("v", ">f8")]), ["D"], ["V"], NSIDE=1)

    class Lost(Exception):
        pass

    def lost(*_):
        raise Lost

    plain = manifest.sketch_maps
    monkeypatch.setattr(manifest, "sketch_maps", lost)
    with pytest.raises(Lost):
        manifest.ingest_incremental(spark, str(src), store)
    monkeypatch.setattr(manifest, "sketch_maps", plain)
    assert manifest.ingest_incremental(spark, str(src), store).count() == 2
    (run,) = spark.read.parquet(f"{store}/manifest").select("run").distinct().first()
    # Sketches and pixels of a run that never came to the manifest.
    for part in ("pixels", "sketches"):
        rows = spark.read.parquet(f"{store}/{part}").filter(F.col("run") == run).withColumn("run", F.lit("r0"))
        rows = spark.createDataFrame(rows.collect(), rows.schema)
        if part == "pixels":
            rows.drop("run").write.parquet(f"{store}/pixels/run=r0")
        else:
            rows.write.mode("append").parquet(f"{store}/sketches")
    pixels = manifest.current(spark.read.parquet(f"{store}/pixels"), spark.read.parquet(f"{store}/manifest"))
    assert pixels.count() == 24 and pixels.select("map_id", "pix").distinct().count() == 24
    assert [(r.minv, r.maxv) for r in manifest.stored_limits(spark, store, "histogram").collect()] == [(0.0, 11.0)] * 2


def test_store_of_the_earlier_layout_fails(spark, tmp_path):
    src, store = tmp_path / "in", f"file://{tmp_path}/store"
    src.mkdir()
    spark.sql("select 'a' source, 0 col, timestamp'2026-01-01' mtime, 'a@1' version").write.parquet(f"{store}/manifest")
    with pytest.raises(ValueError, match="ingest into a new store"):
        manifest.ingest_incremental(spark, str(src), store)


def test_long_path_and_three_columns(spark, tmp_path, monkeypatch):
    """A path of over 200 characters; bytes of a row are read once for all columns."""
    folder = tmp_path / ("x" * 120) / ("y" * 120)
    folder.mkdir(parents=True)
    n = 64
    npix = 12 * n * n
    rows = np.zeros(npix // 1024, dtype=[("a", ">f4", 1024), ("b", ">f8", 1024), ("c", ">i4", 1024)])
    for name in "abc":
        rows[name] = np.arange(npix).reshape(-1, 1024)
    _write(folder / "m.fits", rows, ["1024E", "1024D", "1024J"], ["A", "B", "C"], NSIDE=n, ORDERING="RING")
    columns = _columns(spark, folder)
    got = fits.read_maps(columns, [0, 1, 2])
    found = got.groupBy("map_id").agg(F.count("*"), F.sum(F.abs(F.col("pix") - F.col("value"))), F.max("pix")).collect()
    assert len(found) == 3 and all(tuple(r)[1:] == (npix, 0.0, npix - 1) for r in found)
    (block,) = [r.asDict(recursive=True) for r in fits.block_table(columns, [0, 1, 2]).collect()]
    read, opened = [], blocks.open_file

    class Counted:
        def __init__(self, path):
            self.handle = opened(path)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.handle.close()

        def seek(self, at):
            self.handle.seek(at)

        def read(self, size):
            read.append(size)
            return self.handle.read(size)

    monkeypatch.setattr(blocks, "open_file", Counted)
    batches = list(blocks.decode(block))
    assert sum(read) == rows.nbytes and sum(b.num_rows for b in batches) == 3 * npix
    assert max(b.num_rows for b in batches) <= blocks.SLICE_ROWS
    read.clear()
    part = list(blocks.decode(block, 2000, 2100))
    assert sum(read) == 2 * rows.itemsize and sum(b.num_rows for b in part) == 3 * 101


def test_wide_rows_are_sliced():
    """One file row that holds all pixels."""
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        path = f"{folder}/w.bin"
        np.arange(300_000, dtype=">f8").tofile(path)
        column = {"value_col": 0, "tform": "300000D", "type": "D", "repeat": 300_000, "col_offset": 0}
        block = {
            "file_no": 1, "path": path, "row_bytes": 2_400_000, "data_start": 0, "first_row": 0, "rows": 1,
            "explicit": False, "nside": 0, "index_type": None, "index_offset": None, "columns": [column],
        }
        batches = list(blocks.decode(block))
    assert [b.num_rows for b in batches] == [100_000] * 3
    assert batches[2].column(3)[0].as_py() == 200_000


def test_pixel_ranges(spark, tmp_path):
    """A range, given or pushed, reads the same rows as a filter."""
    rows = np.zeros(48, dtype=[("v", ">f4", 64)])
    rows["v"] = np.arange(3072, dtype="f4").reshape(48, 64)
    _write(tmp_path / "d.fits", rows, ["64E"], ["V"], NSIDE=16, ORDERING="NESTED")
    sparse = np.array([(3, 99.0), (0, 1.0), (3, 2.0), (2000, 3.0)], dtype=[("p", ">i4"), ("v", ">f8")])
    _write(tmp_path / "s.fits", sparse, ["J", "D"], ["P", "V"], NSIDE=16, ORDERING="RING", INDXSCHM="EXPLICIT")
    columns = _columns(spark, tmp_path)
    want = sorted((r.pix, r.value) for r in fits.read_maps(columns).collect() if 3 <= r.pix < 300)
    got = fits.read_maps(columns, pix_range=(3, 300)).collect()
    assert sorted((r.pix, r.value) for r in got) == want and len(want) == 298
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        pushed = fits.read_maps(columns).filter("pix >= 3 and pix < 300")
        assert sorted((r.pix, r.value) for r in pushed.collect()) == want
    finally:
        spark.conf.set(key, before)


def test_unknown_ordering_fails(spark, tmp_path):
    _write(tmp_path / "o.fits", np.ones(12, dtype=[("v", ">f8")]), ["D"], ["V"], NSIDE=1, ORDERING="SPIRAL")
    with pytest.raises(Exception, match="unknown ordering SPIRAL"):
        fits.map_metadata(_columns(spark, tmp_path)).collect()
