"""Files to measurements: scan, containers, decoding, pixels, failures as rows."""

import numpy as np
import pytest
from helpers import SHOT, jpeg, raw_canon, raw_fuji, raw_panasonic, raw_tiff, smooth, texture, tiff, with_exif, write_png

from sharpsieve.config import RAW, Config, from_dict
from sharpsieve.errors import ConfigError, UnreadableImage
from sharpsieve.functions import pixels
from sharpsieve.plans.run import explain_one, run
from sharpsieve.sources import containers, files, tiff as tiffs
from sharpsieve.sources.bytes import Source


# --- scan


def test_discovery(spark, tmp_path):
    for name in ("b.jpg", "a-b/x.png", "a/b/y.PNG", "notes.txt", ".hidden/z.jpg", "_u.tif"):
        write_png(tmp_path / name, texture(4, 4))

    def listed(root, config):
        return [r.path for r in files.file_table(spark, root, config).orderBy("file_idx").collect()]

    found = [p[len(str(tmp_path)) + 1 :] for p in listed(tmp_path, Config())]
    assert found == [".hidden/z.jpg", "_u.tif", "a/b/y.PNG", "a-b/x.png", "b.jpg"]
    assert len(listed(tmp_path, from_dict({"input": {"recursive": False}}))) == 2
    assert listed(tmp_path, from_dict({"input": {"include_suffixes": ["TXT"]}})) == [str(tmp_path / "notes.txt")]
    assert listed(tmp_path / "notes.txt", Config()) == [str(tmp_path / "notes.txt")]
    assert sorted(listed(f"file://{tmp_path}", Config())) == sorted(f"file://{tmp_path}/{x}" for x in found)
    with pytest.raises(ConfigError):
        listed(tmp_path / "none", Config())


def test_a_wide_and_deep_tree_is_shared_out(spark, tmp_path):
    want = []
    for k in range(90):
        path = tmp_path / f"d{k % 70:02d}" / ("e" * (k % 3)) / f"{k}.jpg"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"")
        want.append(str(path))
    assert sorted(r.path for r in files.list_files(spark, tmp_path, Config()).collect()) == sorted(want)
    units = files._units(files.Store(str(tmp_path)), True)
    assert len(units) >= files.UNITS and any(deep for _, deep in units)


def test_hidden_files_and_odd_names_are_measured(spark, tmp_path):
    for k, name in enumerate((".hidden/z.png", "_u.png", "a b/x+y%20[1]{2}.PNG", "k=v/w.png")):
        write_png(tmp_path / name, texture(seed=k))
    rows = run(spark, tmp_path, Config()).collect()
    assert len(rows) == 4 and all(r.error is None and r.width == 144 for r in rows)


# --- containers


def test_tiff_values_and_both_byte_orders():
    for order in "<>":
        found = list(tiffs.Tiff(Source(tiff([(0x010F, 2, "Acme"), (0x0111, 4, [5, 6, 7]), (0x0112, 3, 6), (0x829A, 5, (1, 0))], order, sub=SHOT))))
        assert len(found) == 2
        flat = tiffs.merged(found)
        assert flat[0x010F] == "Acme" and flat[0x0111] == [5, 6, 7] and tiffs.number(flat[0x829A]) is None
        got = tiffs.capture_fields(flat)
        assert got["iso"] == 400 and got["focal_length"] == 85.0 and got["lens"] == "85mm F1.8" and got["orientation"] == 6


def test_tiff_cycles_and_garbage_end():
    block = bytearray(tiff([(0x0112, 3, 1)]))
    block[-4:] = (8).to_bytes(4, "little")  # the next directory is this one
    assert len(list(tiffs.Tiff(Source(bytes(block))))) == 1
    for bad in (b"", b"II*\0", b"garbage that is long enough", b"II\x2b\0\x08\0\0\0"):
        with pytest.raises(ValueError):
            tiffs.Tiff(Source(bad))
    assert list(tiffs.Tiff(Source(b"II*\0\xff\xff\0\0"))) == [{}]


@pytest.mark.parametrize("suffix", sorted(RAW))
def test_every_raw_suffix_finds_its_largest_preview(suffix):
    image = b"\xff\xd8\xff" + bytes(5000)
    data = {".raf": raw_fuji, ".cr3": raw_canon, ".rw2": raw_panasonic}.get(suffix, raw_tiff)(image)
    layout = containers.read_layout(Source(data))
    got = data[layout.largest.offset : layout.largest.offset + layout.largest.length]
    assert got == image
    assert layout.size == {".raf": (11648, 8736), ".cr3": None, ".rw2": (4008, 3000)}.get(suffix, (6000, 4000))


def test_broken_containers_fail_by_name():
    whole = raw_fuji(b"\xff\xd8\xff" + bytes(100))
    for bad in (b"", whole[:60], b"\0\0\0\x18ftypcrx " + bytes(30), b"nonsense" * 10):
        with pytest.raises(UnreadableImage):
            containers.read_layout(Source(bad))


def test_exif_in_a_jpeg(spark):
    data = with_exif(jpeg(spark, texture()), tiff([(0x0110, 2, "X")], ">", sub=SHOT))
    source = Source(data)
    base = containers.exif_base(source, 0, source.size)
    assert tiffs.capture_fields(tiffs.merged(list(tiffs.Tiff(source, base))))["iso"] == 400
    assert containers.exif_base(Source(jpeg(spark, texture())), 0, 10**6) is None


# --- pixels


def test_orientation_turns_like_the_standard():
    stored = np.arange(6).reshape(2, 3)[..., None]
    seen = {1: [[0, 1, 2], [3, 4, 5]], 2: [[2, 1, 0], [5, 4, 3]], 3: [[5, 4, 3], [2, 1, 0]], 4: [[3, 4, 5], [0, 1, 2]], 5: [[0, 3], [1, 4], [2, 5]], 6: [[3, 0], [4, 1], [5, 2]], 7: [[5, 2], [4, 1], [3, 0]], 8: [[2, 5], [1, 4], [0, 3]]}
    for k, want in seen.items():
        assert pixels.orient(stored, k)[..., 0].tolist() == want


def test_resize_keeps_means_and_matches_blocks():
    values = np.random.default_rng(0).random((12, 18))
    assert np.allclose(pixels.resize(values, 4, 6), values.reshape(4, 3, 6, 3).mean(axis=(1, 3)))
    assert pixels.resize(values, 5, 7).mean() == pytest.approx(values.mean())


def test_sharper_is_higher_and_a_patch_is_found():
    sharp, soft = (pixels.luma(texture(256, 256, blur=b), 1024) for b in (0, 3))
    assert pixels.tile_map(sharp).max() > 3 * pixels.tile_map(soft).max()
    y = soft.copy()
    y[150:200, 40:90] = sharp[150:200, 40:90]
    tiles = pixels.tile_map(y)
    row, col = divmod(int(tiles.argmax()), tiles.shape[1])
    assert 150 / 256 <= (row + 0.5) / tiles.shape[0] <= 200 / 256 and 40 / 256 <= (col + 0.5) / tiles.shape[1] <= 90 / 256


def test_tiles_are_root_mean_squares_of_the_convolution():
    y = np.random.default_rng(0).random((30, 50)).astype(np.float32)
    kernel = -np.ones((3, 3))
    kernel[1, 1] = 8
    conv = np.array([[(y[i : i + 3, j : j + 3] * kernel).sum() for j in range(48)] for i in range(28)])
    tiles = pixels.tile_map(y, 6)
    rows, cols = tiles.shape
    assert (rows, cols) == (4, 6)
    part = conv[7:14, 8:16]
    assert tiles[1, 1] == pytest.approx(np.sqrt((part**2).mean()) * 100, rel=1e-4)


def test_small_flat_and_empty_frames():
    for shape in ((1, 1), (2, 5), (3, 3), (1, 40)):
        y = np.full(shape, 0.5, np.float32)
        assert pixels.tile_map(y).max() < 1e-3 and pixels.structure_tensor(y) == (0.0, 0.0, 0.0)
        assert len(pixels.difference_hash(y)) == 1
    flat = pixels.exposure(np.array([[0.0] * 10 + [1.0] * 10 + [0.5] * 80]))
    assert flat["highlight_clipped"] == flat["shadow_clipped"] == 0.1 and pixels.exposure(np.zeros((0, 4)))["contrast"] == 0


def test_hash_ignores_brightness_and_saliency_finds_the_odd_spot():
    y = pixels.luma(smooth(), 1024)
    a, b = (np.array(pixels.difference_hash(v), np.int64).view(np.uint64) for v in (y, y * 0.9))
    assert int(np.bitwise_count(a ^ b).sum()) <= 4
    assert len(pixels.difference_hash(y, 12)) == 3
    odd = np.full((128, 128), 0.4, np.float32)
    odd[80:104, 16:40] = pixels.luma(texture(24, 24), 1024)
    x, top, w, h = pixels.saliency_box(odd)
    assert x < 0.22 < x + w and top < 0.72 < top + h and w * h < 0.5


# --- runs


def test_a_run_over_a_folder(spark, tmp_path):
    root = tmp_path / "shoot"
    for k in range(3):
        write_png(root / f"{k}.png", smooth(seed=k))
    for name in ("burst-a.png", "burst-b.png"):
        write_png(root / "sub" / name, texture(seed=7, blur=1))
    (root / "broken.jpg").write_bytes(b"this is no picture")
    (root / "cam.jpg").write_bytes(with_exif(jpeg(spark, smooth(seed=9)), tiff([(0x010F, 2, "NIKON CORPORATION"), (0x0110, 2, "NIKON D750"), (0x0112, 3, 6)], sub=SHOT)))
    (root / "dsc.nef").write_bytes(raw_tiff(jpeg(spark, texture(seed=3, blur=1)), orientation=8))
    (root / "cut.cr3").write_bytes(b"\0\0\0\x18ftypcrx ")
    rows = {r.filename: r for r in run(spark, root, Config()).collect()}
    assert len(rows) == 9
    a, b = rows["burst-a.png"], rows["burst-b.png"]
    assert a.group_id == b.group_id and {a.group_rank, b.group_rank} == {0, 1} and a.group_size == 2 and a.rating >= 4 and b.rating == 3
    assert all(rows[f].error and rows[f].rating == 1 and rows[f].group_id is None and rows[f].width == 0 for f in ("broken.jpg", "cut.cr3"))
    assert rows["broken.jpg"].detection.note == "file not analysed" and rows["broken.jpg"].group_size == 1 and rows["broken.jpg"].group_rank == 0
    cam = rows["cam.jpg"]
    assert (cam.width, cam.height) == (96, 144) and cam.capture.camera == "NIKON D750" and cam.capture.reciprocal_margin == pytest.approx(np.log2((1 / 85) / (1 / 500)))
    raw = rows["dsc.nef"]
    assert (raw.width, raw.height) == (4000, 6000) and raw.reasons[0] == "loaded via raw-preview" and raw.error is None
    assert rows["0.png"].detection.source in ("saliency", "none") and "manual unavailable" in rows["0.png"].detection.note
    ids = sorted({r.group_id for r in rows.values() if r.group_id is not None})
    assert ids == list(range(len(ids)))


def test_an_empty_folder_and_one_file(spark, tmp_path):
    assert run(spark, tmp_path, Config()).count() == 0
    path = write_png(tmp_path / "one.png", texture())
    r = explain_one(spark, path, Config()).first()
    assert r.group_rank is None and r.group_size == 1 and r.rating is not None and len(r.tile_map) == 16 and len(r.tile_map[0]) == 24
    (tmp_path / "bad.png").write_bytes(b"x")
    assert explain_one(spark, tmp_path / "bad.png", Config()).first().rating is None


def test_a_hand_drawn_box_counts(spark, tmp_path):
    path = write_png(tmp_path / "in" / "one.png", texture())
    sidecar = tmp_path / "boxes.json"
    sidecar.write_text('{"one.png": {"x": 0.1, "y": 0.1, "w": 0.2, "h": 0.2}, "IN/one.png": {"x": 0.5, "y": 0.5, "w": 0.9, "h": 0.2}}')
    r = run(spark, tmp_path / "in", Config().with_values(subject__sidecar=str(sidecar))).first()
    assert r.detection.source == "manual" and r.detection.box.x == 0.5 and r.detection.box.w == 0.5 and r.sharpness.subject_acutance is not None
    sidecar.write_text("[1]")
    with pytest.raises(ConfigError):
        run(spark, tmp_path / "in", Config().with_values(subject__sidecar=str(sidecar)))
    assert path


def test_hash_sizes_and_time_gaps(spark, tmp_path):
    shot = lambda t: tiff([(0x0110, 2, "X")], sub=[(0x9003, 2, t)])
    image = jpeg(spark, smooth(seed=4))
    for name, t in (("a", "2026:06:06 10:00:00"), ("b", "2026:06:06 10:30:00"), ("c", "2026:06:06 10:30:20"), ("d", "0000:00:00 00:00:00")):
        (tmp_path / f"{name}.jpg").write_bytes(with_exif(image, shot(t)))
    group = lambda **k: [r.group_id for r in run(spark, tmp_path, Config().with_values(**k)).orderBy("file_idx").collect()]
    assert group() == [0, 0, 0, 0] and group(grouping__hash_size=12) == [0, 0, 0, 0] and group(grouping__enabled=False) == [None] * 4
    (tmp_path / "d.jpg").unlink()
    assert group(grouping__max_time_gap_seconds=60) == [0, 1, 1]


def test_only_wanted_figures_are_taken(spark, monkeypatch):
    from sharpsieve.plans import queries

    data = spark.createDataFrame([(k, [x / 100 for x in range(k, k + 64)], k % 10) for k in range(30)], "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(queries, "table", lambda *_: data)
    assert queries.pictures(spark, "").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # whatever files there are
    rows = queries.measured(spark, "", "fingerprint").collect()
    assert len(rows) == 30 and all(r.fingerprint and r.error is None and r.frame_width == 9 and r.tiles is r.salient is r.contrast is r.thumbnail is None for r in rows)
    whole = queries.run_of_pictures(spark, "").collect()
    assert len(whole) == 30 and {r.error is None for r in whole if r.file_idx % 10 != 9} == {True}
