"""Groups, ranks, boxes, joins by path, comparison, sheets, names, writers and commands."""

import json

import duckdb
import numpy as np
import pytest
from helpers import made, smooth, texture, write_png
from pyspark.sql import functions as F

import __spark_entry__ as contract
from sharpsieve import cli
from sharpsieve.config import Config
from sharpsieve.errors import ConfigError
from sharpsieve.functions import boxes, capture, paths, tiles
from sharpsieve.operators import compare, grouping, locate, rating, summary
from sharpsieve.operators.components import components
from sharpsieve.sinks import names, writers
from sharpsieve.sources import files

DATA = "/root/testdata/sf0.001"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


# --- groups and ranks


def unions(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components_against_union_find(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    want = unions({x for e in edges for x in e}, edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and all(want[k] == k for k in want if k not in got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_follow_the_number_of_fingerprints():
    assert grouping.best_bands(100, 0) == 1 and grouping.best_bands(10**9, 10) <= grouping.best_bands(1000, 10)
    for n in (10, 10**4, 10**8):
        for most in (1, 5, 18):
            assert 1 <= grouping.best_bands(n, most) <= most + 1


@pytest.mark.parametrize("most", [0, 3, 10, 18])
def test_hamming_pairs_miss_nothing(spark, most):
    rng = np.random.default_rng(most)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 20)]
    rows = [(k, base[k % 20] ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 8), replace=False))) for k in range(160)] + [(500, base[0]), (501, base[0]), (502, None)]
    got = {(r.a, r.b, r.distance) for r in grouping.hamming_pairs(spark.createDataFrame(rows, "file_idx long, fingerprint long"), most).collect()}
    bits = {k: h & ((1 << 64) - 1) for k, h in rows if h is not None}
    assert got == {(a, b, d) for a in bits for b in bits if a < b and (d := (bits[a] ^ bits[b]).bit_count()) <= most}


def test_groups_are_dense_in_file_order_and_time_counts(spark):
    rows = [(0, 0, 0.0), (1, 255 << 20, 0.0), (2, 7, 50.0), (3, 7 << 3 | 7, None), (4, None, None), (5, 255 << 20, 9e9)]
    df = spark.createDataFrame(rows, "file_idx long, fingerprint long, t double")
    got = lambda **k: {r.file_idx: r.group_id for r in grouping.group_by_similarity(df, max_distance=3, time_col="t", **k).collect()}
    assert got() == {0: 0, 2: 0, 3: 0, 1: 1, 5: 1}
    assert got(max_gap=60) == {0: 0, 2: 0, 3: 0, 1: 1, 5: 2}
    assert got(max_gap=10) == {0: 0, 1: 1, 2: 2, 3: 2, 5: 3}


@pytest.mark.parametrize("gap", [7.0, 40.0])
def test_groups_with_a_time_gap_against_all_pairs(spark, gap):
    rng = np.random.default_rng(int(gap))
    base = [int(x) for x in rng.integers(0, 1 << 62, 6)]
    rows = [(k, base[int(rng.integers(6))] ^ int(rng.choice([0, 0, 1, 6, 255 << 30])), None if k % 23 == 0 else float(rng.integers(-200, 900)) / 2) for k in range(160)]
    near = lambda a, b: (a[1] ^ b[1]).bit_count() <= 3 and (a[2] is None or b[2] is None or abs(a[2] - b[2]) <= gap)
    roots = unions(range(160), [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a, b)])
    order = {r: k for k, r in enumerate(sorted(set(roots.values())))}
    df = spark.createDataFrame(rows, "file_idx long, fingerprint long, t double")
    got = {r.file_idx: r.group_id for r in grouping.group_by_similarity(df, max_distance=3, max_gap=gap, time_col="t").collect()}
    assert got == {k: order[r] for k, r in roots.items()}


def test_a_hundred_thousand_equal_fingerprints_with_a_time_gap(spark):
    """Copies, one each second, in two runs far apart; a row without a time would join both."""
    df = spark.range(100_000).select(F.col("id").alias("file_idx"), F.lit(12345).cast("long").alias("fingerprint"), (F.col("id") + F.when(F.col("id") >= 60_000, 1e6).otherwise(0.0)).alias("t"))
    got = grouping.group_by_similarity(df, max_distance=10, max_gap=60.0, time_col="t")
    assert {r.group_id: r["count"] for r in got.groupBy("group_id").count().collect()} == {0: 60_000, 1: 40_000}
    joined = df.union(spark.createDataFrame([(200_000, 12345, None)], "file_idx long, fingerprint long, t double"))
    assert grouping.group_by_similarity(joined, max_distance=10, max_gap=60.0, time_col="t").select("group_id").distinct().count() == 1


def test_wide_fingerprints_group_alike(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 3)], None) for k in range(6)]
    rows += [(10 + k, [h[0] ^ 5, h[1], h[2] ^ 1], None) for k, h, _ in rows[:3]]
    df = spark.createDataFrame(rows, "file_idx long, fingerprint array<long>, t double")
    got = {r.file_idx: r.group_id for r in grouping.group_by_similarity(df, max_distance=4, n_bits=192).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 10: 0, 11: 1, 12: 2}


def test_wide_distances_meet_no_more_than_is_close(spark):
    rng = np.random.default_rng(1)
    hashes = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 9000)]  # three blocks
    hashes += [hashes[k] ^ 1 for k in range(5)] + hashes[:5]
    df = spark.createDataFrame(list(enumerate(hashes)), "file_idx long, fingerprint long")
    rows = []
    most = made(spark, lambda: rows.extend(grouping.hamming_pairs(df, 16).collect()))
    h, want = np.array(hashes).view(np.uint64), set()
    for k in range(len(h)):
        gaps = np.bitwise_count(h[k] ^ h[k + 1 :])
        want |= {(k, k + 1 + int(j), int(gaps[j])) for j in np.flatnonzero(gaps <= 16)}
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    assert most < 3 * len(want) + 3 * len(h)  # bands file 100 rows a fingerprint and meet half of all pairs


def test_groups_of_wide_distances_take_trees(spark):
    rng = np.random.default_rng(2)
    centres = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 40)]
    flips = lambda: sum(1 << int(b) for b in rng.choice(62, 6, replace=False))
    hashes = [centres[k % 40] ^ flips() for k in range(5000)] + centres[:3]
    df = spark.createDataFrame([(7 * k % 5003, h) for k, h in enumerate(hashes)], "file_idx long, fingerprint long")
    rows = []
    most = made(spark, lambda: rows.extend(grouping.group_by_similarity(df, max_distance=12).collect()))
    h, left, want = np.array(hashes).view(np.uint64), set(range(5003)), []
    while left:
        part, new = set(), {left.pop()}
        while new:
            part |= new
            near = np.zeros(5003, bool)
            for k in new:
                near |= np.bitwise_count(h[k] ^ h) <= 12
            new = set(np.flatnonzero(near).tolist()) - part
        left -= part
        want.append(sorted(7 * k % 5003 for k in part))
    assert len(want) > 1
    assert {r.file_idx: r.group_id for r in rows} == {i: g for g, part in enumerate(sorted(want)) for i in part}
    assert most < 10 * len(hashes)  # of about 310,000 pairs within groups


def test_blocks_where_bands_meet_too_many():
    assert grouping.in_blocks(50_000, 18) and grouping.in_blocks(10**7, 18)
    assert not grouping.in_blocks(50_000, 3) and not grouping.in_blocks(10**6, 4)


def test_ranks(spark):
    rows = [(0, 0, 5.0), (1, 0, 9.0), (2, 0, 9.0), (3, None, 1.0), (4, 0, None), (5, None, None)]
    ranked = rating.rank_in_groups(spark.createDataFrame(rows, "file_idx long, group_id int, s double"), F.col("s")).collect()
    assert {r.file_idx: (r.group_rank, r.group_size) for r in ranked} == {1: (0, 4), 2: (1, 4), 0: (2, 4), 4: (3, 4), 3: (0, 1), 5: (0, 1)}


def test_ids_in_order(spark):
    rows = spark.createDataFrame([(int(x),) for x in np.random.default_rng(0).permutation(5000) * 3], "root long")
    got = {r.root: r.group_id for r in grouping.dense_ids(rows).collect()}
    assert got == {k * 3: k for k in range(5000)}


# --- columns


def test_tiles(spark):
    t = [3.0, 9.0, 1.0, 9.0, 0.0, 2.0]
    col, r, c = F.array(*map(F.lit, t)), F.lit(2), F.lit(3)
    whole, corner = boxes.literal(0, 0, 1, 1), boxes.literal(0.99, 0.99, 0.001, 0.001)
    x, y = tiles.focus_point(col, r, c)
    got = one(
        spark, peak=tiles.peak(col), mean=tiles.mean(col), median=tiles.median(col), share=tiles.sharp_fraction(col), x=x, y=y, inside=tiles.within(col, r, c, corner), out=tiles.outside(col, r, c, corner),
        none=tiles.outside(col, r, c, whole), flat=tiles.sharp_fraction(F.array(F.lit(0.0))), ratio=tiles.ratio(F.lit(9e9), F.lit(2.0)), low=tiles.ratio(F.lit(5.0), F.lit(1.9)), rel=tiles.relative(F.lit(12.0), F.lit(9.0)), dark=tiles.relative(F.lit(1.0), F.lit(0.0)),
    )
    assert got.asDict() == {"peak": 9.0, "mean": 4.0, "median": 2.5, "share": 2 / 6, "x": 0.5, "y": 0.25, "inside": 2.0, "out": 3.0, "none": 0.0, "flat": 0.0, "ratio": 999.0, "low": None, "rel": 1.0, "dark": None}


def test_boxes(spark):
    turned = one(spark, **{f"o{k}": boxes.struct(boxes.reorient(boxes.literal(0.1, 0.2, 0.3, 0.4), F.lit(k))) for k in (0, 1, 3, 6, 8)})
    near = lambda b, *want: np.allclose([b.x, b.y, b.w, b.h], want)
    assert near(turned.o0, 0.1, 0.2, 0.3, 0.4) and near(turned.o3, 0.6, 0.4, 0.3, 0.4) and near(turned.o6, 0.4, 0.1, 0.4, 0.3) and near(turned.o8, 0.2, 0.6, 0.4, 0.3)
    px = one(spark, **boxes.to_pixels(boxes.literal(0.995, -1, 0.5, 0.001), F.lit(100), F.lit(50)))
    assert (px.left, px.top, px.right, px.bottom) == (100, 0, 100, 1)
    face = "array(named_struct('x',0.1D,'y',0.1D,'w',0.2D,'h',0.2D,'score',0.95D,'left_eye',named_struct('x',0.15D,'y',0.15D),'right_eye',named_struct('x',0.25D,'y',0.15D)), named_struct('x',0.5D,'y',0.1D,'w',0.01D,'h',0.9D,'score',0.99D,'left_eye',null,'right_eye',null))"
    got = one(spark, eyes=locate.largest_face(F.expr(face)), plain=locate.largest_face(F.expr(face), prefer_eyes=False), none=locate.largest_face(F.expr(face), least_width=0.3))
    assert got.eyes.confidence == "high" and got.eyes.box.x == pytest.approx(0.115) and got.plain.box.w == 0.2 and got.none is None


def test_capture(spark):
    said = lambda t: capture.epoch(F.lit(t))
    got = one(
        spark, a=said("2026:8:18 1:02:03"), b=said("2026:13:01 00:00:00"), c=said(""), d=said(None), cam=capture.camera(F.lit(" Canon\0"), F.lit("Canon EOS R5")), both=capture.camera(F.lit("FUJIFILM"), F.lit("X-T5")), lone=capture.camera(F.lit(None), F.lit("X")), nothing=capture.camera(F.lit(None), F.lit("  ")),
        m=capture.reciprocal_margin(F.lit(0.002), F.lit(85.0), F.lit(0.0)), zero=capture.reciprocal_margin(F.lit(0.0), F.lit(85.0), F.lit(None)),
    )
    assert (got.a, got.b, got.c, got.d) == (1787014923, None, None, None)
    assert (got.cam, got.both, got.lone, got.nothing, got.zero) == ("Canon EOS R5", "FUJIFILM X-T5", "X", None, None) and got.m == pytest.approx(np.log2(500 / 85))


def test_focus_records(spark):
    rows = [
        {"SourceFile": "a", "AFAreaXPosition": 3000, "AFAreaYPosition": 2000, "AFAreaWidth": 984, "AFAreaHeight": 816, "ExifImageWidth": 6016, "ExifImageHeight": 4016},
        {"SourceFile": "b", "FocusPixel": "10 20", "ImageWidth": 100, "ImageHeight": 100}, {"SourceFile": "c", "AFAreaXPosition": 300, "AFAreaYPosition": 2, "ImageWidth": 100, "ImageHeight": 100}, {"SourceFile": "d", "FocusPixel": "x y", "ImageWidth": 100, "ImageHeight": 0},
    ]
    df = files.focus_table(spark.createDataFrame([(json.dumps(rows),)], "value string"))
    assert [r.SourceFile for r in df.orderBy("idx").collect()] == ["a", "b", "c", "d"]
    got = {r.SourceFile: r.b for r in df.select("SourceFile", boxes.from_focus_record({k: F.col(k) for k in files.FOCUS_FIELDS}).alias("b")).collect()}
    assert got["c"] is None and got["d"] is None and got["b"].x == pytest.approx(0.04) and got["a"].w == pytest.approx(984 / 6016) and got["a"].x == pytest.approx(3000 / 6016 - 984 / 6016 / 2)


# --- joins


def test_joins_by_path(spark):
    frames = spark.createDataFrame([(0, "/L/a/DSC_1.NEF"), (1, "/L/b/DSC_1.NEF"), (2, "/other/DSC_2.nef"), (3, "/x")], "file_idx long, path string")
    records = spark.createDataFrame([("file:///l/A/dsc_1.nef", 9, 0), ("/l/a/DSC_1.nef", 1, 1), ("/L/a/dsc_1.NEF", None, 2), ("C:\\q\\DSC_1.NEF", 2, 3), ("Q/dsc_2.NEF", 3, 4), ("z", None, 5)], "SourceFile string, v int, idx int")
    got = {r.file_idx: r.box for r in locate.join_by_path(frames, records, "v").collect()}
    assert got == {0: 1, 1: None, 2: 3, 3: None}  # the last record of a path that has a value
    entries = spark.createDataFrame([("DSC_1.nef", 7, 0), ("dsc_1.NEF", 1, 1), ("B/dsc_1.NEF", 2, 2), ("other\\DSC_2.nef", 3, 3)], "key string, v int, idx int")
    assert {r.file_idx: r.box for r in locate.join_by_longest_suffix(frames, entries, "v").collect()} == {0: 1, 1: 2, 2: 3, 3: None}


def test_schemes_tell_paths_apart(spark):
    frames = spark.createDataFrame([(0, "http://h/a/x.html"), (1, "https://h/a/x.html"), (2, "FILE:/h/a/x.html"), (3, "/h/a/x.html")], "file_idx long, path string")
    records = spark.createDataFrame([("HTTP://H/A/X.HTML", 1, 0), ("/h/a/x.html", 2, 1)], "SourceFile string, v int, idx int")
    got = {r.file_idx: r.box for r in locate.join_by_path(frames, records, "v", by_name=False).collect()}
    assert got == {0: 1, 1: None, 2: 2, 3: 2}


def test_a_path_that_ends_in_a_slash_has_no_folder_name(spark):
    frames = spark.createDataFrame([(0, "http://h/a/7/"), (1, "http://h/b/7"), (2, "http://h/c/8"), (3, "http://h/c/9/")], "file_idx long, path string")
    records = spark.createDataFrame([("http://h/q/7", 1, 0), ("http://h/q/8/", 2, 1), ("http://h/r/9/", 3, 2)], "SourceFile string, v int, idx int")
    got = {r.file_idx: r.box for r in locate.join_by_path(frames, records, "v").collect()}
    assert got == {0: None, 1: 1, 2: None, 3: None}


def test_comparison(spark):
    ddl = "idx int, path string, filename string, rating int, reasons array<string>"
    a = spark.createDataFrame([(0, "p", "f", 3, []), (1, "p", "f", 2, []), (2, "q", "f", None, []), (3, "", "g", 5, []), (4, "gone", "h", 1, []), (5, "s", "s", 4, [])], ddl)
    b = spark.createDataFrame([(0, "q", "f", 4, ["why"]), (1, "p", "f", 5, ["x"]), (2, "", "g", 1, []), (3, "new", "n", None, []), (4, "s", "s", 4, None)], ddl)
    out = cli.compared(a, b)
    assert out["compared"] == 4 and out["changed"] == 3 and out["only_in_before"] == ["gone"] and out["only_in_after"] == ["new"]
    assert [(c["path"], c["from"], c["to"], c["delta"]) for c in out["changes"]] == [("q", None, 4, 4), ("g", 5, 1, -4), ("p", 2, 5, 3)]
    assert out["movement"] == {"keeper -> reject": 1, "reject -> keeper": 1, "unrated -> keeper": 1}
    assert out["buckets"] == {"before": {"keeper": 2, "middle": 0, "reject": 2, "unrated": 1}, "after": {"keeper": 3, "middle": 0, "reject": 1, "unrated": 1}}
    shown = {r.path: r["name"] for r in compare.shown_names(compare.changes(compare.matched(a, b))).collect()}
    assert shown == {"q": "q", "g": "g", "p": "p"}


def test_sheet(spark):
    rows = [("b.jpg", None, None, 2.0, True, "x", "broken"), ("A.jpg", 4, 0, None, True, "y", None), ("c.jpg", 4, 1, 1.0, False, "y", None), ("d.jpg", 0, None, 3.0, False, "z", None)]
    df = spark.createDataFrame(rows, "filename string, rating int, group_id int, subject_background_ratio double, is_group_best boolean, subject_source string, error string")
    shown = lambda order=(), **k: [r.filename for r in (lambda d: d.orderBy(*order) if order else d)(df.where(summary.sheet_filter(**k))).collect()]
    assert sorted(shown(problems=True)) == ["b.jpg", "d.jpg"] and shown(least=1, best_only=True) == ["A.jpg"] and shown(text="  A.J ") == ["A.jpg"] and shown(source="z") == ["d.jpg"]
    assert shown(summary.sheet_order("rating")) == ["c.jpg", "A.jpg", "d.jpg", "b.jpg"]
    assert shown(summary.sheet_order("rating", False)) == ["b.jpg", "d.jpg", "A.jpg", "c.jpg"]
    assert summary.count_map(summary.counted(df, F.col("subject_source"))).first().counts == {"y": 2, "x": 1, "z": 1}


def test_names(spark):
    rows = [(0, "/l/a/x.nef", "x.nef"), (1, "/l/b/x.nef", "x.nef"), (2, "/l/b/x?.nef", "x?.nef"), (3, "/l/b/x-.nef", "x-.nef"), (4, "/l/b/x*.nef", "?"), (5, "/l/b/x--2.nef", "y")]
    df = spark.createDataFrame(rows, "file_idx long, path string, filename string")
    got = [r.name for r in names.mirrored(df, ".xmp").orderBy("file_idx").collect()]
    assert got[:2] == ["a/x.nef.xmp", "b/x.nef.xmp"] and len(set(got)) == 6 and got[2] == "b/x-.nef.xmp"
    assert [r.name for r in names.indexed(df, ".png").orderBy("file_idx").collect()][:3] == ["00000-x.png", "00001-x.png", "00002-x-.png"]
    plain = one(spark, a=paths.safe_part(F.lit(" .a:b?. ")), b=paths.safe_part(F.lit("...")), c=paths.slug(F.lit("ü b.tar.gz")), d=paths.suffix(F.lit("/a.b/.hidden")))
    assert plain.asDict() == {"a": "a-b-", "b": "frame", "c": "ü-b.tar", "d": ""}


# --- commands and writers


@pytest.fixture(scope="module")
def shoot(tmp_path_factory):
    root = tmp_path_factory.mktemp("lib")
    for k in range(2):
        write_png(root / "in" / f"s{k}.png", smooth(seed=k))
        write_png(root / "in" / "sub" / "<b&>.png", texture(seed=7))
    write_png(root / "in" / "b.png", texture(seed=7))
    (root / "in" / "bad.jpg").write_bytes(b"x")
    return root


def test_run_writes_everything(spark, shoot, capsys):
    out = shoot / "out"
    formats = [x for f in ("json", "csv", "html", "keepers", "rejects", "xmp") for x in ("-f", f)]
    assert cli.main(["run", str(shoot / "in"), "--no-config", "-o", str(out), *formats]) == 0
    told = json.loads((out / "report.json").read_text())
    assert told["summary"]["total"] == 5 and told["summary"]["failed"] == 1 and len(told["photos"]) == 5
    paths_ = [p["path"] for p in told["photos"]]
    assert paths_ == sorted(paths_, key=lambda p: p.split("/"))
    header = (out / "report.csv").read_text().splitlines()[0].split(",")
    assert len(header) == 41 and header[:2] == ["filename", "rating"] and not {"path", "label", "reasons"} & set(header)
    keepers = (out / "keepers.txt").read_text().split("\n")[:-1]
    assert keepers == [p["path"] for p in told["photos"] if (p["rating"] or 0) >= 4 and not p["error"]] and keepers
    assert all(line.count("\t") == 1 for line in (out / "rejects.txt").read_text().splitlines())
    sidecars = sorted(str(p.relative_to(out / "xmp")) for p in (out / "xmp").rglob("*.xmp"))
    assert sidecars == ["b.png.xmp", "s0.png.xmp", "s1.png.xmp", "sub/-b&-.png.xmp"]
    assert (out / "xmp-manifest.txt").read_text() == "written\t4\nkept\t0\n"
    from xml.etree import ElementTree

    one = ElementTree.parse(out / "xmp" / "b.png.xmp").getroot()[0][0]
    said = next(p for p in told["photos"] if p["filename"] == "b.png")
    assert one.get("{http://ns.adobe.com/xap/1.0/}Rating") == str(said["rating"]) and one.get("{urn:sharpsieve:1.0}Reason") == "; ".join(said["reasons"])
    page = (out / "contact-sheet.html").read_text()
    assert page.count("data:image/png;base64,") == 4 and "</script>" in page and page.count("</") < 30
    shown = capsys.readouterr().out
    assert "analysed" in shown and "files_per_second" in shown and "contact-sheet.html" in shown
    assert 'add("box"' in page and 'add("at"' in page and 'add("many"' in page
    again = cli.main(["compare", str(out / "report.json"), str(out / "report.json"), "--json"])
    assert again == 0 and json.loads(capsys.readouterr().out)["changed"] == 0
    assert cli.main(["compare", str(out / "report.json"), str(out / "report.json")]) == 0


def test_writers_spill_and_never_overwrite(spark, shoot):
    from sharpsieve.plans.run import run

    config = Config().with_values(output__self_contained_max_frames=1, output__write_xmp_next_to_originals=True)
    (shoot / "in" / "b.png.xmp").write_text("mine")
    reports = run(spark, shoot / "in", config).persist()
    writers.write_all(reports, ["html", "xmp"], shoot / "out2", config)
    assert len(list((shoot / "out2" / "thumbs").iterdir())) == 4 and "data:image" not in (shoot / "out2" / "contact-sheet.html").read_text()
    assert (shoot / "in" / "b.png.xmp").read_text() == "mine" and "kept\t1" in (shoot / "out2" / "xmp-manifest.txt").read_text()
    writers.write_all(reports, ["xmp"], shoot / "out2", config)  # again: what is its own isn't in the way
    assert "written\t3" in (shoot / "out2" / "xmp-manifest.txt").read_text()
    with pytest.raises(ConfigError):
        writers.write_all(reports, ["pdf"], shoot / "out3", config)
    for kind in ("json", "csv", "parquet"):
        writers.export(reports, str(shoot / f"export-{kind}"), kind)
    assert spark.read.parquet(str(shoot / "export-parquet")).count() == 5
    reports.unpersist()


def test_other_commands(spark, shoot, tmp_path, capsys):
    assert cli.main(["explain", str(shoot / "in" / "b.png"), "--no-config"]) == 0
    shown = capsys.readouterr().out
    assert "sharpness.max_local_acutance" in shown and "remarks" in shown
    with pytest.raises(SystemExit):
        cli.main(["--version"])
    assert "sharpsieve" in capsys.readouterr().out
    assert cli.main(["explain", str(shoot / "in" / "bad.jpg"), "--no-config", "--json"]) == 1
    assert cli.main(["doctor", str(shoot), "--no-config"]) == 0 and cli.main(["fetch-models"]) == 0
    target = tmp_path / "sharpsieve.toml"
    assert cli.main(["init", str(target)]) == 0 and cli.main(["init", str(target)]) == 1 and cli.main(["init", str(target), "--force"]) == 0
    (tmp_path / "empty").mkdir()
    assert cli.main(["run", str(tmp_path / "empty")]) == 1
    target.write_text("[input]\nx = 1\n")
    assert cli.main(["run", str(tmp_path), "-c", str(target)]) == 2
    bad = tmp_path / "x.json"
    bad.write_text("{}")
    assert cli.main(["compare", str(bad), str(bad)]) == 2


# --- the contract


def test_queries_match_sql(spark):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")

    def plain(v):
        return str(float(f"{v:.9g}")) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    from sharpsieve.plans import queries as own

    assert set(own.QUERIES) - set(own.SQL) == {"frame_salience"}
    for name, sql in own.SQL.items():
        found = con.sql(sql)
        columns = sorted(found.columns)
        want = sorted(tuple(plain(dict(zip(found.columns, r, strict=True))[c]) for c in columns) for r in found.fetchall())
        df = own.QUERIES[name](spark, DATA)
        assert sorted(df.columns) == columns, name
        assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want, name
    assert contract.entry(spark).count() > 0
