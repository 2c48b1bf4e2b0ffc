"""Kernels against the column expressions and against properties of made-up pages."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import encode, kernels, pixels, rules, sink
from quire.plans import jobs
from quire.sources.adapters import raster_gray, raster_rows
from quire.streaming import debounce

SF = "/root/testdata/sf0.001"


def text_page(h=300, w=220, tilt=0.0):
    page = np.full((h, w), 255, np.uint8)
    for y in range(30, h - 30, 14):
        page[y : y + 5, 25 : w - 25] = 20
    return kernels.rotate(page, tilt) if tilt else page


def test_twins_agree(spark):
    r = raster_gray(spark, SF)
    h = pixels.histogram(r)
    got = pixels.paper_level(h).join(pixels.contrast(h), "page").join(pixels.otsu(h), "page").join(pixels.noise(r), "page").join(pixels.unevenness(r), "page")
    by = {str(x["page"]): x for x in got.collect()}
    for x in kernels.pack_raster(raster_rows(spark, SF)).collect():
        g, e = kernels.unpack(x), by[x["doc"]]
        assert (kernels.paper_level(g), kernels.contrast(g)) == (e["paper_level"], e["contrast"])
        assert kernels.otsu(g) == pytest.approx((e["threshold"], e["ink"]))
        assert kernels.noise(g) == pytest.approx(e["noise"]) and kernels.unevenness(g) == pytest.approx(e["unevenness"])


def test_box_mean_and_binarize_twins(spark):
    r = raster_gray(spark, SF)
    page = kernels.unpack(kernels.pack_raster(raster_rows(spark, SF).where("page = 3")).first())
    sums = {(x["y"], x["x"]): x["box_sum"] / x["box_n"] for x in pixels.box_sums(r.where("page = 3"), 4).collect()}
    mean = kernels.box_mean(page, 9)
    assert all(mean[k] == pytest.approx(v) for k, v in sums.items())


def test_background_twin(spark):
    rng = np.random.default_rng(1)
    page = rng.integers(80, 256, (50, 40, 3)).astype(np.uint8)
    rows = [(0, y, x, *map(int, page[y, x])) for y in range(50) for x in range(40)]
    df = spark.createDataFrame(rows, "page int, y int, x int, r int, g int, b int")
    got = np.zeros_like(page)
    for r in pixels.background(df, 0.5).collect():
        got[r["y"], r["x"]] = r["r"], r["g"], r["b"]
    assert np.abs(got.astype(int) - kernels.remove_background(page, 0.5)).max() <= 1


@pytest.mark.parametrize("tilt", [3.0, -1.5, 0.0])
def test_deskew_leaves_little(tilt):
    page = text_page(400, 300, tilt)
    found = kernels.detect_skew(page)
    assert abs(abs(found) - abs(tilt)) < 0.5
    assert abs(kernels.detect_skew(kernels.deskew(page, found))) < 0.5


def test_predictor_round_trip():
    rng = np.random.default_rng(2)
    for shape in ((13, 17), (9, 11, 3)):
        page = (rng.normal(128, 20, shape).clip(0, 255)).astype(np.uint8)
        k = 1 if page.ndim == 2 else 3
        rows = encode.predicted_rows(page, k)
        assert (encode.unpredicted(rows, shape[0], shape[1] * k, k).reshape(shape) == page).all()


def test_clean_page_stays_clean_and_strength_is_monotone():
    clean = np.full((120, 90, 3), 253, np.uint8)
    gray_paper = np.full((120, 90, 3), 225, np.uint8)
    means = [kernels.remove_background(gray_paper, s).mean() for s in (0.0, 0.3, 0.6, 1.0)]
    assert means == sorted(means)
    assert all(kernels.enhance(clean, {"preset": p, "strength": 1.0})[0].min() >= 245 for p in ("color", "contrast", "original"))


def test_warm_paper_becomes_neutral():
    warm = np.zeros((120, 90, 3), np.uint8)
    warm[:] = (209, 201, 173)
    out = kernels.remove_background(warm, 0.5).astype(int)
    assert abs(out[..., 0].mean() - out[..., 2].mean()) < 6


def test_binarize_gradient_and_class():
    page = np.repeat(np.linspace(250, 150, 300)[None, :], 200, axis=0)
    page[40:160:12, 20:280] *= 0.55
    out = kernels.binarize(page.astype(np.uint8))
    dark, lit = (out[:, 150:] < 128).mean(), (out[:, :150] < 128).mean()
    assert 0.4 < dark / lit < 2.5
    red = np.full((100, 80, 3), 255, np.uint8)
    red[20:60, 20:60] = (204, 30, 25)
    assert kernels.page_class(red) == "color" and kernels.page_class(text_page()) == "mono"


def test_guard_keeps_contrast_and_crop():
    page = text_page()
    assert (kernels.guarded(page, np.full_like(page, 128)) == page).all()
    big = np.full((200, 200), 80, np.uint8)
    big[40:160, 50:150] = 255
    out, notes = kernels.enhance(big, {"quad": [(0.25, 0.2), (0.75, 0.2), (0.75, 0.8), (0.25, 0.8)]})
    assert notes[0] == "cropped" and out.mean() > 240


def test_documents_hold_what_their_tables_say(spark):
    pages = [(d, i, 60 + 4 * i, 80, 1, bytes(np.full(80 * (60 + 4 * i), 200, np.uint8))) for d in ("a", "b") for i in range(4)]
    df = spark.createDataFrame(pages, kernels.PAGE)
    lines = F.array(F.struct(F.lit("Größe (1)").alias("text"), *[F.lit(v).alias(c) for c, v in (("x", 0.1), ("y", 0.8), ("w", 0.6), ("h", 0.03))]))
    for r in sink.write_documents(encode.encode_pages(df.withColumn("lines", lines))).collect():
        data = bytes(r["content"])
        start = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
        assert data[start : start + 4] == b"xref"
        entries = data[start:].split(b"\n")[3:]
        n = 8 + 4 * 4
        for k in range(1, n + 1):
            at = int(entries[k - 1][:10])
            assert data[at:].startswith(f"{k} 0 obj\n".encode())
        found = encode.streams(data)
        assert any(encode.text_chars(encode.inflated(s).decode("latin-1")) for s in found)


def test_streams_and_walks():
    raw = b"q (ab\\)c(d)) Tj <00410042> Tj <4> x"
    assert encode.text_chars(raw.decode()) == 5 + 4
    data = b"x stream\r\n" + zlib.compress(b"hello") + b"endstream stream\nendstream stream\nopen"
    assert [encode.inflated(s) for s in encode.streams(data)] == [b"hello"]
    assert encode.framed(zlib.compress(b"z"), b"z") == zlib.compress(b"z")
    deflate = zlib.compressobj(wbits=-15)
    body = deflate.compress(b"abc") + deflate.flush()
    assert zlib.decompress(encode.framed(body, b"abc")) == b"abc"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x10\x03" + b"\x00" * 12
    assert encode.jpeg_components(jpeg) == 3 and encode.jpeg_components(b"no") is None
    for o in "<>":
        import struct

        ifd = struct.pack(o + "H", 2) + struct.pack(o + "HHII", 273, 4, 1, 40) + struct.pack(o + "HHII", 279, 4, 1, 3)
        tiff = (b"II" if o == "<" else b"MM") + struct.pack(o + "HI", 42, 8) + ifd
        assert encode.tiff_strips(tiff.ljust(40, b"\0") + b"xyz") == b"xyz"
    assert encode.visible_text("<head><title>t</title></head><p>a&amp;b</p><script>x</script>c") == "a&bc"


def test_checksums(spark):
    rows = spark.createDataFrame([(b"",), (b"Wikipedia",), (bytes(range(256)),)], "b binary")
    for r in rows.select("b", encode.adler32(F.col("b")).alias("a"), encode.pixel_signature("b").alias("s")).collect():
        assert r["a"] == zlib.adler32(bytes(r["b"])) and r["s"] == encode.signature(bytes(r["b"]))


def test_jobs(spark):
    page = text_page(160, 120, 2.0)
    df = spark.createDataFrame([(d, i, 120, 160, 1, page.tobytes()) for d in ("a", "b") for i in range(2)], kernels.PAGE)
    got = {r["doc"]: r for r in jobs.report(df).collect()}
    assert got["a"]["page_count"] == 2 and got["a"]["deskew"] and got["a"]["preset"] == "bw"
    done = jobs.process(df, {"deskew": True, "preset": "bw"}, selected=spark.createDataFrame([("a", 0), ("b", 1)], "doc string, page_no int")).collect()
    assert len(done) == 2 and all(bytes(r["content"]).count(b"/Subtype /Image") == 1 for r in done)
    assert all(bytes(r["before"]).startswith(b"\x89PNG") for r in jobs.preview(df, {"preset": "contrast"}, 9).collect())
    with pytest.raises(ValueError):
        sink.checked(df, spark.createDataFrame([("a", 1)], "doc string, declared long"))
    assert rules.PLANS[1][0] == "balanced"


def test_release_section(spark):
    from quire.operators.text import release_section

    text = "# Log\n\n## [1.1.0] — now\n\n- a\n- b\n\n[1.1.0]: https://example.org/x\n\n## [1.0.0]\nold\n\n---\nrest"
    assert release_section(text, "v1.1.0", spark).first()["body"] == "- a\n- b"
    assert release_section(text, "1.0.0", spark).first()["body"] == "old"
    assert release_section(text, "9", spark).count() == 0


def test_debounced_stream(spark, tmp_path):
    rows = [("a", "2025-01-01 00:00:00.000", 1), ("a", "2025-01-01 00:00:00.300", 2), ("a", "2025-01-01 00:00:02.000", 3), ("b", "2025-01-01 00:10:00.000", 4)]
    df = spark.createDataFrame(rows, "k string, t string, v int").select("k", F.col("t").cast("timestamp").alias("t"), "v")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = debounce.debounce_stream(stream, "k", "t", "v").writeStream.outputMode("append").format("memory").queryName("quiet").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["k"], r["v"], r["changes"]) for r in spark.table("quiet").collect()}
    assert got == {("a", 2, 2), ("a", 3, 1)}
    batch = {(r["k"], r["v"]) for r in debounce.debounce(df, "k", "t", "v").collect()}
    assert batch == {("a", 2), ("a", 3), ("b", 4)}


def image(data, number=0):
    """The number-th image of a document of ours, and its dictionary."""
    import re

    found = [m for m in re.finditer(rb"<< /Type /XObject /Subtype /Image (.*?)/Length (\d+) >>\nstream\n", data)]
    head, size, at = found[number][1].decode(), int(found[number][2]), found[number].end()
    raw = zlib.decompress(data[at : at + size])
    value = lambda k: int(re.search(rf"/{k} (\d+)", head)[1])
    w, h, bits, colors = value("Width"), value("Height"), value("BitsPerComponent"), 3 if "DeviceRGB" in head else 1
    if bits == 1:
        return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(h, -1), axis=1)[:, :w], head
    page = encode.unpredicted(raw, h, w * colors, colors)
    return (page.reshape(h, w, 3) if colors == 3 else page), head


def red_page():
    page = np.full((90, 70, 3), 250, np.uint8)
    page[20:60, 10:50] = (204, 30, 25)
    page[30:50:4, 12:40] = (10, 60, 25)
    return page


def test_pages_are_written_by_their_mode(spark):
    red, mono = red_page(), text_page(90, 70)
    shade = np.repeat(np.linspace(90, 250, 70)[None, :], 90, axis=0).astype(np.uint8)
    pages = [("c", 0, 70, 90, 3, red.tobytes()), ("g", 0, 70, 90, 1, shade.tobytes()), ("m", 0, 70, 90, 1, mono.tobytes())]
    df = spark.createDataFrame(pages, kernels.PAGE)
    got = {r["doc"]: image(bytes(r["content"])) for r in jobs.process(df, {"preset": "original"}).collect()}
    assert (got["c"][0] == red).all() and "/Predictor 15 /Colors 3" in got["c"][1]
    assert (got["g"][0] == shade).all() and "DeviceGray" in got["g"][1]
    assert (got["m"][0] == (mono > kernels.otsu(mono)[0])).all() and "/BitsPerComponent 1" in got["m"][1]
    for mode, colors in (("gray", 1), ("color", 3), ("mono", 1)):
        spec = {"preset": "original", "compress": {"mode": mode, "adaptive": False, "encoder": "zip"}}
        page, head = image(bytes(jobs.process(df, spec, selected=F.col("doc") == "c").first()["content"]))
        assert ("DeviceRGB" in head) == (colors == 3) and ("/BitsPerComponent 1 " in head) == (mode == "mono")
        if mode == "gray":
            assert (page == kernels.gray(red)).all()
    zipped = encode.encoded(mono, {"encoder": "zip"})
    assert zipped["mode"] == "gray" and zipped["note"] is None and "not available" in encode.encoded(mono, {})["note"]


def test_layers_of_a_noisy_colour_page():
    rng = np.random.default_rng(3)
    page = np.clip(rng.normal(225, 8, (600, 450, 3)), 0, 255).astype(np.uint8)
    page[100:500:20, 60:390] = (15, 10, 40)
    page[20:80, 20:430] = (230, 60, 60)
    got, flat = encode.encoded(page, {}), encode.encoded(page, {"adaptive": False, "mode": "color"})
    assert got["mode"] == "color" and got["mask"] and flat["mask"] is None
    assert len(got["stream"]) + len(got["mask"]) + 4096 < len(flat["stream"])
    assert max(got["ink"]) <= 0.35 and got["back_width"] == 150
    data = sink.assemble([got | {"lines": None}], "layered")
    mask, head = image(data, 1)
    assert "/ImageMask true" in head and mask[100, 200] == 1 and mask[115, 200] == 0
    assert b"/Im1 Do" in data and image(data)[0].shape == (200, 150, 3)
    assert encode.encoded(page, {"encoder": "jp2lossless"})["mask"] is None


def test_reports_and_plans_of_long_documents(spark):
    page = text_page(80, 60, 2.0)
    df = spark.createDataFrame([(d, i, 60, 80, 1, page.tobytes()) for d, n in (("a", 10), ("b", 3)) for i in range(n)], kernels.PAGE)
    got = {r["doc"]: r for r in jobs.report(df).collect()}
    assert got["a"]["page_count"] == 10 and got["a"]["sampled"] == 6 and got["b"]["page_count"] == 3
    # the recommended plan's compression, in place of the one for mono pages
    assert (got["a"]["adaptive"], got["a"]["compress_mode"], got["a"]["quality"]) == (True, "auto", 72)
    odd = df.where("doc = 'b' or page_no % 3 = 0").withColumn("page_no", F.col("page_no") * 5)
    assert {r["doc"]: (r["page_count"], r["sampled"]) for r in jobs.report(odd, sampled=3).collect()} == {"a": (4, 3), "b": (3, 3)}
    assert jobs.report(df.limit(0)).count() == 0


def test_pixels_are_not_shuffled(spark, tmp_path):
    import re

    page = text_page(80, 60)
    spark.createDataFrame([(d, i, 60, 80, 1, page.tobytes()) for d in "ab" for i in range(3)], kernels.PAGE).write.parquet(f"file://{tmp_path}/pages")
    df = spark.read.parquet(f"file://{tmp_path}/pages")
    chosen = spark.createDataFrame([("a", 1)], "doc string, page_no int")
    for out in (jobs.process(df, {"preset": "bw"}), jobs.process(df, {}, selected=chosen), jobs.preview(df, {}, 1)):
        plan = spark._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
        moved = re.findall(r"\) (?:Exchange|BroadcastExchange)\nInput \[\d+\]: \[(.*)\]", plan)
        assert moved and not any("data#" in m for m in moved), plan
    assert [r["doc"] for r in jobs.process(df, {}, selected=chosen).collect()] == ["a"]


def test_sidecars(spark, tmp_path):
    line = lambda t: {"text": t, "x": 0.1, "y": 0.1, "w": 0.1, "h": 0.1}
    rows = [("a", 1, [line("two"), line("")]), ("a", 0, [line("one"), line("more")]), ("b", 0, None), ("c", 0, [line("")])]
    df = spark.createDataFrame(rows, f"doc string, page_no int, lines {encode.LINES}")
    assert [tuple(r) for r in sink.sidecars(df).collect()] == [("a", "one\nmore\ntwo\n")]
    sink.write_sidecars(df, f"file://{tmp_path}/text")
    assert [p.read_text() for p in tmp_path.glob("text/doc=a/*.txt")] == ["one\nmore\ntwo\n"]


#: id, corners, and levels inside and outside of them.
QUADS = [
    (1, 0.16, 0.16, 0.84, 0.16, 0.84, 0.84, 0.16, 0.84, 240.0, 85.0),
    (2, 0.16, 0.16, 0.84, 0.84, 0.84, 0.16, 0.16, 0.84, 240.0, 85.0),
    (3, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0, 240.0, 85.0),
    (4, 0.4, 0.05, 0.6, 0.05, 0.6, 0.95, 0.4, 0.95, 240.0, 85.0),
    (5, 0.02, 0.02, 0.98, 0.02, 0.98, 0.98, 0.02, 0.98, 250.0, 249.0),
    (6, 0.1136, 0.1136, 0.8864, 0.1136, 0.8864, 0.8864, 0.1136, 0.8864, 240.0, 239.0),
    (7, 0.1, 0.1, 0.3, 0.1, 0.3, 0.3, 0.1, 0.3, 240.0, 85.0),
    (8, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 240.0, 85.0),
    (9, 0.2, 0.2, 0.8, 0.25, 0.75, 0.8, 0.25, 0.75, 200.0, None),
]


def test_quads_pass_the_gates_of_the_rules(spark):
    q = spark.createDataFrame(QUADS, "id int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double, inside double, outside double")
    rows = {r["id"]: r for r in q.collect()}
    gates = {r["id"]: r["gate"] for r in rules.crop_gate(q).collect()}
    assert len(gates) == 9
    for i, r in rows.items():
        quad = [(float(r[f"x{k}"]), float(r[f"y{k}"])) for k in range(4)]
        size = 5 if r["outside"] is None else 400
        page = np.full((size, size), float(r["outside"] or 80), np.uint8)
        xs, ys = [x for x, _ in quad], [y for _, y in quad]
        page[int(min(ys) * size) : int(max(ys) * size) + 1, int(min(xs) * size) : int(max(xs) * size) + 1] = float(r["inside"])
        out, notes = kernels.enhance(page, {"quad": quad})
        assert notes[0] == {"applied": "cropped"}.get(gates[i], gates[i])
        assert (out.shape == page.shape) == (gates[i] != "applied")


def test_crop_twins(spark):
    rng = np.random.default_rng(5)
    page = rng.integers(60, 256, (60, 50)).astype(np.uint8)
    page[:1], page[:, -1:] = 90, 120
    df = spark.createDataFrame([(0, y, x, int(page[y, x])) for y in range(60) for x in range(50)], "page int, y int, x int, v int")
    assert tuple(pixels.border_trim(df).select("top", "bottom", "left", "right").first()) == kernels.border(page)
    quads = spark.createDataFrame([(0, 0.2, 0.7, 0.1, 0.9)], "page int, qx0 double, qx1 double, qy0 double, qy1 double")
    r = pixels.boundary_contrast(df, quads).first()
    assert (r["inside"], r["outside"]) == pytest.approx(kernels.boundary(page, [(0.2, 0.1), (0.7, 0.1), (0.7, 0.9), (0.2, 0.9)]))


def test_residue_of_a_turned_page_is_trimmed():
    desk = np.full((300, 240), 60, np.uint8)
    desk[48:252, 38:202] = 252
    quad = [(36 / 240, 46 / 300), (204 / 240, 46 / 300), (204 / 240, 254 / 300), (36 / 240, 254 / 300)]
    out, gate = kernels.crop(desk, quad)
    assert gate == "cropped" and (out < 128).mean() < 0.004


def test_one_pass_report_of_small_and_odd_pages(spark):
    rng = np.random.default_rng(8)
    pages = {0: rng.integers(0, 256, (40, 30)), 1: rng.integers(200, 256, (5, 7)), 2: np.full((1, 3), 255), 3: np.zeros((2, 2), int), 4: rng.integers(0, 2, (30, 26)) * 255}
    rows = spark.createDataFrame([(p, y, [int(v) for v in line]) for p, a in pages.items() for y, line in enumerate(a)], "page int, y int, row array<int>")
    for r in pixels.report(rows).collect():
        g = pages[r["page"]].astype(np.uint8)
        assert (r["paper_level"], r["contrast"], r["threshold"]) == (kernels.paper_level(g), kernels.contrast(g), kernels.otsu(g)[0])
        assert (r["ink"], r["mean"], r["unevenness"]) == pytest.approx((kernels.otsu(g)[1], g.mean(), kernels.unevenness(g)))
        if min(g.shape) > 3:
            assert r["noise"] == pytest.approx(kernels.noise(g))
    flat = rows.select("page", "y", F.posexplode("row").alias("x", "v"))
    for f in (pixels.noise, pixels.unevenness, pixels.laplacian_variance):
        assert {**dict(map(tuple, f(rows).collect()))} == {**dict.fromkeys(f(rows).select("page").toPandas()["page"], 0.0), **dict(map(tuple, f(flat).collect()))}


def test_signatures_of_many():
    rng = np.random.default_rng(9)
    rows = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 5, 300, 1, 5, 0)]
    assert encode.signatures(rows).tolist() == [encode.signature(b) for b in rows] and len(encode.signatures([])) == 0


def test_next_checks(spark):
    from datetime import datetime as d

    attempts = spark.createDataFrame([("a", d(2025, 1, 1, 8), True), ("a", d(2025, 1, 2, 9), False)], "k string, t timestamp, ok boolean")
    started = spark.createDataFrame([("a", d(2025, 1, 3)), ("b", d(2025, 1, 3))], "k string, t timestamp")
    assert dict(map(tuple, debounce.next_check(attempts, started, "k", "t").collect())) == {"a": d(2025, 1, 3, 9), "b": d(2025, 1, 3, 0, 0, 10)}
