"""Files as sources, synthetic pages, the command line."""

import json

import numpy as np
from pyspark.sql import functions as F

from quire.__main__ import main
from quire.operators import encode, kernels, sink
from quire.plans import jobs
from quire.sources import files


def test_written_documents_read_back(spark, tmp_path):
    title = "Tab\t(brackets)\\ Größe\n"
    page = {"lines": [{"text": "héllo", "x": 0.1, "y": 0.8, "w": 0.5, "h": 0.05}]}
    held = encode.encoded(np.full((80, 60), 200, np.uint8), {}) | {"lines": page["lines"]}
    (tmp_path / "a.pdf").write_bytes(sink.assemble([held], title))
    (tmp_path / "b.pdf").write_bytes(sink.assemble([held | {"lines": None}], ""))
    docs = files.documents(spark, f"file://{tmp_path}")
    assert {r["doc"]: r["t"] for r in docs.select("doc", files.info_title(F.col("content")).alias("t")).collect()} == {"a.pdf": title, "b.pdf": None}
    assert {r["doc"]: r["chars"] for r in files.text_layers(docs).collect()} == {"a.pdf": 10, "b.pdf": 0}
    from quire.operators.text import estimate_dpi

    assert docs.select(estimate_dpi(F.decode("content", "ISO-8859-1"), 28.8).alias("d")).first()["d"] == 150


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    gray, rgb = rng.integers(0, 255, (20, 30)).astype(np.uint8), rng.integers(0, 255, (11, 9, 3)).astype(np.uint8)
    (tmp_path / "g.png").write_bytes(encode.png(gray))
    (tmp_path / "c.png").write_bytes(encode.png(rgb))
    got = {r["doc"]: kernels.unpack(r) for r in files.images(spark, f"file://{tmp_path}").collect()}
    assert (got["g.png"] == gray).all() and (got["c.png"] == rgb).all()


def test_synthetic_pages_and_commands(spark, tmp_path, capsys):
    pages = files.synthetic_pages(spark, 2, 2, 60, 50)
    assert sorted((r["doc"], r["page_no"]) for r in pages.collect()) == [("d0", 0), ("d0", 1), ("d1", 0), ("d1", 1)]
    assert pages.collect() == files.synthetic_pages(spark, 2, 2, 60, 50).collect()
    pages.write.parquet(f"file://{tmp_path}/pages")
    assert main(["report", f"file://{tmp_path}/pages", f"file://{tmp_path}/report"]) == 0
    assert spark.read.json(f"file://{tmp_path}/report").count() == 2
    assert main(["process", f"file://{tmp_path}/pages", f"file://{tmp_path}/out", "--pages", "2", "--preset", "bw"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2
    assert main(["presets"]) == 0 and "contrast" in capsys.readouterr().out
    assert main(["demo", f"file://{tmp_path}/demo", "--kind", "photo"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/demo/documents").count() == 2 and spark.read.json(f"file://{tmp_path}/demo/report").count() == 2
    assert main(["encbench", f"file://{tmp_path}/pages", f"file://{tmp_path}/bench"]) == 0
    sizes = {r["encoding"]: r["bytes"] for r in spark.read.json(f"file://{tmp_path}/bench").where("doc = 'd0' and page_no = 0").collect()}
    assert sizes["mono"] < sizes["flate with predictor"] and sizes["gray"] == sizes["flate with predictor"]
    (tmp_path / "tif").mkdir()
    (tmp_path / "tif" / "a.tif").write_bytes(b"II*\0" + (8).to_bytes(4, "little") + b"\0\0")
    assert main(["stripprobe", f"file://{tmp_path}/tif"]) == 0 and "a.tif" in capsys.readouterr().out
    assert main([]) == 2
    assert main(["langs"]) == 0
    assert ["eng", "英文", "en-US"] in json.loads(capsys.readouterr().out)
    assert main(["preview", f"file://{tmp_path}/pages", f"file://{tmp_path}/previews", "--pages", "1-", "--preset", "bw"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/previews").count() == 2
    assert jobs.report(pages).where("page_count = 2").count() == 2


def test_kinds_of_synthetic_pages(spark):
    got = {}
    for kind in files.KINDS:
        got[kind] = kernels.unpack(files.synthetic_pages(spark, 1, 1, 160, 120, kind=kind).first())
        assert got[kind].shape == (160, 120)
    assert got["desk"][80, 60] > 240 > 100 > got["desk"][2, 2]
    assert got["photo"][5, 5] > got["photo"][-5, -5] and got["gradient"][5, 5] > got["gradient"][5, -5]
    assert (got["quadrant"] < 128).mean() > 0.05 and (got["specks"] == 230).sum() > 5
    state, plain = 11, []
    for _ in range(50):
        state = (state * 2862933555777941757 + 3037000493) % (1 << 64)
        plain.append((state >> 58) % 25 - 12)
    assert files.noise(11, 50).tolist() == plain


def test_no_folder_of_one_machine_on_a_cluster():
    import types

    import pytest

    from quire.functions.shared import shared_dir

    session = lambda master, folder: types.SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=types.SimpleNamespace(master=master))
    assert shared_dir(session("spark://x", "s3://there/")) == "s3://there" and shared_dir(session("local[2]", None)).startswith("file:")
    for master in ("spark://x", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            shared_dir(session(master, None))
