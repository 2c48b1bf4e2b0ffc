"""Documents written by many tasks: ranges against a plain assembly, the format's commit and abort, text read back."""

import re
import zlib

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from quire.operators import encode, kernels, sink

LINE = {"x": 0.1, "y": 0.8, "w": 0.6, "h": 0.03}


def pages_of(spark, sizes):
    rows = []
    for doc, n in sizes.items():
        for i in range(n):
            w, h = 8 + i % 5, 6
            rows.append((doc, 10 * i + 3, w, h, 1, np.random.default_rng(i).integers(0, 255, w * h).astype(np.uint8).tobytes()))
    df = spark.createDataFrame(rows, kernels.PAGE)
    lines = F.array(F.struct(F.concat(F.lit("Größe (1) "), F.col("page_no")).alias("text"), *[F.lit(v).alias(c) for c, v in LINE.items()]))
    return encode.encode_pages(df.withColumn("lines", F.when(F.col("page_no") % 4 != 0, lines)))


def whole(ranges):
    out = {}
    for r in sorted(ranges, key=lambda r: (r["doc"], r["at"])):
        data = out.setdefault(r["doc"], bytearray())
        assert r["at"] == len(data)
        data += r["bytes"]
    return {d: bytes(b) for d, b in out.items()}


def plain(encoded, created=None, titles=None):
    by = {}
    for r in sorted(encoded.collect(), key=lambda r: (r["doc"], r["page_no"])):
        by.setdefault(r["doc"], []).append(r.asDict(recursive=True))
    return {d: sink.assemble(p, (titles or {}).get(d, d), created=created) for d, p in by.items()}


@pytest.mark.parametrize("block", [1, 7, 256])
def test_ranges_are_the_document(spark, block):
    enc = pages_of(spark, {"a": 23, "b": 1, "c": 7}).cache()
    titles = spark.createDataFrame([("a", "Ein (Titel)")], "doc string, title string")
    got = whole(sink.write_ranges(enc, block=block, titles=titles, created="D:20250102030405Z").collect())
    assert got == plain(enc, "D:20250102030405Z", {"a": "Ein (Titel)"})
    assert sink.write_ranges(enc.limit(0), block=block).collect() == []


def test_a_long_document_is_written_by_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(10_000).select(F.lit("long").alias("doc"), F.col("id").cast("int").alias("page_no"), F.lit(2).alias("width"), F.lit(1).alias("height"), F.lit(1).alias("channels"), F.lit(bytes([7, 200])).alias("data"))
        ranges = sink.write_ranges(encode.encode_pages(rows))
        dealt = ranges.where("at > 100").groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    (data,) = whole(ranges.collect()).values()
    start = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    entries = data[start:].split(b"\n")[3:]
    # offsets are the running sums of the objects' sizes, by number of the object, as the rule says
    sizes = [(int(m[1]), m.start()) for m in re.finditer(rb"(?:(?<=\n)|^)(\d+) 0 obj\n", data)]
    assert len(sizes) == 8 + 4 * 10_000
    assert all(int(entries[k - 1][:10]) == at for k, at in sizes)
    ends = [at for _, at in sizes[1:]] + [start]
    objects = spark.createDataFrame([("long", i, e - at) for i, ((_, at), e) in enumerate(zip(sizes, ends))], "doc string, object_no int, bytes long")
    assert [r["offset"] + len(sink.HEAD) for r in sink.offsets(objects).orderBy("object_no").collect()] == [at for _, at in sizes]


def shown(data):
    """Text of a file by its own maps: an independent reader of tables, streams, codes and maps."""
    start = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    table = data[start:].split(b"\n")
    places = [int(x[:10]) for x in table[2 : 2 + int(table[1].split()[1])]]

    def stream(k):
        head = data.index(b"stream\n", places[k])
        return data[head + 7 : head + 7 + int(re.search(rb"/Length (\d+)", data[places[k] : head])[1])]

    font = data[places[4] : data.index(b"endobj", places[4])]
    cmap = stream(int(re.search(rb"/ToUnicode (\d+) 0 R", font)[1])).decode()
    assert cmap.index("/CIDSystemInfo") < cmap.index("begincodespacerange") and cmap.rstrip().endswith("end\nend") and "defineresource pop" in cmap
    to = {}
    for block in re.findall(r"(\d+) beginbfrange\n(.*?)endbfrange", cmap, re.S):
        rows = re.findall("<(....)> <(....)> <(....)>", block[1])
        assert len(rows) == int(block[0]) <= 100
        for lo, hi, u in rows:
            assert lo[:2] == hi[:2]
            to |= {int(lo, 16) + i: int(u, 16) + i for i in range(int(hi, 16) - int(lo, 16) + 1)}
    out = []
    for m in re.finditer(rb"/Contents (\d+) 0 R", data):
        for code in re.findall(rb"<([0-9A-F]+)> Tj", stream(int(m[1]))):
            units = [to[int(code[i : i + 4], 16)] for i in range(0, len(code), 4)]
            out.append(b"".join(u.to_bytes(2, "big") for u in units).decode("utf-16-be"))
    return out


def test_text_is_read_back(spark):
    text = "".join(map(chr, range(0x3E, 0x700, 3))) + "\U0001f600)("
    page = {"doc": "a", "page_no": 0, "width": 9, "height": 9, "colors": 1, "bits": 8, "back_width": 9, "back_height": 9, "predictor": False, "stream": zlib.compress(bytes(81)), "mask": None, "lines": [LINE | {"text": text}, LINE | {"text": ""}]}
    data = sink.assemble([page, page | {"lines": [LINE | {"text": "zwei"}]}], "t (1)", created="D:20250102030405Z")
    assert shown(data) == [text, "zwei"]
    assert b"/CreationDate (D:20250102030405Z)" in data and b"/Producer (quire)" in data and b"/CIDToGIDMap /Identity" in data


def test_format_commits_and_aborts(spark, tmp_path):
    from quire.sources.formats import register

    register(spark)
    enc = pages_of(spark, {"a": 9, "b/1": 2}).cache()
    declared = {"a": 9, "b/1": 2}
    out = tmp_path / "files"
    write = lambda df, **options: df.write.format("quire_documents").mode("append").options(path=str(out), **options).save()
    write(sink.write_ranges(enc, block=2))
    files = {p.name: p.read_bytes() for p in out.iterdir()}
    assert files == {"a.pdf": plain(enc)["a"], "b%2F1.pdf": plain(enc)["b/1"]}

    # a task that fails takes all back, and what was there before stays
    def fail(batches):
        for b in batches:
            if TaskContext.get().partitionId() == 1:
                raise RuntimeError("lost")
            yield b

    more = sink.write_ranges(pages_of(spark, {"c": 9}), block=1).repartition(3).mapInPandas(fail, "doc string, at long, bytes binary")
    with pytest.raises(Exception, match="lost"):
        write(more)
    assert {p.name for p in out.iterdir()} == set(files)

    # gaps and overlaps are no files
    with pytest.raises(Exception, match="without gaps"):
        write(spark.createDataFrame([("d", 0, b"ab"), ("d", 3, b"c")], "doc string, at long, bytes binary"))
    assert {p.name for p in out.iterdir()} == set(files)

    # more pages than declared: nothing is written
    with pytest.raises(Exception, match="more pages than declared"):
        sink.checked(enc, spark.createDataFrame([("a", declared["a"] - 1), ("b/1", 2)], "doc string, declared long"))
    assert sink.checked(enc, spark.createDataFrame(list(declared.items()), "doc string, declared long")) is enc
