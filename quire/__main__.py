"""Command line: report, process and preview over page tables, and lists of what there is."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quire")
    sub = parser.add_subparsers(dest="command")
    for name in ("version", "langs", "encoders", "presets", "filters", "queries"):
        sub.add_parser(name)
    q = sub.add_parser("query", help="run a registered query over a folder of tables")
    q.add_argument("name")
    q.add_argument("sf_dir")
    q.add_argument("--rows", type=int, default=20)
    for name in ("report", "process", "preview"):
        p = sub.add_parser(name, help="over a Parquet table of pages: doc, page_no, width, height, channels, data")
        p.add_argument("pages")
        p.add_argument("out")
        if name != "report":
            p.add_argument("--preset", choices=("auto", "bw", "color", "contrast", "original"))
            p.add_argument("--bg-strength", type=float, default=0.5)
            p.add_argument("--deskew", action="store_true")
            p.add_argument("--descreen", action="store_true")
            p.add_argument("--bg-remove", action="store_true")
            p.add_argument("--sharpen", type=float, default=0.0)
            p.add_argument("--pages", dest="selection", default="all")
            p.add_argument("--dpi", type=int, default=150)
            p.add_argument("--mode", choices=("auto", "color", "gray", "mono"), default="auto")
            p.add_argument("--encoder", default="jpeg")
    p = sub.add_parser("encbench", help="sizes of each page by every encoding, least first")
    p.add_argument("pages")
    p.add_argument("out")
    p = sub.add_parser("stripprobe", help="bytes in the strips of TIFF files")
    p.add_argument("folder")
    p = sub.add_parser("demo", help="synthetic pages, their report and their documents")
    p.add_argument("out")
    p.add_argument("--kind", default="scan")
    got = parser.parse_args(args)
    from quire.operators import rules
    from quire.sources.adapters import LANGUAGES

    if got.command in ("version", "langs", "encoders", "presets", "filters", "queries"):
        if got.command == "queries":
            from quire import queries

            said = sorted(queries.QUERIES)
        else:
            said = {"version": "1", "langs": LANGUAGES, "encoders": list(rules.FALLBACKS), "presets": ["auto", "bw", "color", "contrast", "original"], "filters": ["crop", "deskew", "descreen", "bg_remove", "preset", "sharpen"]}[got.command]
        print(json.dumps(said, ensure_ascii=False))
        return 0
    if got.command is None:
        parser.print_usage(sys.stderr)
        return 2
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from quire.operators import text
    from quire.plans import jobs

    spark = SparkSession.builder.appName("quire").getOrCreate()
    if got.command == "query":
        from quire import queries

        queries.QUERIES[got.name](spark, got.sf_dir).show(got.rows, truncate=80)
        return 0
    if got.command == "stripprobe":
        from quire.operators import encode
        from quire.sources import files

        found = encode.walked(files.documents(spark, got.folder, "*.tif*").select("doc", "content"), encode.tiff_strips, "strips binary")
        found.select("doc", F.octet_length("strips").alias("bytes")).show(1000, truncate=80)
        return 0
    if got.command == "demo":
        from quire.sources import files

        pages = files.synthetic_pages(spark, 2, 3, kind=got.kind)
        pages.write.parquet(f"{got.out}/pages")
        jobs.report(pages).write.json(f"{got.out}/report")
        jobs.process(pages, {"preset": "auto", "strength": 0.5}).write.parquet(f"{got.out}/documents")
        return 0
    pages = spark.read.parquet(got.pages)
    if got.command == "encbench":
        from quire.operators import encode

        encode.bench(pages).orderBy("doc", "page_no", "bytes").write.json(got.out)
        return 0
    if got.command == "report":
        jobs.report(pages).write.json(got.out)
        return 0
    spec = {"preset": got.preset, "strength": got.bg_strength, "deskew": got.deskew, "descreen": got.descreen, "bg_remove": got.bg_remove, "sharpen": got.sharpen}
    # a page is in a selection or not whatever its document's length, so the longest one's will do
    longest = pages.agg((F.max("page_no") + 1).cast("int")).first()[0] or 0
    chosen = F.array_contains(text.parse_selection(F.lit(got.selection), F.lit(longest)), F.col("page_no").cast("int"))
    if got.command == "process":
        spec["compress"] = {"mode": got.mode, "adaptive": got.mode == "auto", "encoder": got.encoder}
        created = datetime.now(timezone.utc).strftime("D:%Y%m%d%H%M%SZ")
        jobs.process(pages, spec, got.dpi, chosen, created=created).write.parquet(got.out)
    else:
        jobs.preview(pages.where(chosen), spec, longest).write.parquet(got.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
