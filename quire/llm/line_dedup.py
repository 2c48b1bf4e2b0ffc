"""Line deduplication by site-relative frequency, with DataFrame functions alone.

For each host, the pages that hold a line are divided by the host's pages; lines above a ratio go. The lines of one
host that are above it are at most its mean number of lines a page divided by the ratio, so they fit in one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: A line counts if it holds a character that is not ASCII white space.
FILLED = r"[^\x20\x09-\x0D]"


def _lines(text: str) -> Column:
    return F.split(F.col(text).cast("string"), "\n", -1)


def drop_common_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1) -> DataFrame:
    """docs with their text less the lines that are on more than ratio of their host's rows, and n_lines, n_dropped.

    A line is what stands between line feeds, told apart within its host by a 64-bit digest; a page counts once for a
    line, however often it repeats it. A line on a single page is not boilerplate, however few pages its host has, and
    stays, as do blank lines. n_lines counts lines that are not blank. Null text stays null with 0 lines; null hosts are one host; repeated rows are pages of their own. A text
    whose lines all go is empty. An empty table gives an empty table. Columns named n_lines or n_dropped are replaced.
    """
    rows = docs.drop("n_lines", "n_dropped")
    marked = rows.withColumn("__q_host", F.coalesce(F.concat(F.lit("a"), F.col(host).cast("string")), F.lit("b")))
    filled = F.filter(_lines(text), lambda x: x.rlike(FILLED))
    held = marked.select("__q_host", F.array_distinct(F.transform(filled, lambda x: F.xxhash64(x))).alias("held"))
    counts = held.select("__q_host", F.explode("held").alias("line")).groupBy("__q_host", "line").agg(F.count("*").alias("pages")).where("pages > 1")
    totals = marked.groupBy("__q_host").agg(F.count("*").alias("total"))
    common = counts.join(totals, "__q_host").where(F.col("pages") > F.col("total") * F.lit(ratio))
    common = shared.save(common.groupBy("__q_host").agg(F.collect_list("line").alias("__q_common")), "common-lines")
    out = marked.join(common, "__q_host", "left")
    # the row's own common lines, by a hash set; they are few, so that each line looks into a short array. They are the
    # one element of an array, so that they are found once a row and not once a line
    hit = F.array(F.coalesce(F.array_intersect(F.transform(filled, lambda x: F.xxhash64(x)), "__q_common"), F.array().cast("array<bigint>")))
    kept = F.transform(hit, lambda own: F.filter(_lines(text), lambda x: ~(x.rlike(FILLED) & F.array_contains(own, F.xxhash64(x)))))
    out = out.withColumn("__q_kept", F.get(kept, 0))
    n_lines = F.coalesce(F.greatest(F.size(filled), F.lit(0)), F.lit(0))
    n_kept = F.size(F.filter(F.col("__q_kept"), lambda x: x.rlike(FILLED)))
    out = out.withColumns({"n_lines": n_lines.cast("long"), "n_dropped": F.coalesce(n_lines - F.greatest(n_kept, F.lit(0)), F.lit(0)).cast("long")})
    out = out.withColumn(text, F.when(F.col("n_dropped") > 0, F.array_join("__q_kept", "\n")).otherwise(F.col(text)))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], "n_lines", "n_dropped")
