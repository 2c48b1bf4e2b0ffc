"""Mixing sources to target weights, with DataFrame functions alone.

Every row has a hash key, uniform within its source, so ranges of keys are ranges of rows: a source's rows are cut
into key ranges of about range_rows rows, whose word totals are summed in key order; a window inside each range does
the rest of the prefix sum. A source gives whole epochs and then, in key order, words up to its exact budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Runs of other characters than ASCII white space are words.
WORD = r"[^\x20\x09-\x0D]+"


def _source_key(source: str) -> Column:
    """Never null, and in code point order with null last."""
    return F.coalesce(F.concat(F.lit("a"), F.col(source).cast("string")), F.lit("b"))


def _running(rows: DataFrame, order: list, sums: list[str], name: str) -> DataFrame:
    """rows with __q_rank, from 0, and __q_<sum>, the sum of what is before, in the order: by ranges of rows, whose totals are one row for each task."""
    dealt = shared.save(rows.repartitionByRange(*order).withColumn("__q_part", F.spark_partition_id()), name)
    totals = dealt.groupBy("__q_part").agg(F.count("*").alias("__q_n"), *[F.sum(c).alias(f"__q_all_{c}") for c in sums])
    whole = Window.orderBy("__q_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = [F.coalesce(F.sum(x).over(whole), F.lit(0)).alias(f"__q_to_{x}") for x in ("__q_n", *(f"__q_all_{c}" for c in sums))]
    inside = Window.partitionBy("__q_part").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(totals.select("__q_part", *earlier), "__q_part")
    out = out.withColumn("__q_rank", F.col("__q_to___q_n") + F.row_number().over(inside) - 1)
    for c in sums:
        out = out.withColumn(f"__q_{c}", F.col(f"__q_to___q_all_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0)))
    return out.select(*rows.columns, "__q_rank", *[f"__q_{c}" for c in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """(source_key, source_size, target) of sizes (source_key, source_size).

    Sources in order take weights in turn. share of all words is dealt out by weight; no target is above epochs times
    its source's size, and the excess is dealt to the others by weight until none is above. With the sources in order
    of size over weight, those that stop are the first few, so prefix sums in that order find the level of the rest.
    """
    ranked = _running(sizes, ["source_key"], [], "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), (F.col("__q_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight).withColumn("cap", (F.col("source_size") * epochs).cast("double")).drop("__q_rank")
    placed = _running(ranked.withColumn("fill", F.col("cap") / F.col("w")), ["fill", "source_key"], ["cap", "w"], "mix-levels")
    total, all_w = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    level = (F.lit(float(total)) * share - F.col("__q_cap")) / (F.lit(all_w) - F.col("__q_w"))
    found = placed.agg(F.max(F.when(F.col("fill") > level, level))).first()[0]
    target = F.col("cap") if found is None else F.least(F.col("cap"), F.lit(found) * F.col("w"))
    return placed.select("source_key", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: str = "mix", range_rows: int = 5_000, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs with size, source_size, target and taken.

    size: words of the text (null: 0). taken: the words of it that the mix takes, repeats counted; a source's add up
    to its target, rounded down. Keys are digests of key and text, so reruns agree, and rows that are equal in both
    stand next to each other; rows may repeat. Null sources are one source, the last. A source without words takes
    nothing. An empty table gives an empty table. Columns of docs named as those above are replaced; others pass.
    """
    spark = docs.sparkSession
    rows = docs.drop("size", "source_size", "target", "taken")
    n = rows.select(F.lit(1)).count()
    ranges = max(1, -(-n // range_rows))
    content = shared.text_or_empty(text)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), content))
    marked = rows.withColumns({"size": F.regexp_count(content, F.lit(WORD)).cast("long"), "__q_source": _source_key(source), "__q_hash": digest})
    marked = marked.withColumn("__q_range", F.floor(F.conv(F.substring("__q_hash", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(1 << 32)))
    totals = shared.save(marked.groupBy("__q_source", "__q_range").agg(F.sum("size").alias("range_size")), "mix-totals")
    aims = targets(totals.groupBy(F.col("__q_source").alias("source_key")).agg(F.sum("range_size").alias("source_size")), weights, share, epochs)
    before = F.sum("range_size").over(Window.partitionBy("__q_source").orderBy("__q_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("range_size")
    plan = totals.withColumn("__q_before", before).join(aims.withColumnRenamed("source_key", "__q_source"), "__q_source").drop("range_size")
    plan = shared.save(plan, "mix-plan")
    inside = Window.partitionBy("__q_source", "__q_range").orderBy("__q_hash", key, "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.join(plan, ["__q_source", "__q_range"]).withColumn("__q_end", F.col("__q_before") + F.sum("size").over(inside))
    whole = F.coalesce(F.floor(F.col("target")).cast("long"), F.lit(0))
    full = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    rest = whole - full * F.col("source_size")
    taken = full * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("__q_end") - F.col("size"))))
    return placed.withColumn("taken", taken.cast("long")).select(*[F.col(f"`{c}`") for c in rows.columns], "size", "source_size", "target", "taken")


def repeat(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows that a mix is made of: each row's whole text as often as it is taken whole, then what is left of it.

    The rest is the text's first words as they stand there. The columns are those of the documents.
    """
    columns = [c for c in mixed.columns if c not in ("size", "source_size", "target", "taken")]
    live = mixed.where("taken > 0").withColumn("__q_i", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("__q_i") - 1) * F.col("size"))
    # a pattern of fixed length cannot hold the count, so the place of the last word's end comes from the words themselves
    kept = F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), F.lit(1), words.cast("int"))
    cut = F.when(words < F.col("size"), F.array_join(kept, "")).otherwise(F.col(text))
    return live.withColumn(text, cut).select(*[F.col(f"`{c}`") for c in columns])
