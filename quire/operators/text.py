"""Page selections, text layers, escapes, fingerprints of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_selection(selection: Column, total: Column) -> Column:
    """Sorted 0-based pages of a selection such as 1,3-5,7-; ranges that end before they begin hold no page."""
    text = F.regexp_replace(selection, r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")

    def pages(p: Column) -> Column:
        begin = F.coalesce(p.substr(F.lit(1), F.instr(p, "-") - 1).try_cast("int"), F.lit(1))
        rest = p.substr(F.instr(p, "-") + 1, F.length(p))
        end = F.coalesce(rest.try_cast("int"), total)
        one = p.try_cast("int")
        first = F.greatest(begin, F.lit(1))
        ranged = F.when(end >= first, F.sequence(first - 1, F.greatest(F.least(end, total), first) - 1)).otherwise(F.array().cast("array<int>"))
        return F.when(p.contains("-"), ranged).when(one.isNotNull(), F.array(one - 1)).otherwise(F.array().cast("array<int>"))

    every = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    some = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(parts, pages)), lambda n: (n >= 0) & (n < total))))
    return F.when((text == "") | (text == "all"), every).otherwise(some)


def page_list(pages: DataFrame, doc: str = "doc", page_no: str = "page_no") -> DataFrame:
    """Each document's pages as text, runs merged: 1,3-5,9."""
    p = pages.select(doc, page_no).distinct()
    p = p.withColumn("run", F.col(page_no) - F.row_number().over(Window.partitionBy(doc).orderBy(page_no)))
    r = p.groupBy(doc, "run").agg(F.min(page_no).alias("a"), F.max(page_no).alias("b"))
    part = F.when(F.col("b") > F.col("a"), F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string"))).otherwise(F.col("a").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("a", part.alias("t"))))
    return r.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), ",").alias("page_list"))


def estimate_dpi(body: Column, width_points: float) -> Column:
    """From the greatest number below 40000 after /Width, of the first 200, and the page's width."""
    if width_points / 72.0 <= 0.1:
        return F.lit(300)
    found = F.slice(F.regexp_extract_all(body, F.lit(r"/Width[ \n\r]*([0-9]{0,8})"), F.lit(1)), F.lit(1), F.lit(200))
    best = F.coalesce(F.array_max(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda n: n < 40000)), F.lit(0))
    return F.when(best == 0, 300).otherwise(F.greatest(F.lit(72), F.least(F.lit(1200), F.round(best / (width_points / 72.0)).cast("int"))))


def has_text(chars: Column, pages: Column) -> tuple[Column, Column]:
    return chars > pages * 20, F.least(F.lit(1.0), chars / F.greatest(F.lit(1), pages * 200))


DELIMITERS = r"[ \t\n\r\f<>()\[\]{}/%]"


def has_token(body: Column, token: str) -> Column:
    return body.rlike(rf"(^|{DELIMITERS}){token}($|{DELIMITERS})")


def printable_share(body: Column) -> Column:
    return F.regexp_count(body, F.lit(r"[\x09\x0A\x0D\x20-\x7E]")) / F.nullif(F.length(body), F.lit(0))


def content_stream(body: Column) -> Column:
    return F.coalesce((printable_share(body) > 0.95) & has_token(body, "BT") & has_token(body, "Tf") & (has_token(body, "Tj") | has_token(body, "TJ")), F.lit(False))


def hex_utf16(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-16BE"))


def byte_values(data: Column) -> Column:
    """The bytes of binary as an array of numbers."""
    return F.transform(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("int"))


def unit_ranges(texts: DataFrame, text: str = "text") -> DataFrame:
    """Ranges of the UTF-16 units that any text uses."""
    letters = texts.select(F.explode(F.array_distinct(F.split(text, ""))).alias("c")).where("c <> ''").distinct()
    units = F.regexp_extract_all(hex_utf16(F.col("c")), F.lit("(....)"), F.lit(1))
    u = letters.select(F.explode(units).alias("h")).select(F.conv("h", 16, 10).cast("int").alias("u")).distinct()
    # at most 65,536 rows
    u = u.withColumn("run", F.col("u") - F.row_number().over(Window.orderBy("u")))
    return u.groupBy("run").agg(F.min("u").alias("first"), F.max("u").alias("last")).select("first", "last")


def pdf_escape(text: Column) -> Column:
    """Backslash and parentheses escaped, other printable ASCII as it is, every other byte as three octal digits."""

    def byte(n: Column) -> Column:
        shown = F.char(n)
        return F.when(n.isin(92, 40, 41), F.concat(F.lit("\\"), shown)).when(n.between(32, 126), shown).otherwise(F.concat(F.lit("\\"), F.lpad(F.conv(n.cast("string"), 10, 8), 3, "0")))

    return F.array_join(F.transform(byte_values(F.encode(text, "UTF-8")), byte), "")


#: Punctuation and what stands for it.
PUNCTUATION = (("，", ","), ("。", "."), ("：", ":"), ("；", ";"), ("（", "("), ("）", ")"), ("「", '"'), ("」", '"'), ("、", ","), ("…", "..."), ("—", "-"), ("·", ""))
#: The characters that end a phrase.
PHRASE_ENDS = r"[.,;:!?()\[\]{}<>\"'/\\|+=*~^&@$—\-]+"


def normalized(text: Column) -> Column:
    for a, b in PUNCTUATION:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(text, r"\s+", "")


def sorted_letters(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, "")), "")


def phrases(text: Column) -> Column:
    """Sorted letters of each phrase that counts: of two letters or more, or an ASCII one."""
    return F.transform(F.filter(F.split(normalized(text), PHRASE_ENDS), lambda p: (F.length(p) >= 2) | p.rlike(r"^[\x00-\x7F]$")), sorted_letters)


def format_ok(key: Column) -> Column:
    """Whether a format holds no other directives than %@ and %%."""
    return ~F.regexp_replace(F.replace(key, F.lit("%%"), F.lit("")), "%@", "").contains("%")


def release_section(text: str, version: str, spark) -> DataFrame:
    """The body below a version's heading, up to the next one or a rule, without link definitions."""
    want = version.lstrip("vV").strip()
    df = spark.createDataFrame([(text,)], "t string").select(F.posexplode(F.split("t", r"(?m)^## \[")).alias("i", "s"))
    df = df.where("i > 0").where(F.trim(F.substring_index("s", "]", 1)) == want).orderBy("i").limit(1)
    body = F.regexp_replace(F.col("s"), r"^[^\n]*\n?", "")
    body = F.get(F.split(body, r"\n---\n"), F.lit(0))
    body = F.regexp_replace(body, r"(?m)^\[[^\]]+\]:[ \t]*https?://\S+[ \t]*$", "")
    return df.select(F.regexp_replace(body, r"^\n+|\n+$", "").alias("body"))
