"""Tables of pages and rasters from the tables at hand.

R1, R2: each label of embeddings is a page, each vector a row of pixels. R3: each user of events is a document, each
event a page. R4: each order is a document, each line item a page. R8: small constant tables.
R9: inputs of every form that a parser meets, with the numbers and texts of a table's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(embeddings: DataFrame) -> DataFrame:
    y = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return embeddings.select(F.col("label").alias("page"), y.alias("y"), "embedding")


def _value(x):
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((x.cast("double") + 0.5) * 255).cast("double"))).cast("int")


def raster_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1: page, y, x, v."""
    rows = _rows(table(spark, sf_dir, "embeddings"))
    return rows.select("page", "y", F.posexplode("embedding").alias("x", "e")).select("page", "y", "x", _value(F.col("e")).alias("v"))


def raster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 with a row of pixels as one array: page, y, row."""
    rows = _rows(table(spark, sf_dir, "embeddings"))
    return rows.select("page", "y", F.transform("embedding", _value).alias("row"))


def raster_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: page, y, x, r, g, b, of the first 63 components."""
    rows = _rows(table(spark, sf_dir, "embeddings"))
    x = F.explode(F.sequence(F.lit(0), F.lit(20))).alias("x")
    rows = rows.select("page", "y", "embedding", x)
    return rows.select("page", "y", "x", *[_value(F.get("embedding", F.col("x") * 3 + i)).alias(c) for i, c in enumerate("rgb")])


def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3: doc, page_no, skew, noise, unevenness, paper, mode."""
    e = table(spark, sf_dir, "events")
    page_no = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    value = F.col("value")
    return e.select(
        F.col("user_id").alias("doc"),
        page_no.cast("long").alias("page_no"),
        F.when(F.col("event_type") == "error", -value / 100).otherwise(value / 100).alias("skew"),
        ((F.col("event_id") % 97) / 96.0).alias("noise"),
        ((F.col("event_id") % 31) / 100.0).alias("unevenness"),
        (F.lit(225.0) + F.col("event_id") % 31).alias("paper"),
        F.when(F.col("event_type") == "purchase", "color").when(F.col("event_type") == "click", "gray").otherwise("mono").alias("mode"),
    )


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4: doc, page_no, bytes."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.row_number().over(order).cast("long").alias("page_no"), F.floor("l_extendedprice").cast("long").alias("bytes"))


def constants(spark: SparkSession, name: str) -> DataFrame:
    """R8."""
    return spark.sql(f"select * from values {VALUES[name][1]} as t({VALUES[name][0]})")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """R9."""
    source, columns = DERIVED[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


#: Id, name and codes of the languages.
LANGUAGES = (
    ("chi_sim+eng", "中文 + 英文", "zh-Hans,en-US"),
    ("chi_sim", "中文简体", "zh-Hans"),
    ("chi_tra+eng", "中文繁体 + 英文", "zh-Hant,en-US"),
    ("eng", "英文", "en-US"),
    ("jpn", "日文", "ja-JP"),
    ("kor", "韩文", "ko-KR"),
    ("fra", "法文", "fr-FR"),
    ("deu", "德文", "de-DE"),
    ("spa", "西班牙文", "es-ES"),
    ("ita", "意大利文", "it-IT"),
    ("por", "葡萄牙文", "pt-BR"),
    ("rus", "俄文", "ru-RU"),
)
#: Column names and rows, in the SQL of any engine.
VALUES = {
    "languages": ("id, name, codes", ", ".join(f"('{i}', '{name}', '{codes}')" for i, name, codes in LANGUAGES)),
    "doc_languages": ("lang, id", "('en', 'eng'), ('de', 'deu'), ('fr', 'fra')"),
    "encoders": ("encoder, factor", "('jpeg', 1.0), ('jp2', 1.9), ('jp2lossless', 3.0), ('zip', 4.5)"),
    "qualities": ("quality", "(60), (70), (80), (90)"),
    "local_core": ("key, text", "('en', 'English'), ('de', 'German'), ('fr', 'French')"),
    "local_overlay": ("key, text", "('de', 'German (overlay)')"),
}

def _forms(key: str, *forms: str) -> str:
    """The form that a row's key chooses."""
    return f"case {key} % {len(forms)} " + " ".join(f"when {i} then {e}" for i, e in enumerate(forms)) + " end"


def _text(*parts: str) -> str:
    """Parts joined: quoted ones as they are, others as text of a number or column."""
    return " || ".join(p if p.startswith("'") else f"cast({p} as string)" for p in parts)


_A, _B, _C = "o_custkey % 17", "o_custkey % 23", "o_orderkey % 11"
_X, _Y, _Z = "p_size % 4", "p_partkey % 11", "p_partkey % 5"
_HEX = "md5(text) || md5(text || 'x')"
_ZIP = ["'{\"name\":\"app'", "p_size", "'.ZIP\",\"browser_download_url\":\"https://example.org/'", "p_partkey", "'.zip\",\"size\":'", "p_partkey * 3"]
_FULL = _text("'{\"tag_name\":\"v'", _X, "'.'", _Y, "'\",\"assets\":[{\"name\":\"app.dmg\",\"browser_download_url\":\"https://example.org/d\"},'", *_ZIP)


def _corner(base: int, factor: int, modulus: int) -> str:
    """A coordinate in hundredths, as far from base as the row's key says."""
    return f"cast({base} + p_partkey * {factor} % {modulus} as double) / 100"


def _quad() -> dict[str, str]:
    near, far = [_corner(1, f, 31) for f in (7, 11, 13, 17)], [_corner(69, f, 31) for f in (5, 3, 19, 23)]
    # as drawn, two corners changed about, the whole page, and a strip
    x = [(near[0], near[0], "0.0", near[0]), (far[0], far[1], "1.0", f"{near[0]} + 0.125"), (far[1], far[0], "1.0", f"{near[0]} + 0.125"), (near[1], near[1], "0.0", near[0])]
    y = [(near[2], near[2], "0.0", near[2]), (near[3], far[2], "0.0", near[2]), (far[2], near[3], "1.0", far[2]), (far[3], far[3], "1.0", far[2])]
    corners = {f"{a}{i}": _forms("p_partkey", *[f"cast({e} as double)" for e in c[i]]) for i in range(4) for a, c in (("x", x), ("y", y))}
    return {"id": "p_partkey", **corners, "inside": "cast(case when p_size % 10 = 0 then null else 150 + p_partkey * 29 % 100 end as double)", "outside": "cast(85 + p_partkey * 13 % 170 as double)"}


#: Table, and columns as SQL that Spark and DuckDB read alike.
DERIVED = {
    "selections": (
        "orders",
        {
            "id": "o_orderkey",
            "total": "cast(o_custkey % 40 + 1 as int)",
            "selection": _forms("o_orderkey", "'all'", _text(_A), _text(_A, "','", _B, "','", _C), _text(_A, "'-'", _B, "','", _C), _text(_A, "'-'"), _text("'-'", _B), _text(_B, "'-'", _A), _text("'x,'", _A), "''", _text("' '", _A, "' , '", _A, "' ,1'"), _text("'0,99,'", _C), _text(_A, "'-x'"), _text("'all,'", _B)),
        },
    ),
    "quads": ("part", _quad()),
    "versions": (
        "part",
        {
            "id": "p_partkey",
            "lhs": _forms("p_partkey", _text(_X, "'.'", _Y, "'.'", _Z), _text("'v'", _X, "'.'", _Y), _text(_X, "'.'", _Y, "'.0.0'"), _text(_X, "'.'", _Y, "'-beta'"), _text(_X, "'+'", _Y), "p_type", _text(_X, "'.x'"), _text(_X, "'..'", _Y), "''", _text("' V'", _X, "'.'", _Z, "' '"), _text(_X, "'.1.2.3.4.'", _Y), _text(_X, "'.1.2.3.4.5.6'"), "p_brand"),
            "rhs": _forms("p_size", _text(_Z, "'.'", _Y), _text(_X, "'.'", _Y, "'.0'"), _text("'v'", _X), _text(_X, "'.'", _Z), _text(_X, "'.1.2.3.4'")),
        },
    ),
    "checksums": (
        "documents",
        {"id": "doc_id", "body": _forms("doc_id", f"upper({_HEX}) || '  app.zip'", f"'sha256:' || {_HEX}", "text", f"'short abc' || chr(10) || {_HEX} || ' ' || md5(text)", f"'x' || {_HEX}", f"text || chr(9) || {_HEX}", "''")},
    ),
    "releases": (
        "part",
        {
            "id": "p_partkey",
            "current": _text("p_size % 3", "'.'", "p_partkey % 7"),
            "feed": _forms(
                "p_partkey",
                f"{_FULL} || ',\"digest\":\"sha256:' || md5(p_name) || upper(md5(p_brand)) || '\"}},{{\"name\":\"app' || cast(p_size as string) || '.ZIP.sha256\",\"browser_download_url\":\"https://example.org/s\"}}]}}'",
                f"{_FULL} || ',\"digest\":\"md5:00\"}},{{\"name\":\"app' || cast(p_size as string) || '.ZIP.ed25519\",\"browser_download_url\":\"https://example.org/e\"}}]}}'",
                _text("'{\"tag_name\":\"'", _X, "'.'", _Y, "'\",\"assets\":[]}'"),
                _text("'{\"tag_name\":\"v'", _X, "'\",\"assets\":[{\"name\":\"a.zip\"}]}'"),
                _text("'{\"tag_name\":\"nightly '", _Y, "'\",\"assets\":[]}'"),
                "cast(null as string)",
                "'{\"assets\":[]}'",
            ),
        },
    ),
    "streams": (
        "documents",
        {
            "id": "doc_id",
            "body": _forms("doc_id", "'BT /F1 12 Tf (' || text || ') Tj ET'", "'q 1 0 0 1 0 0 cm /Im0 Do Q ' || text", "'BT/F1 1 Tf<0041> TJ ET'", "'BTx Tfy Tjz ' || text", "text", "'BT /F1 1 Tf (' || lang || ' (' || source || ') ' || chr(92) || ')) Tj <' || md5(text) || '> Tj ET'", "'BT Tf'"),
        },
    ),
    "widths": (
        "pages",
        {
            "id": "page_id",
            "body": _forms("page_id", "html", "html || ' /Width ' || cast(length(html) as string)", "'/Width' || cast(page_id * 7 % 4000 as string) || ' /Height 1754 /Width 99999 ' || html", "'/Width' || chr(10) || '12345678 /Width ' || cast(page_id as string)", "''"),
        },
    ),
}
