"""Checks of bundles and downloads, labels, dates and sizes as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import release

#: Labels of the modes.
MODE_LABELS = {"color": "彩色", "gray": "灰阶", "mono": "黑白"}


def mode_label(mode: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in MODE_LABELS.items() for x in kv])
    return F.coalesce(F.element_at(labels, mode), mode)


def bundle_state(has_plist: Column, found_id: Column, wanted_id: Column, found_version: Column, wanted_version: Column) -> Column:
    """ok, or the first check that a bundle fails: its list of properties, its id if it has one, its version."""
    return (
        F.when(~has_plist, "no plist")
        .when(found_id.isNotNull() & (found_id != wanted_id), "other id")
        .when(F.coalesce(release.compare(found_version, wanted_version) != "eq", F.lit(True)), "other version")
        .otherwise("ok")
    )


def first_bundle(files: DataFrame, by: str, path: str = "path", order: str = "ord", most: int = 5000) -> DataFrame:
    """Per group the first bundle at the top, else the first anywhere among the first entries of the walk."""
    depth = F.size(F.split(path, "/"))
    found = files.where((F.col(order) < most) & F.col(path).endswith(".app"))
    return found.groupBy(by).agg(F.min_by(path, F.struct(depth > 1, F.col(order))).alias("bundle"))


def verification(digest: Column, checksum: Column, signature: Column, key_set: Column, https: Column) -> Column:
    """How a download is verified: a configured key asks for a signature; else by digest, checksum file, or the connection alone."""
    return (
        F.when(key_set & signature.isNull(), "refused")
        .when(key_set, "signature")
        .when(digest.isNotNull(), "digest")
        .when(checksum.isNotNull(), "checksum")
        .when(https, "https")
        .otherwise("refused")
    )


def pdf_date(ts: Column) -> Column:
    return F.concat(F.lit("D:"), F.date_format(ts, "yyyyMMddHHmmss"))


def byte_text(size: Column) -> Column:
    """A size with its unit, by 1024."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(F.format_string("%.1f", F.floor(size * 10 / 1024.0 + 0.5) / 10.0), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.2f", F.floor(size * 100 / 1048576.0 + 0.5) / 100.0), F.lit(" MB")))
    )


def rotated(x: Column, y: Column, quarter_turns: Column) -> tuple[Column, Column]:
    """A point of the unit square after quarter turns."""
    q = F.pmod(quarter_turns, F.lit(4))
    return F.when(q == 0, x).when(q == 1, 1 - y).when(q == 2, 1 - x).otherwise(y), F.when(q == 0, y).when(q == 1, x).when(q == 2, 1 - y).otherwise(1 - x)
