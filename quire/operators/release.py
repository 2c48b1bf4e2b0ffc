"""Versions, release feeds, checksums and update decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEED = "tag_name string, html_url string, body string, published_at string, assets array<struct<name:string,browser_download_url:string,size:bigint,digest:string>>"


def version(text: Column) -> Column:
    """Numbers of a version, or null: an optional v, up to six plain numbers by dots; what follows - or + is left out."""
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), "^[vV]", ""), "[-+].*$", "")
    parts = F.split(body, r"\.", -1)
    good = body.rlike(r"^[0-9]+(\.[0-9]+){0,5}$")
    return F.when(good, F.transform(parts, lambda p: p.try_cast("bigint")))


def canonical(numbers: Column) -> Column:
    """Six numbers, zeros where there are none, so that arrays compare as versions do."""
    return F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.coalesce(F.get(numbers, i), F.lit(0)))


def compare(left: Column, right: Column) -> Column:
    """lt, eq or gt; null if either is no version."""
    a, b = version(left), version(right)
    x, y = canonical(a), canonical(b)
    return F.when(a.isNull() | b.isNull(), None).when(x == y, "eq").when(x < y, "lt").otherwise("gt")


def checksum(text: Column) -> Column:
    """The first token of 64 hex digits, in lower case, after an optional algorithm and colon."""
    tokens = F.transform(F.split(F.lower(text), r"[ \t\n\r]+"), lambda t: F.element_at(F.split(t, ":"), -1))
    return F.get(F.filter(tokens, lambda t: t.rlike("^[0-9a-f]{64}$")), 0)


def digest_sha256(digest: Column) -> Column:
    return F.when(digest.rlike("(?i)^sha256:[0-9a-f]{64}$"), F.lower(F.substring_index(digest, ":", -1)))


def parse_feed(feeds: DataFrame, feed: str = "feed", suffix: str = ".zip") -> DataFrame:
    """Columns of a release: its archive is the first asset with the suffix, whose checksum and signature are assets named after it."""
    r = feeds.withColumn("_r", F.from_json(feed, FEED))
    assets = F.filter(F.coalesce(F.col("_r.assets"), F.array().cast("array<struct<name:string,browser_download_url:string,size:bigint,digest:string>>")), lambda a: a["name"].isNotNull() & a["browser_download_url"].isNotNull())
    r = r.withColumn("_a", assets).withColumn("_z", F.get(F.filter("_a", lambda a: F.lower(a["name"]).endswith(suffix.lower())), 0))

    def named(ending: str) -> Column:
        return F.get(F.filter("_a", lambda a: a["name"] == F.concat(F.col("_z.name"), F.lit(ending))), 0)["browser_download_url"]

    known = version(F.col("_r.tag_name")).isNotNull()
    return r.select(
        *[c for c in feeds.columns if c != feed],
        F.when(known, F.col("_r.tag_name")).alias("tag"),
        F.when(known, F.col("_z.browser_download_url")).alias("archive_url"),
        F.when(known, F.coalesce("_z.size", F.lit(0))).alias("archive_size"),
        F.when(known, named(".sha256")).alias("checksum_url"),
        F.when(known, named(".ed25519")).alias("signature_url"),
        F.when(known, digest_sha256(F.col("_z.digest"))).alias("digest_sha256"),
    )


def decide(releases: DataFrame, current: str = "current") -> DataFrame:
    """What to do: versions are compared before any asset is looked at."""
    how = compare(F.col("tag"), F.col(current))
    newer = how == "gt"
    signed = F.col("signature_url").isNotNull()
    summed = F.col("checksum_url").isNotNull() | F.col("digest_sha256").isNotNull()
    return releases.withColumns(
        {
            "decision": F.when(F.col("tag").isNull(), "noReleaseYet").when(how == "eq", "upToDate").when(how == "lt", "remoteIsOlder").otherwise("available"),
            "has_checksum": F.when(newer, summed | signed),
            "has_signature": F.when(newer, signed),
        }
    )


def fetch_status(status: Column, repo_visible: Column) -> Column:
    """The class of a feed's HTTP status."""
    return (
        F.when(status == 200, "ok").when(status == 404, F.when(repo_visible, "noRelease").otherwise("inaccessible")).when(status.isin(403, 429), "rateLimited").otherwise("httpStatus")
    )


#: What an event makes of an updater's state; any other leaves it as it is.
MOVES = {
    "idle": {"check": "checking"},
    "checking": {"same": "up to date", "newer": "available", "error": "failed"},
    "up to date": {"check": "checking"},
    "available": {"check": "checking", "download": "downloading"},
    "downloading": {"done": "ready", "mismatch": "blocked", "error": "failed"},
    "ready": {"install": "installing"},
    "installing": {"done": "idle", "error": "failed"},
    "blocked": {"check": "checking"},
    "failed": {"check": "checking"},
}


def updater_states(events: DataFrame, key: str, order: list[str], event: str) -> DataFrame:
    """(key, state): where each updater is after its events, in their order, from idle."""
    moves = F.create_map(*[F.lit(x) for state, to in MOVES.items() for e, then in to.items() for x in (f"{state}:{e}", then)])
    told = F.array_sort(F.collect_list(F.struct(*order, F.col(event).alias("_event"))))
    step = lambda state, e: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit(":"), e["_event"])), state)
    return events.groupBy(key).agg(told.alias("told")).select(key, F.aggregate("told", F.lit("idle"), step).alias("state"))
