"""Mixing, line dedup and URL filter: against plain Python and SQL, with odd rows; the native ones run no Python."""

import collections
import math
import re

import duckdb
import pytest

from quire.llm import queries, url_filter
from quire.llm.line_dedup import drop_common_lines
from quire.llm.mixing import mix, repeat
from quire.llm.url_filter import judge

from .test_pipeline import plain_targets

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    places = [rel.columns.index(c) for c in columns]
    assert sorted([str(r[c]) for c in columns] for r in df.collect()) == sorted([str(r[i]) for i in places] for r in rel.fetchall())


@pytest.mark.parametrize("name", ["op6_mixing", "op9_line_dedup"])
def test_no_python_in_plan(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mixing_of_odd_rows(spark):
    rows = [(1, "a b c", "x", 9), (2, None, "x", 9), (None, "d e", None, 9), (None, "d e", None, 9), (3, "", "y", 9), (4, "w " * 5000, "z", 9), (4, "w " * 5000, "z", 9), (5, "q", "ä", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(3)
    for range_rows in (20_000, 1):
        got = mix(df, range_rows=range_rows).collect()
        sizes, taken, target = collections.Counter(), collections.Counter(), {}
        for r in got:
            assert 0 <= r["taken"] <= 2 * r["size"]
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
        assert len(got) == len(rows) and sum(sizes.values()) == sum(len(WORD.findall(t or "")) for _, t, _, _ in rows)
        order = {s: i for i, s in enumerate([*sorted(s for s in sizes if s is not None), None])}
        expected = plain_targets({order[s]: n for s, n in sizes.items()})
        for s in sizes:
            assert target[s] == pytest.approx(expected[order[s]]) and 0 <= target[s] - taken[s] < 1
    again = sorted(map(str, mix(df.repartition(5)).collect()))
    assert again == sorted(map(str, mix(df).collect()))
    assert mix(df.limit(0)).count() == 0 and repeat(mix(df.limit(0))).count() == 0
    words = collections.Counter()
    for r in repeat(mix(df)).collect():
        words[r["source"]] += len(WORD.findall(r["text"]))
    assert words == +taken


def test_targets_of_many_sources(spark):
    from quire.llm.mixing import targets

    rows = [(f"a{i:03d}", (i * 7919) % 1000 + (i % 5 == 0) * 5000) for i in range(400)] + [("b", 77)]
    df = spark.createDataFrame(rows, "source_key string, source_size long").repartition(7)
    expected = plain_targets(dict(rows))
    got = {r["source_key"]: r["target"] for r in targets(df, (3, 1, 2), 1.5, 2).collect()}
    assert got == pytest.approx(expected) and targets(df.limit(0), (3, 1, 2), 1.5, 2).count() == 0


def test_line_dedup_of_odd_rows(spark):
    lines = "\n".join(f"own {i}" for i in range(2000))
    rows = [(i, f"menu\n\nown {i}\nmenu", "h", 5) for i in range(9)] + [(None, None, "h", 5), (20, "", None, 5), (21, "menu", None, 5), (22, lines, "k", 5), (23, "menu\n\n", "h", 5), (23, "menu\n\n", "h", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int")
    got = drop_common_lines(df, ratio=0.5).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["source"]): (r["text"], r["n_lines"], r["n_dropped"]) for r in got}
    assert by[4, "h"] == ("\nown 4", 3, 2) and by[None, "h"] == (None, 0, 0) and by[20, None] == ("", 0, 0)
    assert by[21, None] == ("menu", 1, 0) and by[22, "k"] == (lines, 2000, 0) and by[23, "h"] == ("\n", 1, 1)
    assert drop_common_lines(df.limit(0)).count() == 0


def test_the_ratio_alone_decides_in_small_hosts(spark):
    rows = [(1, "a\nb", "one"), (2, "a\nb", "two"), (3, "a\nc", "two"), *((i, "x\ny\n" + str(i), "few") for i in range(4, 7)), (7, "y", "few"), (8, "z", "few")]
    got = {r["doc_id"]: r["text"] for r in drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), ratio=0.6).collect()}
    assert got == {1: "a\nb", 2: "b", 3: "c", 4: "x\n4", 5: "x\n5", 6: "x\n6", 7: "", 8: "z"}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b\nc", "x", "p", "q", "r"), (2, "d", None, "s", None, "u")], "doc_id long, text string, source string, common string, line string, level string")
    for out in (drop_common_lines(df).drop("n_lines", "n_dropped"), mix(df).drop("size", "source_size", "target", "taken")):
        assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (low == h or low.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return low, path, best and best[1], best and best[2]


def test_rules_and_parts(spark):
    urls = [r["url"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    urls += [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7?x=://y", "http://Ä.com?/en/", "http://com/en/", "x://notexample.com/en/71", "http://a.example.net/de/88#q", "http://h#/es/", "http://x.org/es/", "http://x.org/es/"]
    df = spark.createDataFrame([(i if i % 9 else None, u, "host") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = judge(df).collect()
    assert sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"])) for r in got) == sorted((str(i if i % 9 else None), *plain_rule(u)[:2], str(plain_rule(u)[2])) for i, u in enumerate(urls))
    for r in got:
        assert r["verdict"] in ("allow", "block") and (r["rule"] is None or r["verdict"] == {h + p: v for v, h, p in url_filter.RULES}[r["rule"]])
    assert judge(df.limit(0)).count() == 0


def test_names_are_split_and_spam_is_blocked(spark):
    rows = [(i, f"http://{n}.example.org/page/{i}") for i, n in enumerate(["therin", "library-blog", "news", "cheap-pills", "casino-win", "freecasinobets", "spamfarm", "travelguide", "free-bets"] * 5)]
    got = {r["host"].split(".")[0]: r["verdict"] for r in judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert {n for n, v in got.items() if v == "block"} == {"cheap-pills", "casino-win", "freecasinobets", "spamfarm", "free-bets"}
    words = ["free", "casino", "bets", *url_filter.PLAIN_WORDS]
    logs = {w: math.log(1 / len(words)) for w in words}
    assert url_filter.split_name("freecasinobets", logs, 1000.0 * len(words)) == ["free", "casino", "bets"] and url_filter.split_name("", logs, 1.0) == []
    assert url_filter.split_name("travelguide", logs, 1000.0 * len(words)) == ["travel", "guide"]
