"""URL filters: rules by host and path; host word segmentation and naive Bayes for what no rule decides.

A unigram Viterbi search splits the labels of a host into words, as the urls and the pages' own texts have them. A
multinomial naive Bayes model scores the words of host and path and the hyphens of the host. Urls that a rule of a
named host decides are examples of its verdict; of the others, those whose host holds a seed word are guessed to be
examples to block and the rest, which nobody has judged, examples to allow. No host is evidence of itself: each is scored
with the counts of all others, so that a name is blocked or allowed for the company that it keeps, with or without a
seed, and not for what it was guessed to be. A host counts once for each of its tokens, however many urls it has, and as
most of the urls with that token do. Seeds count as seen in some more hosts to block; common words help to split names
and say nothing else. Each token's counts are smoothed by two at the classes' own rates, so that a
token which nobody else has speaks for neither.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Fixed values: (verdict, host, path) of the rules that the query applies.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Words by which lists of hosts to block name their kinds: the seeds of the examples.
SEEDS = frozenset("adult ads betting casino dating drugs escort gambling hacking lottery malware pharmacy phishing pills poker porn sex spam torrent tracking viagra warez xxx".split())
#: Common words of names, so that the split of a name knows more than what the corpus holds.
PLAIN_WORDS = frozenset("about account app archive art blog book books business care center city club community company data daily design digital education example family files food forum games garden global group guide health help history home host house info journal lab learn library life live local mail market media mobile music net network news online open page paper park people photo press project radio report research school science search service shop site social software sport state store story studio support team tech times today tools travel university video weather web wiki work world".split())
#: How often a seed or a common word counts, besides what the corpus says.
GIVEN = 1000
#: In how many more hosts to block a seed counts as seen.
EXAMPLES = 100
#: Of how many tokens, at the classes' own rates, each token's counts are smoothed.
SMOOTH = 2
#: A word's letters at most, in the split of a name; longer ones, in no list of words, are split.
LONGEST = 24
#: Steps of a score.
STEPS = float(2**40)
#: A key with more than one in so many rows is joined by broadcast: there are fewer than that of them.
HOT = 1000
#: What is between words.
BETWEEN = "[^0-9a-z\u0080-\U0010ffff]"


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a url: empty where it is null or has no ://."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def split_name(name: str, logs: dict[str, float], total: float) -> list[str]:
    """Most likely words of a name; a part that is no word costs more the longer it is. Ties: the shorter last word."""
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        score, at = -math.inf, end - 1
        for start in range(end - 1, max(-1, end - LONGEST - 1), -1):
            word = name[start:end]
            s = best[start] + logs.get(word, math.log(10.0 / total) - len(word) * math.log(10.0))
            if s > score:
                score, at = s, start
        best.append(score)
        back.append(at)
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def fit_rules(rules) -> dict[str, list[tuple[str, str, str]]]:
    by: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, host, path in rules:
        by.setdefault(host, []).append((path, host + path, verdict))
    return by


def rule_of(host: str, path: str, by: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str, str | None] | None:
    """The longest rule whose host is the url's or a parent of it and whose path begins the url's; ties in text order. Its text, its verdict, and that verdict again if it names a host below a top domain."""
    found, at = [], 0
    while host and at >= 0:
        named = "." in host[at:]
        found += [(-len(rule), rule, verdict, verdict if named else None) for p, rule, verdict in by.get(host[at:], ()) if path.startswith(p)]
        at = host.find(".", at) + 1 or -1
    return min(found, key=lambda x: x[:3])[1:] if found else None


def _substrings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for label in b["label"]:
            subs = {label[i:j] for i in range(len(label)) for j in range(i + 2, min(len(label), i + LONGEST) + 1)}
            if subs:
                yield pd.DataFrame({"label": label, "word": sorted(subs)})


def _splits(total: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [split_name(x, {w["word"]: math.log(w["n"] / total) for w in known}, total) for x, known in zip(b["label"], b["known"], strict=True)]
            yield pd.DataFrame({"label": b["label"], "words": words})

    return run


def _read(by):
    """Path tokens and rule of each url."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [rule_of(h, p, by) or (None, None, None) for h, p in zip(b["host"], b["path"], strict=True)]
            tokens = [[f"p:{w}" for w in re.split(f"{BETWEEN}+", p.lower()) if w and not w.isdigit()] for p in b["path"]]
            rule, ruled, taught = zip(*found, strict=True) if found else ((), (), ())
            yield b.assign(rule=rule, ruled=ruled, taught=taught, path_tokens=tokens)

    return run


def _spread_join(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int) -> DataFrame:
    """left joined with right, whose keys are distinct and each have some row of left, by keys that may be as frequent as they like.

    rows: the column of right that tells how many rows of left have its key, of total. Those with over a thousandth of
    them, at most a thousand, are broadcast; no other key is enough for a task of its own.
    """
    hot = F.col(rows) * HOT > total
    some = right.where(hot).drop(rows)
    return left.join(F.broadcast(some), on).unionByName(left.join(F.broadcast(some.select(*on)), on, "left_anti").join(right.where(~hot).drop(rows), on))


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS, key: str = "page_id", url: str = "url", html: str | None = None) -> DataFrame:
    """(key, host, path, rule, verdict, log_odds) of each row.

    rule and verdict are those of the longest rule that fits; without one, rule is null and the verdict is the model's:
    block where its log odds are above 0. Null urls and urls without :// have an empty host and path, which no rule
    fits and the prior decides. html: the column of pages' texts, from which words are counted too; null ones have
    none. Rows may repeat, and one host, url or token may be in any share of them. key may have any name. Counts cover
    all rows and all words (of up to LONGEST letters) and tokens, which stay tables: a name is split with those of the
    words that it holds. log_odds is summed in steps of 2^-40. An empty table gives an empty table.
    """
    spark = pages.sparkSession
    shared.prepare(spark)
    host, path = parts(url)
    rows = pages.select(F.col(f"`{key}`").alias("_key"), host.alias("host"), path.alias("path"))
    # words of names: parts of a path, parts of a host that it separates by hyphens, and words of texts
    hyphened = F.flatten(F.transform(F.filter(F.split("host", r"\."), lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    words = rows.select(F.explode(F.concat(F.split(F.lower("path"), f"{BETWEEN}+"), hyphened)).alias("word"))
    if html is not None:
        seen_text = F.regexp_replace(F.col(html).cast("string"), r"<[^>]*+>", " ")
        words = words.union(pages.select(F.explode(F.split(F.lower(seen_text), f"{BETWEEN}+")).alias("word")))
    words = words.where(rf"length(word) between 2 and {LONGEST} and not word rlike '^[0-9]+$'").groupBy("word").agg(F.count("*").alias("n"))
    given = spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in sorted(set(seeds) | PLAIN_WORDS)])).alias("word"), F.lit(GIVEN).cast("long").alias("n"))
    words = shared.save(words.union(given).groupBy("word").agg(F.sum("n").alias("n")), "url-words")
    total = float(words.agg(F.sum("n")).first()[0])
    urls = rows.groupBy("host", "path").agg(F.count("*").alias("times"))
    read = urls.mapInPandas(_read(fit_rules(rules)), "host string, path string, times long, rule string, ruled string, taught string, path_tokens array<string>")
    urls = shared.save(read, "urls")
    labels = urls.select("host").distinct().select("host", F.posexplode(F.split("host", f"{BETWEEN}+")).alias("at", "label")).where("label <> ''")
    labels = shared.save(labels, "url-labels")
    names = labels.select("label").distinct()
    known = names.mapInPandas(_substrings, "label string, word string").join(words, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    known = names.join(known, "label", "left").select("label", F.coalesce("known", F.array().cast("array<struct<word:string,n:bigint>>")).alias("known"))
    split = known.mapInPandas(_splits(total), "label string, words array<string>")
    by_host = labels.join(split, "label").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("x")).select("host", F.flatten("x.words").alias("words"))
    n_urls = urls.count()
    hosts = urls.groupBy("host").agg(F.count("*").alias("n_urls")).join(by_host, "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    urls = _spread_join(urls, hosts, ["host"], "n_urls", n_urls)
    hyphens = F.array_repeat(F.lit("h:-"), F.length("host") - F.length(F.translate("host", "-", "")))
    tokens = F.concat(F.transform("words", lambda w: F.concat(F.lit("h:"), w)), hyphens, "path_tokens")
    seeded = F.exists("words", lambda w: w.isin(*sorted(seeds))) if seeds else F.lit(False)
    bad = F.when(F.col("taught").isNull(), seeded).otherwise(F.col("taught") == "block")
    urls = shared.save(urls.select("host", "path", "times", "rule", "ruled", bad.alias("bad"), F.array_distinct(tokens).alias("tokens")), "url-tokens")

    # a host counts once for each of its tokens
    mostly_bad = (F.sum(F.when(F.col("bad"), F.col("times")).otherwise(0)) * 2 >= F.sum("times")).cast("long")
    pairs = urls.select("host", "times", "bad", F.explode("tokens").alias("token")).groupBy("host", "token")
    pairs = shared.save(pairs.agg(mostly_bad.alias("bad"), F.count("*").alias("in_urls")), "url-pairs")
    listed = [F.struct(F.lit(f"h:{w}").alias("token"), F.lit(EXAMPLES).cast("long").alias("n"), F.lit(EXAMPLES).cast("long").alias("bad")) for w in sorted(seeds)]
    none = F.array().cast("array<struct<token:string,n:bigint,bad:bigint>>")
    lists = spark.range(1).select(F.inline(F.array(*listed) if listed else none)).withColumn("in_hosts", F.lit(0).cast("long"))
    seen = pairs.groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("in_hosts")).union(lists)
    seen = shared.save(seen.groupBy("token").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "bad")], F.sum("in_hosts").alias("in_hosts")), "url-counts")
    own = urls.groupBy("host").agg(mostly_bad.alias("is_bad"), F.sum("times").alias("rows")).join(pairs.groupBy("host").agg(F.sum("bad").alias("host_bad"), F.count("*").alias("host_n")), "host", "left")
    own = shared.save(own.withColumn("in_pairs", F.col("host_n")), "url-hosts")
    zero = lambda e: F.coalesce(e, F.lit(0))
    n_hosts, bad_hosts, n_pairs, bad_pairs, n_rows = own.agg(F.count("*"), zero(F.sum("is_bad")), zero(F.sum("host_n")), zero(F.sum("host_bad")), zero(F.sum("rows"))).first()
    rest = _spread_join(pairs, own.where("host_n is not null").select("host", "host_n", "host_bad", "in_pairs"), ["host"], "in_pairs", n_pairs)
    rest = _spread_join(shared.save(rest, "url-pairs-of-hosts"), seen.where("in_hosts > 0"), ["token"], "in_hosts", n_pairs)
    block, block_of = F.col("all_bad") - F.col("bad"), F.lit(bad_pairs + 1) - F.col("host_bad")
    allow, allow_of = F.col("all_n") - 1 - block, F.lit(n_pairs + 2) - F.col("host_n") - block_of
    rate = block_of / (block_of + allow_of)
    odds = F.log((block + rate * SMOOTH) / (allow + (1 - rate) * SMOOTH)) - F.log(block_of / allow_of)
    # whole numbers, so that a sum is the same in any order
    odds = shared.save(rest.select("host", "token", F.round(odds * STEPS).cast("long").alias("odds"), "in_urls"), "url-odds")
    placed = urls.select("host", "path", F.explode("tokens").alias("token"))
    summed = _spread_join(placed, odds, ["host", "token"], "in_urls", odds.agg(F.coalesce(F.sum("in_urls"), F.lit(0))).first()[0])
    # as decimals: 64 bits might not do for the sum of a very long url
    summed = summed.groupBy("host", "path").agg(F.sum(F.col("odds").cast("decimal(20,0)")).alias("sum"))
    others = F.lit(bad_hosts) - F.col("is_bad")
    prior = F.round(F.log((others + 1) / (F.lit(n_hosts) - others)) * STEPS).cast("long")
    priors = own.select("host", prior.alias("prior")).join(hosts.select("host", "n_urls"), "host")
    judged = _spread_join(urls.select("host", "path", "times", "rule", "ruled"), priors, ["host"], "n_urls", n_urls).join(summed, ["host", "path"], "left")
    judged = judged.select("host", "path", "times", "rule", "ruled", ((F.col("prior") + F.coalesce("sum", F.lit(0))) / STEPS).alias("log_odds"))
    verdict = F.coalesce("ruled", F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    judged = shared.save(judged.select("host", "path", "times", "rule", verdict.alias("verdict"), "log_odds"), "url-verdicts")
    return _spread_join(rows, judged, ["host", "path"], "times", n_rows).select(F.col("_key").alias(key), "host", "path", "rule", "verdict", "log_odds")
