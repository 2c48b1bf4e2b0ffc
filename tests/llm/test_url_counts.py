"""URL filter: splits against all splits, scores against a plain naive Bayes, whatever the number of words and tokens."""

import collections
import itertools
import math
import random
import re

import pytest

from quire.llm.url_filter import EXAMPLES, GIVEN, PLAIN_WORDS, RULES, SEEDS, SMOOTH, judge, split_name

from .test_native import plain_rule


def plain_scores(urls, texts=()):
    """Log odds of each url."""
    parts = [plain_rule(u) for u in urls]
    words = collections.Counter({w: GIVEN for w in SEEDS | PLAIN_WORDS})
    for h, p, _, _ in parts:
        words.update(w for x in h.split(".") if "-" in x for w in x.split("-") if 2 <= len(w) <= 24 and not w.isdigit())
        words.update(w for w in re.split("[^0-9a-z]+", p.lower()) if 2 <= len(w) <= 24 and not w.isdigit())
    for t in texts:
        words.update(w for w in re.split("[^0-9a-z]+", t.lower()) if 2 <= len(w) <= 24 and not w.isdigit())
    total = float(sum(words.values()))
    logs = {w: math.log(k / total) for w, k in words.items()}
    examples, memo = [], {}
    for h, p, rule, verdict in parts:
        if h not in memo:
            memo[h] = [w for label in re.split("[^0-9a-z]+", h) if label for w in split_name(label, logs, total)]
        tokens = [f"h:{w}" for w in memo[h]] + ["h:-"] * h.count("-") + [f"p:{w}" for w in re.split("[^0-9a-z]+", p.lower()) if w and not w.isdigit()]
        named = rule is not None and "." in rule.split("/")[0]
        examples.append((h, set(tokens), verdict == "block" if named else any(w in SEEDS for w in memo[h])))
    votes = collections.defaultdict(list)
    for h, tokens, is_bad in examples:
        for t in {None, *tokens}:
            votes[h, t].append(is_bad)
    is_bad = {k: 2 * sum(v) >= len(v) for k, v in votes.items()}
    n, bad, size, size_bad = (collections.Counter() for _ in range(4))
    for (h, t), b in is_bad.items():
        n[t] += 1
        bad[t] += b
        size[h] += t is not None
        size_bad[h] += b and t is not None
    hosts, bad_hosts = n.pop(None), bad.pop(None, 0)
    a_all, n_all, kinds = bad.total(), n.total(), len(n)
    n.update({f"h:{w}": EXAMPLES for w in SEEDS})
    bad.update({f"h:{w}": EXAMPLES for w in SEEDS})
    out = []
    for h, tokens, _ in examples:
        others = bad_hosts - is_bad[h, None]
        score, block_of = math.log((others + 1) / (hosts - others)), a_all - size_bad[h] + 1
        allow_of = n_all - size[h] + 2 - block_of
        rate = block_of / (block_of + allow_of)
        for t in tokens:
            block = bad[t] - is_bad[h, t]
            score += math.log((block + SMOOTH * rate) / (n[t] - 1 - block + SMOOTH * (1 - rate))) - math.log(block_of / allow_of)
        out.append(score)
    return out, kinds


def test_no_token_is_cut(spark):
    hosts = ["therin.example.info", "casino-win.info", "rarely-blocked.info"]
    urls = [f"http://{hosts[i % 3]}/a{i}x/b{i}y/{'once' if i == 1 else 'more'}" for i in range(30_000)]
    expected, kinds = plain_scores(urls)
    assert kinds > 60_000
    got = {r["page_id"]: r["log_odds"] for r in judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert len(got) == len(urls) and all(got[i] == pytest.approx(x) for i, x in enumerate(expected))


def test_scores_near_zero(spark):
    hosts = ["therin.example.info", "casino-win.info", "rarely-blocked.info"]
    urls = [f"http://{hosts[i % 3]}/a{i}x/b{i}y/{'once' if i == 1 else 'more'}" for i in range(60)]
    expected, _ = plain_scores(urls)
    got = {r["page_id"]: r["log_odds"] for r in judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert all(abs(got[i] - x) < 2e-11 for i, x in enumerate(expected))


def test_scores_of_a_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    expected, _ = plain_scores([r["url"] for r in pages], [re.sub("<[^>]*>", " ", r["html"]) for r in pages if r["html"].isascii()])
    df = spark.createDataFrame([(i, r["url"], r["html"] if r["html"].isascii() else None) for i, r in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in judge(df, html="html").collect()}
    for i, r in enumerate(pages):
        verdict = plain_rule(r["url"])[3] or ("block" if expected[i] > 0 else "allow")
        assert got[i]["log_odds"] == pytest.approx(expected[i]) and got[i]["verdict"] == verdict


def test_splits_are_the_best_of_all():
    rng = random.Random(8)
    for _ in range(60):
        words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(8)}
        total = float(sum(words.values()))
        logs = {w: math.log(n / total) for w, n in words.items()}
        cost = lambda w: logs.get(w, math.log(10.0 / total) - len(w) * math.log(10.0))
        name = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        every = [[name[i:j] for i, j in itertools.pairwise((0, *c, len(name)))] for k in range(len(name)) for c in itertools.combinations(range(1, len(name)), k)]
        got = split_name(name, logs, total)
        assert "".join(got) == name and sum(map(cost, got)) == pytest.approx(max(sum(map(cost, x)) for x in every))


def test_words_in_no_list_are_blocked_by_their_company(spark):
    good = sorted(PLAIN_WORDS)
    names = [*(f"{s}-zorbo" for s in sorted(SEEDS)[:12]), *(f"{w}-meadow" for w in good[:12]), *(f"{w}-zine" for w in good[12:24])]
    new = ["zorbo", "get-zorbo", "meadow-zine", "meadowzine", "zine", "meadow"]
    assert not {"zorbo", "get", "meadow", "zine"} & (SEEDS | PLAIN_WORDS)
    urls = [f"http://{n}.info/{k}" for n in [*names, *new, *good] for k in range(3)]
    urls += [f"http://{n}.hiddenfarm.biz/{k}" for n in ("ab", "cd", "ef", "gh", "ij", "kl") for k in range(2)] + [f"http://{w}.biz/1" for w in good[24:40]]
    urls += ["http://hiddenfarm.biz/ok/3", "http://hiddenfarm.shop/"]
    rules = (*RULES, ("block", "hiddenfarm.biz", "/"), ("allow", "hiddenfarm.biz", "/ok/"))
    got = {r["host"]: r["verdict"] for r in judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).where("rule is null").collect()}
    assert {h for h, v in got.items() if v == "block"} == {*(f"{n}.info" for n in [*names, *new] if "zorbo" in n), "hiddenfarm.shop"}


def test_what_the_list_of_seeds_does_not_say(spark):
    # hosts with a hyphen hold seeds, all but one; a host with a seed keeps other company than blocked ones
    urls = [f"http://{s}-{n}.biz/{k}" for s, n in zip(sorted(SEEDS), ["ado", "ebo", "ifo", "ogo", "uko"] * 5) for k in range(3)]
    urls += [f"http://{w}{v}.org/news/{k}" for w in sorted(PLAIN_WORDS) for v in ("", "guide") for k in range(2)]
    got = judge(spark.createDataFrame(list(enumerate([*urls, "http://qualmy-ebo.biz/1", "http://drugs.guide.school.library.health.org/news/1"])), "page_id long, url string"))
    blocked = {r["host"] for r in got.where("verdict = 'block'").collect()}
    assert blocked == {f"{s}-{n}.biz" for s, n in zip(sorted(SEEDS), ["ado", "ebo", "ifo", "ogo", "uko"] * 5)} | {"qualmy-ebo.biz"}


def test_one_url_and_one_host_in_a_third_of_all_rows(spark):
    urls = ["http://www.hot-host.info/a"] * 700 + [f"http://www.hot-host.info/b{i}/c" for i in range(700)] + [f"http://www.h{i}.info/a" for i in range(1300)]
    expected, _ = plain_scores(urls)
    got = {r["page_id"]: r["log_odds"] for r in judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert len(got) == len(urls) and all(got[i] == pytest.approx(x) for i, x in enumerate(expected))


@pytest.mark.parametrize("key", ["host", "rule", "path", "words", "times", "log_odds", "a.b"])
def test_names_of_the_key(spark, key):
    df = spark.createDataFrame([(1, "http://a.casino.info/x")], f"`{key}` long, url string")
    assert [r[0] for r in judge(df, key=key).collect()] == [1]


def test_no_seeds_and_no_rows_to_learn_from(spark):
    df = spark.createDataFrame([(1, None, None), (2, "nothing", None)], "page_id long, url string, html string")
    assert [r["verdict"] for r in judge(df, seeds=(), html="html").collect()] == ["allow"] * 2
    assert judge(df.limit(0), html="html").count() == 0
