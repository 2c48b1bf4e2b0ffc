"""What SQL can say of op1, op3 and op5: joins, offsets and rules, on whole tables."""

import duckdb
import pytest

from quire.llm import queries
from quire.llm.url_filter import RULES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def db():
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    yield con
    con.close()


def listed(rel):
    return sorted(map(str, rel.fetchall()))


def test_counts_of_equal_texts(spark, db):
    got = queries.op1_token_counts(spark, SF).toPandas()
    db.register("got", got)
    assert listed(db.sql("select doc_id, octet_length(encode(coalesce(text, ''))) from documents")) == listed(db.sql("select doc_id, n_bytes from got"))
    assert db.sql("select count(*) from got where over_limit <> (n_tokens > 512)").fetchall() == [(0,)]
    # each count is that of the text, whichever row holds it
    assert db.sql("select count(*) from (select text from documents join got using (doc_id) group by text having count(distinct n_tokens) > 1)").fetchall() == [(0,)]


def test_offsets_of_pieces(spark, db):
    got = queries.op3_packing(spark, SF).toPandas()
    db.register("got", got)
    gaps = """select count(*) from (select sequence_id * 4096 + "offset" as place, coalesce(sum(length) over (order by sequence_id, "offset" rows between unbounded preceding and 1 preceding), 0) as before from got) where place <> before"""
    assert db.sql(gaps).fetchall() == [(0,)]
    starts = "select count(*) from (select start, coalesce(sum(length) over (partition by doc_id order by start rows between unbounded preceding and 1 preceding), 0) as before from got) where start <> before"
    assert db.sql(starts).fetchall() == [(0,)]
    assert listed(db.sql("select doc_id, sum(length) from got group by doc_id")) == listed(db.sql("select distinct doc_id, doc_tokens from got"))
    assert db.sql("select count(*) from documents where doc_id not in (select doc_id from got)").fetchall() == [(0,)]
    assert db.sql("""select max("offset" + length) <= 4096 and min(length) > 0 from got""").fetchall() == [(True,)]


def test_rules_of_urls(spark, db):
    got = queries.op5_url_filter(spark, SF).toPandas()
    db.register("got", got)
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    db.sql(f"""create view expected as with parts as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
    split as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
    fits as (select page_id, h || p as rule, v from split join (values {values}) r(v, h, p) on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)),
    best as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(v, length(rule)) as ruled from fits group by page_id)
    select page_id, host, path, rule, ruled from split left join best using (page_id)""")
    assert listed(db.sql("select page_id, host, path, rule from expected")) == listed(db.sql("select page_id, host, path, rule from got"))
    assert db.sql("select count(*) from got join expected using (page_id) where ruled is not null and ruled <> verdict").fetchall() == [(0,)]
    assert db.sql("select count(*) from got where (rule is null) and verdict <> case when log_odds > 0 then 'block' else 'allow' end").fetchall() == [(0,)]
