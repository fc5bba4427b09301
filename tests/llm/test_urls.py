import random

import duckdb
import pytest

from labelscope.llm import urls
from labelscope.llm.queries import queries
from labelscope.llm.sql import oracle_sql
from labelscope.llm.urls import ALLOW, BLOCK, Rule
from tests.compare import connect, duck_rows, spark_rows


def brute(rules, url):
    """Every rule tried on the url; by plain string tests for host rules."""
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fitting = []
    for i, r in enumerate(rules):
        if r.pattern is None:
            hit = host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
        else:
            at, hit = 0, True
            for piece in r.pattern.split("*"):
                at = (host + path).find(piece, at)
                if at < 0:
                    hit = False
                    break
                at += len(piece)
        if hit:
            fitting.append((r.pattern is not None, -len(r.name), i))
    rule = rules[min(fitting)[2]] if fitting else None
    own = rule.name if rule and rule.pattern is None else None
    other = rule.name if rule and rule.pattern is not None else None
    return host, path, own, other, rule.action if rule else ALLOW


def test_query(spark, sf_dir):
    assert spark_rows(queries()["op10_urls"](spark, sf_dir)) == duck_rows(connect(sf_dir), oracle_sql()["op10_urls"])


RULES = (*urls.HOST_RULES, *urls.PATTERN_RULES, Rule(BLOCK, "b.org", ""), Rule(ALLOW, "b.org", "/x"), Rule(BLOCK, pattern="sp*m"), Rule(ALLOW, pattern="/q*/z/"))


def test_rules_against_brute_force(spark):
    rng = random.Random(6)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "a.net", "net", "b.org", "ab.org", "x.doubleclick.co", "notexample.com:80", "", "ü.net"]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/es/1", "/fr/?q=/ads/", "/ads/", "/x/ads/b", "/xads/", "/q1/z/", "/spam", "/sp/../m", "/a;jsessionid=3", "/fr/#x"]
    made = [rng.choice(["http://", "", "https://", "x://y://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(300)]
    made += [None, "", "://", "http://", "no scheme", "http://a.net/es/" + "x" * 100_000, "http://a\nb.net/fr/\n"]
    rows = spark.createDataFrame([(i, u, "clash", "clash", "clash") for i, u in enumerate(made)], "page_id int, url string, host string, rule string, id string")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge(rows, RULES).collect()}
    for i, u in enumerate(made):
        assert got[i] == brute(RULES, u), u
    assert urls.judge(rows.limit(0), RULES).collect() == []


def test_repeated_rows_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "http://a.net/es/"), (1, "http://a.net/es/"), (None, None)], "page_id bigint, url string")
    assert sorted(map(str, urls.judge(rows).select("page_id", "rule", "verdict").collect())) == sorted(
        ["Row(page_id=1, rule='net/es/', verdict='block')"] * 2 + ["Row(page_id=None, rule=None, verdict='allow')"])


def test_rarest_token_files_a_rule():
    index = urls.Index([Rule(BLOCK, "example.com", "/en/")], {"example": 9, "com": 100, "en": 50})
    assert list(index.by_token) == ["example"]
    assert index.candidates("other.com/en/") == []
    assert urls.Index([Rule(BLOCK, pattern="ads*")], {}).always == [0]


@pytest.mark.parametrize("rule, tokens", [
    (Rule(BLOCK, "example.com", "/en"), ["example", "com"]), (Rule(BLOCK, "com", "/"), ["com"]), (Rule(BLOCK, pattern="/a/*b/"), ["a"]),
])
def test_only_whole_tokens(rule, tokens):
    assert rule.tokens() == tokens


def test_sql_knows_every_rule(spark, tmp_path):
    """Made-up URLs for all patterns and hosts, spellings that only A-Z folding gets right among them."""
    rng = random.Random(9)
    hosts = ["example.com", "WWW.Example.COM", "sub.www.example.com", "a.net", "NET", "a.doubleclick.co", "ÜX.net", "ÀB.org", "x.org", ""]
    parts = ["/ads/", "/adserver/", "/tracker/", "x.gif", "/banner/", "q.swf", "/cgi-bin/", "/login", "/wp-admin/", ";jsessionid=1",
             "/en/", "/es/", "/fr/", "a", "?q=/ads/", "#/ads/", "\n", ".gif", ".swf"]
    rows = [(i, rng.choice(["http://", "https://", "", "://"]) + rng.choice(hosts) + "".join(rng.choices(parts, k=rng.randint(0, 5)))) for i in range(3000)]
    rows += [(9000, None), (9001, "x.org/tracker/x.gif"), (9002, "http://x.org/adserver/x;jsessionid=1"), (9003, "http://x.org/cgi-bin/x/login")]
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/p")
    table = spark.read.parquet(f"{tmp_path}/p")
    got = spark_rows(urls.judge(table))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/p/*.parquet')")
    assert got == duck_rows(con, oracle_sql()["op10_urls"])
    assert {r.pattern for r in urls.judge(table).collect()} == {r.name for r in urls.PATTERN_RULES} | {None}
