import pytest

from skillgrid.llm import hosts as HO
from skillgrid.llm.queries import OP8_RULES


def test_query_matches_twin(twin):
    mine, other = twin("op8_url_filter")
    assert mine == other and mine


def test_rules_and_odd_urls(spark):
    urls = [None, "", "no scheme/en/", "http://EXAMPLE.com/en/x?q#f", "https://www.Example.com/en/", "http://a.www.example.com/en/1", "http://x.net/es/",
            "http://net/fr/?a", "http://x.net/EN/", "http://com", "http://com/", "http://foo?u=http://x.net/es/", "//x.net/es/", "http://x.net:80/es/", "http://é.net/fr/#x"]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(3, urls[3], "h", "p"), (None, urls[6], None, None)],
                               "page_id long, url string, host string, rule string")
    none = spark.createDataFrame([], "id long, bad int")
    rows = HO.judge(df, none, OP8_RULES).collect()
    assert len(rows) == len(urls) + 2
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows if r.page_id is not None}
    empty = ("", "", None, "allow")
    assert got == {
        0: empty, 1: empty, 2: empty, 3: ("example.com", "/en/x", "example.com/en/", "block"), 4: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        5: ("a.www.example.com", "/en/1", "www.example.com/en/", "allow"), 6: ("x.net", "/es/", "net/es/", "block"), 7: ("net", "/fr/", "net/fr/", "block"),
        8: ("x.net", "/EN/", None, "allow"), 9: ("com", "", None, "allow"), 10: ("com", "/", "com/", "allow"), 11: ("foo", "", None, "allow"),
        12: empty, 13: ("x.net:80", "/es/", None, "allow"), 14: ("é.net", "/fr/", "net/fr/", "block")}
    assert HO.judge(df.limit(0), none, OP8_RULES).collect() == []


def test_shrinkage(spark):
    """Two bad pages alone do not block a host of a clean domain; forty do, and colour an unseen host of their domain."""
    pages = ([(i, f"http://clean{i % 50}.good.org/p{i}") for i in range(1000)] + [(2000 + i, "http://new.good.org/") for i in range(2)]
             + [(3000 + i, f"http://h{i % 4}.spam.org/{i}") for i in range(160)] + [(4000, "http://unseen.spam.org/"), (4001, "http://unseen.good.org/")])
    bad = [(i, int(i >= 2000)) for i, _ in pages if i < 4000] + [(7, None)]
    rows = HO.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "id long, bad int"), []).collect()
    verdict = {r.page_id: r.verdict for r in rows}
    assert verdict[0] == "allow" and verdict[2000] == "allow" and verdict[3000] == "block"
    assert verdict[4001] == "allow" and verdict[4000] == "block"


@pytest.mark.parametrize("host,domain,suffix", [("a.b.co.uk", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("x.example.com:80", "example.com", "com"), ("u@h.de", "h.de", "de"), ("", "", "")])
def test_domains(spark, host, domain, suffix):
    from pyspark.sql import functions as F
    r = spark.createDataFrame([(host,)], "h string").select(HO.domain_of(F.col("h")), HO.suffix_of(F.col("h"))).first()
    assert tuple(r) == (domain, suffix)
