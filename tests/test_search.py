"""Search keys, prefix search and catalog search on small tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import matching as J

KEYS = {
    "Škoda Łódź AG": ("SKODA ŁODZ AG", "SKODA ODZ"), "Ørsted A/S": ("ØRSTED A S", "RSTED A S"), "O'Reilly Inc.": ("OREILLY INC", "O REILLY"), "L’Oréal S.A.": ("LOREAL S A", "L OREAL"),
    "AT&T": ("AT AND T", "AT T"), " ^GSPC--x ": ("^GSPC X", "GSPC X"), "漢字 株式": ("漢字 株式", ""), "Inc": ("INC", ""), "ﬁn ½": ("FIN 1 2", "FIN 1 2"), "": ("", ""), None: ("", ""),
    "Straße PLC Limited": ("STRASSE PLC LIMITED", "STRASSE"), "British Public Limited Company": ("BRITISH PUBLIC LIMITED COMPANY", "BRITISH"), "PLC Motors": ("PLC MOTORS", "PLC MOTORS"), "Ünïted N V Corp": ("UNITED N V CORP", "UNITED"),
}


def test_keys(spark):
    df = spark.createDataFrame([(k,) for k in KEYS] * 2, "n string")
    got = T.with_key(T.with_key(df, "n", "a"), "n", "b", T.company_key).collect()
    assert len(got) == 2 * len(KEYS)
    assert {x.n: (x.a, x.b) for x in got} == KEYS


def brute(assets, queries, k):
    out = []
    for q in set(queries) - {""}:
        hits = []
        for symbol, ticker, name in assets:
            names = [name, *name.split(" ")]
            rank = 0 if ticker == q else 1 if ticker.startswith(q) else 2 if any(n.startswith(q) for n in names) else None
            if rank is not None:
                hits.append((rank, len(symbol), symbol))
        out += [(q, n, s, r) for n, (r, _, s) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out)


def test_prefix_search(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("APR") for _ in range(r.randint(1, 7)))
    assets = [("P", "P", "PARKER HANNIFIN"), ("PA", "PA", "PAN AM"), ("PH", "PH", "PARKER HANNIFIN"), ("Z", "Z", "")] + [(f"S{i}", word(), " ".join(word() for _ in range(r.randint(1, 3)))) for i in range(120)]
    queries = ["P", "PA", "PAR", "PARK", "PARKER H", "HANNIFIN", "Z", "", "Q", "AAAAAAA", *[word() for _ in range(40)]]
    a = spark.createDataFrame(assets, "symbol string, ticker_key string, name_key string")
    got = J.search(a, spark.createDataFrame([(q,) for q in queries], "query string"), 8)
    assert sorted(map(tuple, got.collect())) == brute(assets, queries, 8)
    assert J.search(a.limit(0), spark.createDataFrame([("P",)], "query string"), 8).count() == 0


def test_catalog_search(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("AB ") for _ in range(n)).strip()
    entries = [(i, [word(r.randint(0, 9)) for _ in range(r.randint(1, 3))]) for i in range(80)]
    queries = ["", "A", "AB", "ABA", *[word(r.randint(1, 6)) for _ in range(30)]]
    got = J.catalog_search(spark.createDataFrame(entries, "symbol long, values array<string>"), spark.createDataFrame([(q,) for q in queries], "query string"))
    want = []
    for q in set(queries) - {""}:
        for i, values in entries:
            ranks = [0 if v == q else 1 if v.startswith(q) else 2 for v in values if q in v]
            want += [(q, i, min(ranks))] if ranks else []
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert spark.range(1).select(J.prefixes(F.lit("ABCDEF")).alias("p")).first().p == ["A", "AB", "ABC", "ABCD"]


def test_catalog_search_indexes_distinct_values_by_asked_parts(spark, tmp_path):
    """Entries that share values add no parts to the index: what is met by parts grows with the values alone."""
    entries = spark.range(3000).selectExpr("id AS symbol", "array('SMALL BRASS', concat('BRAND ', id % 5)) AS values")
    queries = spark.createDataFrame([("BRASS",), ("ALL B",), ("BRAND 3",), ("X",)], "query string")
    found = J.catalog_search(entries, queries)
    assert found.groupBy("query", "rank").count().count() == 3 and found.count() == 3000 + 3000 + 600
    found.write.parquet(str(tmp_path / "found"))
    nodes, rows = [found._jdf.queryExecution().executedPlan()], []
    found.collect()
    while nodes:
        n = nodes.pop()
        kids = n.children()
        nodes += [kids.apply(k) for k in range(kids.size())]
        if n.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(n.executedPlan())
        elif n.getClass().getSimpleName().endswith("QueryStageExec"):
            nodes.append(n.plan())
        elif n.getClass().getSimpleName() == "GenerateExec" and "gram" in n.toString().split("\n")[0]:
            rows.append(n.metrics().apply("numOutputRows").value())
    assert rows and max(rows) < 1000
