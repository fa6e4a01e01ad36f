"""Universe manifests: what is read, counted and rejected."""

from __future__ import annotations

import pytest

from tidemark.sources import universe as U

HEADER = "\t".join(U.COLUMNS)
ROWS = [
    "AA\tAlpha \"One\"\tEnergy\tLARGE\tACTIVE\tDEVELOPMENT\t2003-03-28\t2017-08-31\t3634\t",
    "AB\tBeta\tEnergy\tMID\tACTIVE\tHOLDOUT\t2003-03-28\t2017-08-31\t100\t5000000000",
    "AB\tBeta again\tEnergy\tMID\tENDED\tHOLDOUT\t2003-03-28\t2017-08-31\t10\t7",
    "",
    "AC\tshort row\tEnergy",
    "AD\tbad role\tEnergy\tMID\tENDED\tTEST\t2003-03-28\t2017-08-31\t1\t7",
    "AE\tbad date\tEnergy\tMID\tENDED\tHOLDOUT\t2003-03-99\t2017-08-31\t1\t7",
    "AF\tbad value\tEnergy\tMID\tENDED\tHOLDOUT\t2003-03-28\t2017-08-31\t1\tmany",
]


def test_manifest_rows_and_counts(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text("\n".join([HEADER, *ROWS]) + "\n")
    m = U.load_manifest(spark, str(path))
    assert [(x.symbol, x.name, x.good) for x in m.collect()] == [("AA", 'Alpha "One"', True), ("AB", "Beta", True), ("AB", "Beta again", True), ("AC", "short row", False), ("AD", "bad role", False), ("AE", "bad date", False), ("AF", "bad value", False)]
    core = spark.createDataFrame([("AB",), ("AB",), ("ZZ",)], "symbol string")
    c = {(x.kind, x.value): (x.rows, x.symbols, x.bad, x.daily_candles, x.shared) for x in U.counts(m, core).collect()}
    assert c["ALL", "ALL"] == (7, 6, 4, 3747, 1) and c["role", "HOLDOUT"] == (4, 3, 2, 112, 1) and c["cap_tier", "LARGE"] == (1, 1, 0, 3634, 0) and c["cohort", "ACTIVE"] == (2, 2, 0, 3734, 1)
    assert U.counts(m.limit(0), core).count() == 0


def test_written_manifest_reads_back(spark, tmp_path):
    rows = [("B", 'Quote "q"', None, "LARGE", "ACTIVE", "VALIDATION", "2003-03-28", "2004-01-01", 5, None), ("A", "Plain", "Energy", "MID", "ENDED", "HOLDOUT", "2003-03-28", "2004-01-01", 6, 7)]
    df = spark.createDataFrame(rows, "symbol string, name string, sector string, cap_tier string, cohort string, role string, first_date string, last_date string, daily_candles long, market_cap_usd long")
    U.write_manifest(df, str(tmp_path / "u"))
    got = sorted((x.symbol, x.sector, x.daily_candles, x.market_cap_usd, x.good) for x in U.load_manifest(spark, str(tmp_path / "u")).collect())
    assert got == [("A", "Energy", 6, 7, True), ("B", None, 5, None, True)]


def test_another_header_is_an_error(spark, tmp_path):
    (tmp_path / "h.tsv").write_text(HEADER.replace("sector", "industry") + "\n" + ROWS[0] + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        U.load_manifest(spark, str(tmp_path / "h.tsv")).collect()
