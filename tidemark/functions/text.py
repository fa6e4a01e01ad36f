"""Column functions that canonicalise identifiers, labels and texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Legal suffixes of company names; official hosts; index aliases.
SUFFIXES = [
    "PUBLIC LIMITED COMPANY", "SOCIETE ANONYME", "SOCIETA PER AZIONI", "NAAMLOZE VENNOOTSCHAP", "SPOLKA AKCYJNA", "S A", "N V", "B V", "S E",
    "SA", "SE", "AG", "AKTIENGESELLSCHAFT", "NV", "PLC", "INC", "INCORPORATED", "CORP", "CORPORATION", "LTD", "LIMITED", "SPA", "SAS", "BV",
]
OFFICIAL_HOSTS = ["house.gov", "senate.gov", "sec.gov"]
INDEX_ALIASES = {"DJI": "^DJI", "SPX": "^GSPC", "NDX": "^NDX", "RUT": "^RUT", "VIX": "^VIX"}


@F.pandas_udf(StringType())
def decomposed(c: pd.Series) -> pd.Series:
    """Compatibility decomposition (NFKD), which no SQL function gives; null stays null."""
    return c.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")


def unmarked(c: Column) -> Column:
    """Decomposed and without combining marks, upper case."""
    return F.upper(F.regexp_replace(decomposed(c), r"\p{M}+", ""))


def search_key(c: Column) -> Column:
    """unmarked(), & as AND, apostrophes dropped, other than letters, digits and ^ as single
    blanks; null counts as empty."""
    plain = F.regexp_replace(F.replace(unmarked(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" AND ")), "['’]", "")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}^]+", " "))


def company_key(c: Column) -> Column:
    """unmarked() words of A-Z and digits, without legal suffixes, as often as they stand at the end."""
    words = F.trim(F.regexp_replace(unmarked(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", " "))
    return F.regexp_replace(words, "(?:(?:^| )(?:" + "|".join(SUFFIXES) + "))+$", "")


def with_key(df: DataFrame, name: str, out: str, key=search_key) -> DataFrame:
    """df with the key of a column, made once per distinct value."""
    known = df.select(F.col(name).alias("_v")).distinct().withColumn(out, key(F.col("_v")))
    return df.join(known, F.col(name).eqNullSafe(F.col("_v")), "left").drop("_v")


def catalog_key(c: Column) -> Column:
    """Upper case, & as AND, other than A-Z, digits and ^ as single blanks; null counts as empty."""
    up = F.replace(F.upper(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" AND "))
    return F.trim(F.regexp_replace(up, "[^A-Z0-9^]+", " "))


def interval_name(c: Column) -> Column:
    x = F.lower(F.trim(c))
    known = F.when(x.isin("1d", "daily", "d"), "1d").when(x.isin("1wk", "1w", "weekly"), "1wk").when(x.isin("1mo", "monthly"), "1mo")
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown interval: "), F.coalesce(c, F.lit("null")))))


def symbol_name(c: Column) -> Column:
    """Trimmed, upper case, index aliases resolved; null if it is no symbol."""
    x = F.upper(F.trim(c))
    alias = F.create_map(*[F.lit(v) for kv in INDEX_ALIASES.items() for v in kv])
    return F.when(x.rlike("^[A-Z0-9^][A-Z0-9.#^=-]{0,19}$"), F.coalesce(F.element_at(alias, x), x))


def trade_type(c: Column) -> Column:
    x = F.upper(F.trim(c))
    return F.when(x.contains("BUY") | x.contains("PURCHASE") | (x == "P"), "PURCHASE").when(x.contains("SELL") | x.contains("SALE") | (x == "S"), "SALE").otherwise("OTHER")


def official_url(c: Column) -> Column:
    """The URL if it is https and on an official host, else null."""
    host = F.lower(F.try_parse_url(c, F.lit("HOST")))
    ok = F.lit(False)
    for h in OFFICIAL_HOSTS:
        ok = ok | (host == h) | host.endswith("." + h)
    return F.when((F.try_parse_url(c, F.lit("PROTOCOL")) == "https") & ok, c)


def bounded_text(c: Column, n: int) -> Column:
    return F.substring(F.trim(F.translate(c, "\r\n", "  ")), 1, n)


def fingerprint(*fields: Column) -> Column:
    """SHA-256 hex of the upper-case fields, joined with |; null counts as empty."""
    return F.sha2(F.concat_ws("|", *[F.upper(F.trim(F.coalesce(f.cast("string"), F.lit("")))) for f in fields]), 256)


def period_label(interval: Column, ts: Column) -> Column:
    """5 Jan 2024; 1–5 Jan 2024 (four days on); January 2024."""
    end = F.date_add(ts.cast("date"), 4)
    same_month, same_year = F.date_trunc("month", end) == F.date_trunc("month", ts), F.year(end) == F.year(ts)
    start = F.when(same_month, F.date_format(ts, "d")).when(same_year, F.date_format(ts, "d MMM")).otherwise(F.date_format(ts, "d MMM yyyy"))
    return F.when(interval == "1d", F.date_format(ts, "d MMM yyyy")).when(interval == "1wk", F.concat(start, F.lit("–"), F.date_format(end, "d MMM yyyy"))).otherwise(F.date_format(ts, "MMMM yyyy"))


def score_reason(c: Column) -> Column:
    """'Category +12.5/20: d1; d2 (+3/5)' as category, earned, maximum, status and details."""
    head = "^(.+?) \\+([0-9]+(?:\\.[0-9]+)?)/([0-9]+(?:\\.[0-9]+)?): (.*)$"
    part = lambda k: F.nullif(F.regexp_extract(c, head, k), F.lit(""))
    earned, most = part(2).cast("double"), part(3).cast("double")
    status = F.when(earned >= most, "FULL").when(earned > 0, "PARTIAL").when(earned == 0, "NONE")
    return F.struct(part(1).alias("category"), earned.alias("earned"), most.alias("maximum"), status.alias("status"), F.transform(F.split(part(4), ";"), lambda x: F.trim(x)).alias("details"))
