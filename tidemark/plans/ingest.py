"""Queries of ingest, cleaning and paging, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import ingest as G
from tidemark.plans import sql as S
from tidemark.plans.catalog import query
from tidemark.sources import files, store, universe
from tidemark.sources import market as M

B = (S.TICKS, S.bars())
COLS = 'symbol, "interval", ts, open, high, low, close, volume'


def _raw(spark, sf_dir, interval="1wk"):
    """Weekly bars with an id, every fifth bar repeated two days later, every seventh without volume."""
    b = M.bars(spark, sf_dir, interval).withColumn("id", F.unix_timestamp("ts"))
    late = b.filter("id DIV 604800 % 5 = 0").withColumns({"ts": F.col("ts") + F.expr("INTERVAL 2 DAYS"), "id": F.col("id") + 172800, "close": F.when(F.col("id") % 7 != 0, F.col("close"))})
    return b.unionByName(late)


RAW = f"""raw AS (SELECT {COLS}, epoch(ts)::BIGINT AS id FROM bars UNION ALL SELECT symbol, "interval", ts + INTERVAL 2 DAYS, open, high, low, CASE WHEN id % 7 <> 0 THEN close END, volume, id + 172800 FROM (SELECT *, epoch(ts)::BIGINT AS id FROM bars) WHERE id // 604800 % 5 = 0)"""


@query("scan_bars", S.over(*B, body=f"SELECT {COLS} FROM bars WHERE symbol IN ('Brand#1', 'Brand#7') AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1999-01-01'"))
def scan_bars(spark, sf_dir):
    held = store.read(spark, M.stored_bars(spark, sf_dir), M.BAR)
    return G.scan_bars(held, ["Brand#1", "Brand#7"], "1wk", "1996-01-01", "1999-01-01")


@query("store_bars", S.over(S.TICKS, S.bars("1d", "b1"), S.bars("1wk", "b2"), S.bars("1mo", "b3"), body=f"SELECT {COLS} FROM b1 UNION ALL SELECT {COLS} FROM b2 UNION ALL SELECT {COLS} FROM b3"))
def store_bars(spark, sf_dir):
    return store.read(spark, M.stored_bars(spark, sf_dir), M.BAR)


@query("complete_price_filter", S.over(*B, RAW, body=f"SELECT {COLS} FROM raw WHERE close IS NOT NULL"))
def complete_price_filter(spark, sf_dir):
    return G.complete(_raw(spark, sf_dir)).drop("id")


@query("valid_ohlc_filter", S.over(*B, RAW, body=f"SELECT {COLS} FROM raw WHERE close IS NOT NULL AND high >= greatest(open, close) AND low <= least(open, close) AND low > 0"))
def valid_ohlc_filter(spark, sf_dir):
    return G.valid(_raw(spark, sf_dir), positive=True).drop("id")


@query("canonical_bar_ts", S.over(*B, RAW, body="SELECT symbol, id, CAST(date_trunc('week', ts) AS TIMESTAMP) AS ts FROM raw"))
def canonical_bar_ts(spark, sf_dir):
    return _raw(spark, sf_dir).select("symbol", "id", G.canonical_ts(F.col("interval"), F.col("ts")).alias("ts"))


@query("dedupe_logical_bars", S.over(*B, RAW, body="SELECT symbol, \"interval\", CAST(date_trunc('week', ts) AS TIMESTAMP) AS ts, open, high, low, close, volume, id FROM raw QUALIFY row_number() OVER (PARTITION BY symbol, date_trunc('week', ts) ORDER BY id DESC) = 1"))
def dedupe_logical_bars(spark, sf_dir):
    return G.dedupe_logical(_raw(spark, sf_dir))


@query("drop_noncanonical_monthly", S.over(S.TICKS, S.bars("1mo"), RAW, body=f"SELECT {COLS} FROM raw WHERE day(ts) = 1"))
def drop_noncanonical_monthly(spark, sf_dir):
    return G.canonical_monthly(_raw(spark, sf_dir, "1mo")).drop("id")


@query("interval_normalize", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '1d' WHEN 1 THEN '1wk' ELSE '1mo' END AS \"interval\" FROM customer")
def interval_normalize(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.when(k % 2 == 0, " Daily").otherwise("1D")).when(k % 3 == 1, F.when(k % 2 == 0, "weekly").otherwise("1w")).otherwise("Monthly ")
    return M.table(spark, sf_dir, "customer").select("c_custkey", T.interval_name(raw).alias("interval"))


@query("infer_interval", S.over(*B, body="SELECT symbol, gap, CASE WHEN gap <= 345600 THEN '1d' WHEN gap <= 1209600 THEN '1wk' ELSE '1mo' END AS \"interval\" FROM (SELECT symbol, list_sort(list(g))[len(list(g)) // 2 + 1] AS gap FROM (SELECT symbol, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY symbol ORDER BY ts) AS g FROM bars) WHERE g > 0 GROUP BY symbol)"))
def infer_interval(spark, sf_dir):
    return G.infer_interval(M.bars(spark, sf_dir))


@query("mixed_interval_guard", S.over(S.RULES, body="SELECT symbol, count(DISTINCT \"interval\") AS n FROM rules GROUP BY symbol HAVING count(DISTINCT \"interval\") > 1"))
def mixed_interval_guard(spark, sf_dir):
    return G.mixed_intervals(M.rules(spark, sf_dir))


@query("completed_bar_filter", S.over(*B, body=f"SELECT {COLS} FROM bars WHERE ts < TIMESTAMP '2000-03-06'"))
def completed_bar_filter(spark, sf_dir):
    return G.completed(M.bars(spark, sf_dir), "2000-03-03 23:30:00")  # Saturday in Brussels


@query("symbol_canonicalize", "SELECT p_partkey, upper(trim(p_brand)) AS symbol FROM part")
def symbol_canonicalize(spark, sf_dir):
    return M.table(spark, sf_dir, "part").select("p_partkey", T.symbol_name(F.concat(F.lit("  "), F.lower("p_brand"), F.lit(" "))).alias("symbol"))


@query("classify_instrument", S.over(S.ASSETS, body="SELECT symbol, company, kind, instrument_type FROM assets"))
def classify_instrument(spark, sf_dir):
    return M.assets(spark, sf_dir)


@query("classify_trade", S.over(S.TICKS, S.FLAGS, S.INSIDERS, body="SELECT trade_id, CASE code WHEN 'P' THEN 'PURCHASE' ELSE 'SALE' END AS trade_type FROM insiders"))
def classify_trade(spark, sf_dir):
    return M.insider_trades(spark, sf_dir).select("trade_id", T.trade_type(F.col("code")).alias("trade_type"))


# Names with letters beyond A-Z, apostrophes, signs and suffixes, by a part's number.
_ODD = ["Škoda Łódź AG", "Ørsted A/S", "O'Reilly & L’Oréal", "Straße ½ ﬁn ÅÉ", "^GSPC Zürich S.A.", "Unilever N.V. PLC", "Naamloze Vennootschap", "Žižkov Public Limited Company"]
_ODD_SQL = "p_name || ' ' || [" + ", ".join("'" + x.replace("'", "''") + "'" for x in _ODD) + f"][CAST(p_partkey % {len(_ODD)} AS INTEGER) + 1]"
# what compatibility decomposition adds to the canonical one, for the letters above
_PLAIN_SQL = "upper(replace(replace(replace(strip_accents(n), '½', '1⁄2'), 'ﬁ', 'fi'), 'ß', 'SS'))"


def _odd_names(spark, sf_dir):
    odd = F.element_at(F.array(*[F.lit(x) for x in _ODD]), (F.col("p_partkey") % len(_ODD) + 1).cast("int"))
    return M.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", odd).alias("n"))


_LETTERS = r"[^\p{L}\p{N}^]+"


@query("search_key", f"SELECT p_partkey, trim(regexp_replace(regexp_replace(replace({_PLAIN_SQL}, '&', ' AND '), '[''’]', '', 'g'), '{_LETTERS}', ' ', 'g')) AS key FROM (SELECT p_partkey, {_ODD_SQL} AS n FROM part)")
def search_key(spark, sf_dir):
    return T.with_key(_odd_names(spark, sf_dir), "n", "key").drop("n")


@query("company_key", f"SELECT p_partkey, regexp_replace(trim(regexp_replace({_PLAIN_SQL}, '[^A-Z0-9]+', ' ', 'g')), '((^| )({'|'.join(T.SUFFIXES)}))+$', '') AS key FROM (SELECT p_partkey, {_ODD_SQL} AS n FROM part)")
def company_key(spark, sf_dir):
    return T.with_key(_odd_names(spark, sf_dir), "n", "key", T.company_key).drop("n")


@query("official_url_filter", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 'https://disclosures.house.gov/' || o_orderkey WHEN o_orderkey % 4 = 2 THEN 'https://sec.gov/x?id=' || o_orderkey END AS link FROM orders")
def official_url_filter(spark, sf_dir):
    k = F.col("o_orderkey")
    s = k.cast("string")
    url = F.when(k % 4 == 0, F.concat(F.lit("http://sec.gov/"), s)).when(k % 4 == 1, F.concat(F.lit("https://disclosures.house.gov/"), s)).when(k % 4 == 2, F.concat(F.lit("https://sec.gov/x?id="), s)).otherwise(F.concat(F.lit("https://notsec.gov.example.com/"), s))
    return M.table(spark, sf_dir, "orders").select("o_orderkey", T.official_url(url).alias("link"))


@query("bounded_text", "SELECT page_id, substr(trim(replace(replace(html, chr(13), ' '), chr(10), ' ')), 1, 80) AS head FROM pages")
def bounded_text(spark, sf_dir):
    return M.table(spark, sf_dir, "pages").select("page_id", T.bounded_text(F.col("html"), 80).alias("head"))


@query("row_fingerprint", S.over(S.CONGRESS, body="SELECT trade_id, sha256(upper(trim(member)) || '|' || upper(symbol) || '|' || trade_type || '|' || amount || '|' || CAST(transaction_date AS VARCHAR)) AS fingerprint FROM congress"))
def row_fingerprint(spark, sf_dir):
    t = M.congress_trades(spark, sf_dir)
    return t.select("trade_id", T.fingerprint(*[F.col(c) for c in ("member", "symbol", "trade_type", "amount", "transaction_date")]).alias("fingerprint"))


@query("period_label", S.over(*B, body="""SELECT symbol, ts, CASE WHEN month(ts) = month(e) THEN strftime(ts, '%-d') WHEN year(ts) = year(e) THEN strftime(ts, '%-d %b') ELSE strftime(ts, '%-d %b %Y') END || '–' || strftime(e, '%-d %b %Y') AS label FROM (SELECT *, ts + INTERVAL 4 DAYS AS e FROM bars)"""))
def period_label(spark, sf_dir):
    return M.bars(spark, sf_dir).select("symbol", "ts", T.period_label(F.col("interval"), F.col("ts")).alias("label"))


@query("score_band", S.over(*B, body="SELECT symbol, ts, CASE WHEN volume % 101 < 75 THEN 'LOW' WHEN volume % 101 < 85 THEN 'MEDIUM' ELSE 'HIGH' END AS band FROM bars"))
def score_band(spark, sf_dir):
    from tidemark.operators.patterns import band

    return M.bars(spark, sf_dir).select("symbol", "ts", band(F.col("volume") % 101).alias("band"))


@query("parse_score_reason", S.over(*B, body="SELECT symbol, ts, 'Momentum' AS category, volume % 16 + 0.5::DOUBLE AS earned, 15.0::DOUBLE AS maximum, CASE WHEN volume % 16 + 0.5 >= 15 THEN 'FULL' ELSE 'PARTIAL' END AS status, 'RSI was ' || volume AS detail_1, 'turn was aligned (+3/3)' AS detail_2 FROM bars"))
def parse_score_reason(spark, sf_dir):
    v = F.col("volume")
    text = F.concat(F.lit("Momentum +"), (v % 16).cast("string"), F.lit(".5/15: RSI was "), v.cast("string"), F.lit("; turn was aligned (+3/3)"))
    df = M.bars(spark, sf_dir).select("symbol", "ts", T.score_reason(text).alias("r"))
    return df.select("symbol", "ts", "r.category", "r.earned", "r.maximum", "r.status", F.get("r.details", F.lit(0)).alias("detail_1"), F.get("r.details", F.lit(1)).alias("detail_2"))


@query("latest_n_per_key", S.over(*B, body=f"SELECT {COLS} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 20"))
def latest_n_per_key(spark, sf_dir):
    return G.latest_n(store.of_interval(spark, M.stored_bars(spark, sf_dir), "1wk").select(*M.BAR), 20)


@query("keyset_page", S.over(*B, body=f"SELECT {COLS}, true AS has_more, min(ts) OVER () AS next_cursor FROM (SELECT * FROM bars WHERE symbol = 'Brand#3' AND ts < TIMESTAMP '2000-01-01' ORDER BY ts DESC LIMIT 50)"))
def keyset_page(spark, sf_dir):
    return G.keyset_page(M.bars(spark, sf_dir), "Brand#3", "1wk", "2000-01-01", 50)


@query("changed_bars_upsert", S.over(*B, body=f"""SELECT symbol, "interval", ts, open, high, low, CASE WHEN k % 3 = 0 THEN close + 1 ELSE close END AS close, volume, CASE WHEN k % 5 = 0 THEN 'INSERT' ELSE 'UPDATE' END AS change FROM (SELECT *, epoch(ts)::BIGINT // 604800 AS k FROM bars) WHERE k % 5 = 0 OR k % 3 = 0"""))
def changed_bars_upsert(spark, sf_dir):
    b = M.bars(spark, sf_dir).withColumn("k", F.expr("unix_timestamp(ts) DIV 604800"))
    new = b.withColumn("close", F.when(F.col("k") % 3 == 0, F.col("close") + 1).otherwise(F.col("close")))
    batch = b.withColumn("seq", F.lit(1)).unionByName(new.withColumn("seq", F.lit(2))).drop("k")
    return G.changed_upsert(b.filter("k % 5 <> 0").drop("k"), batch, "seq")


@query("provider_fallback", S.over(*B, body=f"""SELECT {COLS}, provider FROM (SELECT *, CASE WHEN p >= 100 OR p >= q THEN 'primary' ELSE 'secondary' END AS chosen FROM (
  SELECT *, count(*) FILTER (provider = 'primary') OVER (PARTITION BY symbol) AS p, count(*) FILTER (provider = 'secondary') OVER (PARTITION BY symbol) AS q FROM (
  SELECT *, 'primary' AS provider FROM bars WHERE length(symbol) = 8 OR ts < TIMESTAMP '1996-01-01' UNION ALL SELECT *, 'secondary' AS provider FROM bars))) WHERE provider = chosen"""))
def provider_fallback(spark, sf_dir):
    b = M.bars(spark, sf_dir)
    return G.provider_fallback(b.filter("length(symbol) = 8 OR ts < '1996-01-01'"), b, 100)


@query("history_boundary", S.over(*B, body="SELECT symbol, min(ts) AS oldest, bool_or(volume > 300) AS end_reached FROM bars GROUP BY symbol"))
def history_boundary(spark, sf_dir):
    return M.bars(spark, sf_dir).groupBy("symbol").agg(F.min("ts").alias("oldest"), F.bool_or(F.col("volume") > 300).alias("end_reached"))


@query("disclosure_upsert", S.over(S.CONGRESS, body="""SELECT 'congress' AS provider, f AS fingerprint, amount, CASE WHEN a THEN DATE '2000-01-01' ELSE DATE '2000-02-01' END AS first_seen, CASE WHEN b THEN DATE '2000-02-01' ELSE DATE '2000-01-01' END AS last_seen, NOT a AS inserted
FROM (SELECT sha256('' || trade_id) AS f, amount, trade_id % 3 <> 0 AS a, trade_id % 2 = 0 AS b FROM congress) WHERE a OR b"""))
def disclosure_upsert(spark, sf_dir):
    t = M.congress_trades(spark, sf_dir).select("trade_id", F.lit("congress").alias("provider"), T.fingerprint(F.col("trade_id")).alias("fingerprint"), "amount")
    seen = lambda d: {"first_seen": F.lit(d).cast("date"), "last_seen": F.lit(d).cast("date")}
    return G.disclosure_upsert(t.filter("trade_id % 3 <> 0").drop("trade_id").withColumns(seen("2000-01-01")), t.filter("trade_id % 2 = 0").drop("trade_id").withColumns(seen("2000-02-01")))


@query("bars_from_array_json", S.over(*B, body=f"SELECT {COLS} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 50"))
def bars_from_array_json(spark, sf_dir):
    b = M.bars(spark, sf_dir).withColumn("year", F.year("ts"))
    arrays = F.struct(F.collect_list(F.unix_timestamp("ts")).alias("timestamp"), *[F.collect_list(c).alias(c) for c in G.VALUES])
    return G.parallel_arrays(b.groupBy("symbol", "interval", "year").agg(F.to_json(arrays).alias("json")), 50)


@query("bars_from_object_json", S.over(*B, body="SELECT symbol, \"interval\", ts, open, high, low, close, CASE WHEN volume % 2 = 0 THEN volume ELSE 0 END AS volume FROM bars WHERE ts < TIMESTAMP '2000-01-01'"))
def bars_from_object_json(spark, sf_dir):
    b = M.bars(spark, sf_dir).withColumn("volume", F.when(F.col("volume") % 2 == 0, F.col("volume").cast("string")))
    rows = F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime"), *[F.col(c).cast("string").alias(c) for c in G.VALUES]))
    return G.object_rows(b.groupBy("symbol", "interval", F.year("ts")).agg(F.to_json(F.struct(rows.alias("values"))).alias("json")), "2000-01-01")


@query("congress_from_json", S.over(S.CONGRESS, body="SELECT trade_id, member, symbol, trade_type, amount, transaction_date FROM congress WHERE trade_id % 10 <> 3"))
def congress_from_json(spark, sf_dir):
    t = M.congress_trades(spark, sf_dir)
    row = F.struct(F.col("trade_id").alias("id"), "member", F.lower("symbol").alias("ticker"), F.lower("trade_type").alias("trade_type"), "amount", F.when(F.col("trade_id") % 10 == 3, "n/a").otherwise(F.col("transaction_date").cast("string")).alias("tx_date"))
    landed = t.groupBy(F.col("trade_id") % 50).agg(F.to_json(F.struct(F.collect_list(row).alias("trades"))).alias("json"))
    p = landed.select(F.explode(F.from_json("json", "struct<trades:array<struct<id:bigint,member:string,ticker:string,trade_type:string,amount:string,tx_date:string>>>")["trades"]).alias("t"))
    return p.select(F.col("t.id").alias("trade_id"), "t.member", F.regexp_replace(T.symbol_name(F.col("t.ticker")), "^BRAND", "Brand").alias("symbol"), T.trade_type(F.col("t.trade_type")).alias("trade_type"), "t.amount", F.col("t.tx_date").try_cast("date").alias("transaction_date")).filter("transaction_date IS NOT NULL")


@query("insider_from_json", S.over(S.TICKS, S.FLAGS, S.INSIDERS, body="SELECT trade_id, CASE code WHEN 'P' THEN 'PURCHASE' ELSE 'SALE' END AS trade_type, filed AS transaction_date, shares, price FROM insiders WHERE price > 0 AND shares > 0"))
def insider_from_json(spark, sf_dir):
    t = M.insider_trades(spark, sf_dir)
    row = F.to_json(F.struct("trade_id", F.col("code").alias("transaction_code"), F.col("filed").cast("string").alias("filing_date"), F.col("shares").cast("string").alias("shares"), F.col("price").cast("string").alias("transaction_price")))
    p = t.select(F.from_json(row, "struct<trade_id:string,transaction_code:string,filing_date:string,shares:string,transaction_price:string>").alias("t"))
    return p.select("t.trade_id", T.trade_type(F.col("t.transaction_code")).alias("trade_type"), F.col("t.filing_date").try_cast("date").alias("transaction_date"), F.col("t.shares").try_cast("decimal(24,6)").alias("shares"), F.col("t.transaction_price").try_cast("decimal(24,6)").alias("price")).filter("price > 0 AND shares > 0")


@query("universe_eligibility", S.over(S.TICKS, S.bars("1d"), body="SELECT symbol, min(ts) AS first, max(ts) AS last, count(*) AS bars, CASE WHEN max(ts) >= TIMESTAMP '2001-10-01' THEN 'ACTIVE' ELSE 'ENDED' END AS cohort FROM bars GROUP BY symbol HAVING count(*) >= 1000 AND date_diff('day', min(ts), max(ts)) >= 1500 AND NOT bool_or(NOT (high >= greatest(open, close) AND low <= least(open, close) AND low > 0))"))
def universe_eligibility(spark, sf_dir):
    return G.universe(M.bars(spark, sf_dir, "1d"), 1000, 1500)


@query("load_universe", S.over(S.TICKS, S.bars("1d"), S.ASSETS, body="""SELECT kind, value, count(*) AS rows, count(DISTINCT symbol) AS symbols, CAST(0 AS BIGINT) AS bad, CAST(sum(n) AS BIGINT) AS daily_candles, count(DISTINCT symbol) FILTER (core) AS shared FROM (
  SELECT symbol, n, instrument_type = 'ETF' AS core, unnest([{'kind': 'ALL', 'value': 'ALL'}, {'kind': 'role', 'value': CASE WHEN k % 5 = 0 THEN 'HOLDOUT' ELSE 'DEVELOPMENT' END},
    {'kind': 'cap_tier', 'value': CASE k % 3 WHEN 0 THEN 'LARGE' WHEN 1 THEN 'MID' ELSE 'SMALL' END}, {'kind': 'cohort', 'value': CASE WHEN last >= TIMESTAMP '2001-10-31' THEN 'ACTIVE' ELSE 'ENDED' END}], recursive := true)
  FROM (SELECT symbol, count(*) AS n, max(ts) AS last, CAST(split_part(symbol, '#', 2) AS INTEGER) AS k FROM bars GROUP BY symbol) JOIN assets USING (symbol)) GROUP BY kind, value"""))
def load_universe(spark, sf_dir):
    """The assets with daily bars as a manifest, written, read back and checked against a core list (the funds)."""
    a, k = M.assets(spark, sf_dir), F.split_part("symbol", F.lit("#"), F.lit(2)).cast("int")
    held = M.bars(spark, sf_dir, "1d").groupBy("symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("daily_candles"), F.sum("volume").alias("traded")).join(a, "symbol")
    manifest = held.select(
        "symbol", F.col("company").alias("name"), F.split_part("kind", F.lit(" "), F.lit(1)).alias("sector"), F.when(k % 3 == 0, "LARGE").when(k % 3 == 1, "MID").otherwise("SMALL").alias("cap_tier"),
        F.when(F.col("last") >= "2001-10-31", "ACTIVE").otherwise("ENDED").alias("cohort"), F.when(k % 5 == 0, "HOLDOUT").otherwise("DEVELOPMENT").alias("role"),
        F.to_date("first").alias("first_date"), F.to_date("last").alias("last_date"), "daily_candles", F.when(k % 2 == 0, F.col("traded")).alias("market_cap_usd"),
    )
    at = files.shared_folder(spark, "universe")
    universe.write_manifest(manifest, at)
    return universe.counts(universe.load_manifest(spark, at), a.filter("instrument_type = 'ETF'"))


@query("latest_quote", S.over(*B, body="SELECT symbol, \"interval\", ts, close, round((close - coalesce(p, open)) / coalesce(p, open) * 100, 6) AS change FROM (SELECT *, lag(close) OVER w AS p, lead(ts) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)) WHERE n IS NULL"))
def latest_quote(spark, sf_dir):
    return G.latest_quote(M.bars(spark, sf_dir))
