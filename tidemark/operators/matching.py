"""Joins of signals and disclosures with rules, subscriptions and assets; search and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import company_key


def match_rules(signals: DataFrame, rules: DataFrame, recorded: DataFrame) -> DataFrame:
    """Signals of active rules on symbol, interval and side, without those recorded (rule, pattern, ts)."""
    live = rules.filter("active").select("rule_id", "user_id", "symbol", "interval", F.col("side").alias("direction"), "family")
    found = signals.join(live.filter("family = 'CANDLESTICK'"), ["symbol", "interval", "direction"])
    return found.join(recorded.select("rule_id", "pattern", "ts"), ["rule_id", "pattern", "ts"], "left_anti")


def match_wave_rules(signals: DataFrame, rules: DataFrame, recorded: DataFrame) -> DataFrame:
    """First signal of each cycle and stage for every active wave rule on symbol, interval and side,
    without cycles and stages that the rule has recorded (rule_id, cycle_key, stage).

    signals have symbol, interval, direction (the side), cycle_key, stage, ts, pattern; those without
    a cycle match nothing. Signals are cut to the first of each cycle and stage before rules meet them."""
    cycle = ["symbol", "interval", "direction", "cycle_key", "stage"]
    first = signals.filter("cycle_key IS NOT NULL").groupBy(*cycle).agg(F.min(F.struct("ts", "pattern")).alias("s")).select(*cycle, "s.ts", "s.pattern")
    live = rules.filter("active AND family = 'ELLIOTT'").select("rule_id", "user_id", "symbol", "interval", F.col("side").alias("direction"))
    return first.join(live, ["symbol", "interval", "direction"]).join(recorded.select("rule_id", "cycle_key", "stage"), ["rule_id", "cycle_key", "stage"], "left_anti")


def with_read(events: DataFrame, reads: DataFrame) -> DataFrame:
    """events (user_id, symbol, sent_at and more) with read_at: when their user first opened the
    symbol (reads: user_id, symbol, read_at) at or after they were sent; null while unread.

    An as-of join by one window over both, from the newest back, so that no event meets
    every later reading. Readings or events without user, symbol or time match nothing."""
    more = [c for c in events.columns if c not in ("user_id", "symbol", "sent_at")]
    e = events.select("user_id", "symbol", F.col("sent_at").alias("_at"), F.lit(1).alias("_asks"), F.lit(None).cast("timestamp").alias("read_at"), F.struct(F.lit(True).alias("_is"), *more).alias("_event"))
    r = reads.filter("user_id IS NOT NULL AND symbol IS NOT NULL AND read_at IS NOT NULL")
    r = r.select("user_id", "symbol", F.col("read_at").cast("timestamp").alias("_at"), F.lit(0).alias("_asks"), F.col("read_at").cast("timestamp").alias("read_at"), F.lit(None).cast(e.schema["_event"].dataType).alias("_event")).distinct()
    w = Window.partitionBy("user_id", "symbol").orderBy(F.desc_nulls_first("_at"), "_asks").rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(r).withColumn("read_at", F.when(F.col("_at").isNotNull(), F.last("read_at", ignorenulls=True).over(w)))
    return both.filter("_asks = 1").select("user_id", "symbol", F.col("_at").alias("sent_at"), *[F.col(f"_event.{c}").alias(c) for c in more], "read_at")


def company_board(rules: DataFrame, events: DataFrame) -> DataFrame:
    """Per symbol: rules, active ones, their intervals, families and sides, and unread events of active
    rules. events have rule_id and read_at; they are counted per rule before the join."""
    unread = events.filter("read_at IS NULL").groupBy("rule_id").agg(F.count("*").alias("unread"))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    held = rules.join(unread, "rule_id", "left")
    return held.groupBy("symbol").agg(
        F.count("*").alias("rules"), F.count_if("active").alias("live"), names("interval").alias("intervals"), names("family").alias("families"), names("side").alias("sides"),
        F.coalesce(F.sum(F.when(F.col("active"), F.col("unread"))), F.lit(0)).cast("long").alias("unread"),
    )


def latest_signals(rules: DataFrame, events: DataFrame, k: int = 8) -> DataFrame:
    """Newest k unread events of each user's active rules (then by pattern, then rule)."""
    mine = events.filter("read_at IS NULL").join(rules.filter("active").select("rule_id"), "rule_id", "left_semi")
    w = Window.partitionBy("user_id").orderBy(F.desc("sent_at"), "pattern", "rule_id")
    return mine.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


#: Followers of a group in a task, on average, and in a block; trades of a group in a part, on average, and the least parts that they are dealt in.
AUDIENCE, BLOCK, TRADES, DEALS = 4096, 256, 16384, 16
#: What a follower's dates ask of a trade: seen since the baseline, disclosed since the activation.
DATES, DUE = ("baseline", "activated"), "first_seen >= baseline AND disclosed >= activated"


def audience(subscriptions: DataFrame, by: tuple[str, ...] = ("symbol",), alike: tuple[str, ...] = ()) -> DataFrame:
    """Active followers whose baseline is done, in blocks."""
    return blocks(subscriptions.filter("active AND baseline IS NOT NULL"), by, alike)


def blocks(followers: DataFrame, by: tuple[str, ...], alike: tuple[str, ...]) -> DataFrame:
    """Followers (user_id) in blocks of one group (`by`) that are alike in some columns: by, alike, users. What these
    columns ask of a trade is so asked once a block. Blocks have BLOCK users, the last of some AUDIENCE fewer."""
    live = followers.select(*by, *alike, "user_id").withColumn("_class", F.xxhash64(*by, *alike))
    rows = live.groupBy("_class").agg(F.ceil(F.count("*") / AUDIENCE).alias("_rows"))
    dealt = live.join(rows, "_class").withColumn("_row", F.pmod(F.xxhash64("user_id"), F.col("_rows")))
    held = dealt.groupBy(*by, *alike, "_row").agg(F.collect_list("user_id").alias("_users"))
    cut = F.transform(F.sequence(F.lit(0), F.size("_users") - 1, F.lit(BLOCK)), lambda k: F.slice("_users", k + 1, BLOCK))
    return held.select(*by, *alike, F.explode(cut).alias("users"))


def reached(trades: DataFrame, followers: DataFrame, by: tuple[str, ...] = ("symbol",), where: str = "true", also: tuple[str, ...] = ()) -> DataFrame:
    """Each trade (trade_id, by and more) with every follower of its group whose block it meets by `where`: trade_id, `also`
    (expressions over a trade and a block), user_id.

    Only trades and audiences are shuffled; the pairs are made in the task that writes them, so they
    are never sorted, moved or held. A group's trades are dealt in parts, with a copy of its audience each.
    A block of followers meets a part's trades one after the other: for thousands of rows few ids recur, in runs
    and in one order, which files keep in a fraction of the bytes that they need for any other order.
    """
    on = [*by, "_deal"]
    parts = int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deals = F.broadcast(trades.groupBy(*by).agg(F.greatest(F.ceil(F.count("*") / TRADES), F.lit(DEALS)).alias("_deals")))
    t = trades.join(deals, [*by]).withColumn("_deal", F.pmod(F.xxhash64("trade_id"), F.col("_deals"))).drop("_deals").repartition(parts, *on)
    a = followers.join(deals, [*by]).withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_deals") - 1))).drop("_deals")
    # merged: were one side broadcast, the few rows of the other would make all pairs in a task or two.
    # The trades stand on the right, which is gone through anew for each row of the left. The condition is put as a lambda,
    # which isn't compiled with what follows: else the pairs of a block with all trades of a part would be held before any is written.
    met = F.exists(F.array(F.expr(where)), lambda due: due)
    return a.hint("merge").join(t, on).filter(met).selectExpr("trade_id", *also, "explode(users) AS user_id")


def _fanout(trades: DataFrame, subscriptions: DataFrame, deliveries: DataFrame, alike: tuple[str, ...] = (), where: str = "true") -> DataFrame:
    """Trades with their followers, without what is delivered. A delivery names a user (trade_id, user_id)
    or a segment of the subscriptions (trade_id, segment), all of whose users then have the trade."""
    if "segment" not in deliveries.columns:
        pairs = reached(trades, audience(subscriptions, alike=alike), where=where)
        return pairs.join(deliveries.select("trade_id", "user_id"), ["trade_id", "user_id"], "left_anti")
    gone = deliveries.groupBy("trade_id").agg(F.collect_set("segment").alias("_gone"))
    asked = f"({where}) AND (_gone IS NULL OR segment IS NULL OR NOT array_contains(_gone, segment))"
    return reached(trades.join(gone, "trade_id", "left"), audience(subscriptions, alike=(*alike, "segment")), where=asked)


def congress_fanout(trades: DataFrame, subscriptions: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Deliveries to make: active followers whose baseline is done, of trades seen
    since the baseline and disclosed since the activation, not delivered yet."""
    return _fanout(trades.select("trade_id", "symbol", "first_seen", "disclosed"), subscriptions, deliveries, DATES, DUE)


def insider_fanout(trades: DataFrame, subscriptions: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Deliveries to make of all trades: active followers whose baseline is done, not delivered yet."""
    return _fanout(trades.select("trade_id", "symbol"), subscriptions, deliveries)


def followed_trades(trades: DataFrame, tracked: DataFrame, since: str) -> DataFrame:
    return trades.filter(F.col("disclosed") >= F.lit(since).cast("date")).join(tracked.select("symbol").distinct(), "symbol", "left_semi")


def latest_close_asof(trades: DataFrame, bars: DataFrame, asof: str, look: int = 10) -> DataFrame:
    """Return of each trade to its symbol's newest positive close among the last
    `look` daily bars completed before `asof`, where that is on or after the trade
    (per cent, two decimals half up; the sign turned for sales; else null)."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    last = bars.filter(F.col("ts") < F.lit(asof).cast("timestamp")).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= look)
    close = last.filter("close > 0").groupBy("symbol").agg(F.max_by("close", "ts").alias("close"), F.max("ts").cast("date").alias("asof"))
    df = trades.join(close, "symbol")
    ratio = F.round((F.col("close").cast("decimal(24,6)") - F.col("price")) / F.col("price"), 8)
    change = F.round(ratio * 100, 2) * F.when(F.col("code") == "S", -1).otherwise(1)
    return df.select("trade_id", "symbol", "code", F.when(F.col("asof") >= F.col("filed"), change.cast("double")).alias("change"))


def changes(log: DataFrame) -> DataFrame:
    """Current state per user and symbol of a follow/unfollow log (seq, at, action)."""
    w = Window.partitionBy("user_id", "symbol").orderBy("seq")
    df = log.withColumn("begins", (F.col("action") == "FOLLOW") & (F.coalesce(F.lag("action").over(w), F.lit("UNFOLLOW")) != "FOLLOW"))
    return df.groupBy("user_id", "symbol").agg((F.max_by("action", "seq") == "FOLLOW").alias("active"), F.max(F.when(F.col("begins"), F.col("at"))).alias("activated"), F.count("*").alias("changes"))


def daily_budget(requests: DataFrame, cap: int) -> DataFrame:
    """Each request's place in its key's UTC day; those beyond the cap flagged."""
    w = Window.partitionBy("key", F.to_date("ts")).orderBy("ts", "id")
    return requests.withColumn("place", F.row_number().over(w)).withColumn("over", F.col("place") > cap)


#: Letters of the prefixes and grams by which keys are found; longer queries are verified.
PREFIX, GRAM = 4, 3


def prefixes(key: Column, most: int = PREFIX) -> Column:
    """Every prefix of a key, up to `most` letters (none of an empty key)."""
    size = F.least(F.length(key), F.lit(most))
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda n: F.substring(key, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def grams(key: Column, most: int = GRAM) -> Column:
    """Every distinct part of a key of 1 to `most` letters."""
    at = F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1)))

    def of(n: int) -> Column:
        return F.filter(F.transform(at, lambda k: F.substring(key, k, F.lit(n))), lambda g: F.length(g) == n)

    return F.array_distinct(F.concat(*[of(n) for n in range(1, most + 1)]))


def search(assets: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best k assets per query by prefix: exact ticker (0), ticker prefix (1), prefix of the name or
    of a word of it (2); then the shorter symbol, then the smaller.

    assets has symbol, ticker_key and name_key, queries has query (empty ones find nothing).
    Keys are indexed under each of their first prefixes; a query meets the keys under its own
    first PREFIX letters, so no product of queries and keys is formed, and a query of one
    letter finds every key. A query's rows are cut to k before they are shuffled to it.
    """
    named = F.concat(F.array(F.col("name_key")), F.split("name_key", " "))
    keys = F.concat(F.array(F.struct(F.col("ticker_key").alias("key"), F.lit(1).alias("rank"))), F.transform(F.array_distinct(named), lambda x: F.struct(x.alias("key"), F.lit(2).alias("rank"))))
    a = assets.select("symbol", F.explode(keys).alias("e")).select("symbol", "e.key", "e.rank").withColumn("start", F.explode(prefixes(F.col("key"))))
    q = queries.select("query").distinct().withColumn("start", F.substring("query", 1, PREFIX))
    hit = q.join(a, "start").filter(F.col("key").startswith(F.col("query")))
    best = hit.groupBy("query", "symbol").agg(F.min(F.when((F.col("rank") == 1) & (F.col("key") == F.col("query")), 0).otherwise(F.col("rank"))).alias("rank"))
    w = Window.partitionBy("query").orderBy("rank", F.length("symbol"), "symbol")
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("query", "place", "symbol", "rank")


def catalog_search(catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """query, symbol, rank of every entry (symbol, values: array of keys) of which a value equals (0),
    begins with (1) or contains (2) the query (a key, too; empty ones find nothing).

    Distinct values are indexed by those of their parts of up to GRAM letters with which a query
    begins (so few that they are broadcast); a query is looked up by its first part and verified,
    and the values that it finds lead back to their entries.
    """
    held = catalog.select("symbol", F.explode("values").alias("value"))
    q = queries.select("query").distinct().filter("query <> ''").withColumn("gram", F.substring("query", 1, GRAM))
    index = held.select("value").distinct().withColumn("gram", F.explode(grams(F.col("value")))).join(F.broadcast(q.select("gram").distinct()), "gram", "left_semi")
    v, x = F.col("value"), F.col("query")
    hit = q.join(index, "gram").filter(v.contains(x)).select("query", "value", F.when(v == x, 0).when(v.startswith(x), 1).otherwise(2).alias("rank"))
    return hit.join(held, "value").groupBy("query", "symbol").agg(F.min("rank").alias("rank"))


# Ranks of an exact symbol, of the symbol with a venue's suffix, of the same
# company (plus ticker distance, at most FAR); penalties of secondary venues.
EXACT, SUFFIXED, COMPANY, FAR = 0, 10, 20, 20
VENUES = {"PNK": 40, "IOB": 25, "FRA": 10, "DUS": 10, "MUN": 10, "STU": 10, "BER": 10, "HAM": 10}


def venue_penalty(venue: Column) -> Column:
    v = F.upper(F.trim(venue))
    named = F.coalesce(*[F.when(v == k, n) for k, n in VENUES.items()])
    return F.when(v.contains("OTC") | v.contains("PINK"), 40).when(v.contains("INTERNATIONAL ORDERBOOK"), 25).otherwise(F.coalesce(named, F.lit(0)))


def ticker_root(symbol: Column) -> Column:
    return F.regexp_replace(F.substring_index(symbol, ".", 1), "[^A-Z0-9]", "")


def candidate_rank(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Listing of each request (request_id, symbol, company, suffix) among candidates
    (symbol, company, venue): the same symbol, the symbol before a dot, or the same
    company at the expected suffix by ticker distance; then the smaller symbol.

    Both sides are keyed by symbol prefixes and company, so only what can match meets;
    requests without a candidate have no row.
    """
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    company = company_key(F.col("company"))
    parts = F.split("symbol", "\\.")
    stems = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: key("symbol", F.array_join(F.slice(parts, F.lit(1), n), ".")))
    c = candidates.select(F.col("symbol").alias("candidate"), "venue", F.explode(F.concat(stems, F.array(key("company", company)))).alias("k"))
    r = requests.select("request_id", "symbol", "suffix", F.explode(F.array(key("symbol", F.col("symbol")), key("company", company))).alias("k"))
    met = r.select("request_id", "symbol", "suffix", "k.kind", "k.key").join(c.select("candidate", "venue", "k.kind", "k.key"), ["kind", "key"]).filter("key <> ''")
    met = met.filter((F.col("kind") == "symbol") | F.col("candidate").endswith(F.coalesce("suffix", F.lit(""))))
    a, b = ticker_root(F.col("symbol")), ticker_root(F.col("candidate"))
    distance = F.when((a == "") | (b == ""), FAR).otherwise(F.least(F.lit(FAR), F.levenshtein(a, b)))
    rank = F.when(F.col("kind") == "company", COMPANY + distance + venue_penalty(F.col("venue"))).when(F.col("symbol") == F.col("candidate"), EXACT).otherwise(SUFFIXED)
    best = met.groupBy("request_id", "symbol").agg(F.min(F.struct(rank.alias("rank"), "candidate")).alias("m"))
    return best.select("request_id", "symbol", "m.candidate", "m.rank")


def page(df: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """Page `number` (from 0) in a total order: only what precedes its end is sorted out."""
    top = df.orderBy(*order).limit((number + 1) * size)
    w = Window.orderBy(*order)  # at most (number + 1) pages
    return top.withColumn("place", F.row_number().over(w)).filter(F.col("place") > number * size)


#: Sorts of the archive and their columns.
SORTS = {"date": "sent_at", "ticker": "symbol", "interval": "interval", "confidence": "confidence", "status": "status", "best-return": "best_return", "worst-return": "worst_return"}


def archive_order(sort: str | None, direction: str | None) -> list[Column]:
    """The archive's order: an unknown sort is by date, a direction other than asc is desc; missing
    values come last either way; then the newest, then the largest id (by date, id follows the direction)."""
    key = (sort or "").lower()
    key, up = key if key in SORTS else "date", (direction or "").lower() == "asc"
    first = F.asc_nulls_last(SORTS[key]) if up else F.desc_nulls_last(SORTS[key])
    if key == "date":
        return [first, F.asc("id") if up else F.desc("id")]
    return [first, F.desc("sent_at"), F.desc("id")]


def archive_page(events: DataFrame, sort: str | None = None, direction: str | None = None, number: int = 0, size: int = 50) -> DataFrame:
    """Page `number` (from 0) of events (id, sent_at, symbol, interval, confidence, status, best_return,
    worst_return) with each one's place."""
    return page(events, archive_order(sort, direction), max(0, number), size)


# ------------------------------------------------------------ anchored profile


def anchored_bins(bars: DataFrame, anchors: DataFrame, bins: int = 48) -> DataFrame:
    """Volume by price from each symbol's anchor on: spread by overlap length, the
    last bin taking the remainder, split into rising and falling bars."""
    df = bars.join(anchors, "symbol").filter("ts >= anchor")
    edge = df.groupBy("symbol", "anchor").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    df = df.join(edge, ["symbol", "anchor"]).withColumn("w", (F.col("hi") - F.col("lo")) / float(bins))
    at = lambda p: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((p - F.col("lo")) / F.col("w")).cast("int")))
    df = df.filter("volume > 0 AND w > 0").withColumns({"flat": F.col("high") <= F.col("low"), "a": F.when(F.col("high") <= F.col("low"), at(F.col("close"))).otherwise(at(F.col("low"))), "b": F.when(F.col("high") <= F.col("low"), at(F.col("close"))).otherwise(at(F.col("high")))})
    df = df.withColumn("bin", F.explode(F.sequence("a", "b")))
    low = F.col("lo") + F.col("bin") * F.col("w")
    high = F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(low + F.col("w"))
    # the last bin's remainder is what lies above its lower edge
    share = F.when(F.col("flat"), 1.0).when(F.col("bin") == F.col("b"), (F.col("high") - F.greatest(low, F.col("low"))) / (F.col("high") - F.col("low"))).otherwise(F.greatest(F.lit(0.0), F.least("high", high) - F.greatest(F.col("low"), low)) / (F.col("high") - F.col("low")))
    df = df.withColumn("v", F.col("volume") * F.greatest(share, F.lit(0.0)))
    up = F.col("close") >= F.col("open")
    return df.groupBy("symbol", "anchor", "bin", "lo", "hi", "w").agg(F.sum("v").alias("volume"), F.sum(F.when(up, F.col("v")).otherwise(0.0)).alias("up"), F.sum(F.when(~up, F.col("v")).otherwise(0.0)).alias("down"))


def anchored_area(profile: DataFrame, bins: int = 48, area: float = 0.70) -> DataFrame:
    """Point of control (first largest bin) and value area, grown to the larger neighbour; equal ones together."""
    held = profile.groupBy("symbol", "anchor", "lo", "w").agg(F.map_from_entries(F.collect_list(F.struct("bin", "volume"))).alias("m"))
    held = held.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.round(F.coalesce(F.try_element_at("m", k), F.lit(0.0)), 6)))
    held = held.withColumn("all", F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).withColumn("top", (F.array_position("v", F.array_max("v")) - 1).cast("int"))
    v = F.col("v")

    def grow(s, _):
        lower = F.when(s["lo"] > 0, F.get(v, s["lo"] - 1)).otherwise(-1.0)
        upper = F.when(s["hi"] < bins - 1, F.get(v, s["hi"] + 1)).otherwise(-1.0)
        more = (s["v"] < F.col("all") * area) & ((s["lo"] > 0) | (s["hi"] < bins - 1))
        both, up = (lower == upper) & (lower >= 0), upper > lower
        return F.struct(
            F.when(more & (both | ~up), s["lo"] - 1).otherwise(s["lo"]).alias("lo"), F.when(more & (both | up), s["hi"] + 1).otherwise(s["hi"]).alias("hi"),
            F.when(more, s["v"] + F.when(both, lower + upper).when(up, upper).otherwise(lower)).otherwise(s["v"]).alias("v"),
        )

    start = F.struct(F.col("top").alias("lo"), F.col("top").alias("hi"), F.get(v, F.col("top")).alias("v"))
    held = held.withColumn("g", F.aggregate(F.sequence(F.lit(1), F.lit(bins)), start, grow))
    price = lambda k: F.round(F.col("lo") + k * F.col("w"), 6)
    return held.select("symbol", "anchor", price(F.col("top") + 0.5).alias("poc"), price(F.col("g.lo")).alias("value_low"), price(F.col("g.hi") + 1).alias("value_high"))
