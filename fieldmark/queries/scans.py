"""Sources and sinks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.core import upsert
from ..sources import files, jdbc
from ..sources.shared import shared_path
from . import query


@query("src_jdbc", "SELECT bet_id, cost FROM bets WHERE sport = 'ASIA' AND cost >= 100000")
def _(t):
    """A database's table, read in four ranges of its key; both conditions go to the server."""
    url = jdbc.embedded(t.spark)
    jdbc.write_table(t.bets.select("bet_id", "sport", "cost"), url, "bets")
    top = t.bets.agg(F.max("bet_id")).first()[0] or 1
    return jdbc.read_table(t.spark, url, "bets", "bet_id", (0, top), 4).where("sport = 'ASIA' and cost >= 100000").select("bet_id", "cost")


@query("src_sql_params", "SELECT bet_id, cost FROM bets WHERE sport = 'ASIA' AND cost >= 100000")
def _(t):
    return t.spark.sql("SELECT bet_id, cost FROM {bets} WHERE sport = :sport AND cost >= :least", args={"sport": "ASIA", "least": 100000}, bets=t.bets)


@query("src_scalar", "SELECT max(observed_at) IS NOT NULL AS has_rows, count(*) AS n FROM quotes")
def _(t):
    return t.quotes.agg(F.max("observed_at").isNotNull().alias("has_rows"), F.count("*").alias("n"))


@query("src_csv_soccer", """SELECT game_id, game_date, CASE WHEN home_score > away_score THEN 'H' WHEN home_score = away_score THEN 'D' ELSE 'A' END AS ftr FROM games WHERE game_id % 11 <> 0""")
def _(t):
    """CSV lines with dates in two formats and some bad rows, parsed as a reader would."""
    r = F.when(F.col("home_score") > F.col("away_score"), "H").when(F.col("home_score") == F.col("away_score"), "D").otherwise("A")
    day = F.when(F.col("game_id") % 2 == 0, F.date_format("game_date", "dd/MM/yyyy")).otherwise(F.date_format("game_date", "dd/MM/yy"))
    lines = t.games.select(F.concat_ws(",", F.col("game_id").cast("string"), day, F.when(F.col("game_id") % 11 == 0, "?").otherwise(r)).alias("value"))
    return files.soccer_rows(lines)


@query("src_csv_enc", "SELECT c_custkey, replace(c_mktsegment, 'A', 'Ä') AS segment FROM customer")
def _(t):
    """Files in two encodings, each read in the one that it is valid in."""
    path = shared_path(t.spark, "encodings")
    rows = t.customer.select("c_custkey", F.replace("c_mktsegment", F.lit("A"), F.lit("Ä")).alias("segment"))
    for i, encoding in enumerate(("UTF-8", "ISO-8859-1")):
        rows.where(F.col("c_custkey") % 2 == i).write.option("header", True).option("encoding", encoding).csv(f"{path}/{i}")
    return files.csv_any_encoding(t.spark, path, "c_custkey bigint, segment string").drop("file")


@query("src_csv_history", "SELECT game_id, 'LEAGUE' || league AS sport, game_date FROM games WHERE game_date >= DATE '1998-01-01'")
def _(t):
    """A tree of history files: the sport is in the path, dates come in the file's own format."""
    path = shared_path(t.spark, "history")
    named = t.games.select("game_id", F.date_format("game_date", "dd/MM/yyyy").alias("day"), F.concat(F.lit("LEAGUE"), F.col("league").cast("string")).alias("history"))
    named.write.partitionBy("history").option("header", True).csv(path)
    rows = files.csv_tree(t.spark, path, "game_id bigint, day string").withColumn("game_date", F.to_date("day", "dd/MM/yyyy"))
    return rows.where(F.col("game_date") >= F.lit("1998-01-01").cast("date")).select("game_id", F.regexp_extract("file", r"/history=(\w+)/", 1).alias("sport"), "game_date")


@query("src_csv_numeric", "SELECT game_id, n_name AS team, home_score FROM games JOIN nation ON home = n_nationkey")
def _(t):
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ("game_id", "home", "home_score")])
    r = t.games.select(F.from_csv(line, "game_id bigint, home bigint, home_score bigint").alias("r")).select("r.*")
    return r.join(F.broadcast(t.nation), F.col("home") == F.col("n_nationkey")).select("game_id", F.col("n_name").alias("team"), "home_score")


@query("src_json_scoreboard", "SELECT game_id, home_score, away_score FROM games")
def _(t):
    team = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}_score").alias("score"))
    doc = t.games.select(F.to_json(F.struct(F.array(F.struct(F.col("game_id").alias("id"), F.array(team("home"), team("away")).alias("teams"))).alias("events"))).alias("value"))
    return files.scoreboard_rows(doc)


@query("src_json_schedule", "SELECT home, max(game_id) AS game_id FROM games GROUP BY 1")
def _(t):
    doc = t.games.select(F.to_json(F.struct(F.array(F.struct("game_id", "home")).alias("games"))).alias("value"))
    rows = doc.select(F.explode(F.from_json("value", "games array<struct<game_id bigint, home bigint>>")["games"]).alias("g")).select("g.*")
    return rows.groupBy("home").agg(F.max("game_id").alias("game_id"))


@query("src_json_pbp", "SELECT event_id, event_type, user_id AS shooter FROM events WHERE event_type IN ('click', 'view')")
def _(t):
    doc = t.events.select(F.to_json(F.struct(F.array(F.struct("event_id", "event_type", F.col("user_id").alias("shooter"))).alias("plays"))).alias("value"))
    plays = doc.select(F.explode(F.from_json("value", "plays array<struct<event_id bigint, event_type string, shooter bigint>>")["plays"]).alias("p")).select("p.*")
    return plays.where(F.col("event_type").isin("click", "view"))


@query("src_json_pitch", "SELECT pitcher, count(*) FILTER (WHERE is_whiff) AS whiffs, count(*) FILTER (WHERE is_csw) AS csw FROM pitches GROUP BY 1")
def _(t):
    p = t.pitches.select(F.to_json(F.struct("pitcher", "is_whiff", "is_csw")).alias("value")).select(F.from_json("value", "pitcher bigint, is_whiff boolean, is_csw boolean").alias("p")).select("p.*")
    return p.groupBy("pitcher").agg(F.count(F.when(F.col("is_whiff"), 1)).alias("whiffs"), F.count(F.when(F.col("is_csw"), 1)).alias("csw"))


@query("src_json_odds", "SELECT market, max(price) FILTER (WHERE bookmaker = 'click') AS home, max(price) FILTER (WHERE bookmaker = 'view') AS away FROM quotes GROUP BY 1")
def _(t):
    outcome = F.struct(F.col("bookmaker").alias("name"), "price")
    doc = t.quotes.select("market", F.to_json(F.struct(F.array(F.struct(F.array(outcome).alias("outcomes"))).alias("bookmakers"))).alias("value"))
    long = files.odds_rows(doc)
    one = lambda n: F.max(F.when(F.col("name") == n, F.col("price")))
    return long.groupBy("market").agg(one("click").alias("home"), one("view").alias("away"))


@query("src_odds_snapshot", """SELECT quote_id, sha256(market || '|' || bookmaker || '|' || strftime(observed_at, '%Y-%m-%dT%H:%M')) AS snapshot_id, round(1 / price, 6) AS implied, observed_at < TIMESTAMP '2024-01-20' AS is_pregame FROM quotes""")
def _(t):
    key = F.concat_ws("|", F.col("market").cast("string"), "bookmaker", F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm"))
    return t.quotes.select("quote_id", F.sha2(key, 256).alias("snapshot_id"), F.round(1 / F.col("price"), 6).alias("implied"), (F.col("observed_at") < "2024-01-20").alias("is_pregame"))


@query("src_markets", "SELECT p_partkey AS market, p_brand, p_type FROM part WHERE p_size % 4 <> 0")
def _(t):
    m = t.part.withColumn("state", F.when(F.col("p_size") % 4 != 0, "active").otherwise("closed"))
    return m.where("state = 'active'").select(F.col("p_partkey").alias("market"), "p_brand", "p_type")


@query("src_files_opps", "SELECT bet_id, sport FROM bets WHERE placed_date >= DATE '1999-06-01'")
def _(t):
    """Daily JSON files per sport; the folders of days gone by are never opened."""
    path = shared_path(t.spark, "opportunities")
    t.bets.select("bet_id", "sport", F.trunc("placed_date", "month").alias("month"), "placed_date").repartition("month").write.partitionBy("month").json(path)
    rows = t.spark.read.json(path, schema="bet_id bigint, sport string, placed_date date, month date")
    return rows.where("month >= DATE '1999-06-01' and placed_date >= DATE '1999-06-01'").select("bet_id", "sport")


@query("snk_upsert", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'old' END AS v FROM orders UNION ALL SELECT o_orderkey + 1000000000, 'new' FROM orders WHERE o_orderkey % 40 = 0""")
def _(t):
    base = t.orders.select(F.col("o_orderkey").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("version"))
    changed = t.orders.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("k"), F.lit("new").alias("v"), F.lit(2).alias("version"))
    fresh = t.orders.where("o_orderkey % 40 = 0").select((F.col("o_orderkey") + 1_000_000_000).alias("k"), F.lit("new").alias("v"), F.lit(2).alias("version"))
    return upsert(base, changed.unionByName(fresh), ["k"], "version").select("k", "v")


@query("snk_upsert_jdbc", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'old' END AS v, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 2 = 1 THEN CAST(o_custkey AS BIGINT) END AS owner FROM orders
UNION ALL SELECT o_orderkey + 1000000000, 'new', NULL FROM orders WHERE o_orderkey % 40 = 0""")
def _(t):
    """A database's table under an upsert of some of its columns: a staging table and one MERGE."""
    url, k = jdbc.embedded(t.spark), F.col("o_orderkey")
    jdbc.execute(t.spark, url, 'CREATE TABLE "held" ("k" BIGINT NOT NULL PRIMARY KEY, "v" VARCHAR(10), "owner" BIGINT)')
    base = t.orders.select(k.alias("k"), F.lit("old").alias("v"), F.when((k % 4 == 0) | (k % 2 == 1), F.col("o_custkey").cast("bigint")).alias("owner"))
    jdbc.write_table(base, url, "held", "append")
    changed = t.orders.where("o_orderkey % 4 = 0").select(k.alias("k"), F.lit("new").alias("v"))
    fresh = t.orders.where("o_orderkey % 40 = 0").select((k + 1_000_000_000).alias("k"), F.lit("new").alias("v"))
    jdbc.upsert_table(changed.unionByName(fresh), url, "held", ["k"])
    return jdbc.read_table(t.spark, url, "held")


@query("snk_insert_df", "SELECT bet_id, sport FROM bets WHERE status = 'open' UNION ALL SELECT bet_id, sport FROM bets WHERE status = 'lost'")
def _(t):
    return files.appended([t.bets.where("status = 'open'").select("bet_id", "sport"), t.bets.where("status = 'lost'").select("bet_id", "sport")])


@query("snk_ratings_csv", "SELECT home AS team, CAST(max(home_score) AS BIGINT) AS rating FROM games GROUP BY 1")
def _(t):
    r = t.games.groupBy(F.col("home").alias("team")).agg(F.max("home_score").alias("rating"))
    return files.through_csv(r, "team bigint, rating bigint")


@query("snk_export_slices", "SELECT o_orderkey, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def _(t):
    """A join slice, exported as CSV and read back."""
    o = t.orders.where((F.col("o_orderdate") >= "1997-01-01") & (F.col("o_orderdate") < "1998-01-01"))
    o = o.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", "c_mktsegment")
    return files.through_csv(o, o.schema)
