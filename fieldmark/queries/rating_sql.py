"""The rating folds as recursive SQL, for the check beside DuckDB: one game of every league a step.

A league's ratings are a list by team number.  Each text defines the relation
``scored``: config, game_id, league, game_date, home, away, home_before,
away_before, p_home, home_after, away_after.
"""

from __future__ import annotations

from ..operators.ratings import GlickoState, RatingSpec

GAMES = "SELECT game_id, league, game_date, home, away, home_score - away_score AS margin, is_neutral FROM games WHERE status <> 'scheduled'"
OUT = "game_id, league, game_date, home, away, home_before, away_before, p_home, home_after, away_after"


def _real(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def _put(items: str, at: str, value: str) -> str:
    return f"list_concat(list_concat({items}[1:{at}], [{value}]), {items}[{at} + 2:])"


def elo_sql(configs: dict[str, RatingSpec], games: str = GAMES, teams: int = 30) -> str:
    """``scored`` for each named spec; games: the rows to fold, with -1 for a side that is unknown."""
    rows = ", ".join(
        f"('{name}', {_real(s.k)}, {_real(s.home)}, {_real(s.start)}, {s.margin}, {s.soft}, {_real(s.recency)}, "
        f"{'CAST(NULL AS DOUBLE)' if s.carry is None else _real(s.carry)}, {s.to_mean}, {_real(s.half_life)}, {s.novice})"
        for name, s in configs.items()
    )
    nulls = lambda kind: f"[CAST(NULL AS {kind}) FOR x IN range({teams})]"
    now = lambda x: f"CASE WHEN half_life > 0 AND d[{x} + 1] IS NOT NULL THEN start + ({x}_held - start) * exp(-ln(2) * date_diff('day', d[{x} + 1], game_date) / half_life) ELSE {x}_held END"
    both = lambda items, a, b: _put(_put(items, "home", a), "away", b)
    return f"""WITH RECURSIVE cfg AS (SELECT * FROM (VALUES {rows}) v(config, k, lift, start, by_margin, soft, recency, carry, to_mean, half_life, novice)),
g AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY game_date, game_id) AS i FROM ({games})),
f(config, i, {OUT}, r, c, d, last) AS (
SELECT config, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), league, CAST(NULL AS DATE), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 0.0e0, 0.0e0, 0.0e0, 0.0e0, 0.0e0,
  {nulls('DOUBLE')}, [CAST(0 AS BIGINT) FOR x IN range({teams})], {nulls('DATE')}, CAST(NULL AS DATE) FROM cfg CROSS JOIN (SELECT DISTINCT league FROM g)
UNION ALL
SELECT config, i, game_id, league, game_date, home, away, h, a, p, CASE WHEN known THEN h2 ELSE h END, CASE WHEN known THEN a2 ELSE a END,
  CASE WHEN known THEN {both('base', 'h2', 'a2')} ELSE base END, CASE WHEN known THEN {both('c', 'ch + 1', 'ca + 1')} ELSE c END,
  CASE WHEN known THEN {both('d', 'game_date', 'game_date')} ELSE d END, CASE WHEN known THEN game_date ELSE last END
FROM (SELECT *, h + delta * CASE WHEN ch < novice THEN 1.5e0 ELSE 1.0e0 END AS h2, a - delta * CASE WHEN ca < novice THEN 1.5e0 ELSE 1.0e0 END AS a2
FROM (SELECT *, k * ((CASE WHEN by_margin THEN ln(greatest(abs(margin), 1) + 1) * (2.2e0 / (0.001e0 * (lifted - a) + 2.2e0)) ELSE 1.0e0 END)
  * (CASE WHEN recency > 0 AND last IS NOT NULL THEN greatest(0.5e0, least(1.5e0, 1 + recency * (date_diff('day', last, game_date) / 365.0e0))) ELSE 1.0e0 END))
  * (CASE WHEN NOT soft OR margin = 1 THEN CASE WHEN margin > 0 THEN 1.0e0 ELSE 0.0e0 END WHEN margin = 0 THEN 0.5e0 ELSE 1 / (1 + exp(-greatest(-2.0e0, least(2.0e0, margin)))) END - p) AS delta
FROM (SELECT *, CASE WHEN known THEN 1 / (1 + pow(10.0e0, (a - lifted) / 400)) ELSE 0.5e0 END AS p
FROM (SELECT *, h + CASE WHEN is_neutral THEN 0.0e0 ELSE lift END AS lifted
FROM (SELECT *, {now('home')} AS h, {now('away')} AS a
FROM (SELECT *, coalesce(base[home + 1], start) AS home_held, coalesce(base[away + 1], start) AS away_held, coalesce(c[home + 1], 0) AS ch, coalesce(c[away + 1], 0) AS ca, home >= 0 AND away >= 0 AS known
FROM (SELECT *, CASE WHEN carry IS NOT NULL AND last IS NOT NULL AND year(game_date) <> year(last) THEN [mean + (x - mean) * carry FOR x IN r] ELSE r END AS base
FROM (SELECT cfg.*, g.*, f.r, f.c, f.d, f.last, CASE WHEN to_mean THEN list_avg(f.r) ELSE start END AS mean
FROM f JOIN g ON g.league = f.league AND g.i = f.i + 1 JOIN cfg ON cfg.config = f.config))))))))),
scored AS (SELECT config, {OUT} FROM f WHERE i > 0)"""


def glicko_sql(home: float = 100.0, teams: int = 30) -> str:
    """``scored`` of the Glicko-2 fold; its config is 'glicko'."""
    scale, stiff, steps = _real(GlickoState.SCALE), _real(GlickoState.TAU**2), GlickoState.HALVINGS
    start = [_real(x) for x in GlickoState.START]
    full = lambda x: f"[{x} FOR x IN range({teams})]"
    pick = lambda side: ", ".join(f"{items}[{side} + 1] AS {side}_{items}" for items in ("r", "rd", "vol"))

    def seen(me: str, other: str, lift: str) -> str:
        mine, theirs = f"(({me}_r - 1500) / {scale})", f"(({other}_r + {lift} - 1500) / {scale})"
        return f"{mine} AS {me}_mu, {me}_rd / {scale} AS {me}_phi, 1 / sqrt(1 + 3 * pow({other}_rd / {scale}, 2) / pow(pi(), 2)) AS {me}_w, {theirs} AS {me}_faced"

    chance = lambda x: f"1 / (1 + exp(-{x}_w * ({x}_mu - {x}_faced))) AS {x}_e"
    info = lambda x, y: f"{x}_w * {x}_w * {x}_e * (1 - {x}_e) AS {x}_info, {x}_w * ({y} - {x}_e) AS {x}_surprise"
    gain = lambda x: f"pow((1 / {x}_info) * {x}_surprise, 2) AS {x}_gain, {x}_phi * {x}_phi + 1 / {x}_info AS {x}_spread, ln({x}_vol * {x}_vol) AS {x}_at"

    def volatility(x: str) -> str:
        mid = "((s.low + s.high) / 2)"
        above = f"exp({mid}) * ({x}_gain - {x}_spread - exp({mid})) / (2 * ({x}_spread + exp({mid})) * ({x}_spread + exp({mid}))) > ({mid} - {x}_at) / {stiff}"
        first = f"{{'low': {x}_at - {stiff} / 2, 'high': {x}_at + {stiff} * {x}_gain / (8 * {x}_spread)}}"
        rest = f"[{{'low': 0.0e0, 'high': 0.0e0}} FOR q IN range({steps})]"
        return f"list_reduce(list_concat([{first}], {rest}), lambda s, t: CASE WHEN {above} THEN {{'low': {mid}, 'high': s.high}} ELSE {{'low': s.low, 'high': {mid}}} END) AS {x}_root"

    sigma = lambda x: f"exp(({x}_root.low + {x}_root.high) / 4) AS {x}_sigma"
    tight = lambda x: f"1 / (1 / ({x}_phi * {x}_phi + {x}_sigma * {x}_sigma) + {x}_info) AS {x}_tight"
    after = lambda x: f"1500 + {scale} * ({x}_mu + {x}_tight * {x}_surprise) AS {x}_new, {scale} * sqrt({x}_tight) AS {x}_dev"
    both = lambda items, part: _put(_put(items, "home", f"home_{part}"), "away", f"away_{part}")
    lifted = f"CASE WHEN is_neutral THEN 0.0e0 ELSE {_real(home)} END"
    layers = [
        f"{pick('home')}, {pick('away')}, {lifted} AS lift, CASE WHEN margin > 0 THEN 1.0e0 ELSE 0.0e0 END AS y",
        f"{seen('home', 'away', '0.0e0')}, {seen('away', 'home', 'lift')}, 1 / (1 + exp(-(home_r + lift - away_r) / {scale} / sqrt(1 + 3 * pow(sqrt(pow(home_rd, 2) + pow(away_rd, 2)) / {scale}, 2) / pow(pi(), 2)))) AS p",
        f"{chance('home')}, {chance('away')}",
        f"{info('home', 'y')}, {info('away', '(1 - y)')}",
        f"{gain('home')}, {gain('away')}",
        f"{volatility('home')}, {volatility('away')}",
        f"{sigma('home')}, {sigma('away')}",
        f"{tight('home')}, {tight('away')}",
        f"{after('home')}, {after('away')}",
    ]
    step = "SELECT g.*, f.r, f.rd, f.vol FROM f JOIN g ON g.league = f.league AND g.i = f.i + 1"
    for layer in layers:
        step = f"SELECT *, {layer} FROM ({step})"
    return f"""WITH RECURSIVE g AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY game_date, game_id) AS i FROM ({GAMES})),
f(i, {OUT}, r, rd, vol) AS (
SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), league, CAST(NULL AS DATE), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 0.0e0, 0.0e0, 0.0e0, 0.0e0, 0.0e0,
  {full(start[0])}, {full(start[1])}, {full(start[2])} FROM (SELECT DISTINCT league FROM g)
UNION ALL
SELECT i, game_id, league, game_date, home, away, home_r, away_r, p, home_new, away_new, {both('r', 'new')}, {both('rd', 'dev')}, {both('vol', 'sigma')} FROM ({step})),
scored AS (SELECT 'glicko' AS config, {OUT} FROM f WHERE i > 0)"""
