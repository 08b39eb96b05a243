"""Queries of games: winners by call, recipients, messages, restored states, and who is still there. Each has SQL of another form."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cards import call_positions, random_grid
from ..functions.patterns import PATTERNS, first_win
from ..operators import replay
from ..operators.running import running
from ..operators.tables import dealt, shared_dir
from ..sources import deltas, gamestate, store
from ..streaming import messages, requests, rounds
from .queries import _lines_sql, _table, registered


def _called() -> list[int]:
    """Seventy-five numbers in an order by hash; after each fifth, the number called four calls before is called again."""
    order = sorted(range(1, 76), key=lambda n: hashlib.md5(f"call-{n}".encode()).hexdigest())
    out: list[int] = []
    for i, n in enumerate(order, 1):
        out.append(n)
        if i % 5 == 0:
            out.append(order[i - 4])
    return out


_CARDS_SQL = (
    "with n as (select unnest(generate_series(1, 75)) as n), o as (select n, row_number() over (order by md5('call-' || n)) as i from n), "
    "calls as (select n, i + (i - 1) // 5 as pos from o), "
    "drawn as (select c_custkey, c_nationkey, n, (n - 1) // 15 as c, row_number() over (partition by c_custkey, (n - 1) // 15 order by md5('card-' || c_custkey || '-' || n)) - 1 as r from customer, n), "
    "cells as (select c_custkey, c_nationkey, r * 5 + c as bit, case when r * 5 + c = 12 then 0 else pos end as pos from drawn join calls using (n) where r < 5), "
    f"lines(line, bit) as (values {_lines_sql()}), "
    "done as (select c_custkey, c_nationkey, line, max(pos) as pos from cells join lines using (bit) group by 1, 2, 3), "
    "w as (select c_custkey, c_nationkey, min(pos) as won from done group by 1, 2)"
)


@registered(
    _CARDS_SQL + " select c_nationkey as game, pos::int as call, n::int as number, count(*) filter (where won = pos)::int as fresh, count(*)::int as winners, "
    "string_agg(c_custkey, ' ' order by c_custkey) filter (where won = pos) as cards from w join calls on won <= pos group by 1, 2, 3"
)
def winner_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each new call of a game: the cards that win by it, and how many hold the pattern after it. Repeated calls announce nothing."""
    calls = _called()
    cards = dealt(_table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_nationkey").alias("game"), "c_custkey", random_grid(F.col("c_custkey"), "card").alias("grid"))
    won = first_win(PATTERNS["standard"], call_positions(F.col("grid"), calls))
    found = replay.winner_lists(cards.select("game", F.col("c_custkey").alias("card"), won.alias("won")), calls)
    return found.select("game", "call", "number", F.size("fresh").alias("fresh"), "winners", F.nullif(F.array_join("fresh", " "), F.lit("")).alias("cards"))


def _winning_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = random_grid(F.col("c_custkey"), "card")
    cards = dealt(_table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_nationkey").alias("game"), F.col("c_custkey").alias("card"), F.col("c_name").alias("player"), grid.alias("grid"))
    return cards.withColumn("won", first_win(PATTERNS["standard"], call_positions(F.col("grid"), _called()))).drop("grid")


@registered(_CARDS_SQL + " select c_nationkey as game, c_custkey as card, c_name as player, pos::int as call, n::int as number from w join customer using (c_custkey, c_nationkey) join calls on pos = won")
def winner_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each card that wins, with its player and the call by which it does."""
    return replay.winner_rows(_winning_cards(spark, sf_dir), _called())[0].drop("won")


@registered(
    _CARDS_SQL + " select c_nationkey as game, pos::int as call, n::int as number, count(*) filter (where won = pos)::bigint as fresh, count(*)::bigint as winners "
    "from w join calls on won <= pos group by 1, 2, 3"
)
def winner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cards of a game win by each call, and how many hold the pattern after it."""
    return replay.winner_rows(_winning_cards(spark, sf_dir), _called())[1]


@registered(
    "with m as (select s_suppkey as message, s_nationkey as game from supplier) "
    "select message, game, 'player' as role, c_custkey::varchar as recipient from m join customer on c_nationkey = game where c_acctbal > 0 "
    "union all select message, game, 'host', n_name from m join nation on n_nationkey = game where n_regionkey <> 2"
)
def recipient_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's message with all that it is sent to: the nation's solvent customers, and its host where there is one."""
    sent = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("message"), F.col("s_nationkey").alias("game"))
    players = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("game"), F.col("c_custkey").alias("player"), (F.col("c_acctbal") > 0).alias("connected"))
    hosts = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("game"), F.when(F.col("n_regionkey") != 2, F.col("n_name")).alias("host"))
    return messages.recipients(sent, players, hosts)


_MESSAGE_SQL = (
    "case when event_id % 11 = 0 then '{not json' when event_id % 13 = 0 then '{\"k\": ' || event_id || '}' when event_id % 17 = 0 then '[]' "
    "else '{\"type\": \"' || case event_type when 'click' then 'submit_number' when 'view' then 'ping' when 'signup' then 'join' when 'purchase' then 'start_game' else 'shrug' end || '\", \"k\": ' || event_id || '}' end"
)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages, some broken, some without a type, some of a type that nobody knows."""
    kinds = {"click": "submit_number", "view": "ping", "signup": "join", "purchase": "start_game", "error": "shrug"}
    kind = F.element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("event_type"))
    key = F.col("event_id")
    whole = F.concat(F.lit('{"type": "'), kind, F.lit('", "k": '), key, F.lit("}"))
    text = F.when(key % 11 == 0, "{not json").when(key % 13 == 0, F.concat(F.lit('{"k": '), key, F.lit("}"))).when(key % 17 == 0, "[]").otherwise(whole)
    return _table(spark, sf_dir, "events").select("event_id", "user_id", text.alias("text"))


_BODY = T.StructType([T.StructField("k", T.LongType())])


@registered(
    f"with m as (select event_id, {_MESSAGE_SQL} as t from events), v as (select event_id, t, json_valid(t) and left(t, 1) = '{{' as good from m), "
    "k as (select event_id, good, case when good then t->>'type' end as type, case when good then (t->>'k')::bigint end as k from v), "
    "r as (select *, case type when 'submit_number' then 'calls' when 'ping' then 'liveness' when 'join' then 'players' when 'start_game' then 'games' end as route from k) "
    "select event_id, type, k, route, case when not good then 'not json' when type is null then 'no type' when route is null then 'unknown type' end as reason from r"
)
def message_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message with its type and route, or why it is in quarantine."""
    return messages.routed(_messages(spark, sf_dir), "text", _BODY).select("event_id", "type", F.col("body.k").alias("k"), "route", "reason")


@registered(
    "with b as (select *, sum((event_type = 'view')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as beat from events), "
    "m as (select *, row_number() over (partition by user_id, beat order by ts, event_id) - case when beat > 0 then 1 else 0 end as missed from b) "
    "select user_id, max(missed)::bigint as worst, count(*) filter (where missed > 3)::bigint as late, count(*) filter (where missed > 10)::bigint as lost from m group by user_id"
)
def liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pings go unanswered in a row, with views as the pongs: more than three is late for a player, more than ten for a host."""
    rows = messages.missed_pongs(_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "view")
    return rows.groupBy("user_id").agg(F.max("missed").alias("worst"), F.count_if(F.col("missed") > 3).alias("late"), F.count_if(F.col("missed") > 10).alias("lost"))


@registered(
    "with a as (select user_id as game, max(ts) as last_activity, arg_max(event_type, (ts, event_id)) as t from events group by 1) "
    "select game from a where t <> 'purchase' and last_activity <= (select max(ts) from events) - interval 30 minute "
    "and not exists (select 1 from events e where e.user_id = game and e.event_type = 'view' and e.event_id % 3 = 0 and e.ts >= timestamp '2024-01-29') "
    "and not exists (select 1 from events e where e.user_id = game and e.event_type = 'signup' and e.event_id % 7 = 0)"
)
def idle_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of users whose host (a purchase last) is gone, with nobody connected or waiting, thirty minutes after the last event or later."""
    events = _table(spark, sf_dir, "events")
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("last")
    games = events.groupBy(F.col("user_id").alias("game")).agg(last)
    host = F.when(F.col("last.event_type") == "purchase", F.col("game"))
    games = games.select("game", host.alias("host"), F.col("last.ts").alias("last_activity"))
    seen = (F.col("event_id") % 3 == 0) & (F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz"))
    players = events.where("event_type = 'view'").select(F.col("user_id").alias("game"), seen.alias("connected"))
    waiters = events.where("event_type = 'signup' and event_id % 7 = 0").select(F.col("user_id").alias("game"))
    now = events.agg(F.max("ts").alias("now"))
    found = games.join(F.broadcast(now))  # one row
    return messages.idle_games(found, players, waiters, F.col("now")).select("game")


_STATE_SQL = (
    "case when event_id % 9 = 0 then '{not json' else '{\"game_id\": \"g' || event_id || '\"' || "
    "case event_type when 'signup' then ', \"status\": \"setup\"' when 'purchase' then ', \"status\": \"in_progress\"' when 'error' then ', \"status\": \"game_over\"' when 'click' then ', \"status\": \"paused\"' else '' end || "
    "case event_id % 4 when 0 then ', \"winning_pattern_name\": \"standard\"' when 1 then ', \"winning_pattern_name\": \"blackout\"' when 2 then ', \"winning_pattern_name\": \"nope\"' else '' end || "
    "case when event_id % 2 = 0 then ', \"last_activity\": \"2024-05-0' || (event_id % 9 + 1) || 'T10:00:00\"' else '' end || '}' end"
)


@registered(
    f"with b as (select event_id, {_STATE_SQL} as t from events), v as (select event_id, t, json_valid(t) as good from b) "
    "select event_id, good as restored, case when good then coalesce(t->>'game_id', '') end as game_id, case when good then case when t->>'status' in ('setup', 'in_progress', 'game_over') then t->>'status' else 'setup' end end as status, "
    "case when good then t->>'winning_pattern_name' end as pattern, case when good then coalesce(t->>'winning_pattern_name' in ('standard', 'blackout'), false) end as wins, "
    "case when good then coalesce(replace(t->>'last_activity', 'T', ' '), '2024-06-01 00:00:00') end as last_activity from v"
)
def game_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games from stored texts: an unknown status is setup, an unknown pattern stays named but gives no wins, broken texts are kept apart."""
    key = F.col("event_id")
    part = lambda name, value: F.concat(F.lit(f', "{name}": "'), value, F.lit('"'))
    status = F.element_at(F.create_map(*map(F.lit, ("signup", "setup", "purchase", "in_progress", "error", "game_over", "click", "paused", "view", ""))), F.col("event_type"))
    pattern = F.element_at(F.array(*map(F.lit, ("standard", "blackout", "nope", ""))), (key % 4 + 1).cast("int"))
    seen = F.when(key % 2 == 0, F.concat(F.lit("2024-05-0"), key % 9 + 1, F.lit("T10:00:00"))).otherwise("")
    fields = [F.when(v != "", part(n, v)).otherwise("") for n, v in (("status", status), ("winning_pattern_name", pattern), ("last_activity", seen))]
    whole = F.concat(F.lit('{"game_id": "g'), key, F.lit('"'), *fields, F.lit("}"))
    rows = _table(spark, sf_dir, "events").select("event_id", F.when(key % 9 == 0, "{not json").otherwise(whole).alias("blob"))
    good, broken = store.restored_games(rows, "blob", ["standard", "blackout"], F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))
    good = good.select(
        "event_id", F.lit(True).alias("restored"), "game_id", "status", F.col("winning_pattern_name").alias("pattern"), "wins",
        F.date_format("last_activity", "yyyy-MM-dd HH:mm:ss").alias("last_activity"),
    )
    none = broken.select("event_id", F.lit(False).alias("restored"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in good.schema.fields[2:]])
    return good.union(none)


@registered(
    "with w as (select user_id, event_id, ts from events where event_type = 'signup'), live as (select distinct user_id from events where event_type = 'view' and ts >= timestamp '2024-01-20') "
    "select event_id from w where user_id in (select user_id from live)"
)
def live_waiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The waiters whose connection is still there."""
    events = _table(spark, sf_dir, "events")
    live = events.where((F.col("event_type") == "view") & (F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))).select("user_id")
    return events.where("event_type = 'signup'").join(live, "user_id", "left_semi").select("event_id")


@registered(
    "with r as (select *, sum((event_type = 'signup')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as round from events), "
    "c as (select * from r where event_type in ('click', 'purchase')) "
    "select v.event_id, (select count(*) from c where c.user_id = v.user_id and c.round = v.round and (c.ts, c.event_id) < (v.ts, v.event_id))::bigint as called, "
    "(select c.event_id from c where c.user_id = v.user_id and c.round = v.round and (c.ts, c.event_id) < (v.ts, v.event_id) order by c.ts desc, c.event_id desc limit 1) as current from r v where v.event_type = 'view'"
)
def catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client that comes back (a view) is told: the calls of the round so far, and the last of them."""
    events = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    rows = running(events, ["user_id"], ["ts", "event_id"], {"round": (F.col("event_type") == "signup").cast("long")})
    call = F.when(F.col("event_type").isin("click", "purchase"), F.col("event_id"))
    rows = running(rows, ["user_id", "round"], ["ts", "event_id"], {"called": call.isNotNull().cast("long")}, {"current": call}, before=True)
    return rows.where("event_type = 'view'").select("event_id", "called", "current")


def round_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a game's messages: signup sets up, purchase starts, error ends, clicks and views call a cell named by day and kind."""
    kinds = {"signup": "setup", "purchase": "start", "error": "over", "click": "call", "view": "call"}
    kind = F.element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("event_type"))
    cell = F.dayofmonth("ts") % 5 * 5 + F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1)
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("game"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), cell.alias("cell"))


_ROUNDS_SQL = (
    "with m as (select user_id as game, ts, event_id as seq, event_type as kind, day(ts) % 5 * 5 + case event_type when 'click' then 0 when 'view' then 1 end as cell from events), "
    "s as (select m.*, (select p.kind from m p where p.game = m.game and p.kind in ('signup', 'purchase', 'error') and (p.ts, p.seq) < (m.ts, m.seq) order by p.ts desc, p.seq desc limit 1) as status, "
    "(select count(*) from m p where p.game = m.game and p.kind = 'signup' and (p.ts, p.seq) < (m.ts, m.seq)) as round from m where kind in ('click', 'view')), "
    "f as (select game, round, cell, min((ts, seq)) as first from s where status = 'purchase' group by 1, 2, 3), "
    "c as (select s.*, case when status is null then 'no_game' when status = 'signup' then 'not_started' when status = 'error' then 'over' when (s.ts, s.seq) > f.first then 'repeat' end as reason from s left join f using (game, round, cell)), "
    "r as (select c.*, (select count(*) from c d where d.game = c.game and d.round = c.round and d.reason is null and (d.ts, d.seq) <= (c.ts, c.seq)) as called from c)"
)


@registered(_ROUNDS_SQL + " select game, seq, round::bigint as round, reason, called::bigint as called from r")
def game_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call with its round, why it is turned away, and the calls that count in the round so far."""
    return rounds.call_verdicts(round_messages(spark, sf_dir), "game", "ts", "seq")


@registered(
    _ROUNDS_SQL
    + ", g as (select game, count(*) filter (where kind = 'signup') as round, arg_max(kind, (ts, seq)) filter (where kind in ('signup', 'purchase', 'error')) as k from m group by game) "
    "select g.game, case k when 'signup' then 'setup' when 'purchase' then 'in_progress' when 'error' then 'game_over' else 'none' end as status, g.round::bigint as round, "
    "count(r.seq)::bigint as called, arg_max(r.seq, (r.ts, r.seq)) as current from g left join r on r.game = g.game and r.round = g.round and r.reason is null group by g.game, k, g.round"
)
def game_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each game's status, round, calls and last call at the end: what a client that comes back is told."""
    return rounds.game_status(round_messages(spark, sf_dir), "game", "ts", "seq")


#: Customers of one stored game.
PLAYERS = 50


@registered(
    _CARDS_SQL + ", whole as (select c_custkey // 50 as key, c_custkey, string_agg(case when r * 5 + c = 12 then '0' else n::varchar end, ' ' order by r * 5 + c) as cells, "
    "count(*) filter (where r * 5 + c = 12 or pos <= 20 + c_custkey // 50 % 30) as marked from drawn join calls using (n) where r < 5 group by 1, 2) "
    "select key::bigint as key, 'p' || c_custkey as player_id, c_name as display_name, 'c' || c_custkey as card_id, cells, marked::int as marked, (20 + key % 30)::int as called, "
    "key % 3 = 0 as wins, 'in_progress' as status, (select count(*) from customer w where w.c_custkey // 50 = key and w.c_acctbal < 0)::bigint as waiters from whole join customer using (c_custkey)"
)
def nested_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of fifty customers with their cards, marks, calls and waiters, saved as JSON texts and restored from them: one row for each card."""
    customers = dealt(_table(spark, sf_dir, "customer").withColumn("key", F.floor(F.col("c_custkey") / PLAYERS)), "key")
    called = F.slice(F.array(*map(F.lit, _called())), F.lit(1), (20 + F.col("key") % 30).cast("int"))
    games = customers.select("key").distinct().select(
        "key", F.concat(F.lit("g"), "key").alias("game_id"), F.lit("in_progress").alias("status"), called.cast("array<string>").alias("called_numbers"), F.lit(None).cast("string").alias("current_number"),
        F.when(F.col("key") % 3 == 0, "standard").otherwise("nope").alias("winning_pattern_name"), F.lit("2024-05-01 10:00:00").cast("timestamp_ntz").alias("last_activity"),
    )
    player = F.concat(F.lit("p"), "c_custkey").alias("player_id")
    players = customers.select("key", player, F.col("c_name").alias("display_name"), F.lit(None).cast("timestamp_ntz").alias("connected_at"))
    drawn = customers.select("key", player, F.lit(1).alias("place"), F.concat(F.lit("c"), "c_custkey").alias("card_id"), random_grid(F.col("c_custkey"), "card").alias("grid"))
    cards = gamestate.saved_cards(drawn, ["key"], games.select("key", F.col("called_numbers").cast("array<int>").alias("called")))
    waiters = customers.where("c_acctbal < 0").select("key", F.col("c_custkey").cast("string").alias("pending_id"), F.col("c_name").alias("display_name"))
    saved = f"{shared_dir(spark)}/texts"
    gamestate.state_texts({"games": games, "players": players, "cards": cards, "waiters": waiters}).write.parquet(saved)
    back = gamestate.restored_state(spark.read.parquet(saved), "key", "text", ["standard"], F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))
    waiting = back["waiters"].groupBy("key").agg(F.count(F.lit(1)).alias("waiters"))
    told = back["games"].join(waiting, "key", "left").select("key", "status", "wins", F.size("called_numbers").alias("called"), F.coalesce("waiters", F.lit(0)).cast("long").alias("waiters"))
    rows = back["cards"].join(back["players"], ["key", "player_id"]).join(told, "key")
    marked = F.size(F.filter(F.flatten("marked"), lambda m: m))
    return rows.select("key", "player_id", "display_name", "card_id", F.array_join(F.flatten("grid"), " ").alias("cells"), marked.alias("marked"), "called", "wins", "status", "waiters")


@registered(
    "with c as (select user_id, hour(ts) as hour, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as kind, arg_max(value, (ts, event_id)) as value from events group by 1, 2) "
    "select user_id, hour::int as hour, event_id, kind, value from c where kind <> 'error'"
)
def delta_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and hour, saved in four lots of changes, merged after two; an error deletes."""
    events = _table(spark, sf_dir, "events").select("user_id", F.hour("ts").alias("hour"), "event_id", F.col("event_type").alias("kind"), "value", F.struct("ts", "event_id").alias("at"), (F.col("event_type") == "error").alias("gone"))
    root, keys, lot = shared_dir(spark), ["user_id", "hour"], F.floor((F.dayofmonth("at.ts") - 1) / 8)
    writer = deltas.generation(spark, root, "events")
    for number in range(4):
        deltas.append_delta(events.where(lot == number), root, writer, number, keys, "at", "gone")
        if number == 1:
            deltas.merge(spark, root, keys)
            deltas.vacuum(spark, root)
    return deltas.live(spark, root, keys).drop("at")


@registered(
    "with t as (select user_id as client, ts, event_id as seq, 'r' || day(ts) % 4 as request, event_type = 'purchase' as is_ack from events where event_type in ('view', 'click', 'purchase')), "
    "b as (select t.*, (select max((a.ts, a.seq)) from t a where a.client = t.client and a.request = t.request and a.is_ack and (a.ts, a.seq) < (t.ts, t.seq)) as acked from t where not is_ack), "
    "f as (select b.*, (select arg_min(c.seq, (c.ts, c.seq)) from t c where c.client = b.client and c.request = b.request and not c.is_ack and (b.acked is null or (c.ts, c.seq) > b.acked)) as first from b) "
    "select client, seq, request, first, first <> seq as repeated from f"
)
def answered_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks as tries of a client's four requests, purchases as acknowledgements: which try each answer belongs to."""
    return requests.answered(request_tries(spark, sf_dir), "client", "ts", "seq")


def request_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").where("event_type in ('view', 'click', 'purchase')")
    request = F.concat(F.lit("r"), F.dayofmonth("ts") % 4)
    return rows.select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("seq"), request.alias("request"), (F.col("event_type") == "purchase").alias("is_ack"))
