"""Queries on the given tables, each with SQL of another form that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import lenient_label, strict_label
from ..functions.patterns import FREE_BIT, FULL, PATTERNS, All, Any, AtLeast, AtMost, Mask, cells_of, col_mask, holds, row_mask
from ..operators import islands, metrics, quantiles, replay, signals
from ..operators.running import running
from ..operators.tables import join_few, settled
from ..sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str) -> Callable:
    def add(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[query.__name__] = query
        ORACLE_SQL[query.__name__] = sql
        return query

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TYPES = ["click", "error", "purchase", "signup", "view"]


#: A user has a new card every so many days: with one for all thirty, every card would win.
CARD_DAYS = 8


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as calls of cards' cells: a card is a user's for CARD_DAYS days, the column the type, the row the day modulo 5."""
    kind = F.array_position(F.array(*map(F.lit, _TYPES)), F.col("event_type")).cast("int") - 1
    day = F.dayofmonth("ts")
    card = F.col("user_id") * 10 + F.floor((day - 1) / CARD_DAYS)
    return _table(spark, sf_dir, "events").select(card.alias("card"), "ts", "event_id", ((day % 5) * 5 + kind).alias("bit"))


def _numbered(calls: DataFrame) -> DataFrame:
    order = Window.partitionBy("card").orderBy("ts", "event_id")
    return calls.withColumn("seq", F.row_number().over(order).cast("long"))


_CALLS_SQL = """calls as (
  select card, ts, event_id, bit, row_number() over (partition by card order by ts, event_id) as seq from (
    select user_id * 10 + (day(ts) - 1) // 8 as card, ts, event_id, ((day(ts) % 5) * 5 + list_position(['click','error','purchase','signup','view'], event_type) - 1)::int as bit from events
  )
)"""


def _tree_sql(pattern) -> str:
    """A pattern as SQL over cells: the number of a card's marked cells in each mask."""
    match pattern:
        case Mask(bits) | AtLeast(bits, _) | AtMost(bits, _):
            n = f"count(*) filter (where bit in ({', '.join(map(str, cells_of(bits)))}))"
            if isinstance(pattern, Mask):
                return f"{n} = {len(cells_of(bits))}"
            return f"{n} {'>=' if isinstance(pattern, AtLeast) else '<='} {pattern.n}"
        case All(parts) | Any(parts):
            return "(" + (" and " if isinstance(pattern, All) else " or ").join(map(_tree_sql, parts)) + ")"


_AT_MOST = All((AtMost(row_mask(1), 3), AtLeast(col_mask(0), 3)))


def _pattern_query(name: str, pattern) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        marks = replay.grid_marks(_calls(spark, sf_dir), "card", F.col("bit"))
        return marks.where(holds(pattern, F.col("marked"))).select("card")

    query.__name__ = name
    cells = f"with {_CALLS_SQL}, cells as (select distinct card, bit from calls union select card, {FREE_BIT} from calls)"
    registered(f"{cells} select card from cells group by card having {_tree_sql(pattern)}")(query)


for _name, _pattern in PATTERNS.items():
    _pattern_query(f"pattern_{_name}", _pattern)
_pattern_query("pattern_at_most", _AT_MOST)


@registered(
    f"with {_CALLS_SQL}, cells as (select distinct card, bit from calls union select card, {FREE_BIT} from calls) "
    "select card, (25 - count(*))::int as remaining from cells group by card"
)
def cards_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = replay.grid_marks(_calls(spark, sf_dir), "card", F.col("bit"))
    return marks.select("card", (F.lit(25) - F.bit_count("marked")).cast("int").alias("remaining"))


@registered(
    f"with {_CALLS_SQL}, cells as (select distinct card, bit from calls union select card, {FREE_BIT} from calls) "
    "select card, sum(1 << bit)::int as marked from cells group by card"
)
def mask_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.grid_marks(_calls(spark, sf_dir), "card", F.col("bit"))


def _lines_sql() -> str:
    lines = [cells_of(m.bits) for m in PATTERNS["standard"].parts]
    return ", ".join(f"({i}, {bit})" for i, line in enumerate(lines) for bit in line)


_WIN_SQL = f"""with {_CALLS_SQL}, firsts as (
  select card, bit, min(seq) as pos from calls where bit <> {FREE_BIT} group by card, bit
  union all select distinct card, {FREE_BIT}, 0 from calls
), lines(line, bit) as (values {_lines_sql()}),
done as (select card, line, max(pos) as pos from firsts join lines using (bit) group by card, line having count(*) = 5)
select card, min(pos)::bigint as win_seq from done group by card"""


@registered(_WIN_SQL)
def win_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call at which each card first completes a line."""
    return replay.win_sequence(_calls(spark, sf_dir), "card", F.col("bit"), ["ts", "event_id"], PATTERNS["standard"])


@registered(_WIN_SQL)
def win_sequence_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replay.replayed(_numbered(_calls(spark, sf_dir)), "card", F.col("bit"), F.col("seq"), PATTERNS["standard"])
    return rows.where("won").groupBy("card").agg(F.min("_seq").alias("win_seq"))


#: Holds for a while, and perhaps again: its parts stop holding when one cell too many is called.
_SPANS = Any((All((AtMost(row_mask(1), 3), AtLeast(col_mask(0), 3))), All((AtMost(FULL, 12), AtLeast(col_mask(2), 2), Any((Mask(row_mask(3)), AtMost(col_mask(4), 2)))))))


@registered(
    f"with {_CALLS_SQL}, firsts as (select card, bit, min(seq) as pos from calls where bit <> {FREE_BIT} group by card, bit union all select distinct card, {FREE_BIT}, 0 from calls), "
    f"held as (select c.card, c.seq, f.bit from calls c join firsts f on f.card = c.card and f.pos <= c.seq), after as (select card, seq from held group by card, seq having {_tree_sql(_SPANS)}) "
    "select card, min(seq)::bigint as win_seq from after group by card"
)
def win_sequence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call at which each card first holds a pattern that can stop holding: from its cells' first calls, without a replay."""
    return replay.win_sequence(_calls(spark, sf_dir), "card", F.col("bit"), ["ts", "event_id"], _SPANS)


@registered(
    _WIN_SQL.replace("select card, min(pos)::bigint as win_seq from done group by card", "")
    + ", w as (select card, min(pos) as win_seq from done group by card) "
    f", n as (select *, row_number() over (partition by card, bit order by seq) as again from calls where bit <> {FREE_BIT}) "
    "select seq::bigint as seq, count(*)::bigint as winners from n join w using (card) where seq >= win_seq and again = 1 group by seq"
)
def winners_per_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards that hold the pattern after their n-th call, if it marks a new cell; a winner counts again at each later one."""
    rows = replay.replayed(_numbered(_calls(spark, sf_dir)), "card", F.col("bit"), F.col("seq"), PATTERNS["standard"])
    return rows.where("won and fresh").groupBy(F.col("_seq").alias("seq")).agg(F.count(F.lit(1)).alias("winners"))


@registered(
    "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) r from events) where r = 1"
)
def call_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return replay.first_calls(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


_LABEL = "case when n between 1 and 75 then substr('BINGO', ((n - 1) // 15 + 1)::int, 1) || n::varchar end"


@registered(
    f"select p_partkey, case when n <= 60 and n >= 1 then {_LABEL} else 'O' || n::varchar end as label, {_LABEL} as strict "
    "from (select p_partkey, (p_size * 2 - 2)::int as n from part)"
)
def canonical_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (F.col("p_size") * 2 - 2).cast("string")
    return _table(spark, sf_dir, "part").select("p_partkey", lenient_label(text).alias("label"), strict_label(text).alias("strict"))


@registered(
    "select l_linenumber, count(*)::bigint as n, count(*) filter (where l_quantity::int not between (l_linenumber - 1) * 8 and l_linenumber * 8)::bigint as violations "
    "from lineitem group by l_linenumber"
)
def grid_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, line = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    bad = ~q.between((line - 1) * 8, line * 8)
    return _table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("violations")
    )


@registered(
    "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderdate >= (select max(o_orderdate) from orders) - interval 180 day)"
)
def semi_inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    last = orders.agg(F.max("o_orderdate").alias("last"))
    recent = orders.join(F.broadcast(last), F.col("o_orderdate") >= F.col("last") - F.expr("interval 180 days"))  # one row
    return _table(spark, sf_dir, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@registered("select o_orderkey from orders o where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def anti_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey")
    return _table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@registered(
    "select band, count(*)::bigint as n from orders join (values (0, 0, 50000), (1, 50000, 150000), (2, 150000, 300000), (3, 300000, 100000000)) b(band, lo, hi) "
    "on o_totalprice >= lo and o_totalprice < hi group by band"
)
def theta_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the band of prices that they fall in: a range join with a table of four bands."""
    bands = spark.createDataFrame([(0, 0, 50_000), (1, 50_000, 150_000), (2, 150_000, 300_000), (3, 300_000, 100_000_000)], "band int, lo long, hi long")
    price = F.col("o_totalprice")
    rows = _table(spark, sf_dir, "orders").select("o_totalprice").join(F.broadcast(bands), (price >= F.col("lo")) & (price < F.col("hi")))  # four rows
    return rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@registered(
    "with b as (select user_id, d from (select distinct user_id from events), (values (5), (10), (20)) t(d)) "
    "select b.user_id, b.d, (select event_id from events e where e.user_id = b.user_id and day(e.ts) <= b.d order by ts desc, event_id desc limit 1) as event_id from b "
    "where exists (select 1 from events e where e.user_id = b.user_id and day(e.ts) <= b.d)"
)
def asof_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event up to some days, in one aggregation instead of a join."""
    rows = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.dayofmonth("ts").alias("day"))
    last = [F.max(F.when(F.col("day") <= d, F.struct("ts", "event_id"))).getField("event_id").alias(str(d)) for d in (5, 10, 20)]
    wide = rows.groupBy("user_id").agg(*last)
    return wide.unpivot("user_id", ["5", "10", "20"], "d", "event_id").where("event_id is not null").withColumn("d", F.col("d").cast("int"))


@registered(
    "with c as (select label, dim, round(avg(v), 6) as m from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as dim from embeddings) group by label, dim), "
    "l as (select label, list(m order by dim) as center from c group by label), "
    "d as (select vec_id, e.label as truth, l.label as pred, round(list_sum(list_transform(list_zip(embedding::double[], center), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 4) as far from embeddings e, l), "
    "b as (select vec_id, truth, pred from (select *, row_number() over (partition by vec_id order by far, pred) r from d) where r = 1) "
    "select truth, pred, count(*)::bigint as n from b group by truth, pred"
)
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_predicted(spark, sf_dir), "truth", "pred")


def _predicted(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    """Each vector's label and that of the nearest class centre (ten rows, one array, crossed in an expression)."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("truth"), F.slice(F.col("embedding"), 1, dims).cast("array<double>").alias("v"))
    parts = rows.select("truth", F.posexplode("v").alias("dim", "x")).groupBy("truth", "dim").agg(F.round(F.avg("x"), 6).alias("m"))
    center = parts.groupBy("truth").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).getField("m").alias("center"))
    centers = center.agg(F.collect_list(F.struct(F.col("truth").alias("pred"), "center")).alias("centers"))
    far = lambda c: F.round(F.aggregate(F.zip_with("v", c["center"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), 4)
    near = F.array_min(F.transform("centers", lambda c: F.struct(far(c).alias("far"), c["pred"].alias("pred"))))
    return rows.crossJoin(F.broadcast(centers)).select("vec_id", "truth", near["pred"].alias("pred"))  # one row of ten centres


@registered(
    ORACLE_SQL["confusion"].rpartition(" select ")[0]
    + " select coalesce(t.label, p.label) as label, coalesce(support, 0)::bigint as support, coalesce(predicted, 0)::bigint as predicted, coalesce(hits, 0)::bigint as hits from "
    "(select truth as label, count(*) as support, count(*) filter (where truth = pred) as hits from b group by 1) t full join "
    "(select pred as label, count(*) as predicted from b group by 1) p on t.label = p.label"
)
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_report(_predicted(spark, sf_dir), "truth", "pred")


@registered(
    ORACLE_SQL["confusion"].rpartition(" select ")[0]
    + ", g as (select count(*) filter (where truth = pred) / count(*)::double as new, count(*) filter (where truth = (select mode(truth) from (select truth from b order by truth))) / count(*)::double as old from b) "
    "select round(new, 6) as candidate, round(old, 6) as incumbent, new - old >= -0.005::double as ships from g"
)
def ship_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest-centre predictor's accuracy against that of always naming the commonest class, with the gate's tolerance."""
    rows = _predicted(spark, sf_dir)
    by_class = rows.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth") == F.col("pred")).alias("hits"))
    found = by_class.agg((F.sum("hits") / F.sum("n")).alias("candidate"), (F.max("n") / F.sum("n")).alias("incumbent"))
    ships = metrics.ships(F.col("candidate"), F.col("incumbent"))
    return found.select(F.round("candidate", 6).alias("candidate"), F.round("incumbent", 6).alias("incumbent"), ships.alias("ships"))


@registered(
    "select count(*) filter (where quality is not null and (guess is null or guess <> quality))::bigint as corrected, count(*)::bigint as n "
    "from (select d.doc_id, case when n_chars > 100 then (n_chars > 400)::int end as guess, l.quality from documents d full join labels l on d.doc_id = l.doc_id)"
)
def correction_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 100, (F.col("n_chars") > 400).cast("int")).alias("guess"))
    both = docs.join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "full")
    changed = metrics.was_corrected(F.col("guess"), F.col("quality"))
    return both.agg(F.count_if(changed).alias("corrected"), F.count(F.lit(1)).alias("n"))


@registered(
    "select doc_id, quality, r::int as copy from (select doc_id, quality, case when quality = 0 then 4 else 1 end as k from labels), range(1, 5) t(r) where r <= k"
)
def oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = F.sequence(F.lit(1), F.when(F.col("quality") == 0, 4).otherwise(1))
    return _table(spark, sf_dir, "labels").select("doc_id", "quality", F.explode(copies).alias("copy"))


@registered("select label, round(1.0::double / count(*), 8) as weight from embeddings group by label")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(F.lit(1.0) / F.count(F.lit(1)), 8).alias("weight"))


@registered(
    "with d as (select distinct user_id, day(ts)::bigint as day from events), s as (select *, case when day - lag(day) over (partition by user_id order by day) = 1 then 0 else 1 end as new from d), "
    "g as (select *, sum(new) over (partition by user_id order by day) as k from s) "
    "select user_id, min(day) as run_start, max(day) as run_end, count(*)::bigint as n from g group by user_id, k having count(*) >= 3"
)
def runs_min_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").cast("long").alias("day")).distinct()
    return islands.runs(days, ["user_id"], "day", 3)


@registered(
    "with o as (select o_custkey, date_diff('day', date '1970-01-01', o_orderdate::date)::bigint as day from orders), "
    "s as (select *, case when day - lag(day) over w > 30 then 1 else 0 end as new from o window w as (partition by o_custkey order by day)), "
    "g as (select *, sum(new) over (partition by o_custkey order by day rows unbounded preceding) as k from s) "
    "select o_custkey, (sum(day) // count(*))::bigint as center, count(*)::bigint as n from g group by o_custkey, k having count(*) >= 2"
)
def cluster_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _table(spark, sf_dir, "orders").select("o_custkey", F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("day"))
    return islands.clusters_by_gap(days, ["o_custkey"], "day", 30, support=2)


_DAYS_SQL = "with d as (select event_type, day(ts)::int as day, count(*)::bigint as v from events group by 1, 2)"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_type", F.dayofmonth("ts").alias("day"))
    return rows.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("v"))


@registered(
    _DAYS_SQL + ", n as (select *, row_number() over w as r, count(*) over (partition by event_type) as c from d window w as (partition by event_type order by day)) "
    "select a.event_type, a.day, case when a.r > 5 and a.c - a.r >= 5 then (select sum(v) from n b where b.event_type = a.event_type and abs(b.r - a.r) between 2 and 5) / 8.0::double - a.v else 0.0::double end as dip from n a"
)
def dip_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).select("event_type", "day", signals.dip(F.col("v"), ["event_type"], "day").alias("dip"))


@registered(
    _DAYS_SQL + " select event_type, day, (sum(v) over (partition by event_type order by day rows between 3 preceding and 3 following))::double / 7 as mean from d"
)
def moving_avg_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = signals.moving_average(F.col("v"), ["event_type"], "day", 7)
    return _days(spark, sf_dir).select("event_type", "day", mean.alias("mean"))


@registered(
    _DAYS_SQL + ", n as (select *, row_number() over (partition by event_type order by day) as r from d) "
    "select a.event_type, a.day from n a join n b on a.event_type = b.event_type and b.r = a.r - 1 join n c on a.event_type = c.event_type and c.r = a.r + 1 where a.v > b.v and a.v > c.v"
)
def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _days(spark, sf_dir).withColumn("peak", signals.is_peak(F.col("v"), ["event_type"], "day"))
    return rows.where("peak").select("event_type", "day")


@registered(
    "with q as (select l_returnflag, quantile_cont(l_extendedprice, 0.02) as lo, quantile_cont(l_extendedprice, 0.98) as hi from lineitem group by 1) "
    "select l.l_returnflag, sum((least(greatest(l_extendedprice, round(lo, 2)), round(hi, 2)))::decimal(18,2))::double as total, count(*) filter (where l_extendedprice < round(lo, 2))::bigint as low from lineitem l join q on l.l_returnflag = q.l_returnflag group by 1"
)
def percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("x"))
    q = quantiles.exact(rows, ["l_returnflag"], "x", [0.02, 0.98])
    at = lambda i: F.round(F.max(F.when(F.col("i") == i, F.col("value"))), 2)
    q = q.groupBy("l_returnflag").agg(at(0).alias("lo"), at(1).alias("hi"))
    clipped = F.least(F.greatest("x", "lo"), F.col("hi")).cast("decimal(18,2)")
    return join_few(rows, settled(q), ["l_returnflag"]).groupBy("l_returnflag").agg(
        F.sum(clipped).cast("double").alias("total"), F.count_if(F.col("x") < F.col("lo")).alias("low")
    )


@registered(
    "select l_returnflag, l_linenumber as value from (select *, row_number() over (partition by l_returnflag order by c desc, l_linenumber) r from (select l_returnflag, l_linenumber, count(*) c from lineitem group by 1, 2)) where r = 1"
)
def mode_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.mode("l_linenumber", True).alias("value"))


@registered(
    "with s as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), "
    "g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from s) select user_id, k::bigint as session, count(*)::bigint as n from g group by user_id, k"
)
def sessions_30min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session ends when 30 minutes or more pass, both ends counted; an event without a time is one of its own."""
    rows = _table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    named = islands.clustered(rows, ["user_id"], "us", ~F.coalesce(F.col("_gap") < 30 * 60 * 1_000_000, F.lit(False)))
    return named.groupBy("user_id", F.col("_cluster").alias("session")).agg(F.count(F.lit(1)).alias("n"))


@registered(
    "select user_id, round::bigint as round, count(*) filter (where event_type in ('click', 'view'))::bigint as calls from "
    "(select *, sum((event_type = 'signup')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as round from events) group by user_id, round"
)
def round_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    rows = running(events, ["user_id"], ["ts", "event_id"], {"round": (F.col("event_type") == "signup").cast("long")})
    return rows.groupBy("user_id", "round").agg(F.count_if(F.col("event_type").isin("click", "view")).alias("calls"))


@registered(
    "with s as (select *, (select p.event_type from events p where p.user_id = e.user_id and p.event_type in ('signup', 'purchase', 'error') and (p.ts, p.event_id) < (e.ts, e.event_id) order by p.ts desc, p.event_id desc limit 1) as before from events e where event_type in ('click', 'view')) "
    "select coalesce(before, 'none') as state, count(*)::bigint as n, count(*) filter (where before is distinct from 'purchase')::bigint as rejected from s group by 1"
)
def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by the state they meet: signup sets up, purchase starts, error ends; only a started game takes calls."""
    change = F.when(F.col("event_type").isin("signup", "purchase", "error"), F.col("event_type"))
    events = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    rows = running(events, ["user_id"], ["ts", "event_id"], lasts={"state": change}, before=True).fillna("none", ["state"])
    calls = rows.where(F.col("event_type").isin("click", "view"))
    return calls.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") != "purchase").alias("rejected"))


@registered(
    "select e.event_id, (select n.event_id from events n where n.user_id = e.user_id and n.event_type = 'signup' and (n.ts, n.event_id) > (e.ts, e.event_id) order by n.ts, n.event_id limit 1) as admitted_by from events e where e.event_type = 'view'"
)
def waiting_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each joining event with the next reset that lets it in."""
    reset = F.when(F.col("event_type") == "signup", F.col("event_id"))
    events = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    rows = running(events, ["user_id"], [F.desc("ts"), F.desc("event_id")], lasts={"admitted_by": reset}, before=True)
    return rows.where("event_type = 'view'").select("event_id", "admitted_by")


@registered("select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id from events group by user_id, event_type")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("at"))
    old, new = rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")
    return store.upserted(old, new, ["user_id", "event_type"], "at").drop("at")


@registered("select o_custkey from orders where o_orderstatus = 'O' except select o_custkey from orders where o_orderstatus = 'F'")
def snapshot_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    live = orders.where("o_orderstatus = 'F'").select("o_custkey")
    return orders.where("o_orderstatus = 'O'").select("o_custkey").distinct().join(live, "o_custkey", "left_anti")


@registered(
    "select event_id, coalesce((props->>'k')::int, -1) as k, coalesce(props->>'status', 'setup') as status from events where event_id % 5 <> 0"
)
def json_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with defaults; every fifth row is broken on purpose and goes to quarantine."""
    blob = F.when(F.col("event_id") % 5 == 0, F.lit("{not json")).otherwise(F.col("props"))
    rows = _table(spark, sf_dir, "events").select("event_id", blob.alias("blob"))
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("status", T.StringType())])
    good, _ = store.restored(rows, "blob", schema, {"k": -1, "status": "setup"})
    return good.select("event_id", "k", "status")


@registered(
    "select vec_id, list_position(v, list_max(v))::int - 1 as at, round(1.0 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) as conf from (select vec_id, embedding::double[] as v from embeddings)"
)
def softmax_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return _table(spark, sf_dir, "embeddings").select(
        "vec_id", signals.first_largest(v).alias("at"), F.round(signals.softmax_top(v), 6).alias("conf")
    )


@registered(
    "select conv_id, turn, (select c.turn from conversations c where c.conv_id = a.conv_id and c.turn <= a.turn and c.role = 'user' order by c.turn desc limit 1) as asked from conversations a"
)
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    header = F.when(F.col("role") == "user", F.col("turn"))
    return store.filled_down(rows, ["conv_id"], "turn", header, "asked").select("conv_id", "turn", "asked")


@registered(
    "select l_suppkey, l_orderkey, l_linenumber, p as price from (select *, row_number() over (partition by l_suppkey order by p desc, l_orderkey, l_linenumber) r from (select distinct l_suppkey, l_orderkey, l_linenumber, l_extendedprice p from lineitem)) where r <= 6"
)
def topk_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("p")).distinct()
    top = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("p"), "l_orderkey", "l_linenumber"))
    kept = rows.withColumn("_top", top).where("_top <= 6")
    return kept.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("p").alias("price"))


@registered(
    "with m as (select date_trunc('month', o_orderdate)::date as month, sum(o_totalprice::decimal(18,2)) as rev from orders group by 1), "
    "b as (select *, max(rev) over (order by month rows between unbounded preceding and 1 preceding) as best from m) select month::varchar as month, rev > coalesce(best, -1) as improved from b"
)
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that beat all before them; the window runs over one row per month."""
    rows = _table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).cast("date").alias("month"))
    rev = rows.agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("rev"))
    before = F.max("rev").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1))
    return rev.select(F.col("month").cast("string").alias("month"), (F.col("rev") > F.coalesce(before, F.lit(-1))).alias("improved"))


@registered(
    "select user_id, round(regr_slope(v, d), 6) as slope from (select user_id, day(ts)::double as d, count(*)::double as v from events group by 1, 2) group by user_id having count(*) > 1"
)
def regr_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").groupBy("user_id", F.dayofmonth("ts").cast("double").alias("d")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    found = rows.groupBy("user_id").agg(F.round(F.regr_slope("v", "d"), 6).alias("slope"), F.count(F.lit(1)).alias("n"))
    return found.where("n > 1").select("user_id", "slope")


@registered(
    "select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, try_cast(nullif(regexp_extract(url, '/([0-9]+)/?([?#].*)?$', 1), '') as bigint) as number from pages"
)
def file_name_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.nullif(F.regexp_extract("url", "/([0-9]+)/?([?#].*)?$", 1), F.lit("")).try_cast("long")
    return _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), number.alias("number"))
