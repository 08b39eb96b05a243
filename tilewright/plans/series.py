"""Queries of series, lines, lattices and reports on labels, each with SQL of another form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import islands, metrics, nearest, signals
from .queries import _DAYS_SQL, ORACLE_SQL, _days, _predicted, _table, registered


@registered(
    ORACLE_SQL["class_report"].rpartition(" select coalesce(t.label")[0]
    + ", n as (select coalesce(t.label, p.label)::varchar as label, coalesce(support, 0) as support, coalesce(predicted, 0) as predicted, coalesce(hits, 0) as hits from "
    "(select truth as label, count(*) as support, count(*) filter (where truth = pred) as hits from b group by 1) t full join (select pred as label, count(*) as predicted from b group by 1) p on t.label = p.label), "
    "f as (select label, coalesce(hits / nullif(predicted, 0), 0)::double as precision, coalesce(hits / nullif(support, 0), 0)::double as recall, support, hits from n), "
    "g as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0::double end as f1 from f), "
    "u as (select label, precision, recall, f1, support from g union all select 'accuracy', null, null, sum(hits) / sum(support), sum(support) from g "
    "union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from g "
    "union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from g) "
    "select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support::bigint as support from u"
)
def label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of the nearest-centre prediction by class, with averages."""
    rows = metrics.label_report(_predicted(spark, sf_dir), "truth", "pred")
    return rows.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@registered(
    _DAYS_SQL + ", b as (select event_type, unnest([3, 6, 12, 18, 29]) as bound from (select distinct event_type from d)), e as (select event_type, min(day) as lo, max(day) as hi from d group by 1), "
    "n as (select b.event_type, bound, day, row_number() over (partition by b.event_type, bound order by v desc, day) as r from b join e using (event_type) "
    "join d on d.event_type = b.event_type and day between greatest(lo + 2, bound - 2) and least(hi - 2, bound + 2)) "
    "select b.event_type, b.bound, coalesce(day, b.bound)::int as snapped from b left join n on n.event_type = b.event_type and n.bound = b.bound and r = 1"
)
def snap_strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bound moved to the busiest day within two days of it."""
    days = _days(spark, sf_dir)
    ends = days.groupBy("event_type").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    bounds = ends.withColumn("bound", F.explode(F.array(*map(F.lit, (3, 6, 12, 18, 29)))))
    return signals.strongest_near(days, bounds, ["event_type"], "day", "v", 2).select("event_type", "bound", "snapped")


_MONTHS = (
    "with recursive m as (select c_nationkey as k, date_trunc('month', o_orderdate)::date as month, sum(o_totalprice::decimal(18,2)) as rev from orders join customer on o_custkey = c_custkey group by 1, 2), "
    "n as (select *, row_number() over (partition by k order by month) as i from m), "
    "s as (select k, i, month, rev, rev as best, rev > 0 as improved, case when rev > 0 then 0 else 1 end as stale from n where i = 1 "
    "union all select n.k, n.i, n.month, n.rev, greatest(s.best, n.rev), n.rev > s.best, case when n.rev > s.best then 0 else s.stale + 1 end from s join n on n.k = s.k and n.i = s.i + 1 where s.stale < 6)"
)


@registered(_MONTHS + " select k as nation, month::varchar as month, improved, stale::int as stale from s")
def patience_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's monthly revenue up to the month at which it has not improved six times."""
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).cast("date").alias("month"))
    both = orders.join(_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rev = both.groupBy(F.col("c_nationkey").alias("nation"), "month").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("rev"))
    found = signals.stopped_early(rev, ["nation"], "month", "rev", 6)
    return found.select("nation", F.col("month").cast("string").alias("month"), "improved", "stale")


@registered(
    "with d as (select user_id, day(ts)::double as x, count(*)::double as y from events group by 1, 2), "
    "s as (select user_id, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * y) as sxy, sum(x * x) as sxx from d group by 1), "
    "t as (select *, (n * sxy - sx * sy) / (n * sxx - sx * sx) as slope from s where n > 1) select user_id, round(slope, 6) as slope, round((sy - slope * sx) / n, 6) as intercept from t"
)
def regr_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line through each user's daily counts."""
    rows = _table(spark, sf_dir, "events").groupBy("user_id", F.dayofmonth("ts").cast("double").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    line = rows.groupBy("user_id").agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"), F.count(F.lit(1)).alias("n"))
    return line.where("n > 1").select("user_id", F.round("a", 6).alias("slope"), F.round("b", 6).alias("intercept"))


_DAY_RUNS = (
    "with d as (select distinct user_id, day(ts) as day from events), "
    "i as (select *, day - row_number() over (partition by user_id order by day) as k from d), "
    "r as (select user_id, min(day) as s, max(day) as e, count(*) as n from i group by user_id, k)"
)


def _user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").alias("day")).distinct()


@registered(_DAY_RUNS + " select user_id, max(n)::int as longest from r group by user_id")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most days in a row on which a user was seen."""
    held = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.dayofmonth("ts")).alias("days"))  # 31 at most
    flags = F.transform(F.sequence(F.lit(1), F.lit(31)), lambda d: F.array_contains("days", d))
    return held.select("user_id", islands.longest_run(flags).alias("longest"))


@registered(
    _DAY_RUNS.replace("with d", "with recursive d", 1) + ", o as (select *, row_number() over (partition by user_id order by s) as i from r), "
    "m as (select user_id, i, case when n >= 2 then s end as s, case when n >= 2 then e end as e, n >= 2 as long, 1 as part from o where i = 1 "
    "union all select o.user_id, o.i, case when o.n < 2 then null when m.long and o.s - m.e < 4 then m.s else o.s end, case when o.n >= 2 then o.e end, o.n >= 2, "
    "case when m.long and o.n >= 2 and o.s - m.e < 4 then m.part else m.part + 1 end from m join o on o.user_id = m.user_id and o.i = m.i + 1) "
    "select user_id, min(s)::int as run_start, max(e)::int as run_end from m where long group by user_id, part"
)
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two days or more, joined over gaps of up to three days in which the user was not seen."""
    found = islands.merged_runs(_user_days(spark, sf_dir).withColumn("day", F.col("day").cast("int")), ["user_id"], "day", 2, 4)
    return found.select("user_id", F.col("run_start").cast("int").alias("run_start"), F.col("run_end").cast("int").alias("run_end"))


@registered(
    "with d as (select distinct o_custkey as k, date_diff('day', date '1970-01-01', o_orderdate::date)::double as y from orders), "
    "a as (select k, list(y order by y) as ys from d group by k having count(*) >= 2), "
    "g as (select k, ys, list_transform(range(1, len(ys)), lambda i: ys[i + 1] - ys[i]) as gs from a), m as (select *, list_aggregate(gs, 'median') as med from g), "
    "c as (select k, ys, med, i, case when i = 0 or gs[i] > 1.7::double * med then 1 else 0 end as far, case when i = 0 or gs[i] not between 0.55::double * med and 1.6::double * med then 1 else 0 end as uneven, "
    "case when i > 0 then gs[i] end as gap from (select *, unnest(range(len(ys))) as i from m where med > 0)), "
    "n as (select *, sum(far) over w as card, sum(greatest(far, uneven)) over w as chain from c window w as (partition by k order by i rows unbounded preceding)), "
    "h as (select k, card, chain, min(ys[i + 1]) as first, max(ys[i + 1]) as last, count(*) as n, median(gap) filter (where far + uneven = 0) as pitch, max(med) as med from n group by 1, 2, 3), "
    "b as (select *, row_number() over (partition by k, card order by n desc, first) as r from h) "
    "select k as o_custkey, first, last, n::bigint as n from b where r = 1 and n >= 2 and pitch between 0.7::double * med and 1.3::double * med"
)
def card_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of orders as lines: cards of them, and each card's longest evenly spaced chain."""
    days = _table(spark, sf_dir, "orders").select("o_custkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("day")).distinct()
    return islands.even_chains(days, ["o_custkey"], "day")


@registered(
    "with l as (select vec_id // 8 * 16 + p as g, list(list_transform(embedding[p * 4 + 1 : p * 4 + 4], lambda x: floor(x::double * 10)) order by vec_id) as cs from (select *, unnest(range(16)) as p from embeddings) group by 1), "
    "k as (select g, list_reduce(list_transform(cs, lambda c: [c]), lambda a, x: case when len(list_filter(a, lambda o: list_max(list_transform(list_zip(o, x[1]), lambda z: abs(z[1] - z[2]))) <= 1.0::double)) > 0 then a else list_concat(a, x) end) as kept, len(cs) as n from l) "
    "select g::bigint as g, n::int as n, len(kept)::int as distinct_n, list_sum(list_transform(kept, lambda c: c[1]))::double as firsts from k"
)
def near_lattices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numbers of eight vectors in parts of four: of eight lattices each, in order, those that are not within one of a kept one in all their lines."""
    lines = F.transform(F.slice("embedding", F.col("p") * 4 + 1, F.lit(4)), lambda x: F.floor(x.cast("double") * 10).cast("double"))
    parts = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"))
    held = parts.groupBy(F.expr("vec_id div 8 * 16 + p").alias("g")).agg(
        F.array_sort(F.collect_list(F.struct("vec_id", lines.alias("c"))))["c"].alias("cs")  # eight
    )
    rows = held.select("g", F.size("cs").alias("n"), signals.distinct_lattices(F.col("cs"), 1.0).alias("kept"))
    return rows.select("g", "n", F.size("kept").alias("distinct_n"), F.aggregate("kept", F.lit(0.0), lambda s, c: s + c[0]).alias("firsts"))


@registered(
    "with b as (select o_custkey * 10000 + year(o_orderdate) as sheet, list((o_orderkey % 1000)::double order by o_orderkey) as tops, "
    "list(((o_orderkey % 1000) + 20 + o_custkey % 30 + floor(o_totalprice / 20000))::double order by o_orderkey) as ends from orders group by 1), "
    "h as (select *, list_transform(list_zip(tops, ends), lambda z: z[2] - z[1]) as hs, list_sort(ends) as es from b), "
    "p as (select *, es[2] - es[1] as a, es[3] - es[2] as c, list_min(hs) as lo, list_max(hs) as hi from h), "
    "f as (select *, len(hs) = 1 and hi <= 0.5::double * 100 as single, len(hs) = 3 and a > 0 and abs(a - c) <= 0.28::double * greatest(a, c) and lo >= 0.45::double * hi as whole from p) "
    "select sheet, coalesce(single or whole, false) as ok, round(case when single then 10 when whole then 1000 + lo / hi when len(hs) = 1 then 0 else len(hs) end, 6)::double as score from f"
)
def sheet_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a customer's orders of a year, as bands, look like a sheet of three cards or a single one."""
    top = (F.col("o_orderkey") % 1000).cast("double")
    end = top + 20 + F.col("o_custkey") % 30 + F.floor(F.col("o_totalprice") / 20000)
    sheets = _table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") * 10000 + F.year("o_orderdate")).alias("sheet")).agg(
        F.collect_list(F.struct(top.alias("top"), end.alias("bottom"))).alias("bands")  # one customer's year
    )
    found = islands.sheet_structure(F.col("bands"), F.lit(100))
    return sheets.select("sheet", found.alias("x")).select("sheet", "x.ok", F.round("x.score", 6).alias("score"))


@registered(
    "with o as (select o_custkey, o_orderkey, o_orderstatus as s, date_diff('day', date '1970-01-01', o_orderdate::date)::int as x, o_totalprice as v from orders), "
    "n as (select a.o_orderkey, a.x, b.x as bx, b.v, b.o_orderkey as bk, row_number() over (partition by a.o_orderkey order by abs(a.x - b.x), b.x, b.o_orderkey) as r "
    "from o a left join o b on a.o_custkey = b.o_custkey and b.s = 'F' where a.s <> 'F') "
    "select o_orderkey, v as price, (case when abs(x - bx) > 200 then 0 else x - bx end)::int as shift from n where r = 1"
)
def inherit_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are not finished take the price of the customer's nearest finished one, with the days between if not too many."""
    rows = _table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", F.unix_date(F.col("o_orderdate").cast("date")).alias("x"), F.col("o_totalprice").alias("price")
    )
    found = nearest.inherited(rows, ["o_custkey"], "x", "o_orderkey", ["price"], F.col("o_orderstatus") != "F", 200)
    return found.select("o_orderkey", "price", F.col("_shift").cast("int").alias("shift"))
