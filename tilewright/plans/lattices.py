"""Queries of lattices, valleys, components and blur, each with SQL of another form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grids import cropped
from ..operators import lattices, planes
from .queries import _table, registered


@registered(
    "with recursive l as (select o_custkey as k, date_diff('day', date '1992-01-01', o_orderdate::date) as d from orders), c as (select k, max(d) + 30 as total from l group by k), "
    "b as (select k, total, 0 as i, 0::double as at, [0::bigint] as bounds from c union all "
    "select k, any_value(total), i + 1, any_value(new), list_append(any_value(bounds), any_value(new)::bigint) from ("
    "select b.k, b.total, b.i, b.bounds, coalesce(first_value(l.d) over (partition by b.k order by abs(l.d - (b.at + b.total / 5)) nulls last, l.d), round_even(b.at + b.total / 5, 0))::double as new "
    "from b left join l on l.k = b.k and abs(l.d - (b.at + b.total / 5)) <= b.total / 5 * 0.4::double where b.i < 4) group by k, i) "
    "select k as o_custkey, total::bigint as total, array_to_string(list_append(bounds, total), ' ') as bounds from b where i = 4"
)
def dependent_dividers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's time cut into five by days with an order, each guessed from the cut before it."""
    days = _table(spark, sf_dir, "orders").select("o_custkey", F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).alias("d"))
    cards = days.groupBy("o_custkey").agg((F.max("d") + 30).cast("long").alias("total"))
    found = lattices.divided(cards, days, ["o_custkey"], "total", "d")
    return found.select("o_custkey", "total", F.array_join("bounds", " ").alias("bounds"))


_HOURS_SQL = (
    "with n as (select user_id, hour(ts) as h, count(*) as v from events group by 1, 2), "
    "p as (select u.user_id, g.h, coalesce(v, 0) as v from (select distinct user_id from events) u cross join (select unnest(generate_series(0, 23)) as h) g left join n on n.user_id = u.user_id and n.h = g.h)"
)


@registered(
    _HOURS_SQL + ", m as (select user_id, max(v) as most from p group by 1), "
    "s as (select a.user_id, a.h, a.v, most, (select coalesce(sum(b.v), 0) from p b where b.user_id = a.user_id and b.h between a.h - 5 and a.h - 1) as l, "
    "(select coalesce(sum(b.v), 0) from p b where b.user_id = a.user_id and b.h between a.h + 1 and a.h + 5) as r from p a join m using (user_id)) "
    "select user_id, arg_min(h, (v, h))::bigint as valley from s where h > 6 and h < 18 and v <= most * 0.06::double and (l >= most * 0.3::double or r >= most * 0.3::double) group by 1"
)
def fused_valleys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hour at which a user's day falls into two, if there is an empty one in its middle half."""
    events = _table(spark, sf_dir, "events").groupBy("user_id", F.hour("ts").cast("long").alias("h")).agg(F.count(F.lit(1)).alias("v"))
    places = events.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("h"))
    profile = places.join(events, ["user_id", "h"], "left").fillna(0, ["v"])
    return lattices.valleys(profile, ["user_id"], "h", "v")


#: Places of a month in slots of two hours, and the score of a bound by what its slot holds.
SLOTS = 372


def _rated(profile: Column, extremes: bool):
    """A lattice's mean score: a bound on an empty slot has 1, on one event 0.5, else 0; null if a bound is outside."""

    def score(bounds: Column) -> Column:
        some = F.concat(F.slice(bounds, 1, 2), F.slice(bounds, lattices.PARTS, 2)) if extremes else bounds
        rates = F.transform(some, lambda b: F.when((b < 0) | (b >= SLOTS), None).when(F.get(profile, b.cast("int")) == 0, 1.0).when(F.get(profile, b.cast("int")) == 1, 0.5).otherwise(0.0))
        total = F.aggregate(rates, F.lit(0.0), lambda a, x: a + x)
        return total / F.size(some)

    return score


_LATTICE_SQL = (
    "with n as (select user_id, (day(ts) - 1) * 12 + hour(ts) // 2 as slot, count(*) as v from events group by 1, 2), u as (select user_id, min(slot) as top, max(slot) as bottom from n group by 1), "
    "c as (select *, greatest(40.0, (bottom - top) / 5.0)::double as pitch, list_transform(range(6), lambda k: top + round_even((bottom - top) / 5.0::double * k, 0)::bigint) as own from u), "
    "g as (select c.*, s, p from c, lateral (select distinct round_even(pitch * unnest([0.72, 0.8, 0.85, 0.9, 1.0, 1.1, 1.22]::double[]), 0)::bigint as p), lateral (select distinct round_even(top + pitch * unnest([-0.35, -0.2, -0.05, 0.1, 0.25]::double[]), 0)::bigint as s)), "
    "f as (select user_id, s, p, list_transform(range(6), lambda k: s + p * k) as b from g where s + p * 5 <= bottom + 8), "
    "fb as (select user_id, s, p, unnest([b[1], b[2], b[5], b[6]]) as slot from f), "
    "fr as (select fb.user_id, s, p, avg(case when fb.slot < 0 or fb.slot >= 372 then null when coalesce(v, 0) = 0 then 1.0 when v = 1 then 0.5 else 0 end) as score, bool_or(fb.slot < 0 or fb.slot >= 372) as bad from fb left join n on n.user_id = fb.user_id and n.slot = fb.slot group by 1, 2, 3), "
    "w as (select user_id, arg_max((s, p), (score, -p, -s)) as x from fr where not bad group by 1), "
    "h as (select user_id, x[1] as s, x[2] as p from w), "
    "k as (select h.user_id, s + d as s, q, row_number() over (partition by h.user_id order by q, s + d) as place from h, (select unnest([-6, 0, 6]) as d), lateral (select distinct unnest([p, greatest(p - 3, round_even(p * 0.94::double, 0)::bigint), least(p + 3, round_even(p * 1.06::double, 0)::bigint)]) as q)), "
    "a as (select user_id, list_transform(range(6), lambda i: s + q * i) as b, place from k union all select c.user_id, own, 0 from c join h using (user_id)), "
    "r as (select a.*, bottom from a join c using (user_id) where b[6] <= bottom + 8), rb as (select user_id, place, unnest(b) as slot from r union all select user_id, -1, unnest(own) from c), "
    "rr as (select rb.user_id, place, avg(case when coalesce(v, 0) = 0 then 1.0 when v = 1 then 0.5 else 0 end) as score, bool_or(rb.slot < 0 or rb.slot >= 372) as bad from rb left join n on n.user_id = rb.user_id and n.slot = rb.slot group by 1, 2), "
    "best as (select user_id, max(score) as score, arg_max(place, (score, -place)) as place from rr where place >= 0 and not bad group by 1) "
)


@registered(
    _LATTICE_SQL + "select c.user_id, round(o.score, 6) as base, case when best.score >= 0.85 and best.score > o.score + 0.1::double then array_to_string(r.b, ' ') end as found "
    "from c join rr o on o.user_id = c.user_id and o.place = -1 left join best on best.user_id = c.user_id left join r on r.user_id = c.user_id and r.place = best.place"
)
def lattice_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user six slots of the month, evenly apart, that meet fewer events than an even cut of the user's time does."""
    slot = (F.dayofmonth("ts") - 1) * 12 + F.floor(F.hour("ts") / 2)
    counts = _table(spark, sf_dir, "events").groupBy("user_id", slot.alias("slot")).agg(F.count(F.lit(1)).alias("v"))
    held = F.map_from_entries(F.collect_list(F.struct("slot", "v")))  # at most SLOTS entries
    users = counts.groupBy("user_id").agg(F.min("slot").alias("top"), F.max("slot").alias("bottom"), held.alias("_held"))
    profile = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.coalesce(F.try_element_at("_held", i.cast("long")), F.lit(0)))
    step = (F.col("bottom") - F.col("top")) / 5.0
    own = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.col("top") + F.bround(step * k).cast("long"))
    users = users.select("user_id", "top", "bottom", profile.alias("profile"), own.alias("own"))
    full = _rated(F.col("profile"), False)
    users = users.withColumn("base", full(F.col("own")))
    found = lattices.better_lattice(users, "top", "bottom", "own", "base", _rated(F.col("profile"), True), full)
    return found.select("user_id", F.round("base", 6).alias("base"), F.array_join("found", " ").alias("found"))


_LIT_SQL = "held as (select event_type as k, day(ts) as y, hour(ts) as x, count(*) as n from events group by 1, 2, 3), lit as (select k, y, x from held where n > (select avg(n) from held))"


def _lit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each type of event the days and hours with more events than the mean of those that have some."""
    cells = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("k"), F.dayofmonth("ts").alias("y"), F.hour("ts").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    mean = cells.agg(F.avg("n")).first()[0] or 0.0
    return cells.where(F.col("n") > mean)


_PARTS_SQL = (
    f"with recursive {_LIT_SQL}, c as (select k, y * 100 + x as id, y, x from lit), "
    "n as (select a.k, a.id as a, b.id as b from c a join c b on a.k = b.k and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1), "
    "r as (select k, id, id as root from c union select n.k, n.b, r.root from r join n on n.k = r.k and n.a = r.id), "
    "f as (select k, id, min(root) as root from r group by 1, 2), "
    "p as (select f.k, root // 100 as first_y, root % 100 as first_x, count(*) as area, min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1 from f join c on c.k = f.k and c.id = f.id group by f.k, root)"
)
_LONGS = ", ".join(f"{c}::bigint as {c}" for c in ("first_y", "first_x", "area", "y0", "y1", "x0", "x1"))


@registered(_PARTS_SQL + f" select k, {_LONGS} from p")
def lit_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected parts, corners included, of the days and hours at which a type of event is frequent."""
    return planes.components(_lit(spark, sf_dir), ["k"])


@registered(_PARTS_SQL + f" select k, {_LONGS} from (select *, row_number() over (partition by k order by area desc, first_y, first_x) as r from p) where r = 1")
def largest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest of the parts of each type."""
    return planes.largest(planes.components(_lit(spark, sf_dir), ["k"]), ["k"])


@registered(
    "with n as (select event_type as k, day(ts) - 1 as y, hour(ts) as x, count(*) as v from events group by 1, 2, 3), s as (select k, max(y) as h, 23 as w from n group by 1), "
    "p as (select s.k, h, w, y.y, x.x, coalesce(n.v, 0) as v from s, lateral (select unnest(generate_series(0, h)) as y) y, lateral (select unnest(generate_series(0, 23)) as x) x left join n on n.k = s.k and n.y = y.y and n.x = x.x), "
    "d as (select p.k, (select sum(q.v) from p q where q.k = p.k and q.x = p.x and (q.y = case p.y when 0 then 1 else p.y - 1 end)) + (select sum(q.v) from p q where q.k = p.k and q.x = p.x and q.y = case when p.y = h then h - 1 else p.y + 1 end) + "
    "(select sum(q.v) from p q where q.k = p.k and q.y = p.y and q.x = case p.x when 0 then 1 else p.x - 1 end) + (select sum(q.v) from p q where q.k = p.k and q.y = p.y and q.x = case when p.x = w then w - 1 else p.x + 1 end) - 4 * p.v as d from p) "
    "select k, round(var_pop(d), 6) as variance from d group by k"
)
def blur_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sharp each type's plane of days and hours is: the variance of its second differences."""
    events = _table(spark, sf_dir, "events")
    counts = events.groupBy(F.col("event_type").alias("k"), (F.dayofmonth("ts") - 1).alias("y"), F.hour("ts").alias("x")).agg(F.count(F.lit(1)).alias("v"))
    sides = counts.groupBy("k").agg(F.max("y").alias("h"))
    places = sides.select("k", F.explode(F.sequence(F.lit(0), "h")).alias("y")).select("k", "y", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("x"))
    found = planes.second_difference_variance(places.join(counts, ["k", "y", "x"], "left"), ["k"], tile=16)
    return found.select("k", F.round("variance", 6).alias("variance"))


@registered(
    "with v as (select vec_id, vec_id % 3 as y0, vec_id % 3 + vec_id % 7 as y1, vec_id % 2 as x0, 7 - vec_id % 4 as x1, list_transform(range(8), lambda r: embedding[r * 8 + 1:r * 8 + 8]) as p from embeddings) "
    "select vec_id, case when y1 - y0 > 2 and x1 - x0 > 2 then array_to_string(list_transform(flatten(list_transform(p[y0 + 2:y1 - 1], lambda r: r[x0 + 2:x1 - 1])), lambda x: round(x * 1000)::int), ' ') end as cells from v"
)
def cell_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as planes of 8 x 8: a box of each, without its outermost cells."""
    rows = _table(spark, sf_dir, "embeddings")
    plane = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("embedding", r * 8 + 1, 8))
    i = F.col("vec_id")
    box = [c.cast("int") for c in (i % 3, i % 3 + i % 7, i % 2, 7 - i % 4)]
    cells = cropped(plane, *box, 1)
    thousand = F.lit(1000).cast("float")  # as a whole number it would make the product a double, which rounds otherwise near a half
    return rows.select("vec_id", F.array_join(F.transform(F.flatten(cells), lambda x: F.round(x * thousand).cast("int")), " ").alias("cells"))
