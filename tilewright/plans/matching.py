"""Queries of nearest neighbours, releases, messages and sheets, each with SQL of another form."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cards import call_positions, random_grid
from ..functions.geometry import completed_lines, line_at, projected
from ..functions.numbers import TOKEN, WORDS, is_free, number_of
from ..functions.patterns import FREE_BIT, PATTERNS, first_win
from ..operators import metrics, nearest, signals
from ..operators.running import running
from ..operators.tables import dealt
from ..streaming import pending
from .queries import _DAYS_SQL, _TYPES, ORACLE_SQL, QUERIES, _days, _lines_sql, _predicted, _table, registered


@registered(
    "with d as (select q.vec_id as query, r.vec_id as neighbour, round(sqrt(list_sum(list_transform(list_zip(q.embedding::double[], r.embedding::double[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 4) as far "
    "from embeddings q join embeddings r on q.vec_id <> r.vec_id where q.vec_id % 100 = 0), "
    "n as (select *, row_number() over (partition by query order by far, neighbour) as r from d) "
    "select a.query, a.neighbour as first, b.neighbour as second, a.far as first_far, b.far as second_far, a.far < 0.75::double * b.far as accepted from n a join n b on a.query = b.query and a.r = 1 and b.r = 2"
)
def knn_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest vectors of each query (ids divisible by 100) among all; a match is clear when the first is 0.75 as far at most."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    near = nearest.k_nearest(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 2)
    of = lambda rank, name: F.max(F.when(F.col("rank") == rank, F.col(name)))
    both = near.groupBy("query").agg(
        of(1, "neighbour").alias("first"), of(2, "neighbour").alias("second"), of(1, "distance").alias("first_far"), of(2, "distance").alias("second_far")
    )
    return both.where("second is not null").withColumn("accepted", F.col("first_far") < F.col("second_far") * 0.75)


def knn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest vectors of each query (ids divisible by 100) through an index over all; SQL can't tell which ones it misses."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.indexed_nearest(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 2)


QUERIES["knn_index"] = knn_index


@registered(
    "with t as (select user_id, event_id, epoch_us(ts)::bigint as us from events), p as (select t.* from t join events e using (event_id) where e.event_type = 'purchase'), "
    "v as (select t.* from t join events e using (event_id) where e.event_type = 'view'), "
    "near as (select p.event_id, v.us, row_number() over (partition by p.event_id order by abs(v.us - p.us), v.us) as r from p join v on p.user_id = v.user_id and abs(v.us - p.us) <= 21600000000) "
    "select p.event_id, near.us as snapped_to from p left join near on near.event_id = p.event_id and r = 1"
)
def snap_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the time of the user's nearest view within six hours."""
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    buys = rows.where("event_type = 'purchase'").select("user_id", "event_id", "us")
    views = rows.where("event_type = 'view'").select("user_id", "us")
    return nearest.snapped(buys, views, ["user_id"], "us", 6 * 3_600_000_000).select("event_id", "snapped_to")


_CENTRES = ORACLE_SQL["confusion"].rpartition(" select ")[0]
_SMALL = _CENTRES.removeprefix("with ").replace("embeddings", "small")
for _name in "cldb":
    _SMALL = _SMALL.replace(f" from {_name}", f" from s{_name}").replace(f"{_name} as (", f"s{_name} as (", 1)
_SMALL = _SMALL.replace("e, l)", "e, sl l)")


@registered(
    f"{_CENTRES}, small as (select vec_id, label, embedding[1:16] as embedding from embeddings), {_SMALL}, "
    "w as (select truth as label, count(*) filter (where truth = pred) / count(*)::double as was from b group by 1), "
    "n as (select truth as label, count(*) filter (where truth = pred) / count(*)::double as now from sb group by 1) "
    "select label, coalesce(was, 0) as was, coalesce(now, 0) as now from w full join n using (label) where coalesce(now, 0) < coalesce(was, 0) - 0.05::double"
)
def worst_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that lose when centres know 16 dimensions instead of 64."""
    was = metrics.per_class(_predicted(spark, sf_dir), "truth", "pred")
    now = metrics.per_class(_predicted(spark, sf_dir, 16), "truth", "pred")
    return metrics.worst_classes(was, now, "truth").withColumnRenamed("truth", "label")


@registered(
    "with s as (select *, (select p.event_id from events p where p.user_id = e.user_id and p.event_type in ('signup', 'purchase', 'error') and (p.ts, p.event_id) < (e.ts, e.event_id) order by p.ts desc, p.event_id desc limit 1) as since "
    "from events e where event_type in ('click', 'view')), "
    "r as (select s.*, c.event_type as state, row_number() over (partition by s.user_id, since, (day(s.ts) % 5) * 5 + list_position(['click','view'], s.event_type) order by s.ts, s.event_id) as again from s left join events c on c.event_id = s.since), "
    "m as (select case when state is null then 'no_game' when state = 'signup' then 'not_started' when state = 'error' then 'over' when again > 1 then 'repeat' end as reason from r) "
    "select reason, count(*)::bigint as n from m where reason is not null group by reason"
)
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why calls are turned away: no game, not started, over, or the cell was called before in the same game."""
    change = F.when(F.col("event_type").isin("signup", "purchase", "error"), F.col("event_type"))
    kind = F.array_position(F.array(*map(F.lit, _TYPES)), F.col("event_type"))
    events = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", (F.dayofmonth("ts") % 5 * 5 + kind).alias("cell"))
    rows = running(events, ["user_id"], ["ts", "event_id"], {"game": change.isNotNull().cast("long")}, {"state": change}, before=True)
    calls = rows.where(F.col("event_type").isin("click", "view")).groupBy("user_id", "game", "state", "cell").agg(F.count(F.lit(1)).alias("n"))
    reason = F.when(F.col("state").isNull(), "no_game").when(F.col("state") == "signup", "not_started").when(F.col("state") == "error", "over").otherwise("repeat")
    turned = F.when(reason == "repeat", F.col("n") - 1).otherwise(F.col("n"))
    return calls.groupBy(reason.alias("reason")).agg(F.sum(turned).alias("n")).where("n > 0")


@registered(
    "with g as (select *, sum((event_type = 'signup')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as game from events), "
    "s as (select user_id, game, ts as opened from g where event_type = 'signup'), "
    "e as (select user_id, game, ts as ended, event_type, row_number() over (partition by user_id, game order by ts, event_id) as r from g where event_type in ('purchase', 'error')) "
    "select case when ended is null then 'expired' when event_type = 'purchase' then 'confirmed' else 'rejected' end as outcome, count(*)::bigint as n "
    "from s left join e on s.user_id = e.user_id and s.game = e.game and r = 1 and ended <= opened + interval 6 hour group by 1"
)
def pending_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as scans: the next purchase confirms, the next error rejects, six hours expire."""
    events = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    rows = running(events, ["user_id"], ["ts", "event_id"], {"game": (F.col("event_type") == "signup").cast("long")})
    rows = rows.withColumn("scan_id", F.concat_ws("-", "user_id", "game"))
    scans = rows.where("event_type = 'signup'").select("scan_id", F.col("ts").alias("scan_ts"))
    first = F.min(F.struct("ts", "event_id", "event_type")).alias("first")
    ends = rows.where("event_type in ('purchase', 'error')").groupBy("scan_id").agg(first)
    kind = F.when(F.col("first.event_type") == "purchase", "confirmed").otherwise("rejected")
    found = pending.scan_outcomes(scans, ends.select("scan_id", F.col("first.ts").alias("end_ts"), kind.alias("kind")))
    return found.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@registered(
    "with w as (select trim(unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), ',') as w from documents), "
    f"v as (select coalesce(case when regexp_full_match(w, '[0-9]+') then try_cast(w as bigint) end, list_position({WORDS}, lower(w)) - 1) as value, upper(w) = 'FREE' as free from w) "
    "select value::bigint as value, count(*)::bigint as n from v where value is not null or free group by value"
)
def word_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each number is written, in digits or as a word of 0 to 19; the free cell is null."""
    words = _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("w"))
    named = words.select(number_of(F.col("w")).alias("value"), is_free(F.col("w")).alias("free")).where("value is not null or free")
    return named.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@registered(
    _DAYS_SQL + ", t0 as (select * from d), "
    + ", ".join(
        f"p{i} as (select event_type, day, v from (select *, row_number() over (partition by event_type order by v desc, day) as r from t{i}) where r = 1), "
        f"t{i + 1} as (select t.* from t{i} t join p{i} p on t.event_type = p.event_type and abs(t.day - p.day) >= 4)"
        for i in range(3)
    )
    + " select * from p0 union all select * from p1 union all select * from p2"
)
def spaced_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type's three busiest days that are four days apart or more."""
    return signals.spaced_peaks(_days(spark, sf_dir), ["event_type"], "day", "v", apart=4).select("event_type", "day", "v")


@registered(
    "with g as (select d.lang, l.quality, case when n_chars > 100 then (n_chars > 400)::int end as guess from documents d join labels l on d.doc_id = l.doc_id) "
    "select lang, count(*) filter (where guess = quality)::bigint as ok, count(*) filter (where guess is distinct from quality)::bigint as bad, "
    "round(sum(case when guess is null then 999 else abs(quality - guess) end) filter (where guess is distinct from quality)::double / count(*) filter (where guess is distinct from quality), 6) as error from g group by lang"
)
def sheet_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right and wrong guesses by language, and how far off the wrong ones are."""
    guess = F.when(F.col("n_chars") > 100, (F.col("n_chars") > 400).cast("int"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", guess.alias("guess"))
    both = docs.join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return metrics.group_errors(both, ["lang"], "quality", "guess").withColumn("error", F.round("error", 6))


@registered(
    "with s as (select label, list_position(v, list_max(v)) - 1 as place, round(1.0 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6)::decimal(12,6) as conf from (select label, embedding::double[] as v from embeddings)) "
    f"select label, coalesce(sum(conf)::double / count(*), 0) as mean, min(conf)::double as least from s where place <> {FREE_BIT} group by label"
)
def confidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and least confidence by label, readings of the free place left out."""
    v = F.col("embedding").cast("array<double>")
    rows = _table(spark, sf_dir, "embeddings").select(
        "label", signals.first_largest(v).alias("at"), F.round(signals.softmax_top(v), 6).cast("decimal(12,6)").alias("conf")
    ).where(F.col("at") != FREE_BIT)
    mean = F.sum("conf").cast("double") / F.count(F.lit(1))
    return rows.groupBy("label").agg(F.coalesce(mean, F.lit(0.0)).alias("mean"), F.min("conf").cast("double").alias("least"))


@registered("select (greatest(coalesce((select max(c_custkey) from customer), 0), coalesce((select max(s_suppkey) from supplier), 0)) + 1)::bigint as next_id")
def next_sequence_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next free number over two sources; 1 if both are empty."""
    both = _table(spark, sf_dir, "customer").select("c_custkey").union(_table(spark, sf_dir, "supplier").select("s_suppkey"))
    return both.agg((F.coalesce(F.max("c_custkey"), F.lit(0)) + 1).alias("next_id"))


@registered(
    "select o_orderkey, n from (select o.o_orderkey, (select count(*) from customer c2 where c2.c_nationkey = c.c_nationkey) + (select count(*) from supplier s where s.s_nationkey = c.c_nationkey) as n "
    "from orders o join customer c on c.c_custkey = o.o_custkey)"
)
def recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many customers and hosts of its nation each order is sent to: counted by nation first, never expanded."""
    people = _table(spark, sf_dir, "customer").select("c_nationkey").unionAll(_table(spark, sf_dir, "supplier").select("s_nationkey"))
    sizes = people.groupBy(F.col("c_nationkey").alias("to")).agg(F.count(F.lit(1)).alias("n"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    senders = orders.join(_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return senders.join(sizes, F.col("c_nationkey") == F.col("to")).select("o_orderkey", "n")


@registered(
    "with p as (select p_brand, p_partkey, p_size as x, (p_retailprice / 20)::int as y from part), "
    "r as (select *, row_number() over (partition by p_brand order by x + y, p_partkey) as a, row_number() over (partition by p_brand order by x + y desc, p_partkey) as c, "
    "row_number() over (partition by p_brand order by y - x, p_partkey) as b, row_number() over (partition by p_brand order by y - x desc, p_partkey) as d from p) "
    "select p_brand, max(p_partkey) filter (where a = 1) as top_left, max(p_partkey) filter (where b = 1) as top_right, max(p_partkey) filter (where c = 1) as bottom_right, max(p_partkey) filter (where d = 1) as bottom_left from r group by p_brand"
)
def corner_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corner points of each brand's parts in the plane of size and price, by sums and differences."""
    rows = _table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").alias("x"), F.bround(F.col("p_retailprice") / 20).cast("int").alias("y"))
    total, slope = F.col("x") + F.col("y"), F.col("y") - F.col("x")
    at = lambda by: F.min(F.struct(by.alias("by"), F.col("p_partkey"))).getField("p_partkey")
    return rows.groupBy("p_brand").agg(
        at(total).alias("top_left"), at(slope).alias("top_right"), at(-total).alias("bottom_right"), at(-slope).alias("bottom_left")
    )


@registered(
    "with n as (select unnest(generate_series(1, 75)) as n), calls as (select n, row_number() over (order by md5('call-' || n)) as pos from n), "
    "drawn as (select c_custkey, n, (n - 1) // 15 as c, row_number() over (partition by c_custkey, (n - 1) // 15 order by md5('card-' || c_custkey || '-' || n)) - 1 as r from customer, n), "
    "cells as (select c_custkey, r * 5 + c as bit, case when r * 5 + c = 12 then 0 else pos end as pos from drawn join calls using (n) where r < 5), "
    f"lines(line, bit) as (values {_lines_sql()}), "
    "done as (select c_custkey, line, max(pos) as pos from cells join lines using (bit) group by 1, 2) select c_custkey, min(pos)::bigint as win_seq from done group by 1"
)
def load_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random card for each customer and 75 calls: all first wins in one projection, for which customers are dealt to all tasks."""
    calls = sorted(range(1, 76), key=lambda n: hashlib.md5(f"call-{n}".encode()).hexdigest())
    cards = dealt(_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("c_custkey", random_grid(F.col("c_custkey"), "card").alias("grid"))
    return cards.select("c_custkey", first_win(PATTERNS["standard"], call_positions(F.col("grid"), calls)).alias("win_seq"))


def _misfit_sql(rows: str, lines: str) -> str:
    """Rows with the median of the gaps of sorted lines (pitch), and how far any gap is from it (far)."""
    gaps = f"select *, list_transform(range(1, len({lines})), lambda i: {lines}[i + 1] - {lines}[i]) as g from {rows}"
    pitch = f"select *, list_aggregate(g, 'median') as pitch from ({gaps})"
    return f"select * exclude (g), list_max(list_transform(g, lambda v: abs(v - pitch))) as far from ({pitch})"


@registered(
    "with recursive v as (select vec_id * 6 + k as lattice, list_sort(list_transform(embedding[k * 12 + 1 : k * 12 + 12], lambda x: floor(x::double * 100))) as xs from (select *, unnest(range(6)) as k from embeddings)), "
    "s as (select lattice, xs from v "
    f"union all select lattice, arg_min(ys, far * 100 + j) from ({_misfit_sql('(select lattice, j, list_filter(xs, lambda x, i: i <> j) as ys from (select lattice, xs, unnest(range(1, len(xs) + 1)) as j from (' + _misfit_sql('s', 'xs') + ') where len(xs) >= 4 and far > pitch * 0.12::double))', 'ys')}) group by lattice) "
    "select lattice, len(xs)::int as n, xs[1] as first, xs[-1] as last from (select lattice, arg_min(xs, len(xs)) as xs from s group by lattice)"
)
def lattice_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's numbers in parts of twelve as lines, those that fit no common pitch dropped one by one, without a shuffle."""
    lines = F.transform(F.slice("embedding", F.col("k") * 12 + 1, F.lit(12)), lambda x: F.floor(x.cast("double") * 100).cast("double"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    rows = rows.select((F.col("vec_id") * 6 + F.col("k")).alias("lattice"), signals.fitting_lines(lines).alias("xs"))
    return rows.select("lattice", F.size("xs").alias("n"), F.get("xs", F.lit(0)).alias("first"), F.element_at("xs", -1).alias("last"))


_TILT = (1.5, 0.25, -40.0, -0.125, 2.0, 12.0, 0.001, -0.0005, 1.0)


@registered(
    "with p as (select p_partkey, p_size::double as x, p_retailprice as y from part), w as (select *, {6}::double * x + {7}::double * y + {8}::double as w from p) "
    "select p_partkey, round(({0}::double * x + {1}::double * y + {2}::double) / w, 6) as x, round(({3}::double * x + {4}::double * y + {5}::double) / w, 6) as y from w".format(*_TILT)
)
def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's point (size, price) under a fixed homography."""
    at = projected(F.array(*map(F.lit, _TILT)), F.col("p_size").cast("double"), F.col("p_retailprice"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", at.alias("at"))
    return rows.select("p_partkey", F.round("at.x", 6).alias("x"), F.round("at.y", 6).alias("y"))


def _fours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lattice, p): all numbers of each vector in parts of four, as whole numbers."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    part = F.transform(F.slice("embedding", F.col("k") * 4 + 1, F.lit(4)), lambda x: F.floor(x.cast("double") * 100).cast("double"))
    return rows.select((F.col("vec_id") * 16 + F.col("k")).alias("lattice"), part.alias("p"))


_FOURS_SQL = "with f as (select vec_id * 16 + k as lattice, list_transform(embedding[k * 4 + 1 : k * 4 + 4], lambda x: floor(x::double * 100)) as p from (select *, unnest(range(16)) as k from embeddings)), "


@registered(
    _FOURS_SQL + "v as (select lattice, list_sort(p) as xs from f), "
    "g as (select *, [xs[2] - xs[1], xs[3] - xs[2], xs[4] - xs[3]] as g from v), p as (select *, list_aggregate(g, 'median') as pitch from g), "
    "k as (select *, case when g[1] < 0.7::double * pitch then xs[2:4] else xs end as kept from p where pitch > 0) "
    "select lattice, len(kept)::int as own, list_sum(kept) + (6 - len(kept)) * xs[4] + (case when len(kept) = 3 then 6 else 3 end) * round_even(pitch, 0) as total from k"
)
def lattice_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numbers each as lines of a lattice, completed to six: how many are its own, and the sum of all."""
    rows = _fours(spark, sf_dir).select("lattice", F.array_sort("p").alias("xs"))
    rows = rows.withColumn("all", completed_lines(F.col("xs")))
    own = F.size(F.filter("all", lambda x: x <= F.element_at("xs", -1)))  # the pitch of whole numbers is 1 at least
    total = F.aggregate("all", F.lit(0.0), lambda s, x: s + x)
    return rows.where("all is not null").select("lattice", own.alias("own"), total.alias("total"))


@registered(
    _FOURS_SQL + "s as (select lattice, p, case when p[4] = p[2] then 0 else (p[3] - p[1]) / (p[4] - p[2]) end as slope from f) "
    "select lattice, round(p[1] - slope * p[2], 6) as above, round(p[3] + slope * (1000 - p[4]), 6) as below from s"
)
def line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines through two points of four numbers each, continued up to the ordinate 0 and down to 1,000."""
    p = [F.get("p", F.lit(i)) for i in range(4)]
    above, below = line_at(*p, F.lit(0.0)), line_at(p[2], p[3], p[0], p[1], F.lit(1000.0))
    return _fours(spark, sf_dir).select("lattice", F.round(above, 6).alias("above"), F.round(below, 6).alias("below"))
