"""Queries of the way from scores to playable cards, each with SQL of another form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grids
from ..functions.patterns import FREE_BIT
from ..operators import decode, metrics, signals
from .queries import _table, registered

#: Where each column's fifteen scores begin in a vector of 64; the last two overlap.
_STARTS = (0, 15, 30, 45, 49)
_MICRO = 1_000_000


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five vectors are a card's rows and slices of them the scores of its columns, in millionths; the free cell has none."""
    v = F.transform("embedding", lambda x: F.round(x.cast("decimal(12,6)") * _MICRO).cast("long"))
    parts = F.array(*[F.struct(F.lit(c).alias("c"), F.slice(v, s + 1, 15).alias("s")) for c, s in enumerate(_STARTS)])
    rows = _table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("g"), F.expr("cast(vec_id % 5 as int)").alias("r"), F.explode(parts).alias("p"))
    rows = rows.where(F.col("r") * 5 + F.col("p.c") != FREE_BIT)
    return rows.select("g", F.col("p.c").alias("c"), "r", F.posexplode("p.s").alias("choice", "score"))


def _decode_sql() -> str:
    """The same programme as joins, one row of scores after the other; ``n`` is the row's place among those that a column has."""
    starts = ", ".join(f"({c}, {s})" for c, s in enumerate(_STARTS))
    steps = ["d1 as (select g, c, 1 << choice as used, score * 1048576 + 1048575 - (choice << 16) as v from s where n = 1)"]
    for n in range(2, 6):
        steps.append(
            f"d{n} as (select g, c, used, max(v) as v from (select a.g, a.c, a.used | (1 << s.choice) as used, a.v + s.score * 1048576 - (s.choice << {20 - 4 * n}) as v "
            f"from d{n - 1} a join s on a.g = s.g and a.c = s.c and s.n = {n} where a.used & (1 << s.choice) = 0) group by 1, 2, 3)"
        )
    ends = " union all ".join(f"select g, c, {n} as n, max(v) as v from d{n} group by 1, 2" for n in range(1, 6))
    return (
        f"with recursive p(c, s) as (values {starts}), e as (select vec_id // 5 as g, (vec_id % 5)::int as r, embedding from embeddings), "
        "raw as (select g, r, c, unnest(range(15)) as choice, unnest(list_transform(embedding[s + 1 : s + 15], lambda x: (x::decimal(12,6) * 1000000)::bigint)) as score from e, p where r * 5 + c <> 12), "
        "s as (select *, dense_rank() over (partition by g, c order by r) as n from raw), "
        + ", ".join(steps)
        + f", t as (select g, c, max_by(v, n) as v, max(n) as n from ({ends}) group by 1, 2), "
        "u as (select g, c, (v - low) // 1048576 as total, 1048575 - low as path from (select *, ((v % 1048576) + 1048576) % 1048576 as low from t)), "
        "w as (select t.g, t.c, s.r, s.n, total, (path >> (20 - 4 * s.n)) & 15 as choice from u t join (select distinct g, c, r, n from s) s on t.g = s.g and t.c = s.c), "
        "q as (select w.*, (select exp(a.score / 1e6) / sum(exp(b.score / 1e6)) from s a, s b where a.g = w.g and a.c = w.c and a.r = w.r and a.choice = w.choice and b.g = w.g and b.c = w.c and b.r = w.r group by a.score) as conf from w)"
    )


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.assigned(_scores(spark, sf_dir), ["g", "c"], "r", "choice", "score", unit=1 / _MICRO)


@registered(_decode_sql() + " select g::bigint as g, c::int as c, (max(total) / 1e6)::double as total from q group by g, c")
def assign_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest total score of each card's column with every number used once."""
    return _decoded(spark, sf_dir).select("g", "c", (F.col("total") / F.lit(1e6)).alias("total"))


@registered(_decode_sql() + " select g::bigint as g, c::int as c, r, choice::int as choice, (c * 15 + choice + 1)::int as number from q")
def assign_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that each cell gets by it; missing rows and the free cell have none."""
    rows = _decoded(spark, sf_dir).select("g", "c", F.explode("picks").alias("p"))
    number = F.col("c") * 15 + F.col("p.choice") + 1
    return rows.select("g", "c", F.col("p.row").alias("r"), F.col("p.choice").alias("choice"), number.alias("number"))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, value, conf) of each card."""
    return decode.read_cards(_decoded(spark, sf_dir), ["g"], "c")


_CELLS_SQL = (
    _decode_sql() + ", z as (select g, unnest(range(25)) as place from (select distinct g from e)), "
    "k as (select z.g, place, case when place <> 12 then c * 15 + choice + 1 end as value, coalesce(conf, 0) as conf from z left join q on q.g = z.g and q.r * 5 + q.c = place)"
)


@registered(
    _CELLS_SQL + " select g::bigint as g, place::int as place, value::int as value, place = 12 as is_free_space, place = 12 or value is not null as valid, "
    "case when place = 12 then 'FREE' else value::int::varchar end as raw, case when place = 12 then 100.0 else round(conf * 100, 1) end::double as confidence from k"
)
def card_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each card as 25 cells with value, validity, text and confidence."""
    cards = _cards(spark, sf_dir).select("g", F.posexplode(decode.card_cells(F.col("value"), F.col("conf"))).alias("place", "x"))
    return cards.select("g", "place", "x.*")


@registered(
    _CELLS_SQL + " select g::bigint as g, count(*) filter (where place <> 12 and value is null)::int as missing, round(avg(conf) filter (where place <> 12), 4) as mean, "
    "bool_or(place <> 12 and value is null) or avg(conf) filter (where place <> 12) < 0.08::double or min(conf) filter (where place <> 12) < 0.05::double or g % 9 = 4 as needs_review from k group by g"
)
def card_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cards to look at; scores of random vectors are flat, so the bounds are lower than for a trained reader, and every ninth image is blurred."""
    blur = F.when(F.col("g") % 9 == 4, 100.0).otherwise(900.0)
    review = decode.needs_review(F.col("value"), F.col("conf"), blur, mean=0.08, least=0.05)
    others = F.filter("conf", lambda _, i: i != FREE_BIT)
    missing = F.size(F.filter("value", lambda v: v.isNull())) - 1
    mean = F.round(F.aggregate(others, F.lit(0.0), lambda a, b: a + b) / 24, 4)
    return _cards(spark, sf_dir).select("g", missing.alias("missing"), mean.alias("mean"), review.alias("needs_review"))


def _grids_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, grid): each vector's numbers in parts of 25 as grids: some cells null, some out of range, the last grid and some others short."""
    cell = lambda x, i: F.when(x > -0.25, F.floor(F.abs(x) * 60).cast("int") + 1 + 15 * (i % 5))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    values = F.transform(F.slice("v", F.col("k") * 25 + 1, F.when(F.col("vec_id") % 7 == 0, 20).otherwise(25)), cell)
    high = F.ceil(F.size("values") / 5).cast("int")
    rows = rows.select((F.col("vec_id") * 3 + F.col("k")).alias("id"), values.alias("values"))
    return rows.select("id", F.transform(F.sequence(F.lit(0), high - 1), lambda r: F.slice("values", r * 5 + 1, F.lit(5))).alias("grid"))


_GRID_SQL = (
    "with p as (select vec_id * 3 + k as id, embedding[k * 25 + 1 : k * 25 + case when vec_id % 7 = 0 then 20 else 25 end]::double[] as xs from (select *, unnest(range(3)) as k from embeddings)), "
    "v as (select id, list_transform(xs, lambda x, i: case when x > -0.25 then floor(abs(x) * 60)::int + 1 + 15 * ((i - 1) % 5) end) as xs from p), "
    "c as (select id, unnest(range(len(xs))) as place, unnest(xs) as x from v), "
    "k as (select *, case when place = 12 then null when x is null then 'missing' when x not between place % 5 * 15 + 1 and place % 5 * 15 + 15 then 'out of range' end as kind from c)"
)


@registered(
    _GRID_SQL + " select id, count(*) = 25 as square, count(*) filter (where kind = 'missing')::int as missing, count(*) filter (where kind = 'out of range')::int as outside, "
    "case when count(*) = 25 and count(kind) = 0 then string_agg(case when place = 12 then 'FREE' else substr('BINGO', (place % 5)::int + 1, 1) || x end, ' ' order by place) end as labels from k group by id"
)
def grid_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which grids are playable: their labels, or how many cells are missing or out of range."""
    rows = _grids_of_vectors(spark, sf_dir)
    of = lambda kind: F.size(F.filter(grids.violations(F.col("grid")), lambda x: x["kind"] == kind))
    return rows.select(
        "id", grids.is_square(F.col("grid")).alias("square"), of("missing").alias("missing"), of("out of range").alias("outside"),
        F.array_join(grids.labelled(F.col("grid")), " ").alias("labels"),
    )


@registered(_GRID_SQL + " select id, place::int // 5 as r, place::int % 5 as c, x as value, kind from k where kind is not null")
def grid_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that keep grids from play."""
    rows = _grids_of_vectors(spark, sf_dir).select("id", F.explode(grids.violations(F.col("grid"))).alias("x"))
    return rows.select("id", "x.*")


@registered(
    "with c as (select p_partkey, (p_partkey % 25)::int as place, case when p_size % 11 = 0 then '' when p_size % 7 = 0 then 'x' || p_size else ((p_size * 3) % 80)::varchar end as raw from part), "
    "v as (select *, case when regexp_full_match(raw, '[0-9]+') then raw::int end as value from c) "
    "select p_partkey, case when place <> 12 then value end as value, place = 12 as is_free_space, place = 12 or coalesce(value between place % 5 * 15 + 1 and place % 5 * 15 + 15, false) as valid, raw from v"
)
def checked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised texts as cells: digits, and in the range of their column."""
    size = F.col("p_size")
    raw = F.when(size % 11 == 0, "").when(size % 7 == 0, F.concat(F.lit("x"), size)).otherwise((size * 3 % 80).cast("string"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", grids.checked_cell(raw, (F.col("p_partkey") % 25).cast("int")).alias("x"))
    return rows.select("p_partkey", "x.*")


@registered(
    "with a as (select p_partkey // 24 as card, list(p_size order by p_partkey) as xs from part group by 1), "
    "s as (select card, unnest(xs) as value, unnest(range(24)) as i from a where len(xs) = 24), p as (select card, value, case when i >= 12 then i + 1 else i end as place from s) "
    "select card::bigint as card, (place % 5)::int as r, (place // 5)::int as c, value from p"
)
def dictated_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by twenty-four, read column by column with the free cell left out; a lot of fewer is no card."""
    items = F.array_sort(F.collect_list(F.struct("p_partkey", "p_size")))["p_size"]
    rows = _table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 24").alias("card")).agg(grids.by_columns(items).alias("grid")).where("grid is not null")
    cells = rows.select("card", F.posexplode("grid").alias("at", "value")).where(F.col("at") != FREE_BIT)
    return cells.select("card", F.expr("cast(at div 5 as int)").alias("r"), (F.col("at") % 5).alias("c"), "value")


@registered(
    "select p_partkey, case when lo <= hi then h between lo and hi else h >= lo or h <= hi end as inside from "
    "(select *, (p_size * 7) % 180 as h, (p_partkey * 13) % 180 as lo, (p_partkey * 29) % 180 as hi from part)"
)
def hue_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a hue lies in a range that may go through red."""
    h, key = F.col("p_size") * 7 % 180, F.col("p_partkey")
    return _table(spark, sf_dir, "part").select("p_partkey", grids.in_wrapped(h, key * 13 % 180, key * 29 % 180).alias("inside"))


@registered(
    "select p_partkey, trunc(p_size * 1.25::double)::int as x0, trunc((p_size + 7) * 0.75::double)::int as y0, trunc((p_size + 90) * 1.25::double)::int as x1, trunc((p_size + 201) * 0.75::double)::int as y1, "
    "list_aggregate(list_transform(range(6), lambda k: round_even(k * p_size::double / 5, 0)::int), 'string_agg', ' ') as rounded, list_aggregate(list_transform(range(6), lambda k: floor(k * p_size::double / 5)::int), 'string_agg', ' ') as floored from part"
)
def scaled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes scaled to another image's size, and an extent cut into five."""
    size = F.col("p_size")
    box = grids.scaled_box(F.array(size, size + 7, size + 90, size + 201), F.lit(1.25), F.lit(0.75))
    rows = _table(spark, sf_dir, "part").select("p_partkey", box.alias("b"), size)
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    return rows.select(
        "p_partkey", *[F.col("b")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))],
        text(grids.cuts(size)).alias("rounded"), text(grids.cuts(size, floor=True)).alias("floored"),
    )


@registered(
    "with v as (select vec_id, vec_id % 5 as c, embedding[1:64]::double[] as x from embeddings), a as (select vec_id, c, (list_position(x, list_max(x)) * 75) // 64 as n from v) "
    "select vec_id, n::int as number, n between c * 15 + 1 and c * 15 + 15 as valid from a"
)
def argmax_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of each vector's largest score (its place, spread over 1 to 75), and whether its column may hold it."""
    v = F.col("embedding").cast("array<double>")
    number = F.expr("cast((at + 1) * 75 div 64 as int)")
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", signals.first_largest(v).alias("at"))
    return rows.select("vec_id", number.alias("number")).withColumn("valid", F.expr("number between vec_id % 5 * 15 + 1 and vec_id % 5 * 15 + 15"))


#: Words that the confidences belong to, over and over; some are blank.
_WORDS = ["a", "", "b", " ", "c", "d", "", "e"]


@registered(
    f"with m as (select vec_id, coalesce(avg(c) filter (where trim(w) <> '' and c >= 0), 0) as mean from (select vec_id, unnest(list_transform(embedding, lambda x: x::double)) as c, unnest({_WORDS * 8}) as w from embeddings) group by 1), "
    "q as (select vec_id, p, list_transform(embedding[p * 4 + 1:p * 4 + 4], lambda x: x::double) as v from embeddings, (select unnest(range(16)) as p)) "
    "select vec_id, p::int as part, (abs(floor(v[1] * 10)) % 10 * 10 + abs(floor(v[2] * 10)) % 10)::int as value, round((abs(v[3]) + abs(v[4])) / 2, 6) as conf, round(mean, 6) as mean from q join m using (vec_id)"
)
def digit_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read as two digits with their mean confidence, sixteen of each vector, and the mean confidence of its words that are not blank."""
    v = F.col("embedding").cast("array<double>")
    mean = metrics.mean_confidence(v, F.array(*map(F.lit, _WORDS * 8)))
    fours = F.transform(F.sequence(F.lit(1), F.lit(61), F.lit(4)), lambda i: F.slice(v, i, 4))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.round(mean, 6).alias("mean"), F.posexplode(fours).alias("part", "v"))
    digit = lambda i: F.abs(F.floor(F.col("v")[i] * 10)) % 10
    pair = metrics.digit_reading(digit(0), digit(1), F.abs(F.col("v")[2]), F.abs(F.col("v")[3]))
    return rows.withColumn("p", pair).select("vec_id", "part", F.col("p.value").cast("int").alias("value"), F.round("p.conf", 6).alias("conf"), "mean")
