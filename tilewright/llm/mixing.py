"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with built-in functions only.

A document's key is -ln(u) / w: u is a fixed uniform number from its id, w its quality weight, so that
small keys favour good documents. A source takes its documents in the order of (key, id) until their
sizes sum up to its target: complete epochs first, then the first part of one more.

Keys never need a total sort. A key's bucket (some thousands for each source, in the order of keys)
sums sizes by source and bucket; running sums of these name the one bucket in which a source's budget
ends. That bucket is cut into 4,096 finer ones in the same way until it holds few documents, and only
these are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_small, n_words

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Documents of one source that are sorted in one task at most, as far as their keys can be told apart.
MOST_SORTED = 50_000
_FINEST = 3


def quality_weight(text: Column) -> Column:
    """1 for a text without symbols, falling to 0.05 with the share of symbols in it; null and empty texts: 1."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    share = F.when(F.length(text) > 0, symbols.cast("double") / F.length(text))
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(8.0) * share), F.lit(1.0))


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) that depends on the id alone."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**52)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None = None, keep: bool = False) -> DataFrame:
    """_id, _from (the source), _size (words) and _key; with ``keep`` also _doc, a struct of the row's own columns."""
    text = F.col(text_col)
    given = quality_weight(text) if weight is None else F.greatest(F.lit(1e-6), F.coalesce(weight.cast("double"), F.lit(1.0)))
    rows = [F.col(id_col).alias("_id"), F.col(source_col).alias("_from"), n_words(text).alias("_size")]
    rows.append((-F.log(uniform(F.col(id_col))) / given).alias("_key"))
    if keep:
        rows.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    return docs.select(*rows)


def _bucket(key: Column, level: int) -> Column:
    """In the order of keys: at level 0 a bucket spans about 0.3 % of a key, at each further level 1/4096 of that."""
    return F.floor(F.log2(key * 16 + 1) * float(1 << (8 + 12 * level))).cast("long")


def _targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds target: shares of the whole by weight, stopped at ``most`` times the size, the excess shared again.

    Sources are in the order of most * size / weight; those before the first whose share fits its stop
    are stopped. The windows run over one row per source in one task, which bounds the sources to some
    ten millions; documents are not in it.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    given = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_w", given.cast("long")).withColumn(
        "_ratio", (F.col("source_size") * most).cast("double") / F.col("_w")
    )
    before = Window.orderBy("_ratio", F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    shared = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    rows = rows.withColumn("_level", left.cast("double") / shared)
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", F.col("_source"), "_level"))).over(every)
    target = F.least((F.col("source_size") * most).cast("double"), level["_level"] * F.col("_w"))
    return rows.select("_source", "source_size", target.alias("target"))


def _ends(cells: DataFrame, goals: DataFrame) -> DataFrame:
    """(_s, _end, _base, _n): the bucket in which each source's last part ends, the sizes before it, and its rows.

    ``cells`` sums sizes by _source and _bucket; ``goals`` has _source, _rest, and _base, the sizes before the cells.
    """
    running = Window.partitionBy("_source").orderBy("_bucket")
    at = cells.withColumn("_upto", F.sum("cell").over(running))
    at = join_small(at, goals.select(F.col("_source").alias("_s"), "_rest", "_base"), F.col("_source").eqNullSafe(F.col("_s")))
    upto = F.col("_base") + F.col("_upto")
    first = F.struct("_bucket", (upto - F.col("cell")).alias("base"), "n")
    return (
        at.where(upto >= F.col("_rest")).groupBy("_source").agg(F.min(first).alias("end"))
        .select(F.col("_source").alias("_s"), F.col("end._bucket").alias("_end"), F.col("end.base").alias("_base"), F.col("end.n").alias("_n"))
    )


def mix_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, most_sorted: int = MOST_SORTED) -> DataFrame:
    """One row per source: sizes, target, complete epochs, and where in the order of keys the last part ends.

    ``rows`` has _from, _id, _size and _key.
    """
    keyed = rows.select(F.col("_from").alias("_source"), "_id", "_size", "_key")
    summed = (F.sum("_size").alias("cell"), F.count(F.lit(1)).alias("n"))
    cells = cut(keyed.groupBy("_source", _bucket(F.col("_key"), 0).alias("_bucket")).agg(*summed))
    sizes = cells.groupBy("_source").agg(F.sum("cell").alias("source_size"))
    goals = _targets(sizes, weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("epochs", epochs.cast("long")).withColumn("_base", F.lit(0).cast("long"))
    goals = cut(goals.withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size")))

    def inside(ends: DataFrame, level: int) -> DataFrame:
        of = F.col("_source").eqNullSafe(F.col("_s")) & (_bucket(F.col("_key"), level) == F.col("_end"))
        return join_small(keyed, ends, of)

    level, ends = 0, cut(_ends(cells, goals))
    while level < _FINEST and (ends.agg(F.max("_n")).first()[0] or 0) > most_sorted:
        finer = inside(ends.select("_s", "_end"), level).groupBy("_source", _bucket(F.col("_key"), level + 1).alias("_bucket"))
        bases = goals.drop("_base").join(ends, F.col("_source").eqNullSafe(F.col("_s"))).select("_source", "_rest", "_base")
        level, ends = level + 1, cut(_ends(cut(finer.agg(*summed)), cut(bases)))
    ends = ends.join(goals.select("_source", "_rest"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_source")

    # rows of one id have one key; they are one row here, so that even they fill no task
    tied = inside(ends.select("_s", "_end", "_base", "_rest"), level).groupBy("_source", "_key", "_id", "_base", "_rest")
    order = Window.partitionBy("_source").orderBy("_key", "_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum("_size").over(order), F.lit(0))
    last = (
        tied.agg(F.sum("_size").alias("_size")).withColumn("_before", before)
        .where(F.col("_before") * 2 + F.col("_size") <= F.col("_rest") * 2)
        .groupBy("_source").agg(F.max(F.struct("_key", "_id")).alias("_last"))
    )
    first = F.shiftleft(F.col("_end"), 12 * (_FINEST - level)).alias("_first")
    plan = goals.join(ends.select("_s", first), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    plan = plan.join(last.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left")
    return cut(plan.select("_source", "source_size", "target", "epochs", "_first", "_last"))


def mixed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and _copies (how often the mix takes the document) to rows of ``sized``."""
    out = join_small(rows, plan, F.col("_from").eqNullSafe(F.col("_source")))
    more = (_bucket(F.col("_key"), _FINEST) < F.col("_first")) | (F.struct("_key", "_id") <= F.col("_last"))
    copies = F.col("epochs") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)
    return out.withColumn("_copies", copies.cast("long"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None,
    most_sorted: int = MOST_SORTED,
) -> DataFrame:
    """One row per document: id_col, size, source_size, target, taken.

    The whole mix is as large as all documents. A null source is one more source, the last. Null and
    empty texts have size 0, and nothing is taken from them. Rows of one id have one place in the order
    and are taken or left together; all null ids are one id. Ties of keys go by id. Reruns agree, as keys
    depend on ids and weights alone. ``weight`` (by default ``quality_weight``, a share of symbols; a null
    is 1) is a document's quality. Very long texts are counted by one built-in function, in the row. An
    empty table has no rows; other columns, whatever their names, are not looked at.
    """
    rows = cut(sized(docs, id_col, text_col, source_col, weight))
    return mixed(rows, mix_plan(rows, most_sorted=most_sorted)).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target",
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None
) -> DataFrame:
    """The mix itself: each document as often as ``mix`` takes it, with its own columns, whatever their names.

    The plan comes from a written table of sizes and keys, so texts are counted once for it and once for the mix.
    """
    plan = mix_plan(cut(sized(docs, id_col, text_col, source_col, weight)))
    out = mixed(sized(docs, id_col, text_col, source_col, weight, keep=True), plan).where("_copies > 0 and _size > 0")
    return out.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_doc.*")


#: The same rows in DuckDB, from one total sort of each source's keys.
MIX_SQL = r"""
with d as (
  select doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    coalesce(case when length(text) > 0 then greatest(0.05::double, 1.0::double - 8.0::double *
      ((length(text) - length(translate(text, '#*$%&|<>', '')))::double / length(text))) end, 1.0::double) as w,
    ((('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double) as u
  from documents
), k as (select *, -ln(u) / w as key from d),
s as (select source, sum(size)::bigint as source_size from k group by source),
g as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as wt from s),
r as (select *, (source_size * 3)::double / wt as ratio from g),
l as (
  select *,
    ((sum(source_size) over () - coalesce(sum(source_size * 3) over b, 0))::double /
     (sum(wt) over () - coalesce(sum(wt) over b, 0))::double) as level
  from r window b as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)
), v as (select level as found from l where level <= ratio order by ratio, source nulls last limit 1),
t as (
  select source, source_size, least((source_size * 3)::double, found * wt) as target from l, v
), e as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t
), o as (
  select k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
    coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from k join e on k.source is not distinct from e.source
)
select doc_id, size, source_size, target,
  (size * (epochs + case when before * 2 + size <= rest * 2 then 1 else 0 end))::bigint as taken
from o
"""
