"""Queries of names, ids, splits, manifests and comparisons with stored results, each with SQL of another form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cards import random_grid
from ..operators import metrics, readers
from ..operators.tables import dealt, shared_dir
from ..sources import files, manifests, pending, text
from .queries import _table, registered


@registered(
    "select event_id, substr(sha256(user_id || '-' || event_id), 1, 32) as id, "
    "printf('%d_%s_c%d_r%dc%d%s.jpg', epoch_us(ts)::bigint // 1000000, substr(sha256(event_id::varchar), 1, 8), user_id % 3 + 1, event_id % 5, event_id % 7 % 5, case when event_id % 4 = 0 then '_x' else '' end) as name, "
    "strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso, nullif(regexp_replace(props, '[^0-9]', '', 'g'), '') as digits, "
    "strptime(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S') <= ts and ts - strptime(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S') < interval 1 second as same_second from events"
)
def record_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that reruns repeat, file names of cells, times as text and back, and the digits of a text."""
    key, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    name = files.format_name(
        F.unix_seconds(ts), F.substring(F.sha2(key.cast("string"), 256), 1, 8), F.col("user_id") % 3 + 1, key % 5, key % 7 % 5, key % 4 == 0
    )
    iso = files.iso_text(F.col("ts"))
    back = files.iso_time(iso)
    return _table(spark, sf_dir, "events").select(
        "event_id", files.stable_id("user_id", "event_id").alias("id"), name.alias("name"), iso.alias("iso"), files.digits_of(F.col("props")).alias("digits"),
        ((back <= F.col("ts")) & (F.col("ts") < back + F.make_interval(secs=F.lit(1)))).alias("same_second"),
    )


@registered(
    "with b as (select doc_id, n_chars, 'first' as batch from documents where lang = 'en' union all select doc_id, n_chars, 'second' from documents where lang <> 'en' or lang is null), "
    "s as (select *, case when doc_id % 11 = 0 then null else doc_id % 83 end as sheet from b where doc_id % 83 not in (7, 40)), "
    "e as (select s.*, l.quality, case when doc_id % 13 = 0 then null else 1000 + doc_id end as epoch from s left join labels l using (doc_id)), "
    "g as (select case when sheet between 1 and 65 then 'train' else 'valid' end as split, case when quality is null then 'no_truth' when n_chars < 100 then 'blank' else 'ok' end as reason from e where epoch >= 1050) "
    "select split, reason, count(*)::bigint as n from g group by 1, 2"
)
def training_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches without the excluded sheets and those of too old or unknown origin: how many cells go where, and why."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    batches = docs.where("lang = 'en'").unionByName(docs.where("lang <> 'en' or lang is null"))
    excluded = spark.createDataFrame([(7,), (40,)], "bad long")
    kept = batches.join(F.broadcast(excluded), F.col("doc_id") % 83 == F.col("bad"), "left_anti")  # two rows
    rows = kept.join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = rows.withColumn("sheet", F.when(F.col("doc_id") % 11 != 0, F.col("doc_id") % 83)).withColumn("epoch", F.when(F.col("doc_id") % 13 != 0, F.col("doc_id") + 1000))
    reason = F.when(F.col("quality").isNull(), "no_truth").when(F.col("n_chars") < 100, "blank").otherwise("ok")
    rows = metrics.proven(rows, "epoch", 1050).select(metrics.split_of(F.col("sheet")).alias("split"), reason.alias("reason"))
    return rows.groupBy("split", "reason").agg(F.count(F.lit(1)).alias("n"))


@registered("select d.doc_id, quality from documents d join labels l on d.doc_id = l.doc_id where n_chars > 0")
def confirmed_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed cells whose crop is there; the others are passed over."""
    docs = _table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id")
    return docs.join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@registered("select o_custkey, o_orderkey, o_orderstatus as status, o_totalprice > 150000 as partial, row_number() over (partition by o_custkey order by o_orderkey) as place from orders")
def golden_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of cases for each customer, one JSON object with a key for each order, as rows in the order of its keys as numbers."""
    case = F.struct(F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") > 150000).alias("partial"))
    held = F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").cast("string"), case)))  # one customer's orders
    texts = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(held).alias("text"))
    rows = manifests.cases(texts, "text", "status string, partial boolean", ["o_custkey"])
    return rows.select("o_custkey", F.col("key").cast("long").alias("o_orderkey"), "case.status", "case.partial", F.col("place").cast("long").alias("place"))


@registered(
    "with g as (select l_orderkey as k, l_linenumber as c, min(l_partkey) as v from lineitem where l_orderkey % 7 <> 0 group by 1, 2), "
    "a as (select l_orderkey as k, l_linenumber as c, min(case when l_quantity > 45 then l_partkey + 1 when l_quantity > 43 then null else l_partkey end) as v from lineitem where l_orderkey % 11 <> 0 group by 1, 2), "
    "b as (select coalesce(g.k, a.k) as k, g.v is distinct from a.v as off, g.k is null as extra, a.k is null as lost from g full join a on g.k = a.k and g.c = a.c) "
    "select k as o_orderkey, count(*) filter (where off)::bigint as off, count(*) filter (where extra)::bigint as extra, count(*) filter (where lost)::bigint as lost from b group by k having count(*) filter (where off or extra or lost) > 0"
)
def golden_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which orders differ from a stored reading, and in how many cells; cells that only one side has count."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("cell"), "l_partkey", "l_quantity")
    seen = F.when(F.col("l_quantity") > 45, F.col("l_partkey") + 1).when(F.col("l_quantity") > 43, None).otherwise(F.col("l_partkey"))
    golden = rows.where("key % 7 <> 0").groupBy("key", "cell").agg(F.min("l_partkey").alias("value"))
    actual = rows.where("key % 11 <> 0").groupBy("key", "cell").agg(F.min(seen).alias("value"))
    return manifests.mismatched(golden, actual).withColumnRenamed("key", "o_orderkey")


def _mostly_positive():
    """Whether more than half of a vector's 64 numbers are positive."""
    return F.size(F.filter("embedding", lambda x: x > 0)) > 32


@registered(
    "with p as (select vec_id, label, (len(list_filter(embedding, lambda x: x > 0)) > 32)::int * 3 as guess from embeddings), w as (select *, row_number() over (order by vec_id) as r from p where guess <> label) "
    "select vec_id, label, guess from w where r <= 40"
)
def first_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty wrong readings, in the order of their ids."""
    guess = _mostly_positive().cast("int") * 3
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "label", guess.alias("guess"))
    return rows.where("guess <> label").orderBy("vec_id").limit(40)


@registered("select p_partkey, (select count(*) from range(1, 76) t(n) where n::varchar < (p_size)::varchar)::int as class from part")
def class_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of a number among the numbers 1 to 75 sorted as texts, which is how a reader's classes are numbered."""
    return _table(spark, sf_dir, "part").select("p_partkey", metrics.class_of(F.col("p_size")).alias("class"))


@registered(
    "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::bigint as joined_seq, "
    "'{\"id\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}' as card from orders"
)
def joined_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A player's cards in the order in which they came, each as JSON without the player's id."""
    order = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = _table(spark, sf_dir, "orders").withColumn("joined_seq", order.cast("long"))
    card = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))
    return rows.select("o_custkey", "o_orderkey", "joined_seq", card.alias("card"))


@registered(
    "select label, count(*) filter (where near)::bigint as correct, count(*)::bigint as total, round(avg(near::int), 6) as accuracy from "
    "(select label, (len(list_filter(embedding, lambda x: x > 0)) > 32) = (label % 2 = 0) as near from embeddings) group by label"
)
def accuracy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right answers, all answers and their share by label."""
    near = _mostly_positive() == (F.col("label") % 2 == 0)
    rows = _table(spark, sf_dir, "embeddings").select("label", near.alias("near"))
    return rows.groupBy("label").agg(F.count_if("near").alias("correct"), F.count(F.lit(1)).alias("total"), F.round(F.avg(F.col("near").cast("int")), 6).alias("accuracy"))


@registered(
    "select l_orderkey, (max(l_quantity) filter (where l_linenumber = 2))::double as second, (max(l_quantity) filter (where l_linenumber = 3))::double as third, count(distinct l_linenumber)::int as cells from lineitem group by l_orderkey"
)
def cell_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as a map from place to value, of repeated places the largest."""
    cells = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    maps = cells.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "q"))).alias("m"))
    at = lambda n: F.try_element_at("m", F.lit(n))
    return maps.select("l_orderkey", at(2).alias("second"), at(3).alias("third"), F.size("m").alias("cells"))


@registered(
    "with n as (select doc_id, quality, 2 as copy_of from labels where doc_id % 3 = 0), b as (select doc_id, toxic as quality from labels where doc_id not in (select doc_id from n)), "
    "c as (select doc_id, quality, case when quality = 0 then 4 else 1 end as k from n) "
    "select doc_id, quality, 1 as copy from b union all select doc_id, quality, r::int from c, range(1, 5) t(r) where r <= k"
)
def merged_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held rows, those that were confirmed again replaced, and corrected ones four times."""
    labels = _table(spark, sf_dir, "labels")
    fresh = labels.where("doc_id % 3 = 0").select("doc_id", "quality")
    return metrics.merged(labels.select("doc_id", F.col("toxic").alias("quality")), fresh, ["doc_id"], F.col("quality") == 0)


@registered(
    "with k as (select o_custkey, o_orderkey, o_totalprice as y, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as i, count(*) over (partition by o_custkey) as n from orders) "
    "select o_custkey, max(o_orderkey) filter (where i = 1) as top, max(o_orderkey) filter (where i = n) as bottom, max(n)::int as n from k group by o_custkey"
)
def cards_by_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet's cards from top to bottom: the first and the last of them, and how many there are."""
    rows, at = _table(spark, sf_dir, "orders"), F.struct("o_totalprice", "o_orderkey")
    return rows.groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("top"), F.max_by("o_orderkey", at).alias("bottom"), F.count(F.lit(1)).cast("int").alias("n"))


@registered(
    "with g as (select d.lang, d.doc_id % 4 = 0 as cut, l.quality, case when n_chars > 100 then (n_chars > 400)::int end as guess from documents d join labels l on d.doc_id = l.doc_id) "
    "select lang, count(*) filter (where not cut and guess = quality)::bigint as ok, count(*) filter (where not cut and guess is distinct from quality)::bigint as bad, "
    "count(*) filter (where cut and guess = quality)::bigint as cut_ok, count(*) filter (where cut and guess is distinct from quality)::bigint as cut_bad from g group by lang"
)
def sliced_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right and wrong readings by sheet, those of truncated images counted apart."""
    guess = F.when(F.col("n_chars") > 100, (F.col("n_chars") > 400).cast("int"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", guess.alias("guess"))
    both = docs.join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return metrics.sliced_errors(both, ["lang"], "quality", "guess", F.col("doc_id") % 4 == 0)


@registered(
    "with c as (select user_id, count(distinct (day(ts) % 5) * 5 + list_position(['click','error','purchase','signup','view'], event_type)) as n, count(*) as calls from events group by 1) "
    "select user_id, n % 2 = 1 and calls > 50 as holds from c"
)
def own_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate written in Python over the counts of a card, in batches: an odd number of cells after more than fifty calls."""
    place = (F.dayofmonth("ts") % 5) * 5
    kind = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("event_type"))
    counts = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct(place + kind).alias("n"), F.count(F.lit(1)).alias("calls"))
    return counts.select("user_id", readers.predicate(lambda n, calls: (n % 2 == 1) & (calls > 50), "n", "calls").alias("holds"))


@registered(
    "with d as (select doc_id, case doc_id % 3 when 0 then 'digits' when 1 then 'words' else 'nobody' end as reader, coalesce(text, '') as t from documents) "
    r"select doc_id, reader, case reader when 'digits' then len(regexp_replace(t, '[^0-9]', '', 'g')) when 'words' then len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) end::bigint as value from d"
)
def chosen_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document read by the reader that its row names; a reader that nobody registered reads nothing."""
    named = {0: "digits", 1: "words", 2: "nobody"}
    reader = F.element_at(F.array(*map(F.lit, named.values())), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", reader.alias("reader"), "text")
    return readers.read_by(rows, "reader", "text", readers.READERS).select("doc_id", "reader", "value")


_NAME_SQL = "printf('%d_%s_c%d_r%dc%d%s.jpg', epoch_us(ts)::bigint // 1000000, substr(sha256(event_id::varchar), 1, 8), user_id % 3 + 1, event_id % 5, event_id % 7 % 5, case when event_id % 4 = 0 then '_x' else '' end)"


@registered(
    f"with n as (select event_id, case when event_id % 6 = 0 then event_id || '_c2_r0c1.png' when event_id % 10 = 0 then 'odd.jpg' else {_NAME_SQL} end as name from events) "
    r"select event_id, try_cast(nullif(regexp_extract(name, '^([0-9]+)_', 1), '') as bigint) as epoch, nullif(regexp_extract(name, '^[0-9]+_([0-9a-f]+)_c[0-9]', 1), '') as sha, "
    r"try_cast(nullif(regexp_extract(name, '_c([0-9]+)_r', 1), '') as int) as card, try_cast(nullif(regexp_extract(name, '_r([0-9]+)c', 1), '') as int) as row, "
    r"try_cast(nullif(regexp_extract(name, '_r[0-9]+c([0-9]+)[_.]', 1), '') as int) as col, name like '%\_x.%' escape '\' as corrected from n"
)
def cell_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What file names of cells say, old ones without a hash and names of another kind among them."""
    key = F.col("event_id")
    name = files.format_name(F.unix_seconds(F.col("ts").cast("timestamp")), F.substring(F.sha2(key.cast("string"), 256), 1, 8), F.col("user_id") % 3 + 1, key % 5, key % 7 % 5, key % 4 == 0)
    name = F.when(key % 6 == 0, F.concat(key, F.lit("_c2_r0c1.png"))).when(key % 10 == 0, "odd.jpg").otherwise(name)
    rows = _table(spark, sf_dir, "events").select("event_id", name.alias("name"))
    return rows.select("event_id", *[c.alias(k) for k, c in files.cell_name(F.col("name")).items()])


_SHEET_SQL = (
    "with n as (select unnest(generate_series(1, 75)) as n), drawn as (select c_custkey, n, (n - 1) // 15 as c, row_number() over (partition by c_custkey, (n - 1) // 15 order by md5('sheet-' || c_custkey || '-' || n)) - 1 as r from customer, n) "
    "select c_custkey as sheet, (1 + c_custkey % 3)::int as card, r::int as r, c::int as c, case when r * 5 + c <> 12 then n end::int as value from drawn where r < 5"
)


def _sheet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sheets with a card each, written as text files and read by blocks."""
    grid = random_grid(F.col("c_custkey"), "sheet")
    row = lambda r: F.concat(F.lit("["), F.array_join(F.transform(F.slice("grid", r * 5 + 1, 5), lambda n: F.when(n == 0, "FREE").otherwise(n.cast("string"))), ", "), F.lit("]"))
    rows = dealt(_table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", grid.alias("grid"))
    card = (1 + F.col("c_custkey") % 3).cast("string")
    lines = F.concat_ws("\n", F.format_string("#blue_sheet_%03d:", "c_custkey"), F.lit(""), F.concat(F.lit("#card"), card), *[row(r) for r in range(5)], F.lit(""))
    folder = f"{shared_dir(spark)}/sheets"
    rows.select(lines.alias("value")).write.text(folder)
    return text.numbered_lines(spark, folder)


@registered(_SHEET_SQL)
def sheet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of cards that stand in text files, under headers that may lie in an earlier block of the file."""
    return text.truth_cells(_sheet_lines(spark, sf_dir)).select(F.col("sheet").cast("long").alias("sheet"), "card", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("value").cast("int").alias("value"))


@registered(_SHEET_SQL)
def sheet_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cells by a table function that reads the lines of one sheet after the other."""
    lines = _sheet_lines(spark, sf_dir)
    number = F.nullif(F.regexp_extract("text", "^#blue_sheet_0*([0-9]+):", 1), F.lit("")).cast("long")
    return text.sheet_cells(text.under_headers(lines, number, "sheet"))


@registered(
    "with p as (select vec_id, vec_id // 10 as scan_id, unnest(embedding) as v from embeddings), s as (select vec_id, scan_id, avg((v::double > 0.3::double)::int) as share from p group by 1, 2) "
    "select s.scan_id, (s.vec_id % 10)::int as cell, share, case when s.scan_id % 4 not in (1, 2, 3) then label end::int as read from s join embeddings using (vec_id) where share >= 0.01::double"
)
def pending_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as pending cells of scans, the blank ones left out, with what a scan's sidecar says of them: some sidecars are broken, no list, or missing."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 10).alias("scan_id"), (F.col("vec_id") % 10).cast("int").alias("cell"), "embedding", "label")
    places = vectors.select("scan_id", "cell", F.explode("embedding").alias("v"))
    cells = pending.dark_shares(places, ["scan_id", "cell"], F.col("v").cast("double") > 0.3)
    one = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("cell", "label"))), lambda x: F.array(x["cell"], x["label"])))  # ten cells
    kind = F.col("scan_id") % 4
    autos = vectors.where("scan_id % 4 <> 3").groupBy("scan_id").agg(one.alias("t")).select("scan_id", F.when(kind == 1, F.substring("t", 1, 7)).when(kind == 2, '{"a": 1}').otherwise(F.col("t")).alias("auto"))
    root = shared_dir(spark)
    pending.save_pending(cells, autos, root, "0")
    found = pending.pending(spark, root, "array<int>")
    read = F.filter("auto", lambda x: x[0] == F.col("cell"))
    return found.select("scan_id", "cell", "share", F.get(read, F.lit(0))[1].alias("read"))
