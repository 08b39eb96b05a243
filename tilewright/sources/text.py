"""Text sources in sections (truth files, dictated cards) as cells, and the CSV manifest sink."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import is_free, number_of
from ..functions.patterns import FREE_BIT, SIDE


#: Lines of a piece, the most that a window over headers and lines holds.
PIECE = 50_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, text) of text files of any size, with the number of each line in its file.

    Files are read in blocks of bytes. A task reads a block's lines in order, so their ids are consecutive, and the least of them and
    the count of lines (a row a block, as Spark plans the reading) number them without a sort. ``block`` grows along a file
    and is the same for PIECE lines at most: a block's first byte and the number of the piece within it.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_i"),
        F.trim(F.regexp_replace("value", "\r$", "")).alias("text"),
    )
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "_start").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    blocks = blocks.select("file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.col("_i") - F.col("_first")
    block = F.col("_start") + F.floor(at / PIECE)  # a piece has more bytes than one, so no other block begins there
    return rows.join(F.broadcast(blocks), ["file", "_start"]).select("file", block.alias("block"), (F.col("_before") + at).alias("line"), "text")


def under_headers(lines: DataFrame, header: Column, name: str) -> DataFrame:
    """Adds the last header at or above each line of its file; those that a block begins under come from one row a block."""
    rows = lines.withColumn("_header", header)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("file", "block").agg(F.max_by("_header", F.when(F.col("_header").isNotNull(), F.col("line"))).alias("_end"))
    carried = ends.select("file", "block", F.last("_end", True).over(before).alias("_in"))
    upto = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_last", F.last("_header", True).over(upto)).join(carried, ["file", "block"])
    return rows.select(*lines.columns, F.coalesce("_last", "_in").alias(name))


def _sections(lines: DataFrame, outer, inner) -> DataFrame:
    """Adds outer and inner, the headers above each line; an outer header ends the inner section.

    Headers are carried down within a block; those that a block begins under come from the blocks before it, each of
    which is one row: the last outer header in it, and the inner one after that.
    """
    rows = lines.withColumn("_outer", outer).withColumn("_inner", inner)
    place = lambda c: F.max(F.when(F.col(c).isNotNull(), F.col("line")))
    ends = rows.groupBy("file", "block").agg(
        F.max_by("_outer", F.when(F.col("_outer").isNotNull(), F.col("line"))).alias("_o"), place("_outer").alias("_o_at"),
        F.max_by("_inner", F.when(F.col("_inner").isNotNull(), F.col("line"))).alias("_i"), place("_inner").alias("_i_at"),
    )
    open_inner = F.when(F.col("_i_at") > F.coalesce("_o_at", F.lit(-1)), F.col("_i"))
    says = F.when(F.col("_o_at").isNotNull() | F.col("_i_at").isNotNull(), F.struct(open_inner.alias("i")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "block", F.last("_o", True).over(before).alias("_outer_in"), F.last(says, True).over(before)["i"].alias("_inner_in"))
    upto = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy("file", "block", "_part").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_o", F.last("_outer", True).over(upto)).withColumn("_part", F.count("_outer").over(upto))
    rows = rows.withColumn("_i", F.last("_inner", True).over(inside)).join(carried, ["file", "block"])
    rows = rows.withColumn("outer", F.coalesce("_o", "_outer_in")).withColumn("inner", F.coalesce("_i", F.when(F.col("_part") == 0, F.col("_inner_in"))))
    rest = rows.where("_outer is null and _inner is null and outer is not null and inner is not null")
    return rest.where("text != '' and not startswith(text, '#')").select("file", "line", "text", "outer", "inner")


def truth_cells(lines: DataFrame) -> DataFrame:
    """(file, sheet, card, r, c, value) of sheets like ``#blue_sheet_001:`` / ``#card1`` / ``[1, FREE, 3]``; the free cell is null."""
    sheet = F.nullif(F.regexp_extract("text", "^#[a-z_]*sheet_0*([0-9]+):", 1), F.lit("")).cast("int")
    card = F.nullif(F.regexp_extract("text", "^#card([0-9])", 1), F.lit("")).cast("int")
    rows = _sections(lines, sheet, card)
    place = F.row_number().over(Window.partitionBy("file", "outer", "inner").orderBy("line")) - 1
    cells = rows.withColumn("r", place).select(
        "file", F.col("outer").alias("sheet"), F.col("inner").alias("card"), "r",
        F.posexplode(F.regexp_extract_all("text", F.lit("[0-9]+|FREE"), F.lit(0))).alias("c", "_token"),
    )
    return cells.withColumn("value", number_of(F.col("_token"))).drop("_token")


class SheetCells:
    """A table function from the lines of one sheet, in order, to its cells; it keeps the card and row that it is in.

    A card begins with ``#card1`` and its rows are lists such as ``[1, FREE, 3]``; lines before any card are passed over.
    """

    def __init__(self) -> None:
        self.card, self.row = None, 0

    def eval(self, line: Row) -> Iterator[tuple]:
        text = (line["text"] or "").strip()
        head = re.match(r"#card([0-9])", text)
        if head:
            self.card, self.row = int(head[1]), 0
        elif self.card is not None and text and not text.startswith("#"):
            for c, token in enumerate(re.findall(r"[0-9]+|FREE", text)):
                yield line["sheet"], self.card, self.row, c, None if token == "FREE" else int(token)
            self.row += 1


def sheet_cells(lines: DataFrame) -> DataFrame:
    """(sheet, card, r, c, value) of lines (sheet, line, text): each sheet's lines go through a table function in their order.

    Spark deals and sorts the lines by sheet; the function holds no more than its place in one sheet.
    """
    cells = F.udtf(SheetCells, returnType="sheet long, card int, r int, c int, value int")
    return cells(lines.select(F.col("sheet").cast("long").alias("sheet"), "line", "text").asTable().partitionBy("sheet").orderBy("line"))


def dictated_cells(lines: DataFrame) -> DataFrame:
    """(file, image, card, r, c, value, bad) of dictated cards: an image's name with a colon, ``Card one:``, tokens by columns.

    The column in the middle has four tokens, as the free cell is left out. ``bad`` marks tokens that are no number.
    """
    image = F.nullif(F.regexp_extract("text", r"(?i)^(\S+\.(?:png|jpg|jpeg))\s*:$", 1), F.lit(""))
    word = F.lower(F.regexp_extract("text", r"^[Cc]ards?\s*([1-3]|one|two|three)\s*:", 1))
    rows = _sections(lines, image, number_of(word))
    tokens = rows.select("file", "line", "outer", "inner", F.posexplode(F.split("text", ",")).alias("_p", "_token")).where("trim(_token) != ''")
    place = F.row_number().over(Window.partitionBy("file", "outer", "inner").orderBy("line", "_p")) - 1
    place = place + F.when(place >= FREE_BIT, 1).otherwise(0)
    value, token = number_of(F.col("_token")), F.col("_token")
    return tokens.withColumn("_at", place).select(
        "file", F.col("outer").alias("image"), F.col("inner").alias("card"), (F.col("_at") % SIDE).alias("r"),
        F.expr(f"cast(_at div {SIDE} as int)").alias("c"), value.alias("value"), (value.isNull() & ~is_free(token)).alias("bad"),
    )


def write_manifest(rows: DataFrame, root: str, split: str) -> None:
    """A CSV manifest with a header, in a folder for each split."""
    rows.write.mode("overwrite").partitionBy(split).option("header", True).csv(root)
