"""Records of CSV files, found in parallel, with a reject for every bad one.

A cell in quotes may hold line breaks, so whether a line begins a record
depends on all quotes before it.  Spark's ``multiLine`` reader answers that by
reading a file in one task; here the lines are read in splits as any text and
the question is answered by a scan over *functions*: a line (or a whole split)
maps "inside a quoted cell before" to "inside after", and such maps compose.

1. Lines with a quote get their map from two patterns; lines without one keep
   the state.  Only (split, position, map) of lines with a quote is shuffled.
2. One row per split: number of lines, the composed map, the first line of the
   file.  Windows over these rows give every split its entry state and the
   number of its first line.  They are joined back, as a broadcast while the
   number of splits is at most ``FEW_SPLITS``.
3. Splits in which no quoted cell is open over a line end, nearly all, need no
   more: a line is a record, and no text is shuffled.  Lines of the others are put
   in order per split; those of a record are joined.

A record is rejected, with file, line, column and reason, if it lacks cells or
has too many, if a cell is no value of its column's type, if its quoted cell
never closes or spans more than ``MAX_LINES`` lines (then each of the lines is a
reject of its own: an unclosed quote must not gather the rest of a file in one
row), or if its file has another header than the first file.  Every other
record is loaded; blank lines are neither.  Quotes inside a quoted cell are doubled; a
quote in the middle of an unquoted cell is an ordinary sign.  Line breaks inside
a cell become ``\\n``.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LINES = 1000
FEW_SPLITS = 50_000  # rows of a few hundred bytes each

# A cell in quotes that ends at a separator or the line's end; one that is
# open at the line's end; the rest of one that was open before.
_WHOLE = r'(^|,)"(?:[^"]++|"")*+"(?=,|$)'
_OPEN = r'(^|,)"(?:[^"]++|"")*+$'
_REST = r'^(?:[^"]++|"")*+"(?=,|$)'


def _opens(line: Column) -> Column:
    """Whether a line that begins outside ends inside a quoted cell."""
    return F.regexp_replace(line, _WHOLE, "$1").rlike(_OPEN)


def _lines(spark: SparkSession, path) -> DataFrame:
    """(file, block, seq, text, from_out, from_in): every line with its place
    and its map; seq counts by one inside a split."""
    text = F.col("text")
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").alias("text"))
    quoted = text.contains('"')
    return rows.withColumns({
        "from_out": quoted & _opens(text),
        "from_in": ~quoted | ~text.rlike(_REST) | _opens(F.regexp_replace(text, _REST, "")),
    })


def _states(rows: DataFrame, scope: list[str], order: str) -> DataFrame:
    """``rows`` with ``fixed`` (the state before the row if a map before it in
    its scope forgets the state; else null) and ``flip`` (whether the state at
    the scope's entry arrives inverted); the same after the row with ``_after``."""
    forgets = F.col("from_out") == F.col("from_in")
    swap = (F.col("from_out") & ~F.col("from_in")).cast("int")
    upto = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_swaps", F.sum(swap).over(upto))
    mark = F.when(forgets, F.struct(F.col("from_out").alias("state"), F.col("_swaps").alias("swaps")))

    def state(last: Column, swaps: Column) -> tuple[Column, Column]:
        swaps = F.coalesce(swaps, F.lit(0))
        odd = (swaps - F.coalesce(last["swaps"], F.lit(0))) % 2 == 1
        return F.when(last.isNotNull(), last["state"] != odd), odd

    rows = rows.withColumns({
        "_m0": F.last(mark, ignorenulls=True).over(before), "_s0": F.last("_swaps").over(before),
        "_m1": F.last(mark, ignorenulls=True).over(upto)})
    fixed, flip = state(F.col("_m0"), F.col("_s0"))
    fixed_after, flip_after = state(F.col("_m1"), F.col("_swaps"))
    return rows.withColumns({"fixed": fixed, "flip": flip, "fixed_after": fixed_after, "flip_after": flip_after}) \
        .drop("_swaps", "_m0", "_s0", "_m1")


def _per_split(spark: SparkSession, path):
    """The hint for a table with one row per split of the files, or none."""
    files = spark.read.text(path)
    few = files.rdd.getNumPartitions() + len(files.inputFiles()) <= FEW_SPLITS
    return F.broadcast if few else (lambda rows: rows)


def _splits(lines: DataFrame, header: str) -> DataFrame:
    """One row per split: entry (inside a quoted cell at its begin), first_seq,
    lines_before, headed (its file begins with ``header``), plain (a line is a
    record)."""
    quoted = lines.filter("from_out OR NOT from_in").select("file", "block", "seq", "from_out", "from_in")
    composed = _states(quoted, ["file", "block"], "seq").groupBy("file", "block").agg(
        F.max_by(F.struct("fixed_after", "flip_after"), "seq").alias("m"))
    each = lines.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("from_out").alias("any_open"),
        F.min_by((F.col("block") == 0) & (F.col("text") == header), "seq").alias("begins"))
    fixed, flip = F.col("m.fixed_after"), F.coalesce("m.flip_after", F.lit(False))
    rows = each.join(composed, ["file", "block"], "left").withColumns(
        {"from_out": F.coalesce(fixed, flip), "from_in": F.coalesce(fixed, ~flip)})
    rows = _states(rows, ["file"], "block")
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "file", "block", "first_seq", F.coalesce("fixed", "flip").alias("entry"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("lines_before"),
        F.first("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("headed"),
        (~F.coalesce("fixed", "flip") & ~F.col("any_open")).alias("plain"))


def records(spark: SparkSession, path, header: str, max_lines: int = MAX_LINES) -> DataFrame:
    """(file, line, headed, text, problem) of every record: the number of its
    first line, whether its file begins with ``header``, its lines joined by
    line breaks, and why they are no record (else null)."""
    lines, per_split = _lines(spark, path), _per_split(spark, path)
    placed = lines.join(per_split(_splits(lines, header)), ["file", "block"]).withColumn(
        "line", F.col("lines_before") + F.col("seq") - F.col("first_seq") + 1)
    none = F.lit(None).cast("string")
    single = placed.filter("plain").select("file", "line", "headed", "text", none.alias("problem"))

    inner = _states(placed.filter("NOT plain"), ["file", "block"], "seq")
    begun = F.coalesce(F.col("fixed"), F.col("flip") != F.col("entry"))
    ended = F.coalesce(F.col("fixed_after"), F.col("flip_after") != F.col("entry"))
    inner = inner.select("file", "line", "headed", "text", "block", begun.alias("inside"), ended.alias("open"))
    alone = inner.filter("NOT inside AND NOT open").select("file", "line", "headed", "text", none.alias("problem"))
    # lines of records with several lines; a record's first line is its number
    part = inner.filter("inside OR open")
    start = F.when(~F.col("inside"), F.col("line"))
    here = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("own", F.last(start, ignorenulls=True).over(here))
    last = part.groupBy("file", "block").agg(F.max(start).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("file", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    part = part.join(per_split(last), ["file", "block"]).withColumn("record", F.coalesce("own", "carried"))
    sizes = part.groupBy("file", "record").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("open", "line").alias("unclosed"))
    part = part.join(sizes, ["file", "record"])
    wrong = F.when(F.col("unclosed"), F.lit("a quoted cell never closes")) \
        .when(F.col("n") > max_lines, F.lit(f"a quoted cell spans more than {max_lines} lines"))
    part = part.withColumn("problem", wrong)
    joined = part.filter("problem IS NULL").groupBy("file", "record").agg(
        F.min("headed").alias("headed"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("parts")) \
        .select("file", F.col("record").alias("line"), "headed",
                F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"), none.alias("problem"))
    broken = part.filter("problem IS NOT NULL").select("file", "line", "headed", "text", "problem")
    return single.unionByName(alone).unionByName(joined).unionByName(broken)


def _typed(f: T.StructField) -> tuple[Column, Column]:
    """(value, reason why the cell is none) of a cell text."""
    cell = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.StringType):
        return cell, F.lit(None).cast("string")
    kind = f.dataType.simpleString()
    text = F.trim(cell)
    if isinstance(f.dataType, T.DecimalType):
        text = F.regexp_replace(text, "%$", "")  # rates such as 10.65%
    value = text.try_cast(f.dataType)
    if isinstance(f.dataType, (T.LongType, T.IntegerType)):
        # a cast would cut decimals off silently
        value = F.when(text.rlike(r"^[+-]?\d+$"), value)
    return value, F.when(cell.isNotNull() & value.isNull(), F.concat(F.lit(f"not a {kind}: "), cell))


def checked(spark: SparkSession, path, schema: T.StructType, max_lines: int = MAX_LINES) -> DataFrame:
    """Every record: file, line, text, its ``column`` and ``reason`` if it is
    bad (else null), and the typed columns of ``schema`` as struct ``row``.
    Columns are found by the header of the first file, in any order."""
    files = sorted(spark.read.text(path).inputFiles())
    # the first file that is not empty
    head = next((row for f in files if (row := spark.read.text(f).first())), None)
    if head is None:
        raise ValueError(f"no header in {path}")
    names = next(csv.reader([head["value"]]))
    missing = [n for n in schema.names if n not in names]
    if missing:
        raise ValueError(f"columns missing from the header: {', '.join(missing)}")
    rows = records(spark, path, head["value"], max_lines).filter((F.col("line") > 1) | ~F.col("headed")) \
        .filter(F.col("text").rlike(r"\S"))
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    options = {"columnNameOfCorruptRecord": "ragged", "mode": "PERMISSIVE", "escape": '"', "nullValue": "NULL",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}
    parsed = F.from_csv("text", cells.add("ragged", T.StringType()).simpleString()[7:-1].replace(":", " "), options)
    rows = rows.withColumn("cells", parsed)
    texts = {n: F.col("cells")[f"c{names.index(n)}"] for n in schema.names}
    rows = rows.select("file", "line", "headed", "text", "problem", F.col("cells.ragged").isNotNull().alias("ragged"),
                       *[F.when(t.rlike(r"\S"), t).alias(n) for n, t in texts.items()])
    found = {f.name: _typed(f) for f in schema.fields}
    none = F.lit(None).cast("string")
    whole = F.when(F.col("problem").isNotNull(), F.col("problem")) \
        .when(~F.col("headed"), F.lit("another header than the first file's")) \
        .when(F.col("ragged"), F.lit(f"not {len(names)} cells"))
    bad = F.coalesce(
        F.when(whole.isNotNull(), F.struct(none.alias("column"), whole.alias("reason"))),
        *[F.when(reason.isNotNull(), F.struct(F.lit(n).alias("column"), reason.alias("reason")))
          for n, (_, reason) in found.items()])
    return rows.select("file", "line", "text", bad.alias("bad"),
                       F.struct(*[value.alias(n) for n, (value, _) in found.items()]).alias("row")) \
        .select("file", "line", "text", "bad.column", "bad.reason", "row")


def import_loans(spark: SparkSession, path, schema: T.StructType,
                 max_lines: int = MAX_LINES) -> tuple[DataFrame, DataFrame]:
    """(loans, rejects) of CSV files with a header: each record is in one of
    them.  Rejects are (file, line, column, reason, text); column is null if the
    whole record is wrong, else the first bad cell's."""
    rows = checked(spark, path, schema, max_lines)
    return (rows.filter("reason IS NULL").select("row.*"),
            rows.filter("reason IS NOT NULL").select("file", "line", "column", "reason", "text"))
