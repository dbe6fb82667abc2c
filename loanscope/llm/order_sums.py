"""Positions, running sums and list ranks over tables of any size.

``ranked`` numbers rows in an order without a single partition, ``running_sums``
adds up along positions in blocks of bounded size, ``list_ranks`` finds the
positions of a linked list's elements.  No step holds more than a block, or a
range partition, in one task, and whatever is read twice is written first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanscope.llm.tables import written

# Rows of one window of a running sum, and elements of a list at which one
# task follows the links.
BLOCK = 4096


def ranked(df: DataFrame, order: list[Column], keep: list[Column], name: str = "rank") -> DataFrame:
    """``keep`` of every row of ``df`` with its place 0, 1, .. in ``order``.

    Rows are dealt by ranges of the order and written with their place in the
    partition; the counts of the partitions (one row each) become offsets.
    Only ``keep`` is written, so long sort keys are shuffled once.  Rows that
    ``order`` does not tell apart get places next to each other."""
    cols = [f"_o{i}" for i in range(len(order))]
    keyed = df.select(*[c.alias(n) for c, n in zip(order, cols)], *keep)
    names = keyed.columns[len(cols):]
    by = [F.asc_nulls_first(c) for c in cols]
    pid = F.spark_partition_id()
    tagged = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select(
        *names, pid.alias("_pid"),
        (F.monotonically_increasing_id() - F.shiftleft(pid.cast("bigint"), 33)).alias("_at"))
    tagged = written(tagged, "ranked")
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row per range partition
    return tagged.join(F.broadcast(offsets), "_pid").select(*names, (F.col("_before") + F.col("_at")).alias(name))


def running_sums(df: DataFrame, keys: list[str], position: str, values: list[str], block: int = BLOCK,
                 modulus: int | None = None, top: int | None = None) -> DataFrame:
    """``df`` with each of ``values`` (bigint) replaced by its sum over the
    rows of equal ``keys`` up to the row's ``position`` (0 or more, unique
    within the keys).  Sums run inside blocks of ``block`` positions; the
    totals of the blocks are summed the same way, level by level.  With
    ``modulus`` all sums are taken modulo it."""
    if top is None:
        top = df.agg(F.max(position)).first()[0]
    wrap = (lambda c: F.pmod(c, F.lit(modulus))) if modulus else (lambda c: c)
    number = "_next_block" if position == "_block" else "_block"
    blocks = df.withColumn(number, F.expr(f"{position} div {block}"))
    inside = Window.partitionBy(*keys, number).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    if top is None or top < block:
        return blocks.withColumns({v: wrap(F.sum(v).over(inside)) for v in values}).select(df.columns)
    totals = blocks.groupBy(*keys, number).agg(*[wrap(F.sum(v)).alias(v) for v in values])
    sums = running_sums(totals, keys, number, values, block, modulus, top // block)
    # what lies before a block is the running sum of the block before it
    before = sums.select(*keys, (F.col(number) + 1).alias(number), *[F.col(v).alias(f"_b_{v}") for v in values])
    out = blocks.withColumns({v: F.sum(v).over(inside) for v in values}).join(before, [*keys, number], "left")
    return out.select(*[wrap(F.col(c) + F.coalesce(F.col(f"_b_{c}"), F.lit(0))).alias(c) if c in values else F.col(c)
                        for c in df.columns])


def list_ranks(links: DataFrame, base: int = BLOCK) -> DataFrame:
    """(id, pos) of the elements of one linked list: ``links`` has id, prev
    and next (bigint; null at the ends), pos counts from 0.

    Each round takes out elements whose hash is below those of both
    neighbours (never two in a row, about a third of all); the neighbours are
    linked past them and remember the distance.  When at most ``base`` are
    left, one task follows the links; the rounds then give their elements
    back, last round first: an element lies its distance behind the element
    that preceded it.  Work over all rounds is a few times the list's length,
    and every round is written, so a lost executor repeats one round only."""
    live = written(links.select("id", F.col("prev"), F.col("next"), F.lit(1).cast("bigint").alias("gap")), "list")
    rounds, n = [], live.count()
    while n > base:
        seed = len(rounds)
        h = lambda c: F.xxhash64(F.col(c), F.lit(seed))  # noqa: B023,E731
        out = F.col("prev").isNotNull() & F.col("next").isNotNull() & (h("id") < h("prev")) & (h("id") < h("next"))
        marked = live.withColumn("out", out)
        gone = marked.filter("out")
        none = F.lit(None).cast("bigint")
        told = gone.select(F.explode(F.array(
            F.struct(F.col("next").alias("id"), F.col("prev").alias("to_prev"), none.alias("to_next"),
                     F.col("gap").alias("more")),
            F.struct(F.col("prev").alias("id"), none.alias("to_prev"), F.col("next").alias("to_next"),
                     F.lit(0).cast("bigint").alias("more")))).alias("m")).select("m.*")
        stay = marked.filter("NOT out").select(
            "id", "prev", "next", "gap", none.alias("to_prev"), none.alias("to_next"),
            F.lit(0).cast("bigint").alias("more"))
        merged = stay.unionByName(told, allowMissingColumns=True).groupBy("id").agg(
            F.coalesce(F.max("to_prev"), F.max("prev")).alias("prev"),
            F.coalesce(F.max("to_next"), F.max("next")).alias("next"),
            (F.max("gap") + F.sum("more")).alias("gap"))
        rounds.append(gone.select("id", "prev", "gap"))
        live = written(merged, "list")
        n = live.count()

    def follow(table):
        import pyarrow as pa

        after = dict(zip(table.column("prev").to_pylist(), zip(table.column("id").to_pylist(),
                                                               table.column("gap").to_pylist())))
        ids, pos, at, here = [], [], 0, None
        while here in after:
            here, gap = after[here]
            at += gap
            ids.append(here)
            pos.append(at - 1)
        return pa.table({"id": pa.array(ids, pa.int64()), "pos": pa.array(pos, pa.int64())})

    # at most ``base`` elements
    placed = live.select("id", "prev", "gap").groupBy(F.lit(0).alias("all")).applyInArrow(follow, "id bigint, pos bigint")
    for gone in reversed(rounds):
        placed = written(placed, "placed")
        back = gone.join(placed.select(F.col("id").alias("prev"), "pos"), "prev") \
            .select("id", (F.col("pos") + F.col("gap")).alias("pos"))
        placed = placed.unionByName(back)
    return written(placed, "placed")
