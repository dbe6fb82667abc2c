"""CSV import against Python's csv module, over splits of any size; rejects."""

import csv
import io
import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanscope.operators.cleaning import standardise_units
from loanscope.sources.files import read_loans
from loanscope.sources.loan_csv import import_loans

SCHEMA = T.StructType([T.StructField("amt", T.LongType()), T.StructField("id", T.LongType()),
                       T.StructField("name", T.StringType())])


@pytest.fixture
def split_bytes(spark):
    def set_(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _folder(**files):
    d = tempfile.mkdtemp(prefix="loanscope-csv-")
    for name, text in files.items():
        Path(d, f"{name}.csv").write_text(text, newline="")
    return d


def _rows(spark, path, **kw):
    good, bad = import_loans(spark, path, SCHEMA, **kw)
    return ({(r["id"], r["name"], r["amt"]) for r in good.collect()},
            {(Path(r["file"]).stem, r["line"], r["column"], r["reason"]) for r in bad.collect()})


MIXED = '''id,name,amt
1,plain,10
2,"quoted, comma",20
3,"two
lines, ""here""",30
4,short
5,too,50,many
6,bad,1O

7,"empty",
8,"x"y,80
9,in"side,90
10,NULL,NULL
11,"
""
",1.5
12,"a
b
c",12
'''


@pytest.mark.parametrize("n", [1 << 20, 64, 23, 7])
def test_records_of_every_kind(spark, split_bytes, n):
    split_bytes(n)
    good, bad = _rows(spark, _folder(a=MIXED))
    assert good == {(1, "plain", 10), (2, "quoted, comma", 20), (3, 'two\nlines, "here"', 30), (7, "empty", None),
                    (8, '"x"y', 80), (9, 'in"side', 90), (10, None, None), (12, "a\nb\nc", 12)}
    assert bad == {("a", 6, None, "not 3 cells"), ("a", 7, None, "not 3 cells"), ("a", 8, "amt", "not a bigint: 1O"),
                   ("a", 14, "amt", "not a bigint: 1.5")}


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_csv_module(spark, split_bytes, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["plain", "with, comma", 'say "so"', "two\nlines", 'a",\n"b', '\n', ',"', "x" * 40, '"']), i * 7)
            for i in range(150)]
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n", quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    w.writerow(["id", "name", "amt"])
    w.writerows(rows)
    split_bytes(rng.choice([50, 333]))
    good, bad = _rows(spark, _folder(a=out.getvalue()))
    assert bad == set()
    assert good == {(i, n if n.strip() else None, a) for i, n, a in rows}


def test_an_open_quote_rejects_line_by_line(spark, split_bytes):
    text = "id,name,amt\n1,a,1\n2,\"open,2\n" + "".join(f"{i},x,{i}\n" for i in range(3, 40))
    split_bytes(30)
    good, bad = _rows(spark, _folder(a=text, b="id,name,amt\n90,b,90\n"))
    assert good == {(1, "a", 1), (90, "b", 90)}
    assert bad == {("a", i, None, "a quoted cell never closes") for i in range(3, 41)}
    closed = text + 'end",5\n50,after,50\n'
    good, bad = _rows(spark, _folder(a=closed), max_lines=10)
    assert good == {(1, "a", 1), (50, "after", 50)}
    assert {b[3] for b in bad} == {"a quoted cell spans more than 10 lines"} and len(bad) == 39


def test_headers(spark):
    good, bad = _rows(spark, _folder(a="amt,name,id,more\n1,a,2,x\n", b="id,name,amt\n1,b,3\n", c="", d="amt,name,id,more\n5,d,6,\n"))
    assert good == {(2, "a", 1), (6, "d", 5)}
    assert {b[:3] for b in bad} == {("b", 1, None), ("b", 2, None)}
    with pytest.raises(ValueError, match="missing from the header: amt"):
        import_loans(spark, _folder(a="id,name\n1,a\n"), SCHEMA)


def test_line_ends_and_an_empty_table(spark):
    good, bad = _rows(spark, _folder(a='id,name,amt\r\n1,"a\r\nb",1\r\n2,c,2'))
    assert good == {(1, "a\nb", 1), (2, "c", 2)} and not bad
    assert _rows(spark, _folder(a="id,name,amt\n")) == (set(), set())


def test_plain_splits_are_not_shuffled(spark, split_bytes):
    """Only quotes and one row per split are exchanged for lines that are
    records."""
    d = _folder(a="id,name,amt\n" + "".join(f"{i},n{i},{i}\n" for i in range(500)))
    split_bytes(2000)
    good, _ = import_loans(spark, d, SCHEMA)
    assert good.count() == 500
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert "ResolvedHint" not in plan and "strategy=broadcast" in plan


def test_strict_reader_fails_with_the_line(spark):
    d = _folder(a="id,name,amt\n1,a,1\n2,b\n")
    with pytest.raises(Exception, match="line 3 of .*not 3 cells"):
        read_loans(spark, d, SCHEMA).select("id").collect()


def test_units_are_read_or_fail(spark):
    def got(*cells):
        df = spark.createDataFrame([(c,) for c in cells], "int_rate string")
        return [r[0] for r in standardise_units(df).collect()]

    assert got("10.65%", " 7.005 %".replace(" %", "%"), "", None, "8") == [1065, 701, None, None, 800]
    for bad in ("12,5", "1O.65%", "%"):
        with pytest.raises(Exception, match="column int_rate: not a number"):
            got(bad)


def test_rates_are_checked_on_import(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("int_rate", T.DecimalType(9, 4))])
    good, bad = import_loans(spark, _folder(a="id,int_rate\n1,10.65%\n2,1O.65%\n3,\n"), schema)
    assert {(r["id"], r["int_rate_bp"]) for r in standardise_units(good).collect()} == {(1, 1065), (3, None)}
    assert [(r["line"], r["column"]) for r in bad.collect()] == [(3, "int_rate")]
    assert good.unionByName(good).filter(F.col("id") == 1).count() == 2
