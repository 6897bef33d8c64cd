"""CSV records against Python's csv module, whatever the splits, and 1,500 headers."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from kontor.sources import card_csv
from kontor.sources.csv_records import read_csv_records, records_of, split_record


BLANK = " " * 9


def python_rows(text):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r not in ([], [BLANK])]
    return [[f.replace("\r\n", "\n") or None for f in r] for r in rows]


def random_csv(rng, rows):
    out = []
    for _ in range(rows):
        fields = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.randrange(6)
            if kind < 2:
                fields.append("u" + "".join(rng.choices('ab "', k=rng.randint(0, 4))) if kind else "")
            else:
                body = "".join(rng.choices(['a', ',', '""', '\n', ' ', 'b', '\n\n'], k=rng.randint(0, 6)))
                fields.append(f'"{body}"' + ("tail" if rng.random() < 0.1 else ""))
        out.append(",".join(fields) or "x")
        if rng.random() < 0.1:
            out.append(rng.choice(["", BLANK]))
    return "\n".join(out) + "\n"


def lines_of(spark, files, rng):
    """Lines with files cut into splits at random line starts."""
    rows = []
    for name, text in files.items():
        split, n = 0, 0
        for i, line in enumerate(text.split("\n")[:-1]):
            if i and rng.random() < 0.25:
                split = i * 100
            rows.append((name, split, n + (rng.randrange(3) if i == 0 else 0), line))
            n += 3
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "src_file string, split long, src_row long, value string")


@pytest.mark.parametrize("seed", range(4))
def test_records_equal_python_csv(spark, seed):
    rng = random.Random(seed)
    files = {f"f{i}": random_csv(rng, rng.randint(1, 25)) for i in range(12)}
    got = (records_of(lines_of(spark, files, rng)).withColumn("fields", split_record(F.col("record")))
           .orderBy("src_file", "position").collect())
    for name, text in files.items():
        assert [r.fields for r in got if r.src_file == name] == python_rows(text), text


def test_a_quote_that_never_closes_takes_no_other_line(spark):
    text = 'a,"b\nc"\nd,"open\ne,f\n\ng,h\n'
    rng = random.Random(1)
    got = records_of(lines_of(spark, {"f": text, "g": "x,y\n"}, rng)).orderBy("src_file", "position").collect()
    assert [r.record for r in got] == ['a,"b\nc"', 'd,"open', "e,f", "g,h", "x,y"]


def test_long_fields_do_not_exhaust_the_stack(spark):
    field = 'word ""quoted"" , ' * 20_000
    df = spark.createDataFrame([("f", 0, 0, f'a,"{field}",b'), ("f", 0, 1, 'c,"' + field),
                                ("f", 0, 2, field + '",d')],
                               "src_file string, split long, src_row long, value string")
    got = records_of(df).orderBy("position").select(split_record(F.col("record")).alias("f")).collect()
    plain = field.replace('""', '"')
    assert [r.f for r in got] == [["a", plain, "b"], ["c", plain + "\n" + plain, "d"]]


def test_file_splits_inside_a_quoted_field(spark, tmp_path):
    body = "".join(f'{i},"text {i}\nsecond ""line"", {i}\n\nend",{i % 7}\n' for i in range(400))
    (tmp_path / "a.csv").write_text(body)
    (tmp_path / "b.csv").write_text("p,q\n1,2\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    try:
        got = read_csv_records(spark, [str(tmp_path / "*.csv")])
        assert got.rdd.getNumPartitions() > 5
        rows = got.withColumn("f", split_record(F.col("record"))).orderBy("src_file", "position").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.f for r in rows] == python_rows(body) + [["p", "q"], ["1", "2"]]


def test_a_header_over_two_lines_and_rows_without_some_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n"Sta\nte",State,"Amount",Amount,Type\n'
                                    'a,COMPLETED,1,2\n\n"x\ny",PENDING,"3,5",4,"T ""q"""\n')
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text('State,Description\nCOMPLETED,"a ""b"" c"d\n')
    raw = card_csv.read_card_csv(spark, [str(tmp_path / "*.csv")]).orderBy("src_file", "src_row")
    assert [(r.State, r.Amount, r.Type, r.Description) for r in raw.collect()] == [
        ("COMPLETED", "1", None, None), ("PENDING", "3,5", 'T "q"', None),
        ("COMPLETED", None, None, 'a "b" cd')]


def test_fifteen_hundred_headers(spark, tmp_path):
    columns = ["Type", "Started Date", "Description", "Amount", "State", "Balance"]
    for i in range(1500):
        rng = random.Random(i)
        names = columns + [f"extra {i}"]
        rng.shuffle(names)
        values = {"Type": "ATM", "Started Date": "2024-01-02 03:04:05", "Description": f'"d,{i}"',
                  "Amount": str(i), "State": "COMPLETED", "Balance": str(2 * i)}
        lead = "﻿" if i % 2 else ""
        (tmp_path / f"{i}.csv").write_text(lead + ",".join(names) + "\n"
                                           + ",".join(values.get(n, "z") for n in names) + "\n")
    (tmp_path / "rates.csv").write_text("Date,Rate\n2024-01-01,1.1\n")
    raw = card_csv.read_card_csv(spark, [str(tmp_path / "*.csv")])
    assert raw.columns == [*card_csv.CARD_COLUMNS, "src_file", "src_row"]
    led = card_csv.parse_card_rows(raw, "Card").collect()
    assert sorted((r.concept, int(r.amount), int(r.balance), r.category) for r in led) \
        == sorted((f"d,{i}", i, 2 * i, "atm") for i in range(1500))
