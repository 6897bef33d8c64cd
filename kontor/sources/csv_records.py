"""CSV records from text lines: quoted fields may hold commas, doubled quotes and line
breaks, and files may be cut into splits anywhere.

A field is quoted if it begins with a quote; quotes inside other fields are plain
characters, and what follows a closing quote belongs to the field as it is.  Whether a
line begins a record depends on all lines before it, so a line is a function of one
state (inside a quoted field or not) to the state after it:

1. per line, the state it leaves from either state (two regexes);
2. files in which no line leaves a quote open need nothing more: their lines are records.
   In the others, the functions of a split's lines are composed by running sums (a line
   either sets the state or swaps or keeps it), then those of the file's splits;
3. the states replayed, lines from one record start to the next are put together.

Windows run over one split of a file, then over its splits, never over a whole file's
lines.  A quoted field that no later line closes ends with its line: the lines from
there on are records of their own, so a stray quote does not swallow the file's rest.

Line breaks inside a field become ``\n``.  Blank lines between records are skipped.
All of it is JVM code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontor.sources.files import stage_table

# the inside of a quoted field: anything but single quotes
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_CLOSED = f'"{_INSIDE}"[^,]*+'
_PLAIN = r'[^",][^,]*+'
#: A line that begins outside a quoted field and ends inside one: whole fields, then an
#: opened one.
_OPENS = f'^(?:(?:{_CLOSED}|{_PLAIN}|),)*+"{_INSIDE}$'
#: What a line that begins inside a quoted field has up to its closing quote.
_CLOSES = f'^{_INSIDE}"'
_FIELD = f',("{_INSIDE}"?[^,]*+|{_PLAIN}|)'


def split_record(record: Column) -> Column:
    """The fields of a record as an array of texts, quotes taken off; empty ones are null."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_FIELD), F.lit(1))

    def plain(field: Column) -> Column:
        quoted = F.regexp_extract(field, f'^"({_INSIDE})"?', 1)
        rest = F.regexp_replace(field, f'^"{_INSIDE}"?', "")
        value = F.when(field.startswith('"'),
                       F.concat(F.replace(quoted, F.lit('""'), F.lit('"')), rest)) \
            .otherwise(field)
        return F.when(value != "", value)

    return F.transform(fields, plain)


def csv_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of text files: src_file, split, src_row (order in the split), value."""
    return (spark.read.text(sorted(paths))
            .select(F.col("_metadata.file_path").alias("src_file"),
                    F.col("_metadata.file_block_start").alias("split"),
                    F.monotonically_increasing_id().alias("src_row"), "value"))


def read_csv_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of CSV files: src_file, src_row, position (their order in the file), record."""
    return records_of(csv_lines(spark, paths))


def headed_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first record of every file (src_file, first, record) and the others' records
    (src_file, src_row, first, record).  The records are put together once and stored: both
    are read from there."""
    marks = stage_table(file_marks(lines), "csv-marks")
    records = stage_table(records_of(lines, marks).join(marks.select("src_file", "first"),
                                                        "src_file"), "csv-records")
    heads = records.filter(F.col("position") == F.col("first"))
    rows = records.filter(F.col("position") != F.col("first"))
    return (heads.select("src_file", "first", "record"),
            rows.select("src_file", "src_row", "record"))


def _position(split: Column, row: Column) -> Column:
    """Order of a file's lines as one number, which is aggregated by hashing."""
    return (split.cast("decimal(38,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)")
            + row).cast("decimal(38,0)")


def _placed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("position", _position(F.col("split"), F.col("src_row")))


def file_marks(lines: DataFrame) -> DataFrame:
    """Per file the position of its first line that is not blank, and of the first that
    leaves a quoted field open (null: every line is a record)."""
    opens = F.col("value").contains('"') & F.col("value").rlike(_OPENS)
    return _placed(lines).groupBy("src_file").agg(
        F.min(F.when(F.trim("value") != "", F.col("position"))).alias("first"),
        F.min(F.when(opens, F.col("position"))).alias("first_open"))


def records_of(lines: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Records of text lines (src_file, split, src_row, value): the lines of a split in the
    order of ``src_row``, the splits of a file in that of ``split``."""
    marks = (file_marks(lines) if marks is None else marks).select("src_file", "first_open")
    lines = _placed(lines).join(marks, "src_file")
    whole = (lines.filter(F.col("first_open").isNull() & (F.trim("value") != ""))
             .select("src_file", "src_row", "position", F.col("value").alias("record")))
    torn = lines.filter(F.col("first_open").isNotNull()).drop("first_open")
    return whole.unionByName(_joined_lines(torn))


def _joined_lines(lines: DataFrame) -> DataFrame:
    """Records of files whose records may span lines."""
    value = F.col("value")
    # a line that begins inside a field goes on, after its closing quote, as a plain field
    rest = F.concat(F.lit("x"), F.regexp_replace("value", _CLOSES, ""))
    lines = (lines.withColumn("from_out", value.rlike(_OPENS).cast("int"))
             .withColumn("from_in", F.when(value.rlike(_CLOSES), rest.rlike(_OPENS))
                         .otherwise(F.lit(True)).cast("int"))
             .withColumn("swap", ((F.col("from_out") == 1) & (F.col("from_in") == 0)).cast("int")))

    # inside a split: the state is the last one set, swapped as often as lines swap it since;
    # "sets" is the state set, seen through all swaps of the split up to there
    own = Window.partitionBy("src_file", "split").orderBy("src_row")
    to_here, before = (own.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    lines = (lines.withColumn("swaps", F.sum("swap").over(to_here))
             .withColumn("sets", F.when(F.col("from_out") == F.col("from_in"),
                                        (F.col("from_out") + F.col("swaps")) % 2))
             .withColumn("set_before", F.last("sets", ignorenulls=True).over(before))
             .withColumn("swaps_before", F.col("swaps") - F.col("swap")))

    # a split's function: 0 and 1 set the state, 2 keeps it, 3 swaps it (of the last line)
    after = F.last("sets", ignorenulls=True).over(to_here)
    code = F.when(after.isNotNull(), (after + F.col("swaps")) % 2).otherwise(
        2 + F.col("swaps") % 2)
    # stored: the sums over splits read its states, not the texts, and no line is scanned again
    lines = stage_table(lines.withColumn("code", code)
                        .select("src_file", "split", "src_row", "value", "position", "set_before",
                                "swaps_before", "code"), "csv-lines")
    splits = lines.groupBy("src_file", "split").agg(
        F.max(F.col("src_row") * 4 + F.col("code")).alias("last"))
    of_file = Window.partitionBy("src_file").orderBy("split")
    up_to, ahead = (of_file.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    splits = (splits.withColumn("f", F.col("last") % 4)
              .withColumn("f_swap", (F.col("f") == 3).cast("int"))
              .withColumn("f_swaps", F.sum("f_swap").over(up_to))
              .withColumn("f_sets", F.when(F.col("f") < 2, (F.col("f") + F.col("f_swaps")) % 2))
              .withColumn("entry", (F.coalesce(F.last("f_sets", ignorenulls=True).over(ahead),
                                               F.lit(0))
                                    + F.col("f_swaps") - F.col("f_swap")) % 2)
              .withColumn("exit", F.when(F.col("f") < 2, F.col("f"))
                          .otherwise((F.col("entry") + F.col("f")) % 2))
              .select("src_file", "split", "entry", "exit"))
    state = (F.coalesce("set_before", F.col("entry")) + F.col("swaps_before")) % 2
    lines = lines.join(splits, ["src_file", "split"]).withColumn("inside", state == 1)

    # the start of a line's record, in its split or in an earlier one
    start = F.when(~F.col("inside") & (F.trim("value") != ""), F.col("position"))
    lines = lines.withColumn("start", start)
    starts = (lines.groupBy("src_file", "split").agg(F.max("start").alias("last_start"),
                                                     F.max_by("exit", "split").alias("exit"))
              .withColumn("carried", F.max("last_start").over(ahead))
              .withColumn("file_start", F.max("last_start").over(Window.partitionBy("src_file")))
              .withColumn("open_end", F.max_by("exit", "split").over(
                  Window.partitionBy("src_file")) == 1)
              .select("src_file", "split", "carried", "file_start", "open_end"))
    lines = (lines.drop("exit").join(starts, ["src_file", "split"])
             .withColumn("start", F.coalesce(F.max("start").over(to_here), F.col("carried"))))
    # of a field that never closes every line is a record
    lines = lines.withColumn("alone", F.col("open_end") & (F.col("start") == F.col("file_start")))
    lines = (lines.filter((F.col("inside") & ~F.col("alone")) | (F.trim("value") != ""))
             .withColumn("start", F.when(F.col("alone"), F.col("position"))
                         .otherwise(F.col("start"))))

    parts = F.array_sort(F.collect_list(F.struct("position", "src_row", "value")))
    return (lines.groupBy("src_file", "start").agg(parts.alias("parts"))
            .select("src_file", F.col("parts")[0]["src_row"].alias("src_row"),
                    F.col("parts")[0]["position"].alias("position"),
                    F.array_join(F.col("parts")["value"], "\n").alias("record")))
