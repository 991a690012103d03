"""Netlist text to rows: logical lines, commands, and one reader for each kind of element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.values import spice_value


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file_name, line_no, raw_line of the text files under a path; ``.gz`` files are unpacked by Spark.

    A file's lines are numbered in the task that reads it, so files, not lines, are spread over tasks.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_name"), F.posexplode(F.split("value", "\r?\n", -1)).alias("line_no", "raw_line"))
    return whole.withColumn("line_no", F.col("line_no") + 1)


#: Lines of a file that one window holds.
BLOCK = 20_000


def logical_lines(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """file_name, line_no (of the first part), text: comment and blank lines dropped, ``+`` lines joined, blanks collapsed, a trailing comment cut.

    A field ``*`` starts a comment; ``*node`` is a boundary mark and stays. A ``+`` line without a line before it stands alone.
    A file is cut into blocks of lines, so a long file is the work of many tasks; the last line that starts before a
    block is carried into it by a scan over blocks.
    """
    text = F.btrim(F.regexp_replace("raw_line", r"[ \t\r]+", " "), F.lit(" "))
    rows = lines.select("file_name", "line_no", text.alias("text")).filter((F.col("text") != "") & ~F.col("text").rlike(r"^\*"))
    rows = rows.withColumn("block", F.floor(F.col("line_no") / block)).withColumn("start", F.when(~F.col("text").startswith("+"), F.col("line_no")))
    before = Window.partitionBy("file_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("file_name", "block").agg(F.max("start").alias("last")).select("file_name", "block", F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("file_name", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("part", F.max("start").over(inside)).join(carried, ["file_name", "block"])
    rows = rows.withColumn("part", F.coalesce("part", "carried", F.lit(-1)))
    own = F.btrim(F.regexp_replace("text", r"^\+", ""), F.lit(" "))
    joined = rows.groupBy("file_name", "part").agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", own.alias("t")))).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: p["t"]), " ")
    return joined.select("file_name", "line_no", F.btrim(F.regexp_replace(whole, r" \*( .*)?\z", ""), F.lit(" ")).alias("text"))


def commands(lines: DataFrame) -> DataFrame:
    """Lines that start with a dot: command (lower case), rest, and the first NAME=VALUE of the rest."""
    text = F.btrim(F.col("raw_line"), F.lit(" \t\r"))
    rows = lines.withColumn("text", text).filter(F.col("text").startswith("."))
    command, rest = F.lower(F.regexp_extract("text", r"^\.([A-Za-z_]+)", 1)), F.btrim(F.regexp_extract("text", r"^\.[A-Za-z_]*(.*)", 1), F.lit(" \t"))
    pair = lambda k: F.nullif(F.regexp_extract(rest, r"([A-Za-z_][A-Za-z0-9_]*)[ \t]*=[ \t]*([^ \t=]+)", k), F.lit(""))
    return rows.select("line_id", command.alias("command"), rest.alias("rest"), pair(1).alias("name"), spice_value(pair(2)).alias("value"))


def fields(text: Column) -> Column:
    return F.split(F.btrim(F.regexp_replace(text, r"[ \t\r]+", " "), F.lit(" ")), " ", -1)


def node_nets(lines: DataFrame) -> DataFrame:
    """node, net of node files: the first and the sixth field of lines that have six."""
    f = fields(F.col("raw_line"))
    rows = lines.filter(F.col("file_name").endswith(".nd")).withColumn("f", f).filter((F.size("f") >= 6) & ~F.col("raw_line").rlike(r"^[ \t]*[*.]"))
    return rows.select("line_id", F.get("f", F.lit(0)).alias("node"), F.get("f", F.lit(5)).alias("net"))


#: Letter of an element, unit its value is kept in, factor to it.
UNITS = {"r": ("kOhm", 1e-3), "c": ("fF", 1e15), "l": ("nH", 1e9)}


def two_terminal(lines: DataFrame, letter: str) -> DataFrame:
    """Elements of one kind: name (file and line where it has none), u, v without boundary marks, value in its unit.

    Lines with fewer than four fields or without a number are left out.
    """
    rows = lines.filter(F.col("file_name").endswith(".ckt")).withColumn("f", fields(F.col("raw_line")))
    rows = rows.filter(F.lower(F.substring(F.get("f", F.lit(0)), 1, 1)) == letter).filter(F.size("f") >= 4)
    own = F.get("f", F.lit(0))
    name = F.when(F.length(own) > 1, own).otherwise(F.concat_ws(":", "file_name", F.col("line_no").cast("string")))
    end = lambda k: F.regexp_replace(F.get("f", F.lit(k)), r"^\*", "")
    value = spice_value(F.get("f", F.lit(3))) * F.lit(UNITS[letter][1])
    return rows.select("line_id", name.alias("name"), end(1).alias("u"), end(2).alias("v"), value.alias("value")).filter("value IS NOT NULL")


def current_sources(lines: DataFrame) -> DataFrame:
    """Current sources of instance files: name, node, ret, dc and static_value in mA, instance, counts of pulses and waves."""
    text = F.regexp_replace("raw_line", r"[ \t\r]+", " ")
    rows = lines.filter(F.col("file_name").endswith(".sp")).withColumn("text", F.btrim(text, F.lit(" ")))
    head = r"^([iI][^ ]*) ([^ ]+) ([^ ]+) ([^ ]+)"
    part = lambda k: F.regexp_extract("text", head, k)
    option = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    return rows.filter(F.col("text").rlike(head)).select(
        "line_id", part(1).alias("name"), F.regexp_replace(part(2), r"^\*", "").alias("node"), part(3).alias("ret"), (spice_value(part(4)) * 1000).alias("dc_ma"),
        (spice_value(option(r"(?i) static_value=([^ ]+)")) * 1000).alias("static_ma"), option(r'(?i) inst="([^"]*)"').alias("instance"),
        F.size(F.regexp_extract_all("text", F.lit(r"(?i) pulse\("), F.lit(0))).alias("pulses"), F.size(F.regexp_extract_all("text", F.lit(r"(?i) pwl\("), F.lit(0))).alias("pwls"),
    )


def numbers(text: Column) -> Column:
    """The values of a list parted by commas or blanks."""
    return F.transform(F.filter(F.split(text, r"[,\s]+", -1), lambda x: x != ""), spice_value)


def pulse_literals(text: Column) -> Column:
    """Every ``pulse(..)`` of a text as a struct; missing trailing values are 0."""
    names = ("v1", "v2", "delay", "rise", "fall", "width", "period")
    lists = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)pulse\(([^()]*)\)"), F.lit(1)), numbers)
    return F.transform(lists, lambda x: F.struct(*[F.coalesce(F.get(x, F.lit(k)), F.lit(0.0)).alias(n) for k, n in enumerate(names)]))


def pwl_literals(text: Column) -> Column:
    """Every ``pwl(..)`` of a text as an array of points in order of time; an odd last value is dropped."""
    lists = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)pwl\(([^()]*)\)"), F.lit(1)), numbers)
    pairs = lambda x: F.transform(F.filter(F.sequence(F.lit(0), F.size(x)), lambda i: (i % 2 == 0) & (i + 1 < F.size(x))), lambda i: F.struct(F.get(x, i).alias("t"), F.get(x, i + 1).alias("v")))
    return F.transform(lists, lambda x: F.array_sort(pairs(x)))


def waveforms(text: Column) -> tuple[Column, Column]:
    """The pulses and the piecewise linear waves of a current source, with the options after them applied.

    ``pwl_period=``, ``pwl_delay=`` and ``sp=`` (the period of pulses) count for the waves that stand before them and
    have none yet. Pulses: structs as of ``pulse_literals``; waves: ``points`` (t, v in order of time), ``period``,
    ``delay``.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"(?i)(?<![^ ])(?:pulse\([^()]*\)|pwl\([^()]*\)|(?:pwl_period|pwl_delay|sp)=[^ ]+)"), F.lit(0))
    placed = F.transform(tokens, lambda x, i: F.struct(i.alias("at"), x.alias("text")))

    def later(name: str, at: Column) -> Column:
        own = F.filter(placed, lambda o: (o["at"] > at) & F.lower(o["text"]).startswith(name + "="))
        values = F.filter(F.transform(own, lambda o: spice_value(F.substring_index(o["text"], "=", -1))), lambda x: x.isNotNull() & (x != 0))
        return F.coalesce(F.get(values, F.lit(0)), F.lit(0.0))

    kind = lambda name: F.filter(placed, lambda o: F.lower(o["text"]).startswith(name + "("))
    one = lambda found, o: F.get(found(o["text"]), F.lit(0))
    pulses = F.transform(kind("pulse"), lambda o: one(pulse_literals, o).withField("period", F.when(one(pulse_literals, o)["period"] != 0, one(pulse_literals, o)["period"]).otherwise(later("sp", o["at"]))))
    pwls = F.transform(kind("pwl"), lambda o: F.struct(one(pwl_literals, o).alias("points"), later("pwl_period", o["at"]).alias("period"), later("pwl_delay", o["at"]).alias("delay")))
    return pulses, pwls


def source_options(text: Column) -> dict[str, Column]:
    """Options of voltage and current sources by name; NULL where a source has none."""
    found = lambda p, k=1: F.nullif(F.regexp_extract(text, p, k), F.lit(""))
    number = lambda p, k=1: found(p, k).try_cast("double")
    fsdb = r"(?i) fsdb ([^ ]+)(?: ([^ ]+))?(?: ([^ ]+))?"
    return {
        "ac": number(r"(?i) ac ([^ ]+)"), "portid": found(r"(?i) portid(?: [^ =]*)?=([^ ]+)"), "pwl_text": found(r"(?i) (pwl *\(.*)"),
        "instance": found(r'(?i) inst="([^"]*)"'), "fsdb_path": found(fsdb), "fsdb_coeff": number(fsdb, 2), "fsdb_shift": number(fsdb, 3),
        "inst_x": found(r"^[^ ]*?:([0-9]+)_([0-9]+):").cast("bigint"), "inst_y": found(r"^[^ ]*?:([0-9]+)_([0-9]+):", 2).cast("bigint"),
    }
