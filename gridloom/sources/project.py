"""A folder of netlist files as tables: includes followed, packed files unpacked, elements, nets, sources and parameters read."""

from __future__ import annotations

import gzip
import posixpath
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.values import spice_value
from ..operators.graph import components
from ..session import Scratch
from .netlist import fields, logical_lines, source_options, waveforms


def _unpacked(data: bytes) -> str:
    """The text of a file, whatever its name says; bytes that are no UTF-8 are left out."""
    if data[:2] == b"\x1f\x8b":
        try:
            data = gzip.decompress(data)
        except (OSError, EOFError, zlib.error):
            return ""
    return data.decode("utf-8", "ignore")


def _is_packed(spark: SparkSession, path: str) -> bool:
    """By the first two bytes, whatever the name says."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    f = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return (f.read(), f.read()) == (0x1F, 0x8B)
    finally:
        f.close()


def _packed_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A packed file can't be split: it is one task, its lines leave it one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = re.split("\r\n|\r|\n", _unpacked(data))
                for p in range(0, len(lines), 10_000):
                    part = lines[p : p + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), pa.array(range(p + 1, p + 1 + len(part)), pa.int32()), pa.array(part, pa.string())], names=["file_name", "line_no", "raw_line"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, "file_name string, line_no int, raw_line string")


def _plain_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Plain files are split as Spark splits text; a line's number is its place in its piece and the lines of the pieces before."""
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("piece"), F.regexp_replace("value", "\ufffd", "").alias("raw_line"), F.monotonically_increasing_id().alias("id"))
    pieces = text.groupBy("file_name", "piece").agg(F.count(F.lit(1)).alias("lines"), F.min("id").alias("first"))
    before = Window.partitionBy("file_name").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("file_name", "piece", "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
    return text.join(starts, ["file_name", "piece"]).select("file_name", (F.col("before") + F.col("id") - F.col("first") + 1).cast("int").alias("line_no"), "raw_line")


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_name, line_no, raw_line of the files: packed ones as a whole, plain ones in pieces. Bytes that are no UTF-8 are left out."""
    packed = [p for p in paths if _is_packed(spark, p)]
    plain = [p for p in paths if p not in set(packed)]
    parts = ([_packed_lines(spark, packed)] if packed else []) + ([_plain_lines(spark, plain)] if plain else [])
    if not parts:
        return spark.createDataFrame([], "file_name string, line_no int, raw_line string")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def included(spark: SparkSession, main: str) -> tuple[list[str], list[str]]:
    """All files that a main file leads to, and the names that are not there. A name is looked for beside the including file, then beside the main file, with and without ``.gz``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    found, missing, new = [main], [], [main]
    while new:
        rows = read_lines(spark, new).filter(F.lower("raw_line").rlike(r"^[ \t]*\.include[ \t]"))
        name = F.btrim(F.regexp_extract("raw_line", r"(?i)^[ \t]*\.include[ \t]+(.*)", 1), F.lit(" \t\r\"'"))
        wanted, new = rows.select("file_name", name.alias("name")).collect(), []
        for r in wanted:
            places = [posixpath.join(posixpath.dirname(base), r.name) + end for base in (r.file_name.removeprefix("file:"), main) for end in ("", ".gz")]
            path = next((p for p in places if there(p)), None)
            if path is None:
                missing.append(r.name)
            elif path not in found:
                found.append(path)
                new.append(path)
    return found, missing


@dataclass
class Project:
    """The tables of a netlist folder."""

    #: file_name, file_type (main, die, instance, package), tile_x, tile_y, line_no, kind, name, u, v, value (SI units), net; and of sources dc, static_value, pulses, pwls, ac, portid, pwl_text, instance, fsdb_path, fsdb_coeff, fsdb_shift, inst_x, inst_y; of controlled ones ctrl_pos, ctrl_neg
    elements: DataFrame
    node_nets: DataFrame  # node, net, as node files give them
    nets: DataFrame  # node, net, category: besides these the nodes that package elements join to them
    couplings: DataFrame  # name, first, second, coupling (K lines)
    subcircuits: DataFrame  # name, pins (.subckt lines; bodies are not expanded)
    parameters: DataFrame  # name, value
    unsupported: DataFrame  # file_name, line_no, text of lines no reader knows
    missing: list[str]

    def statistics(self) -> DataFrame:
        """net, category, kind, n, total: counts and summed values (current sources by amount) of the elements of each net; an element with an end in the package counts there."""
        at = lambda end: self.nets.select(F.col("node").alias(end), F.col("category").alias(f"_{end}"))
        e = self.elements.join(at("u"), "u", "left").join(at("v"), "v", "left")
        outside = lambda end: (F.col(end) != "0") & (F.coalesce(f"_{end}", F.lit("package")) == "package")
        category = F.when(outside("u") | outside("v"), "package").otherwise("die")
        amount = F.when(F.col("kind") == "I", F.abs("value")).otherwise(F.col("value"))
        return e.filter("net IS NOT NULL").groupBy("net", category.alias("category"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"))


def _with_types(rows: DataFrame, main: str) -> DataFrame:
    """What a file is by its name: tile and instance files have a place, files with ``package`` in their name are the package."""
    own = F.lower(F.element_at(F.split("file_name", "/"), -1))
    tile = r"^(tile|instancemodels)_([0-9]+)_([0-9]+)\.(?:ckt|sp)(?:\.gz)?\z"
    kind = F.regexp_extract(own, tile, 1)
    number = lambda k: F.nullif(F.regexp_extract(own, tile, k), F.lit("")).cast("int")
    file_type = F.when(kind == "tile", "die").when(kind != "", "instance").when(own.contains("package"), "package").when(own == posixpath.basename(main).lower(), "main").otherwise("die")
    return rows.withColumn("file_type", file_type).withColumn("tile_x", number(2)).withColumn("tile_y", number(3))


def propagate(node_nets: DataFrame, elements: DataFrame) -> DataFrame:
    """node, net, category: nodes on file are ``die`` and keep their net; other nodes that elements outside the tiles join to them are ``package`` and take it (of several nets the least)."""
    links = elements.filter("file_type IN ('main', 'package') AND kind IN ('R', 'L', 'V') AND u <> '0' AND v <> '0'").select("u", "v")
    labels = components(links)
    die = node_nets.groupBy("node").agg(F.min("net").alias("net"))
    nets = labels.join(die, "node").groupBy("component").agg(F.min("net").alias("net"))
    more = labels.join(nets, "component").join(die.select("node"), "node", "left_anti").select("node", "net", F.lit("package").alias("category"))
    return die.select("node", "net", F.lit("die").alias("category")).unionByName(more)


def load(spark: SparkSession, folder: str, main: str = "ckt.sp", cache: str | None = None, net: str | None = None) -> Project:
    """Reads ``main`` of a folder and all it includes. Node files (``.nd``) beside tile files give the nets.

    Resistors, capacitors, inductors, voltage, current and controlled sources become elements; a nameless one is named
    by file and line. K lines are ``couplings``, ``.subckt`` lines ``subcircuits``. Every other element line is kept in
    ``unsupported``, none is dropped silently. With ``net`` (any case) only elements of that net are kept, and package
    elements and voltage sources of no known net. With ``cache`` elements and nets are written there as Parquet and
    read back.
    """
    scratch = Scratch(spark)
    files, missing = included(spark, posixpath.join(folder, main))
    text = scratch.write(logical_lines(read_lines(spark, files)))
    rows = _with_types(text, main).withColumn("f", fields(F.col("text"))).withColumn("letter", F.upper(F.substring("text", 1, 1)))
    get = lambda k: F.get("f", F.lit(k))
    letter = F.col("letter")
    controlled = letter.isin("E", "F", "G", "H")
    elements = (letter.isin("R", "C", "L", "V", "I") & (F.size("f") >= 4)) | (controlled & (F.size("f") >= 6))
    known = rows.filter(elements)
    end = lambda k: F.regexp_replace(get(k), r"^\*", "")
    name = F.when(F.length(get(0)) > 1, get(0)).otherwise(F.concat_ws(":", "file_name", F.col("line_no").cast("string")))
    static = spice_value(F.nullif(F.regexp_extract("text", r"(?i) static_value=([^ ]+)", 1), F.lit("")))
    dc = spice_value(F.when(controlled, get(5)).when((letter == "I") & F.lower(get(3)).isin("dc"), get(4)).otherwise(get(3)))
    pulses, pwls = waveforms(F.col("text"))
    own = lambda kind, c: F.when(letter == kind, c)
    options = {k: c if k == "pwl_text" else F.when(letter.isin("V", "I"), c) for k, c in source_options(F.col("text")).items()}
    options["pwl_text"] = own("V", options["pwl_text"])
    parsed = known.select(
        "file_name", "file_type", "tile_x", "tile_y", "line_no", letter.alias("kind"), name.alias("name"), end(1).alias("u"), end(2).alias("v"),
        (F.coalesce(dc, F.when(letter == "I", 0.0)) + F.when(letter == "I", F.coalesce(static, F.lit(0.0))).otherwise(0.0)).alias("value"), own("I", dc).alias("dc"), own("I", static).alias("static_value"),
        own("I", pulses).alias("pulses"), own("I", pwls).alias("pwls"), *[c.alias(k) for k, c in options.items()], F.when(controlled, end(3)).alias("ctrl_pos"), F.when(controlled, end(4)).alias("ctrl_neg"),
    )
    pairs = rows.filter(F.lower("text").rlike(r"^\.param(eter)?\b"))
    value = r"(?i)^\.param(?:eter)? +([A-Za-z_][A-Za-z0-9_]*) *[= ] *([^ =]+)"
    parameters = pairs.select(F.upper(F.regexp_extract("text", value, 1)).alias("name"), spice_value(F.regexp_extract("text", value, 2)).alias("value"))
    coupling = (letter == "K") & (F.size("f") >= 4) & get(3).try_cast("double").isNotNull()
    couplings = rows.filter(coupling).select(get(0).alias("name"), get(1).alias("first"), get(2).alias("second"), get(3).cast("double").alias("coupling"))
    subcircuits = rows.filter(F.lower("text").startswith(".subckt ") & (F.size("f") >= 3)).select(get(1).alias("name"), F.expr("slice(f, 3, size(f) - 2)").alias("pins"))
    unsupported = rows.filter(~F.col("text").startswith(".") & ~F.coalesce(elements | coupling, F.lit(False))).select("file_name", "line_no", "text")
    tiles = sorted({p.removesuffix(".gz").removesuffix(".ckt") for p in files if p.removesuffix(".gz").endswith(".ckt")})
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    nd = [p for t in tiles for p in (f"{t}.nd", f"{t}.nd.gz") if (x := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(x)]
    if nd:
        nodes = read_lines(spark, nd).withColumn("f", fields(F.col("raw_line"))).filter(F.size("f") >= 6).select(get(0).alias("node"), get(5).alias("net")).distinct()
    else:
        nodes = spark.createDataFrame([], "node string, net string")
    nodes = scratch.write(nodes)
    parsed = scratch.write(parsed)
    nets = scratch.write(propagate(nodes, parsed))
    at = lambda e: nets.select(F.col("node").alias(e), F.col("net").alias(f"_{e}"))
    parsed = parsed.join(at("u"), "u", "left").join(at("v"), "v", "left").withColumn("net", F.coalesce("_u", "_v"))
    if net is not None:
        own_net = (F.lower("_u") == net.lower()) | (F.lower("_v") == net.lower())
        parsed = parsed.filter(own_net | (F.col("net").isNull() & ((F.col("kind") == "V") | (F.col("file_type") == "package"))))
    parsed = parsed.drop("_u", "_v")
    if cache:
        parsed.write.mode("overwrite").parquet(f"{cache}/elements")
        nodes.write.mode("overwrite").parquet(f"{cache}/node_nets")
        parsed, nodes = spark.read.parquet(f"{cache}/elements"), spark.read.parquet(f"{cache}/node_nets")
    return Project(parsed, nodes, nets, couplings, subcircuits, parameters, unsupported, missing)
