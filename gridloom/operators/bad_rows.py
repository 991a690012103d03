"""Rows that fail to parse, apart from the rows that load.

A line is read permissively under an explicit schema (``from_csv`` with a column that keeps the corrupt text), then its
fields are cast. What fits is loaded; only the rest is looked at again, field by field, for the first reason that holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the line format.
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
VALUE = rf"(?:{NUMBER}(?:[mM][eE][gG]|[tTgGkKmMuUnNpPfF])?|[vV][dD][dD]|[vV][sS][sS])"
NODE = r"\*?(?:0|[0-9]+_[0-9]+_[mM][0-9]|pkg_[A-Za-z0-9_]+)"
NET = r"[A-Za-z][A-Za-z0-9_]*"
SCALE = {"t": 1e12, "g": 1e9, "meg": 1e6, "k": 1e3, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15}

# Options of a source. Repetitions are possessive, so a list of any length is matched in a loop, not by recursion.
_GAP = r"[ \t,]"
_PULSE = rf"pulse\({_GAP}*+{VALUE}(?:{_GAP}++{VALUE}){{6}}{_GAP}*+\)"
_PWL = rf"pwl\((?:{_GAP}*+{VALUE}{_GAP}++{VALUE}(?={_GAP}|\)))++{_GAP}*+\)"
_OPTION = rf'(?:static_value={VALUE}|inst="(?:[^"]|"")*+"|{_PULSE}|{_PWL})(?=[ \t]|\z)'

BASE = "line_id bigint, design_id bigint, file_name string, line_no int, kind string"
FIELDS = BASE + ", name string, u string, v string, value string, net string, options array<string>, raw_line string"


def _csv(text: Column, columns: str) -> Column:
    return F.from_csv(text, f"{columns}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "sep": "\t", "quote": "\x00"})


def without_line_end(c: Column) -> Column:
    """A text without one line end (CR, LF or both) at its end."""
    n = F.length(c)
    return F.when(c.endswith("\r\n"), F.substring(c, F.lit(1), n - 2)).when(c.endswith("\r") | c.endswith("\n"), F.substring(c, F.lit(1), n - 1)).otherwise(c)


def records(lines: DataFrame) -> DataFrame:
    """The lines of tile and instance files that are records, with the kind of their file (``ckt``, ``nd``, ``sp``).

    ``line`` is the raw line without the line end that may stand at its end; a CR or LF anywhere else is a letter like
    any other. NULL and blank lines, lines that start with ``*`` or ``.``, and lines of other files are no records.
    """
    kind = F.lower(F.regexp_extract("file_name", r"\.([A-Za-z]+)\z", 1))
    rows = lines.select("line_id", "design_id", "file_name", "line_no", kind.alias("kind"), "raw_line", without_line_end(F.col("raw_line")).alias("line"))
    return rows.filter(F.col("kind").isin("ckt", "nd", "sp") & F.col("line").rlike(r"^[ \t]*+[^ \t*.]"))


def _permissive(rows: DataFrame) -> DataFrame:
    """Adds the fields and ``fits``; it is true only for lines that surely fit, and the others keep their text."""
    line, kind = F.col("line"), F.col("kind")
    cut = F.btrim(F.regexp_replace(line, r"(?s)[ \t]\*(?:[ \t].*)?\z", ""), F.lit(" \t"))
    four = F.regexp_extract(line, r"^[ \t]*+((?:[^ \t]++[ \t]++){3}[^ \t]++)", 1)
    rows = rows.withColumn("_head", F.regexp_replace(F.when(kind == "sp", four).otherwise(cut), r"[ \t]++", "\t"))
    rows = rows.withColumn("_c", F.when(kind != "nd", _csv(F.col("_head"), "name string, u string, v string, value string")))
    rows = rows.withColumn("_d", F.when(kind == "nd", _csv(F.col("_head"), "node string, a string, b string, c string, d string, net string")))
    c, d = F.col("_c"), F.col("_d")
    whole = lambda pattern: f"^(?:{pattern})\\z"
    element = c["_corrupt"].isNull() & c["u"].rlike(whole(NODE)) & c["v"].rlike(whole(NODE)) & c["value"].rlike(whole(VALUE))
    ckt = element & c["name"].rlike(r'^[rRcClL][^()"]*\z') & ~c["value"].startswith("-")
    after = rf"^[ \t]*+(?:[^ \t]++[ \t]++){{3}}[^ \t]++(?i:((?:[ \t]++{_OPTION})*+))[ \t]*+"
    sp = element & c["name"].rlike(r'^[iI][^()"]*\z') & line.rlike(rf"(?s){after}(?:(?<=[ \t])\*(?:[ \t].*)?)?\z")
    nd = d["_corrupt"].isNull() & d["node"].rlike(whole(NODE)) & d["net"].rlike(whole(NET))
    for x in "abcd":
        nd = nd & d[x].rlike(whole(VALUE))
    fits = F.coalesce(F.when(kind == "ckt", ckt).when(kind == "sp", sp).otherwise(nd), F.lit(False))
    # The test stands in a generator: a filter on its result can't be pushed below it, which would copy the parse into every reference.
    rows = rows.select("*", F.explode(F.array(fits)).alias("fits"))
    options = F.regexp_extract_all(F.regexp_extract(line, after, 1), F.lit(rf"(?i){_OPTION}"), F.lit(0))
    options = F.transform(options, lambda o: F.when(o.rlike("(?i)^p"), _listed(o)).otherwise(o))
    good = lambda x: F.when(F.col("fits"), x)
    return rows.select(
        "line_id", "design_id", "file_name", "line_no", "kind", good(c["name"]).alias("name"), good(F.coalesce(c["u"], d["node"])).alias("u"), good(c["v"]).alias("v"), good(c["value"]).alias("value"), good(d["net"]).alias("net"),
        F.when(F.col("fits") & (kind == "sp"), options).otherwise(F.array().cast("array<string>")).alias("options"), "raw_line", "line", "fits",
    )


def _listed(o: Column) -> Column:
    """A list of values parted by single commas."""
    return F.regexp_replace(F.regexp_replace(o, rf"{_GAP}+", ","), r"(?<=\(),|,(?=\))", "")


def split_fields(line: str) -> tuple[list[str], bool]:
    """The fields of a line up to a comment, and whether its quotes and parentheses pair up there."""
    fields, start, depth, quoted, paired = [], -1, 0, False, True
    for m in re.finditer(r'[ \t]+|["()]|[^ \t"()]+', line):
        x = m[0]
        if x[0] in " \t" and not quoted and not depth:
            if start >= 0:
                fields.append(line[start : m.start()])
                start = -1
                if fields[-1] == "*":
                    return fields[:-1], paired
            continue
        if start < 0:
            start = m.start()
        if x == '"':
            quoted = not quoted
        elif not quoted and x == "(":
            depth += 1
        elif not quoted and x == ")":
            paired, depth = paired and depth > 0, max(0, depth - 1)
    if start >= 0 and line[start:] != "*":
        fields.append(line[start:])
    return fields, paired and not quoted and not depth


_VALUE, _NODE, _NET = (re.compile(f"(?:{p})\\Z") for p in (VALUE, NODE, NET))
_LIST = re.compile(r"(pulse|pwl)\((.*)\)\Z", re.I | re.S)
_OTHER = re.compile(rf'(?:static_value={VALUE}|inst="(?:[^"]|"")*")\Z', re.I)


def _commas(m: re.Match) -> str:
    return m[1] + "(" + ",".join(x for x in re.split("[, \\t]+", m[2]) if x) + ")"


def _negative(value: str) -> bool:
    m = re.match(NUMBER, value)
    return bool(m) and float(m[0]) < 0


def reason(kind: str, line: str) -> tuple[str | None, list[str]]:
    """The first reason for which a line doesn't fit, or None; and its fields."""
    fields, paired = split_fields(line)
    if not paired:
        return "quoting", fields
    n = len(fields)
    if n != {"ckt": 4, "nd": 6}.get(kind, n) or n < 4:
        return "column_count", fields
    bad = False
    for o in fields[4:] if kind == "sp" else []:
        if m := _LIST.match(o):
            items = [x for x in re.split(r"[, \t]+", m[2]) if x]
            if len(items) != 7 if m[1].lower() == "pulse" else not items or len(items) % 2:
                return "column_count", fields
            bad |= not all(map(_VALUE.match, items))
        else:
            bad |= not _OTHER.match(o)
    if kind == "nd":
        bad |= not (_NODE.match(fields[0]) and all(map(_VALUE.match, fields[1:5])) and _NET.match(fields[5]))
    else:
        bad |= fields[0][0] not in ("iI" if kind == "sp" else "rRcClL") or not (_NODE.match(fields[1]) and _NODE.match(fields[2]) and _VALUE.match(fields[3]))
        bad |= kind == "ckt" and _negative(fields[3])
    return "bad_value" if bad else None, fields


_BASE = [x.split()[0] for x in BASE.split(", ")]
_NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def _rescan(b: pa.RecordBatch) -> pa.RecordBatch:
    out = {c: [] for c in ("name", "u", "v", "value", "net", "options", "reason")}
    for kind, line in zip(b.column("kind").to_pylist(), b.column("line").to_pylist()):
        why, f = reason(kind, line)
        nd = kind == "nd"
        row = (None if nd else f[0], f[0] if nd else f[1], None if nd else f[2], None if nd else f[3], f[5] if nd else None, [_LIST.sub(_commas, o) for o in f[4:]] if kind == "sp" else []) if why is None else (None,) * 6
        for c, x in zip(out, (*row, why)):
            out[c].append(x)
    new = {c: pa.array(x, pa.list_(pa.string()) if c == "options" else pa.string()) for c, x in out.items()}
    cols = {c: b.column(c) for c in [*_BASE, "raw_line"]} | new
    return pa.RecordBatch.from_arrays([cols[c] for c in [*_NAMES, "reason"]], names=[*_NAMES, "reason"])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that fit pass as they are; the others are scanned."""
    for b in batches:
        good = b.filter(b.column("fits"))
        if good.num_rows:
            yield pa.RecordBatch.from_arrays([*(good.column(c) for c in _NAMES), pa.nulls(good.num_rows, pa.string())], names=[*_NAMES, "reason"])
        if good.num_rows < b.num_rows:
            yield _rescan(b.filter(pc.invert(b.column("fits"))))


def classify(lines: DataFrame) -> DataFrame:
    """Every record of ``netlist_lines`` once, with its fields and ``reason``, which is NULL where the line loads: one pass over the lines."""
    return _permissive(records(lines)).mapInArrow(_judge, FIELDS + ", reason string")


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``netlist_lines`` as (loaded, failed).

    Both have line_id, design_id, file_name, line_no, kind, name, u, v, value, net, options and raw_line; ``failed`` has
    ``reason`` as well: ``quoting``, ``column_count`` or ``bad_value``. Every row of ``lines`` that is a record is in
    exactly one of them, as often as it stands in ``lines``. ``raw_line`` is the whole line as it came, with its line
    end. Whoever needs both takes ``classify``; ``failed`` alone sends only doubtful lines to the scan.
    """
    doubtful = _permissive(records(lines)).filter("NOT fits").mapInArrow(_judge, FIELDS + ", reason string")
    return classify(lines).filter("reason IS NULL").drop("reason"), doubtful.filter("reason IS NOT NULL")


def number(c: Column, vdd: float = 0.75, vss: float = 0.0) -> Column:
    """The double a value stands for: sign, digits, exponent, then a factor; VDD and VSS are parameters."""
    digits = F.regexp_extract(c, f"^({NUMBER})", 1)
    suffix = F.lower(F.regexp_replace(c, f"^{NUMBER}", ""))
    factor = F.create_map(*[F.lit(x) for kv in {"": 1.0, **SCALE}.items() for x in kv])
    return F.when(F.lower(c) == "vdd", F.lit(vdd)).when(F.lower(c) == "vss", F.lit(vss)).when(digits != "", digits.cast("double") * F.try_element_at(factor, suffix))
