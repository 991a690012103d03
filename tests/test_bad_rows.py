import re

from hypothesis import given, settings, strategies as st

from gridloom.operators.bad_rows import classify, number, parse_lines, reason, split_fields
from gridloom.plans.problems import SQL

SCHEMA = "line_id bigint, design_id bigint, file_name string, line_no int, raw_line string"


def by_letter(line):
    """The rule of the fields, letter by letter."""
    out, field, depth, quoted, ok = [], "", 0, False, True
    for c in line + " ":
        if c in " \t" and not quoted and depth == 0:
            if field == "*":
                return out, ok
            if field:
                out.append(field)
            field = ""
            continue
        if c == '"':
            quoted = not quoted
        elif c == "(" and not quoted:
            depth += 1
        elif c == ")" and not quoted:
            ok, depth = ok and depth > 0, max(depth - 1, 0)
        field += c
    if field.rstrip(" ") :
        out.append(field[:-1])
    return out, ok and not quoted and depth == 0


@given(st.text('ab" ()*\t', max_size=24))
@settings(max_examples=400, deadline=None)
def test_fields_against_letters(line):
    assert split_fields(line) == by_letter(line)


CASES = [
    ("a.ckt", "R1 1_2_M1 3_4_m2 5.", None), ("a.ckt", "r 1_2_M1 *3_4_M2 .5k * note \"open", None), ("a.ckt", "r 1_2_M1 3_4_M2 -1", "bad_value"), ("a.ckt", "r 1_2_M1 3_4_M2 -0", None),
    ("a.ckt", "r 1_2_M1 3_4_M2", "column_count"), ("a.ckt", "r 1_2_M1 3_4_M2 (5", "quoting"), ("a.ckt", "x 1_2_M1 3_4_M2 5", "bad_value"), ("a.ckt", "r 1_2_M1 3_4_M2 5\r", None), ("a.ckt", "r 1_2_M1 3_4_M2 5\r\n", None), ("a.ckt", "r 1_2_M1 3_4_M2 5\r\r", "bad_value"), ("a.ckt", "r 1_2_M1\r 3_4_M2 5", "bad_value"),
    ("a.nd", "1_2_M1 0 0 0 0 V\r", None), ("a.sp", 'i1 1_2_M1 0 1 inst="a\rb"\r', None), ("a.sp", "i1 1_2_M1 0 1 pwl(1 2\r", "quoting"), ("a.sp", "i1 1_2_M1 0 1 * inst=\"", None), ("a.sp", 'i1 1_2_M1 0 1 inst="a"static_value=1', "bad_value"),
    ("a.sp", "i1 1_2_M1 0 1 pwl(1 (2)) ", "bad_value"), ("a.sp", 'i1 1_2_M1 0 1 pwl(1 ")" 3 4)', "bad_value"), ("a.sp", "i1 1_2_M1 * 1 2", "column_count"), ("a.sp", "i1 1_2_M1 0 1MEG PWL(1MEG,,5e-3 )\tstatic_value=VDD", None),
    ("a.ckt", "l pkg_a 0 VDD", None), ("a.ckt", "l pkg_ 0 VDD", "bad_value"), ("a.ckt", "l 1_2_M12 0 1", "bad_value"), ("a.ckt", "l 1_2_M1 0 1MEGA", "bad_value"),
    ("a.nd", "1_2_M1 0 0 0 0 VDD_1", None), ("a.nd", "1_2_M1 0 0 0 VDD_1", "column_count"), ("a.nd", "1_2_M1 0 0 0 0 9V", "bad_value"), ("a.nd", "1_2_M1 0 0 x 0 V", "bad_value"), ("a.nd", '1_2_M1 0 0 0 0 "V', "quoting"),
    ("a.sp", "i1 1_2_M1 0 1m", None), ("a.sp", "i1 1_2_M1 0", "column_count"), ("a.sp", "I1 1_2_M1 0 1m PULSE(1 2 3 4 5 6 7) pwl(1,2, 3 4)", None), ("a.sp", "i1 1_2_M1 0 1 pulse(1 2)", "column_count"),
    ("a.sp", "i1 1_2_M1 0 1 pwl(1 2 3)", "column_count"), ("a.sp", "i1 1_2_M1 0 1 pwl()", "column_count"), ("a.sp", 'i1 1_2_M1 0 1 inst="a (b * c" static_value=-3', None), ("a.sp", 'i1 1_2_M1 0 1 inst="a ""b"" c"', None),
    ("a.sp", 'i1 1_2_M1 0 1 inst="a', "quoting"), ("a.sp", "i1 1_2_M1 0 1 pwl(1 x)", "bad_value"), ("a.sp", "i1 1_2_M1 0 1 sin(1 2)", "bad_value"), ("a.sp", "v1 1_2_M1 0 1", "bad_value"),
    ("a.sp", "i1 1_2_M1 0 1 pwl(" + "1 2 " * 8000 + ")", None), ("a.sp", "i1 1_2_M1 0 1 pwl(" + "1 2 " * 8000 + "3)", "column_count"),
]
NONE = [("a.ckt", ""), ("a.ckt", " \t"), ("a.ckt", "* r 1 2"), ("a.ckt", "  .param x=1"), ("a.ckt", None), ("a.txt", "r 1"), (None, "r 1"), ("a.ckt", "\r"), ("a.ckt", " \r\n")]


def test_loaded_and_failed(spark):
    rows = [(i, 1, f, i, x) for i, (f, x, _) in enumerate(CASES)] + [(1000 + i, None, f, None, x) for i, (f, x) in enumerate(NONE)]
    good, bad = parse_lines(spark.createDataFrame(rows + rows[:2], SCHEMA))
    assert {r.line_id: r.reason for r in bad.collect()} == {i: w for i, (_, _, w) in enumerate(CASES) if w}
    assert sorted(r.line_id for r in good.collect()) == sorted([i for i, c in enumerate(CASES) if not c[2]] + [0, 1])
    for f, x, w in CASES:
        assert reason(f[-3:].strip("."), re.sub(r"\r?\n?\Z", "", x, count=1))[0] == w


def test_sql_judges_alike(spark):
    """The oracle of p3_found on the same lines."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE netlist_lines (line_id BIGINT, design_id BIGINT, file_name VARCHAR, line_no INT, raw_line VARCHAR)")
    con.executemany("INSERT INTO netlist_lines VALUES (?, 1, ?, 1, ?)", [(i, f, x) for i, (f, x, *_) in enumerate(CASES + NONE)])
    assert dict(con.execute(SQL["p3_found"]).fetchall()) == {i: w for i, (_, _, w) in enumerate(CASES) if w}


def test_each_line_is_parsed_once(spark):
    """The plan holds one permissive parse a schema, whichever result is asked."""
    lines = spark.createDataFrame([(1, 1, "a.ckt", 1, "r 0 0 1")], SCHEMA)
    for df in (*parse_lines(lines), classify(lines)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_csv") == 2, plan


def test_other_columns_do_not_clash(spark):
    row = [(1, 1, "a.ckt", 1, "r 0 0 1\r", "x", True, "y")]
    good, bad = parse_lines(spark.createDataFrame(row, SCHEMA + ", line string, fits boolean, reason string"))
    assert [(r.name, r.raw_line) for r in good.collect()] == [("r", "r 0 0 1\r")] and bad.count() == 0


def test_both_paths_load_alike(spark):
    text = 'i1 *1_2_M1 0 1m pwl( 1, 2  3 4 ) inst="a b"'
    good, _ = parse_lines(spark.createDataFrame([(1, 1, "f.sp", 1, text), (2, 1, "f.sp", 2, text + ' inst="x ""y"""')], SCHEMA))
    a, b = sorted(good.collect(), key=lambda r: r.line_id)
    assert (a.name, a.u, a.v, a.value) == (b.name, b.u, b.v, b.value)
    assert a.options[1] == b.options[1] == 'inst="a b"'
    assert a.options[0].replace("(,", "(").replace(",)", ")") == b.options[0].replace("(,", "(").replace(",)", ")")


def test_empty_table(spark):
    good, bad = parse_lines(spark.createDataFrame([], SCHEMA))
    assert good.count() == bad.count() == 0


def test_number(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("1K",), ("2meg",), ("VDD",), ("vss",), ("bad",), (None,)], "x string")
    assert [r[0] for r in df.select(number(F.col("x"))).collect()] == [1e3, 2e6, 0.75, 0.0, None, None]
