"""Command line: ``python -m gridloom.cli solve FOLDER [--main ckt.sp] [--vdd V] [--top K] [--out PATH]``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.elements import conductance
from .operators.model import network_drop
from .sources.project import Project, load
from .sources.sinks import write_table


def solve(project: Project, vdd: float | None = None) -> DataFrame:
    """node, island, drop of a project: pads are the live ends of its voltage sources, loads its current sources."""
    e = project.elements
    v = e.filter("kind = 'V'")
    if vdd is None:
        row = v.agg(F.max("value")).first()[0] or project.parameters.filter("name LIKE 'VDD%'").agg(F.max("value")).first()[0]
        vdd = row if row else 1.0
    ends = v.select(F.col("u").alias("node")).union(v.select("v")).filter("node <> '0'").distinct()
    edges = e.filter("kind = 'R'").select("u", "v", conductance(F.col("value")).alias("g"))
    loads = e.filter("kind = 'I'").select(F.when(F.col("u") == "0", F.col("v")).otherwise(F.col("u")).alias("node"), F.col("value").alias("amps"))
    return network_drop(edges, ends, loads, vdd)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="gridloom")
    p.add_argument("command", choices=["solve"])
    p.add_argument("folder")
    p.add_argument("--main", default="ckt.sp")
    p.add_argument("--vdd", type=float)
    p.add_argument("--top", type=int, default=10)
    p.add_argument("--out")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    drops = solve(load(spark, a.folder, a.main), a.vdd)
    if a.out:
        write_table(drops, a.out)
    for r in drops.orderBy(F.desc("drop"), "node").limit(a.top).collect():
        print(f"{r.node:<32} {r.drop * 1e3:12.6f} mV")


if __name__ == "__main__":
    main()
