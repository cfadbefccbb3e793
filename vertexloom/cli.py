"""Command line: python -m vertexloom.cli generate | describe | convert | stats | check ..."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from . import api, sources, tools


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vertexloom", description="Graph generation, conversion, statistics and checks.")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate", help="a graph by its option string")
    g.add_argument("options")
    g.add_argument("-o", "--output", required=True)
    g.add_argument("-f", "--format", dest="formats", action="append", help="once for each file; the name's extension tells otherwise")
    d = sub.add_parser("describe", help="an option string with its deduced parameters")
    d.add_argument("options")
    c = sub.add_parser("convert", help="from one format to another")
    c.add_argument("input")
    c.add_argument("output")
    for name in ("input-format", "output-format"):
        c.add_argument(f"--{name}")
    for name in ("drop-weights", "add-reverse", "drop-loops", "sort", "degree-weights"):
        c.add_argument(f"--{name}", action="store_true")
    c.add_argument("--isolated", type=int, default=0, help="weight by degree of vertices without edges")
    for name, text in (("stats", "a line of statistics for each file"), ("check", "rules that files break; exit status 1 if any")):
        s = sub.add_parser(name, help=text)
        s.add_argument("inputs", nargs="+")
        s.add_argument("--input-format")
    s.add_argument("--allow-loops", action="store_true")
    s.add_argument("--allow-multi", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "describe":
        print(json.dumps(asdict(api.describe(a.options)), default=str))
        return 0
    spark = spark or SparkSession.builder.appName("vertexloom").getOrCreate()
    if a.command == "generate":
        g = api.generate(spark, a.options)
        for fmt in a.formats or [None]:
            sources.write_graph(g, a.output if not a.formats or len(a.formats) == 1 else f"{a.output}.{fmt}", fmt)
    elif a.command == "convert":
        g = sources.read_graph(spark, a.input, a.input_format)
        sources.write_graph(tools.converted(g, a.drop_weights, a.add_reverse, a.drop_loops, a.sort, a.degree_weights, a.isolated), a.output, a.output_format)
    elif a.command == "stats":
        for path in a.inputs:
            print(json.dumps({"file": path, **tools.statistics(sources.read_graph(spark, path, a.input_format)).first().asDict()}))
    else:
        broken = 0
        for path in a.inputs:
            for rule, n in tools.checked(sources.read_graph(spark, path, a.input_format), a.allow_loops, a.allow_multi).collect():
                print(f"{path}\t{rule}\t{n}")
                broken += n if not rule.endswith("beyond_32_bits") and rule != "beyond_32_bits" else 0
        return int(broken > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
