"""python -m factloom mcp [--root FOLDER] [--state FOLDER] [--lsp auto|off]"""

from __future__ import annotations

import sys

USAGE = "Usage: python -m factloom mcp [--root FOLDER] [--state FOLDER] [--lsp auto|off]"


def parse(args: list[str]) -> dict:
    if args[:1] != ["mcp"]:
        raise ValueError(USAGE)
    out, rest = {}, list(args[1:])
    while rest:
        name = rest.pop(0)
        if name not in ("--root", "--state", "--lsp") or not rest:
            raise ValueError(USAGE)
        out[name[2:]] = rest.pop(0)
    if out.get("lsp", "auto") not in ("auto", "off"):
        raise ValueError("--lsp must be auto or off")
    if "state" in out and "root" not in out:
        raise ValueError("--state needs --root")
    return out


def main(args: list[str]) -> int:
    try:
        options = parse(args)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from factloom.rpc import serve
    from factloom.service import FactsError, Registry

    spark = SparkSession.builder.appName("factloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        serve(Registry(spark, options.get("root"), options.get("state"), options.get("lsp", "auto")))
    except (FactsError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
