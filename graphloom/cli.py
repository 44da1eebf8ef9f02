"""Command line: python -m graphloom.cli REPORT GRAPH [--name value ...]; build and profile take a source tree."""

from __future__ import annotations

import argparse
import inspect
import json

from pyspark.sql import SparkSession

from graphloom.plans import tools
from graphloom.plans.build import build


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    own = {"build": build, "profile": tools.profile, **tools.REPORTS}
    for name, f in own.items():
        sub = commands.add_parser(name, help=(f.__doc__ or "").strip().split("\n")[0])
        sub.add_argument("path")
        sub.add_argument("--json", action="store_true", help="compact JSON")
        if name not in ("build", "profile"):
            sub.add_argument("--timeout", type=float, default=0)
        for key, p in list(inspect.signature(f).parameters.items())[2 if name in ("build", "profile") else 1 :]:
            kind = type(p.default) if p.default is not inspect.Parameter.empty else str
            if kind is bool:
                sub.add_argument(f"--{key}", action="store_true")
            else:
                sub.add_argument(f"--{key}", type=kind, default=p.default if p.default is not inspect.Parameter.empty else None, required=p.default is inspect.Parameter.empty)
    commands.add_parser("guide")
    args = vars(parser.parse_args(argv))
    command, compact = args.pop("command"), args.pop("json", False)
    if command == "guide":
        out = tools.guide()
    else:
        spark = SparkSession.builder.appName("graphloom").getOrCreate()
        path = args.pop("path")
        out = own[command](spark, path, **args) if command in ("build", "profile") else tools.run(spark, path, command, **args)
    print(json.dumps(out, default=str, separators=(",", ":")) if compact else json.dumps(out, default=str, indent=2))
    return int("error" in out)


if __name__ == "__main__":
    raise SystemExit(main())
