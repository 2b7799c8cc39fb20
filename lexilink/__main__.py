"""python -m lexilink NAME --dir FOLDER [--out FOLDER] [--config FILE ...] [--set a.b=1 ...] [--debug]: a registered query over a folder of tables, shown or written as Parquet.

python -m lexilink pubtator --run input --dir FOLDER --out FOLDER: the passages (eid, passage_id, text) of a Parquet folder as PubTator files.
python -m lexilink pubtator --run append --dir FOLDER --files FOLDER --out FOLDER: PubTator files with the annotations (eid, start, end, text, type, ids) of a Parquet folder put before their own.
"""

from __future__ import annotations

import argparse
import sys

from lexilink.operators import settings
from lexilink.plans import catalog
from lexilink.session import build_session
from lexilink.sources import writers


def pubtator(words: list[str]) -> None:
    parser = argparse.ArgumentParser(prog="lexilink pubtator")
    parser.add_argument("--run", choices=["input", "append"], required=True)
    parser.add_argument("--dir", required=True)
    parser.add_argument("--files", help="PubTator files that are appended to")
    parser.add_argument("--out", required=True)
    args = parser.parse_args(words)
    spark = build_session()
    rows = spark.read.parquet(args.dir)
    if args.run == "append":
        if not args.files:
            parser.error("--run append needs --files")
        writers.append_pubtator(spark, args.files, rows, args.out)
    else:
        none = spark.createDataFrame([], "eid long, start long, end long, text string, type string, ids array<string>")
        writers.write_contents(writers.pubtator_documents(rows, none), args.out)


def main(words: list[str] | None = None) -> None:
    words = sys.argv[1:] if words is None else words
    if words[:1] == ["pubtator"]:
        return pubtator(words[1:])
    known = catalog.queries()
    parser = argparse.ArgumentParser(prog="lexilink", description=__doc__)
    parser.add_argument("name", choices=sorted(known), metavar="NAME")
    parser.add_argument("--dir", required=True)
    parser.add_argument("--out")
    parser.add_argument("--config", nargs="*", default=[])
    parser.add_argument("--set", nargs="*", default=[], dest="overrides")
    parser.add_argument("--debug", action="store_true", help="show the plan")
    args = parser.parse_args(words)
    found = settings.load(args.config, args.overrides)
    spark = build_session(**{"master": "local[*]"} | {k.replace(".", "__"): str(v) for k, v in settings.dotted(found.get("session", {})).items()})
    df = known[args.name](spark, args.dir)
    if args.debug:
        df.explain("formatted")
    if args.out:
        df.write.mode("error").parquet(args.out)
    else:
        df.show(truncate=False)


if __name__ == "__main__":
    main()
