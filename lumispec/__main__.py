"""Command line: python -m lumispec build | samples | validate | identify | identify-folder."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .schemas import BIN_WIDTH, COARSE_LIMIT, PPM, SHARDS
from .session import Session
from .sources import binary, export, pickle_source
from .sources.discovery import discover


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lumispec")
    sub = parser.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="build a library from pickle files")
    build.add_argument("source")
    build.add_argument("out")
    build.add_argument("--bin-width", type=int, default=BIN_WIDTH)
    build.add_argument("--order", choices=["source", "accession"], default="source")
    build.add_argument("--strict", action="store_true")
    build.add_argument("--shards", type=int, default=SHARDS, help="folders of each table, about")
    build.add_argument("--progress-jsonl", action="store_true")
    build.add_argument("--binary", help="also write the four-file layout here")
    samples = sub.add_parser("samples", help="write query files of the first genomes")
    samples.add_argument("source")
    samples.add_argument("out")
    samples.add_argument("--count", type=int, default=3)
    check = sub.add_parser("validate", help="check a four-file library")
    check.add_argument("path")
    run = sub.add_parser("identify", help="identify query files")
    run.add_argument("library")
    run.add_argument("out")
    run.add_argument("files", nargs="+")
    run.add_argument("--coarse-limit", type=int, default=COARSE_LIMIT)
    run.add_argument("--ppm", type=int, default=PPM)
    whole = sub.add_parser("identify-folder", help="identify the query files of a folder, batch by batch; run again to go on")
    whole.add_argument("library")
    whole.add_argument("out")
    whole.add_argument("folder")
    whole.add_argument("--checkpoint", required=True)
    whole.add_argument("--every", type=int, default=64, help="files of a batch")
    whole.add_argument("--coarse-limit", type=int, default=COARSE_LIMIT)
    whole.add_argument("--ppm", type=int, default=PPM)
    whole.add_argument("--progress-jsonl", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "validate":
        ok, errors = binary.validate(args.path)
        print("\n".join(errors) or "ok")
        return int(not ok)
    spark = SparkSession.builder.appName("lumispec").getOrCreate()
    session = Session(spark)
    if args.command == "build":
        say = (lambda e: print(json.dumps(e), file=sys.stderr)) if args.progress_jsonl else None
        library = session.build(args.source, args.out, args.bin_width, args.order, args.strict, args.shards, say)
        if args.binary:
            binary.from_library(library, args.binary)
    elif args.command == "samples":
        rows = export.sample_queries(pickle_source.read_peaks(spark, str(discover(args.source).peaks)), args.count).collect()  # count rows
        Path(args.out).mkdir(parents=True, exist_ok=True)
        for r in rows:
            (Path(args.out) / r.name).write_text(r.content)
        return int(not rows)
    elif args.command == "identify-folder":
        session.open(args.library)
        tell = (lambda n, total: print(json.dumps({"processed": n, "total": total}), file=sys.stderr)) if args.progress_jsonl else lambda n, total: None
        session.identify_folder(args.folder, args.out, args.checkpoint, args.every, args.coarse_limit, args.ppm, on_progress=tell)
    else:
        session.open(args.library)
        session.export_results(session.identify(args.files, args.coarse_limit, args.ppm), args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
