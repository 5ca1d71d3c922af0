"""python -m repeatloom -f genome.fasta -o out [-m 1000] [-i 7] [-t templates.fasta] [-p 4] [-q]"""

from __future__ import annotations

import argparse
import logging
import os
import shutil
import sys

from repeatloom.config import Config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="repeatloom", description="Annotate tandem-repeat arrays in a FASTA genome.")
    p.add_argument("-f", "--fasta", required=True, help="genome, plain or .gz")
    p.add_argument("-o", "--output", required=True, help="folder of the result tables")
    p.add_argument("-m", "--max-rep-size", type=int, default=Config.max_repeat)
    p.add_argument("-i", "--min-rep-size", type=int, default=Config.min_repeat)
    p.add_argument("-t", "--templates", help="FASTA of named units")
    p.add_argument("-p", "--processes", type=int, default=1, help="local cores, where no master is configured")
    p.add_argument("--aligner", help="multiple aligner to run on the executors in place of the built-in one, such as clustalo")
    p.add_argument("--mapper", help="profile search to run on the executors in place of the built-in one, such as nhmmer")
    p.add_argument("-q", "--quiet", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.processes < 1 or not ("://" in args.fasta or os.path.exists(args.fasta)):
        print("processes must be at least 1 and the input must exist", file=sys.stderr)
        return 2
    missing = [p for p in (args.aligner, args.mapper) if p and not shutil.which(p)]
    if missing:
        print(f"not found or not executable: {', '.join(missing)}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from repeatloom.functions import external
    from repeatloom.plans import annotate

    logging.basicConfig(level=logging.WARNING if args.quiet else logging.INFO, format="%(asctime)s %(message)s", stream=sys.stdout)
    builder = SparkSession.builder.appName("repeatloom")
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{args.processes}]")
    spark = builder.getOrCreate()
    aligner = external.Aligner(args.aligner, external.tally(spark)) if args.aligner else None
    mapper = external.Mapper(args.mapper, external.tally(spark)) if args.mapper else None
    cfg = Config(max_repeat=args.max_rep_size, min_repeat=args.min_rep_size, aligner=aligner, mapper=mapper)
    annotate.run(spark, args.fasta, args.output, cfg, args.templates)
    return 0


if __name__ == "__main__":
    sys.exit(main())
