"""``python -m gridloom run STUDY --models CSV... --root DIR --out DIR``."""

import argparse
import json

from gridloom.operators.regions import Regions
from gridloom.plans.study import Settings, run_study
from gridloom.sources import sinks
from gridloom.sources.catalog import Catalog, model_database


def main() -> None:
    parser = argparse.ArgumentParser(prog="gridloom")
    run = parser.add_subparsers(dest="command", required=True).add_parser("run", help="run a study")
    run.add_argument("study")
    run.add_argument("--models", nargs="+", required=True)
    run.add_argument("--root", default=".")
    run.add_argument("--out", required=True)
    run.add_argument("--regions", nargs="*", default=[])
    args = parser.parse_args()
    from pyspark.sql import SparkSession

    spark, known = SparkSession.builder.appName("gridloom").getOrCreate(), Regions()
    scalars = run_study(spark, args.study, Catalog(args.root), model_database(spark, args.models), args.out, Settings(regions=(None, *args.regions), known=known))
    print(json.dumps(sinks.bundle(scalars, known.name, known.source), indent=1))


if __name__ == "__main__":
    main()
