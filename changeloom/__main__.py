"""Runs a task: python -m changeloom --config task.json (or the file that CONFIG names)."""

import argparse
import os
from pathlib import Path

from pyspark.sql import SparkSession

from .plans.tasks import load_task


def main() -> None:
    p = argparse.ArgumentParser(prog="changeloom")
    p.add_argument("-c", "--config", default=os.environ.get("CONFIG"), required="CONFIG" not in os.environ)
    spark = SparkSession.builder.appName("changeloom").getOrCreate()
    load_task(Path(p.parse_args().config).read_text(), spark).run()


if __name__ == "__main__":
    main()
