"""``python -m qissaflow.cli QUERY FOLDER OUT``: runs a registered query over a folder of tables and writes it as Parquet."""

from __future__ import annotations

import argparse
import importlib.util

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("query")
    parser.add_argument("folder")
    parser.add_argument("out")
    parser.add_argument("--format", default="parquet", choices=("parquet", "json", "csv"))
    own = parser.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    names = ["qissaflow.plans.queries"] + ["qissaflow.llm.queries"] * bool(importlib.util.find_spec("qissaflow.llm"))
    found = {k: f for n in names for k, f in importlib.import_module(n).queries().items()}
    if own.query not in found:
        parser.error(f"no query {own.query}; there are {', '.join(sorted(found))}")
    found[own.query](spark, own.folder).write.format(own.format).mode("overwrite").save(own.out)


if __name__ == "__main__":
    main()
