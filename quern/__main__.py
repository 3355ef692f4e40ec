"""Run SQL from the command line: one statement, or a file with one on each line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quern.engine.errors import EngineError
from quern.engine.session import Engine, Policy


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quern", description=__doc__)
    parser.add_argument("--data", required=True, help="folder of the tables")
    what = parser.add_mutually_exclusive_group(required=True)
    what.add_argument("--sql", help="a statement")
    what.add_argument("--batch-file", help="a file with a statement on each line; # starts a comment line")
    parser.add_argument("--no-limits", action="store_true", help="no limit of rows and seconds; without it they are those of Policy.interactive")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("quern").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    lines = [given.sql] if given.sql else [x.strip() for x in open(given.batch_file, encoding="utf-8")]
    with Engine(spark, given.data, Policy() if given.no_limits else Policy.interactive()).connect() as session:
        for sql in lines:
            if not sql or sql.startswith("#"):
                continue
            try:
                result = session.execute(sql)
            except EngineError as e:
                print(e, file=sys.stderr)
                return 1
            if result.frame is None:
                print(f"{result.rows_affected} rows affected")
            else:
                print("\t".join(result.columns))
                for row in result.rows():
                    print("\t".join("NULL" if v is None else str(v) for v in row))
    return 0


if __name__ == "__main__":
    sys.exit(main())
