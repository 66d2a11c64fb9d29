"""``python -m tidelog repair FOLDER [--force]``: rebuild a store that does not open.

A store that opens is left alone unless ``--force`` is given. Exit codes: 0 repaired and opened, 1 it failed, 2 usage,
3 the store opens as it is.
"""

from __future__ import annotations

import sys
from dataclasses import asdict

from .model import StoreError


def main(arguments: list[str]) -> int:
    paths = [a for a in arguments[1:] if a != "--force"]
    if arguments[:1] != ["repair"] or len(paths) != 1 or paths[0].startswith("-"):
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from .operators.repair import needs_repair, repair

    spark = SparkSession.builder.appName("tidelog repair").getOrCreate()
    try:
        if "--force" not in arguments and not needs_repair(spark, paths[0]):
            print("the store opens as it is; nothing was done")
            return 3
        report = asdict(repair(spark, paths[0]))
        for line in report.pop("notes"):
            print(line)
        print(", ".join(f"{k} {v}" for k, v in report.items()))
        return 0
    except (StoreError, OSError) as e:
        print(f"repair failed: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
