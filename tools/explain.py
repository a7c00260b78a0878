"""Print the formatted physical plan of registered queries.

Usage: python tools/explain.py [sf_dir] key [key ...]

Shows what Catalyst chose: pushed filters and read schemas at the scans,
exchanges (shuffles), broadcast vs sort-merge joins, WindowGroupLimit for
top-k, and whole-stage-codegen spans.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reelspark.plans.catalog import load_all  # noqa: E402
from reelspark.session import build_session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    reg = load_all()
    for key in args:
        print(f"===== {key} ({reg[key].covers})")
        reg[key].build(spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main()
