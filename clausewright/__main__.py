"""Command line: ``python -m clausewright list | run QUERY FOLDER [OUT] | graph-stats FOLDER``."""

from __future__ import annotations

import sys

from clausewright.session import build_session


def main(args: list[str]) -> int:
    import importlib

    names = ("clausewright.plans.core_queries", "clausewright.plans.reference_queries", "clausewright.llm.queries")
    queries = {}
    for name in names:
        try:
            queries |= importlib.import_module(name).QUERIES
        except ModuleNotFoundError:
            continue
    if args[:1] == ["list"]:
        print("\n".join(queries))
        return 0
    if args[:1] == ["graph-stats"] and len(args) == 2:
        args = ["run", "q24_graph_stats", args[1]]
    if args[:1] != ["run"] or len(args) not in (3, 4) or args[1] not in queries:
        print(__doc__)
        return 2
    spark = build_session()
    out = queries[args[1]](spark, args[2])
    if len(args) == 4:
        out.write.mode("overwrite").parquet(args[3])
    else:
        out.show(50, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
