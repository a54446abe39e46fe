"""Command line: python -m folioquery list | sql NAME | explain NAME DIR | run NAME DIR [--out PATH] [--rows N]."""

from __future__ import annotations

import argparse

from .plans import catalog


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioquery", description=__doc__)
    steps = parser.add_subparsers(dest="step", required=True)
    steps.add_parser("list")
    for step in ("sql", "explain", "run"):
        own = steps.add_parser(step)
        own.add_argument("name", choices=sorted(catalog.queries()))
        if step != "sql":
            own.add_argument("data")
        if step == "run":
            own.add_argument("--out")
            own.add_argument("--rows", type=int, default=20)
    args = parser.parse_args(argv)
    if args.step == "list":
        print("\n".join(sorted(catalog.queries())))
    elif args.step == "sql":
        print(catalog.oracle_sql().get(args.name, "-- no SQL"))
    else:
        from .session import local_session

        out = catalog.queries()[args.name](local_session(), args.data)
        if args.step == "explain":
            out.explain("formatted")
        elif args.out:
            out.write.parquet(args.out)
        else:
            out.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
