"""Run reports and export them: python -m loanscope SF_DIR OUT_DIR [KEY ...]

Every report key (all when none is given) is computed on the loan table
built from SF_DIR and written by Spark to OUT_DIR/<key> (Parquet, or CSV
with a header when --csv is given); rows never pass through the driver.
"""

from __future__ import annotations

import argparse
import sys


def main(argv=None) -> int:
    """Command-line entry point."""
    ap = argparse.ArgumentParser(prog="loanscope", description=__doc__.split("\n")[0])
    ap.add_argument("sf_dir")
    ap.add_argument("out_dir")
    ap.add_argument("keys", nargs="*")
    ap.add_argument("--csv", action="store_true", help="write CSV with a header instead of Parquet")
    ap.add_argument("--cores", type=int, default=8)
    args = ap.parse_args(argv)

    from loanscope.plans import registry
    from loanscope.session import local_session
    from loanscope.sources.files import save_report

    queries = registry.queries()
    unknown = [k for k in args.keys if k not in queries]
    if unknown:
        ap.error(f"unknown report keys: {', '.join(unknown)}")
    spark = local_session(cores=args.cores)
    for key in args.keys or list(queries):
        save_report(queries[key](spark, args.sf_dir), f"{args.out_dir.rstrip('/')}/{key}",
                    fmt="csv" if args.csv else "parquet")
        print(key, file=sys.stderr)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
