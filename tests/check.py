"""Run registered queries against their oracles: python tests/check.py [sf] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from conftest import local_session
from oracle import compare

import __spark_entry__ as entry


def main(args):
    sf_dir = f"/root/testdata/{args[0] if args else 'sf0.01'}"
    names = args[1:] or list(entry.queries())
    spark = local_session()
    oracles = entry.oracle_sql()
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                verdict = compare(spark, entry.queries()[name], oracles[name], sf_dir) or "ok"
            else:
                verdict = f"rows only: {entry.queries()[name](spark, sf_dir).count()}"
        except Exception as exc:
            verdict = f"ERROR {type(exc).__name__}: {str(exc)[:500]}"
        print(f"{name:28s} {time.time() - start:6.1f}s {verdict}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
