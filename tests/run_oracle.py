"""Run registered queries against their oracle SQL: python -m tests.run_oracle [sf_dir] [names...]"""

from __future__ import annotations

import sys
import time

from leasegrid.plans.catalog import REGISTRY
from leasegrid.session import local_session

from .oracle import compare, duck


def main(argv: list[str]) -> int:
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(REGISTRY)
    spark = local_session(4)
    con = duck(sf)
    failed = 0
    for n in names:
        q = REGISTRY[n]
        t0 = time.time()
        try:
            df = q.run(spark, sf)
            if q.sql is None:
                cnt = df.count()
                print(f"{n:28s} rows-only {cnt} rows ({time.time() - t0:.1f}s)", flush=True)
                continue
            ok, msg = compare(df, con, q.sql)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:800]}"
        failed += not ok
        print(f"{n:28s} {'OK ' if ok else 'BAD'} {msg} ({time.time() - t0:.1f}s)", flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
