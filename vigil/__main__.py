"""``python -m vigil --in EVENTS --rules RULES --out DIR``: run a job and print its alerts per pattern.

Paths default to the environment variables VIGIL_EVENTS, VIGIL_RULES and VIGIL_OUT (empty counts as unset).
"""

from __future__ import annotations

import argparse
import os
import sys
import threading
import time

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from vigil.operators import checks, profile
from vigil.plans.jobs import JOBS
from vigil.sources import records


def main(args: list[str] | None = None) -> int:
    env = lambda name, default=None: os.environ.get(name) or default
    ap = argparse.ArgumentParser(prog="vigil")
    ap.add_argument("--job", choices=sorted(JOBS), default="detect")
    ap.add_argument("--in", dest="events", default=env("VIGIL_EVENTS"))
    ap.add_argument("--rules", default=env("VIGIL_RULES"))
    ap.add_argument("--out", default=env("VIGIL_OUT", "out"))
    ap.add_argument("--serve-state", type=int, metavar="PORT", help="then serve profiles over HTTP on this port")
    ap.add_argument("--hold", type=float, default=20, help="seconds to serve")
    own = ap.parse_args(args)
    if not own.events:
        print("--in is missing", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName(f"vigil {own.job}").getOrCreate()
    try:
        result = JOBS[own.job].build(spark, own.events, own.rules)
    except AnalysisException as e:
        print(f"can't read the input: {e}", file=sys.stderr)
        return 2
    if own.job == "detect":
        records.write_alerts(result, own.out, by_pattern=True)
        # the pattern is the folder's name
        written = spark.read.option("basePath", own.out).text(own.out)
        for r in checks.counts(written).orderBy("pattern").collect():
            print(f"{r['pattern']}: {r['alerts']}")
    else:
        result.write.parquet(own.out)
    if own.serve_state is not None:
        http = profile.server(JOBS["profiles"].build(spark, own.events).cache(), own.serve_state)
        threading.Thread(target=http.serve_forever, daemon=True).start()
        time.sleep(own.hold)
        http.shutdown()
    return 0


if __name__ == "__main__":
    sys.exit(main())
