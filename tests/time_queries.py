"""Time registered queries without collecting: ``python tests/time_queries.py [sf_dir] [names...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import queries  # noqa: E402
from eoframe.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    for name, build in queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            print(f"{time.time() - started:7.1f} {name}", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"ERROR {name} {str(e)[:300]}", flush=True)
