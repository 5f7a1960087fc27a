"""Time all queries of the time-series operators and print one JSON line.

Every query is run to its end without collecting rows (``noop`` sink), once to warm up and then
``BENCH_RUNS`` times; the best run counts. Three further entries do what the baseline has figures
for: set up a table and read its mark, load a batch of candles by range, and peek into a topic.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from wickwork import queries as q  # noqa: E402
from wickwork.loader import CandleLoader  # noqa: E402
from wickwork.session import build_session, scratch_path  # noqa: E402

HEADLINE = list(q.QUERIES)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = sys.argv[1:] or [*HEADLINE, "table_setup", "load_batch"]
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def table_setup():
        name = f"bench_{time.time_ns()}"
        CandleLoader(spark, name, location=scratch_path(spark, name))

    replay: dict[str, str] = {}

    def load_batch():
        replay.update(replay or q._replay(spark, sf_dir))
        name = f"bench_{time.time_ns()}"
        loader = CandleLoader(
            spark, name, symbol="click", start=replay["start"], end=replay["end"], location=scratch_path(spark, name)
        )
        loader.load_range(replay["fetch"], path=replay["path"])

    own = {"table_setup": table_setup, "load_batch": load_batch}

    def run(name: str) -> float:
        start = time.perf_counter()
        if name in own:
            own[name]()
        else:
            q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in wanted:
        run(name)
        times[name] = round(min(run(name) for _ in range(runs)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
