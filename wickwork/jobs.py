"""Command line of the ingestion jobs, for ``spark-submit``.

    spark-submit wickwork/jobs.py consume '{"topic": "btc", "servers": "...", "database": "crypto",
        "table": "btc", "symbol": "BTC-USD"}' --checkpoint hdfs:///checkpoints/btc

Parameters come as a JSON object; they are parsed, never evaluated.
"""

from __future__ import annotations

import argparse
import json
import pathlib
import sys

# The script's own folder is on the path; the package is in the one above.
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from wickwork.loader import CandleLoader  # noqa: E402
from wickwork.session import build_session  # noqa: E402


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="wickwork")
    parser.add_argument("job", choices=["consume", "load", "load-events", "compact"])
    parser.add_argument("loader", type=json.loads, help="JSON object of CandleLoader parameters")
    parser.add_argument("--checkpoint", help="checkpoint folder of the stream")
    parser.add_argument("--append", action="store_true", help="append the stream instead of upserting it")
    parser.add_argument("--once", action="store_true", help="consume what is there, then stop")
    parser.add_argument("--fetch", help="package.module:function, for load")
    parser.add_argument("--options", type=json.loads, default={}, help="JSON object of source options")
    parser.add_argument("--values", type=json.loads, default=[], help="JSON list of partition values, for compact")
    parser.add_argument("--files", type=int, default=1, help="files per partition, for compact")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = parse(argv)
    loader = CandleLoader(build_session(f"wickwork-{args.job}"), **args.loader)
    if args.job == "consume":
        more = {"trigger": None} if args.once else {}
        loader.consume(checkpoint=args.checkpoint, merge=not args.append, **more, **args.options).awaitTermination()
    elif args.job == "load":
        print(f"loaded {loader.load_range(args.fetch, **args.options)} rows")
    elif args.job == "load-events":
        print(f"loaded {loader.load_events(**args.options)} rows")
    else:
        loader.compact(args.values, args.files)


if __name__ == "__main__":
    main()
