"""python -m tidemark --start 2025-01-01 [--end ...] [--sources a,b] --out DIR: fetch, keep what is admissible, snapshot."""

from __future__ import annotations

import argparse
from datetime import date, datetime, timezone

from .config import CUTOFF, available, fetch_window, load_dotenv
from .session import get_session
from .sources.feeds import FEEDS, fetch_all
from .sources.tables import snapshot


def main(argv: list[str] | None = None) -> dict:
    args = argparse.ArgumentParser(prog="tidemark")
    args.add_argument("--start", type=date.fromisoformat, default=CUTOFF)
    args.add_argument("--end", type=date.fromisoformat)
    args.add_argument("--sources", default=",".join(k for k in FEEDS if available(k)))
    args.add_argument("--out", required=True)
    args.add_argument("--env")
    a = args.parse_args(argv)
    if a.env:
        load_dotenv(a.env)
    start, end = fetch_window(a.start, a.end)
    spark = get_session("tidemark-fetch")
    now = datetime.now(timezone.utc)
    observations, status = fetch_all(spark, [k for k in a.sources.split(",") if k], start, end, landing=f"{a.out}/landing_{now:%Y%m%d%H%M%S}")
    return snapshot(spark, observations, status, f"{a.out}/fresh_{now:%Y%m%d}", (str(start), str(end)), str(CUTOFF), now.isoformat())


if __name__ == "__main__":
    main()
