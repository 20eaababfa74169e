"""Command line: ``python -m loomlog -i log.txt -g SYSLOGLINE -q 'select ...'``."""

from __future__ import annotations

import sys

from .config import ServerAddress, load, parse_input
from .functions.grok import PATTERNS


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if "--grok-list-default-patterns" in argv:
        for name, regex in sorted(PATTERNS.items()):
            print(name, regex)
        return 0
    config = load(argv)
    from pyspark.sql import SparkSession

    from .engine import run_batch, run_stream, stop_stream

    spark = SparkSession.builder.appName("loomlog").getOrCreate()
    if isinstance(parse_input(config.input), ServerAddress):
        query = run_stream(spark, config)
        try:
            query.awaitTermination()
        except KeyboardInterrupt:
            stop_stream(query)
    else:
        run_batch(spark, config)
    return 0


if __name__ == "__main__":
    sys.exit(main())
