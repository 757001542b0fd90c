"""python -m rigvane: the engine's path on Parquet tables, or the rate report of a message table."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from .operators.streams import rate_report
from .plans.engine import Engine
from .sources.frames import arguments, config, load_config


def plan(spark: SparkSession, argv: list[str]) -> tuple[DataFrame, str | None]:
    """What the arguments ask for, and where it goes (nowhere: it is shown)."""
    a = arguments(argv)
    settings = load_config(a.config, a.execution_mode) if a.config else config(None, a.execution_mode)
    read = lambda path, name: spark.read.parquet(path) if path else sys.exit(f"--{name} is missing")
    if a.camera_only:
        m = read(a.messages, "messages")
        return rate_report(m, ["rig", "camera", "stream"], "wall_ns", "stamp_ns", ["wall_ns", "stamp_ns"], int(a.window_seconds * 1e9), 1e9), a.out
    out = Engine(settings).run(read(a.logits, "logits"), read(a.depth, "depth"), read(a.views, "views"), a.width, a.height)
    return out, a.out


def main(argv: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("rigvane").getOrCreate()
    df, out = plan(spark, sys.argv[1:] if argv is None else argv)
    df.write.mode("overwrite").parquet(out) if out else df.show(50, truncate=False)


if __name__ == "__main__":
    main()
