"""Jobs that run by themselves: ``python -m jobs.NAME --config FILE ...``.

Each does its work in ``run``, which takes a session; only the command line
creates and stops one.
"""

from __future__ import annotations

import logging
from pathlib import Path
from typing import Any

from groundwork.settings import BASE, Settings, from_dict, merged

log = logging.getLogger("jobs")


def read_config(path: str | Path) -> dict[str, Any]:
    import yaml

    return yaml.safe_load(Path(path).read_text())


def pipeline(config: dict[str, Any], *more: dict[str, Any]) -> Settings:
    """Settings of the library from a job's ``pipeline`` and what is laid over it."""
    own = merged(BASE, config.get("pipeline") or {})
    for over in more:
        own = merged(own, over)
    return from_dict(own)


def session(name: str):
    from pyspark.sql import SparkSession

    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
