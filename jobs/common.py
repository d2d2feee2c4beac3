"""What the jobs share: configuration, logging and the session of a command line."""

from __future__ import annotations

import json
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def config(name: str, path: str | None = None) -> dict:
    """A job's configuration: that beside the job, with what a given file says instead."""
    out = json.loads((Path(__file__).parent / f"{name}.json").read_text())
    return out | json.loads(Path(path).read_text()) if path else out


def session(name: str) -> SparkSession:
    """For command lines only, which also stop it."""
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def bracketed(path: str) -> str:
    """A glob that matches this path only: a file stream takes a glob for a single file as well as for a folder."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"
