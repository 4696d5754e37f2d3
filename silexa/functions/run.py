"""Small helpers of batch programs: unique names, output paths, timing."""
from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger("silexa")


def unique_name(prefix: str = "") -> str:
    """A name that no other run has."""
    return prefix + uuid.uuid4().hex


def row_uuid() -> Column:
    """A random UUID for each row."""
    return F.uuid()


def evaluation_paths(base: str, kinds: tuple[str, ...] = ("summary", "roc", "pr", "confusion", "equal-frequency", "equal-width")) -> dict[str, str]:
    """Where the parts of an evaluation are written: a folder of each kind below `base`."""
    return {k: f"{base.rstrip('/')}/evaluation/{k}" for k in kinds}


@contextmanager
def timed(what: str) -> Iterator[dict]:
    """Logs how long a step took; the dictionary holds `seconds` afterwards."""
    out: dict = {}
    began = time.perf_counter()
    try:
        yield out
    finally:
        out["seconds"] = time.perf_counter() - began
        log.info("%s: %.1f s", what, out["seconds"])
