"""Messages and progress of drivers and command lines."""

from __future__ import annotations

import importlib.util
import logging
import sys
from collections.abc import Iterable, Iterator
from typing import TypeVar

from . import __version__

T = TypeVar("T")


def setup(level: str = "INFO", path: str | None = None) -> logging.Logger:
    """The library's logger, writing to the error stream and, if given, to a file; called again, it replaces its own handlers."""
    log = logging.getLogger("alembiq")
    log.setLevel(level.upper())
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    for h in [logging.StreamHandler(sys.stderr), *([logging.FileHandler(path)] if path else [])]:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(h)
    return log


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"alembiq.{name}")


def progress(items: Iterable[T], what: str = "", every: int = 10) -> Iterator[T]:
    """``items``, with a message after every so many and at the end; their number is told where it is known."""
    log, total, n = logger("progress"), len(items) if hasattr(items, "__len__") else None, 0
    for n, x in enumerate(items, 1):
        yield x
        if n % every == 0 and n != total:
            log.info("%s %d%s", what, n, f" of {total}" if total else "")
    log.info("%s %d done", what, n)


def installed(*names: str) -> dict[str, bool]:
    """Which optional libraries can be imported: vina, meeko, xgboost, Bio and the like."""
    return {n: importlib.util.find_spec(n) is not None for n in names}


def version() -> str:
    return __version__
