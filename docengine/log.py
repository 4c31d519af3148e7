"""Logging: one logger for the package, silent unless it is configured."""

from __future__ import annotations

import logging
import sys
from typing import TextIO

LOGGER = logging.getLogger("docengine")
LOGGER.addHandler(logging.NullHandler())


def configure(level: str | int = "INFO", stream: TextIO | None = None, form: str = "%(asctime)s %(levelname)s %(name)s %(message)s") -> logging.Logger:
    """Write messages of this level and above to a stream; a second call replaces the first one's handler."""
    for old in [h for h in LOGGER.handlers if not isinstance(h, logging.NullHandler)]:
        LOGGER.removeHandler(old)
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(logging.Formatter(form))
    LOGGER.addHandler(handler)
    LOGGER.setLevel(level)
    return LOGGER
