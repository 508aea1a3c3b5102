"""The library's own log, apart from the logs that it analyzes."""

from __future__ import annotations

import logging

NAME = "quarrylog"
LEVELS = {"DEBUG": logging.DEBUG, "INFO": logging.INFO, "WARNING": logging.WARNING, "ERROR": logging.ERROR}


def setup_logging(level: str = "INFO", *, verbose: bool = False) -> logging.Logger:
    """Sends the library's messages of this level and above to standard error; ``verbose``: all. Unknown levels count as INFO.

    Called again it changes the level and adds nothing. Messages don't reach the root logger.
    """
    log = logging.getLogger(NAME)
    log.setLevel(logging.DEBUG if verbose else LEVELS.get(level.upper(), logging.INFO))
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
    log.propagate = False
    return log


def get_logger(name: str | None = None) -> logging.Logger:
    """The library's logger, or its child of that name."""
    return logging.getLogger(f"{NAME}.{name}" if name else NAME)
