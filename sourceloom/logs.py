"""Logging under the root `sourceloom`."""

import logging
import sys

from sourceloom.config import LoggingConfig


def get_logger(name: str) -> logging.Logger:
    return logging.getLogger(f"sourceloom.{name}")


def configure_logging(config: LoggingConfig) -> None:
    """Messages go to stderr, and to a file if one is named; repeated calls replace the handlers."""
    root = logging.getLogger("sourceloom")
    root.setLevel(config.level.upper())
    handlers = [logging.StreamHandler(sys.stderr)]
    if config.file:
        handlers.append(logging.FileHandler(config.file))
    for handler in handlers:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    root.handlers, root.propagate = handlers, False
