"""Logging of the command line and the server: to standard error, at a level of one's choice."""

from __future__ import annotations

import logging
import os
import sys
from typing import TextIO

LEVEL_VARIABLE = "RAG_LOG_LEVEL"
FORMAT = "%(asctime)s | %(levelname)-8s | %(name)s | %(message)s"
#: Libraries that tell of each request or call; only their warnings are shown.
CHATTY = ("py4j", "urllib3", "httpx", "huggingface_hub", "transformers", "sentence_transformers")


def level_of(name: str | int | None) -> int:
    """A level by name or number; what is no level counts as INFO."""
    if isinstance(name, int):
        return name
    return logging.getLevelNamesMapping().get((name or "").strip().upper(), logging.INFO)


def set_up(level: str | int | None = None, stream: TextIO | None = None) -> None:
    """The given level, else that of the environment; handlers that are there are replaced."""
    chosen = level_of(os.environ.get(LEVEL_VARIABLE) if level is None else level)
    logging.basicConfig(level=chosen, stream=stream or sys.stderr, format=FORMAT, datefmt="%H:%M:%S", force=True)
    for name in CHATTY:
        logging.getLogger(name).setLevel(max(chosen, logging.WARNING))
