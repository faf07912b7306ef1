"""Experiments by name, with a life cycle."""

from __future__ import annotations

import logging
from collections.abc import Callable

_LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warning": logging.WARNING, "error": logging.ERROR, "critical": logging.CRITICAL}


def log(message: str, level: str = "info") -> None:
    """Log with the time; an unknown level warns and counts as info."""
    logger = logging.getLogger("focalis")
    if level.lower() not in _LEVELS:
        logger.warning("unknown level %s", level)
    logger.log(_LEVELS.get(level.lower(), logging.INFO), message)


class Experiment:
    """Subclasses give ``run``; ``setup`` and ``teardown`` may do nothing."""

    def setup(self) -> None:
        pass

    def run(self):
        raise NotImplementedError

    def teardown(self) -> None:
        pass

    def __call__(self):
        self.setup()
        try:
            return self.run()
        finally:
            self.teardown()


class Registry:
    def __init__(self) -> None:
        self._known: dict[str, Callable] = {}

    def register(self, name: str, made: Callable) -> None:
        self._known[name] = made

    def get(self, name: str) -> Callable:
        if name not in self._known:
            raise ValueError(f"no experiment is named {name}")
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)
