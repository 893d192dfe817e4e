"""Library-wide settings, validated when they are set."""

from __future__ import annotations

import logging

LEVELS = ("error", "warning", "info", "hint", "debug")


class Settings:
    """``verbosity`` (a level or its number), ``max_memory_gb`` and ``chunk_size`` of readers by blocks, and a logger."""

    def __init__(self) -> None:
        self._verbosity, self._max_memory_gb, self._chunk_size = 1, 4.0, 0

    @property
    def verbosity(self) -> int:
        return self._verbosity

    @verbosity.setter
    def verbosity(self, value: int | str) -> None:
        if isinstance(value, str):
            if value not in LEVELS:
                raise ValueError(f"verbosity has to be one of {LEVELS}")
            value = LEVELS.index(value)
        if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value < len(LEVELS):
            raise ValueError(f"verbosity has to lie between 0 and {len(LEVELS) - 1}")
        self._verbosity = value

    @property
    def max_memory_gb(self) -> float:
        return self._max_memory_gb

    @max_memory_gb.setter
    def max_memory_gb(self, value: float) -> None:
        if not value > 0:
            raise ValueError("max_memory_gb has to be positive")
        self._max_memory_gb = float(value)

    @property
    def chunk_size(self) -> int:
        return self._chunk_size

    @chunk_size.setter
    def chunk_size(self, value: int) -> None:
        if value != int(value) or value < 0:
            raise ValueError("chunk_size has to be a whole number, 0 for none")
        self._chunk_size = int(value)

    def log(self, level: str, message: str) -> None:
        if LEVELS.index(level) <= self._verbosity:
            logging.getLogger("cellmesa").log(logging.ERROR if level == "error" else logging.WARNING, "%s: %s", level, message)


settings = Settings()
