"""Typed options of the tools: bounds, checks, and limits from the environment."""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass


@dataclass(frozen=True)
class Whole:
    """A whole number from low to high."""

    default: int
    low: int
    high: int

    def checked(self, name: str, value: object) -> int:
        if type(value) is not int or not self.low <= value <= self.high:
            raise ValueError(f"{name} is a whole number from {self.low} to {self.high}")
        return value

    def from_env(self, name: str) -> int:
        """The number that an environment variable sets; a bad one warns and leaves the default."""
        said = os.environ.get(name, "").strip()
        if not said:
            return self.default
        if said.isascii() and said.isdigit() and self.low <= int(said) <= self.high:
            return int(said)
        warnings.warn(f"{name} is not a whole number from {self.low} to {self.high}; {self.default} is used", stacklevel=2)
        return self.default


@dataclass(frozen=True)
class OneOf:
    values: tuple[str, ...]

    def checked(self, name: str, value: object) -> str:
        if value not in self.values:
            raise ValueError(f"{name} is one of {', '.join(self.values)}")
        return value


def checked(options: dict[str, Whole | OneOf], given: dict[str, object]) -> dict[str, object]:
    """given, after every option's own check."""
    return {name: options[name].checked(name, value) if name in options else value for name, value in given.items()}
