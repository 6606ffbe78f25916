"""Elapsed times of a job's steps, with the place that asked."""

from __future__ import annotations

import inspect
import time
from typing import NamedTuple


class Mark(NamedTuple):
    millis: int
    message: str
    where: str


class Stopwatch:
    """Each mark() is the time since the one before it, or since the start."""

    def __init__(self) -> None:
        self.marks: list[Mark] = []
        self.last = time.perf_counter()

    def mark(self, message: str = "") -> Mark:
        now, caller = time.perf_counter(), inspect.stack(0)[1]
        self.marks.append(Mark(round(1000 * (now - self.last)), message, f"{caller.filename}:{caller.lineno}"))
        self.last = now
        return self.marks[-1]

    def lines(self) -> list[str]:
        return [f"{m.millis} ms  {m.message}  ({m.where})" for m in self.marks]

    def show(self) -> None:
        print("\n".join(self.lines()))

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            f.writelines(f"{x}\n" for x in self.lines())
