"""Time budgets of single documents (T07): a step's budget never outlasts the one that it is part of."""

from __future__ import annotations

import time
from collections.abc import Callable

#: Seconds for a document, and how many ticks go by between looks at the clock; fixed values.
DOCUMENT_SECONDS, TICKS = 300.0, 4096


class DeadlineError(RuntimeError):
    """Which step ran out of time."""


class Deadline:
    """A budget in seconds from now. tick() is cheap: it looks at the clock every TICKS calls, and at the first."""

    def __init__(self, name: str, seconds: float = DOCUMENT_SECONDS, parent: Deadline | None = None, clock: Callable[[], float] = time.monotonic):
        self.name, self.clock, self.ticks = name, parent.clock if parent else clock, 0
        own = self.clock() + seconds
        self.ends, self.named = (parent.ends, parent.named) if parent and parent.ends < own else (own, name)

    def child(self, name: str, seconds: float) -> Deadline:
        return Deadline(name, seconds, self)

    def left(self) -> float:
        return max(0.0, self.ends - self.clock())

    def tick(self) -> bool:
        self.ticks += 1
        if self.ticks % TICKS == 1 and self.clock() >= self.ends:
            raise DeadlineError(self.named)
        return True
