"""When batches are asked and views are updated."""

from __future__ import annotations

from dataclasses import dataclass

#: Words for schedules that ask every k-th batch. Fixed values.
EVERY = {"every-2nd": 2, "every-4th": 4, "every-8th": 8}


def queried_batches(value: str | list[int] | None, batches: int) -> list[int]:
    """Batches (from 1 on) after which the query is asked: all, last, none, every-2nd, every-4th, every-8th or a list; periodic ones include the last."""
    if batches < 1:
        raise ValueError("there must be a batch")
    if value is None or value == "all":
        return list(range(1, batches + 1))
    if value == "none":
        return []
    if value == "last":
        return [batches]
    if isinstance(value, str) and value in EVERY:
        return sorted({*range(EVERY[value], batches + 1, EVERY[value]), batches})
    listed = [int(x) for x in value.split(",")] if isinstance(value, str) else list(value)
    if any(not 1 <= b <= batches for b in listed):
        raise ValueError(f"batches are 1 to {batches}")
    return sorted(set(listed))


@dataclass(frozen=True)
class Firing:
    """When an operator runs: always, never, every k batches from ``offset`` on, at given ones, or where a size exceeds ``rows``: that of ``view``, or of the events not taken in."""

    kind: str = "always"
    k: int = 1
    offset: int = 0
    batches: tuple[int, ...] = ()
    rows: int = 0
    view: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("always", "never", "every_k", "at_batches", "when_size_exceeds"):
            raise ValueError(f"no such firing: {self.kind}")
        if self.k < 1 or self.rows < 0 or any(b < 0 for b in self.batches):
            raise ValueError("periods are positive; sizes and batches are not negative")

    def fires(self, batch: int, rows: int = 0) -> bool:
        if self.kind == "every_k":
            return batch >= self.offset and (batch - self.offset) % self.k == 0
        return {"always": True, "never": False, "at_batches": batch in self.batches, "when_size_exceeds": rows > self.rows}[self.kind]
