"""Windows of one key as a fold over its rows in arrival order.

Used where sets cannot say it: sessions with late rows, and exact streams. All
times are microseconds."""

from __future__ import annotations

from collections.abc import Iterator

from .aggregates import Aggregate
from .windows import Assigner, Session, merges

Window = tuple[int, int]
_NEVER = 2**63


class PaneFold:
    """cells: window -> [state, fired, firing number]."""

    def __init__(self, assigner: Assigner, aggregate: Aggregate, lateness_us: int = 0, cells: dict[Window, list] | None = None):
        self.assigner, self.aggregate, self.lateness = assigner, aggregate, max(0, lateness_us)
        self.cells: dict[Window, list] = cells or {}
        self._due = self._next()

    def due(self) -> int | None:
        """When the clock next changes something: a window fires, or goes."""
        self._due = self._next()
        return None if self._due == _NEVER else self._due

    def _next(self) -> int:
        return min((w[1] + self.lateness if c[1] else w[1] for w, c in self.cells.items()), default=_NEVER)

    def advance(self, clock: int | None) -> Iterator[tuple]:
        """Fire windows whose end the clock has reached, then drop those whose
        lateness it has passed. Yields ("fire", start, end, state, firing). What
        is due next is remembered, so most rows look at no window here."""
        if clock is None or clock < self._due:
            return
        for w in sorted(w for w, cell in self.cells.items() if w[1] <= clock and not cell[1]):
            cell = self.cells[w]
            cell[1] = True
            yield ("fire", *w, cell[0], cell[2])
            cell[2] += 1
        for w in [w for w in self.cells if w[1] + self.lateness <= clock]:
            del self.cells[w]
        self._due = self._next()

    def add(self, ts: int, value, clock: int | None) -> Iterator[tuple]:
        """One row. Yields fires as advance does, and ("late", start, end, None,
        None) for each window that is too late for it."""
        yield from self.advance(clock)
        for w in self.assigner.panes(ts):
            if isinstance(self.assigner, Session):
                merged = self._merged(w)
                if clock is not None and merged[1] <= clock and clock >= merged[1] + self.lateness:
                    yield ("late", *merged, None, None)
                    continue
                if merged not in self.cells:
                    state = None
                    for old in [x for x in self.cells if merges(merged, x)]:
                        state = self.aggregate.merge(state, self.cells.pop(old)[0])
                    self.cells[merged] = [state, False, 0]
                w = merged
            if clock is not None and w[1] <= clock:
                if clock >= w[1] + self.lateness:
                    yield ("late", *w, None, None)
                    continue
                cell = self.cells.setdefault(w, [None, False, 1])
                self._due = min(self._due, w[1] + self.lateness)
                cell[0] = self.aggregate.add(cell[0], value)
                cell[1] = True
                cell[2] = max(cell[2], 1)
                yield ("fire", *w, cell[0], cell[2])
                cell[2] += 1
                continue
            cell = self.cells.setdefault(w, [None, False, 0])
            self._due = min(self._due, w[1])
            cell[0] = self.aggregate.add(cell[0], value)

    def _merged(self, w: Window) -> Window:
        grown = True
        while grown:
            grown = False
            for x in self.cells:
                if merges(w, x) and (x[0] < w[0] or x[1] > w[1]):
                    w, grown = (min(w[0], x[0]), max(w[1], x[1])), True
        return w
