"""Open tables: the frames of the files read last, with their listing, so that a file is opened once for many reads."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame


class TableCache:
    """The `capacity` tables used last, by path."""

    def __init__(self, capacity: int, opened: Callable[[str], DataFrame]) -> None:
        self.capacity, self.opened, self.held = capacity, opened, OrderedDict()

    def get(self, path: str) -> DataFrame:
        if path not in self.held:
            self.held[path] = self.opened(path)
        self.held.move_to_end(path)
        while len(self.held) > self.capacity:
            self.held.popitem(last=False)
        return self.held[path]

    def evict(self, path: str) -> None:
        self.held.pop(path, None)
