"""A bounded memory of computed values in a Python worker."""

from __future__ import annotations

#: Keys in each of two generations, and the longest key that is kept.
SIZE, LENGTH = 500_000, 64


class Remembered(dict):
    """Values by key, made on demand. Of two generations the older one is given up when the younger is
    full, so that frequent keys stay; long keys are made each time."""

    def __init__(self, make, size: int = SIZE, length: int = LENGTH) -> None:
        super().__init__()
        self.make, self.size, self.length, self.older = make, size, length, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.length:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value
