"""A bounded memo for per-word results inside a task."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Memo(dict):
    """word -> result (never None); misses are computed many at a time. Two generations keep what is used often, and bound the memory."""

    def __init__(self, compute: Callable[[list], Iterable], limit: int = 400_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def resolve(self, found: list[list]) -> list[list]:
        """The results of every word of every list: one lookup a word, and a second for those that were not known."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        get = self.get
        out = [list(map(get, words)) for words in found]
        holes = [[i for i, v in enumerate(values) if v is None] for values in out]
        missing = {words[i] for words, at in zip(found, holes, strict=True) for i in at}
        if not missing:
            return out
        new = []
        for w in missing:
            v = self.old.get(w)
            if v is None:
                new.append(w)
            else:
                self[w] = v
        for i in range(0, len(new), 5_000):
            part = new[i : i + 5_000]
            self.update(zip(part, self.compute(part), strict=True))
        for words, values, at in zip(found, out, holes, strict=True):
            for i in at:
                values[i] = self[words[i]]
        return out
