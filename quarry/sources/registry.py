"""Named plug-ins: readers and layouts register under a name."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Names to things of one kind; a name is taken once, and an unknown one is told along with those there are."""

    def __init__(self, kind: str):
        self.kind, self._of = kind, {}

    def register(self, name: str, thing=None) -> Callable:
        """Directly, or as a decorator."""
        if thing is None:
            return lambda x: self.register(name, x)
        if name in self._of:
            raise ValueError(f"{self.kind} {name!r} is registered already")
        self._of[name] = thing
        return thing

    def get(self, name: str):
        if name not in self._of:
            raise KeyError(f"no {self.kind} {name!r}; there are {', '.join(sorted(self._of)) or 'none'}")
        return self._of[name]

    def names(self) -> list[str]:
        return sorted(self._of)


readers, layouts = Registry("reader"), Registry("layout")
