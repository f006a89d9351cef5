"""Named strategies: the extension points of the engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator


class Registry:
    """Strategies by name. Names are stripped; blank, unknown and (without `replace`) repeated ones are
    refused."""

    def __init__(self, kind: str, **built_in: Callable):
        self.kind, self._by_name = kind, dict(built_in)

    def register(self, name: str, strategy: Callable, replace: bool = False) -> None:
        name = name.strip()
        if not name:
            raise ValueError(f"a {self.kind} needs a name")
        if name in self._by_name and not replace:
            raise ValueError(f"there is a {self.kind} {name!r} already")
        self._by_name[name] = strategy

    def __getitem__(self, name: str) -> Callable:
        try:
            return self._by_name[name.strip()]
        except KeyError:
            raise KeyError(f"no {self.kind} {name!r}; there are {', '.join(sorted(self._by_name))}") from None

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._by_name))

    def __contains__(self, name: str) -> bool:
        return name in self._by_name
