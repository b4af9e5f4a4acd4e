"""Named components: parsers, renderers, providers. Names are unique; a miss says what there is."""

from __future__ import annotations

from collections.abc import Callable
from typing import Generic, TypeVar

T = TypeVar("T")


class UnknownName(LookupError):
    def __init__(self, kind: str, code: str, name: str, known: list[str]):
        self.code, self.name, self.known = code, name, known
        super().__init__(f"no {kind} is called {name!r}; known: {', '.join(known)}")


class Registry(Generic[T]):
    def __init__(self, kind: str, code: str):
        self.kind, self.code, self._items = kind, code, {}

    def add(self, name: str, item: T) -> None:
        if name in self._items:
            raise ValueError(f"{self.kind} {name!r} is registered already")
        self._items[name] = item

    def register(self, name: str, *aliases: str) -> Callable[[T], T]:
        def keep(item: T) -> T:
            for n in (name, *aliases):
                self.add(n, item)
            return item

        return keep

    def get(self, name: str) -> T:
        if name not in self._items:
            raise UnknownName(self.kind, self.code, name, self.names())
        return self._items[name]

    def names(self) -> list[str]:
        return list(self._items)

    def __contains__(self, name: object) -> bool:
        return name in self._items


def default_parsers() -> Registry:
    """format name -> payloads DataFrame -> cues DataFrame."""
    from lectern.operators import parse

    out: Registry = Registry("caption format", "UNKNOWN_CAPTION_FORMAT")
    out.register("json3")(parse.parse_json3)
    out.register("vtt", "webvtt")(parse.parse_vtt)
    out.register("srt", "subrip")(parse.parse_srt)
    return out


def default_renderers() -> Registry:
    from lectern.plans import render

    out: Registry = Registry("renderer", "UNKNOWN_RENDERER")
    out.register("markdown", "md")(render.markdown)
    out.register("plain", "text")(lambda lectures, sections, passages, corrections=None: render.plain(passages))
    out.register("citation", "cite")(lambda lectures, sections=None, passages=None, corrections=None: render.citation(lectures))
    out.register("jsonl")(lambda lectures, sections, passages, corrections=None: render.jsonl(lectures, sections, passages))
    out.register("context")(lambda lectures, sections, passages, corrections=None, budget=render.BUDGET: render.context(lectures, sections, passages, budget))
    return out


def provider_for(source: str, providers: dict):
    """The first of the ordered providers (name -> handles(source)) that knows the source."""
    for name, handles in providers.items():
        if handles(source):
            return name
    raise UnknownName("provider", "UNKNOWN_PROVIDER", source, list(providers))
