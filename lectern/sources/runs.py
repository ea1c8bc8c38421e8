"""A page as runs of text, each with the elements it stands in; readers are folds over the runs."""

from __future__ import annotations

from html.parser import HTMLParser
from typing import NamedTuple

#: Elements that hold nothing.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Element(NamedTuple):
    tag: str
    classes: str
    serial: int


class Run(NamedTuple):
    #: 'text', 'void' (``text`` is an image's alternative) or 'end' (of the innermost element of ``path``)
    kind: str
    text: str
    tag: str
    path: tuple[Element, ...]

    def inside(self, tags: set[str], classes: tuple[str, ...] = ()) -> bool:
        return any(e.tag in tags or any(c in e.classes for c in classes) for e in self.path)


class _Recorder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.runs: list[Run] = []
        self.path: tuple[Element, ...] = ()
        self.serial = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        given = dict(attrs)
        if tag in VOID:
            self.runs.append(Run("void", given.get("alt") or "", tag, self.path))
            return
        self.serial += 1
        self.path += (Element(tag, given.get("class") or "", self.serial),)

    def handle_endtag(self, tag: str) -> None:
        at = max((k for k, e in enumerate(self.path) if e.tag == tag), default=None)
        if at is not None:
            self.runs.append(Run("end", "", tag, self.path[: at + 1]))
            self.path = self.path[:at]
        elif tag not in VOID:
            self.runs.append(Run("end", "", tag, self.path))

    def handle_data(self, data: str) -> None:
        self.runs.append(Run("text", data, "", self.path))


def runs(source: str) -> list[Run]:
    """All runs of a page in order; elements that are never closed reach to the end of what holds them."""
    recorder = _Recorder()
    recorder.feed(source)
    recorder.close()
    return recorder.runs
