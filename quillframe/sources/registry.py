"""Which parser reads which file extension."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

# What is said of a file that no parser takes.
UNSUPPORTED = "Unsupported file extension '"
SUPPORTED = "'. Supported: "


@dataclass(frozen=True)
class Parser:
    """How one kind of document is read.

    ``blocks`` turns (document_id, content) rows into block rows, as column
    expressions or with ``mapInPandas``. ``metadata`` gives a map of facts per
    document. ``failure``, if given, is the reason a text cannot be parsed, or
    null. For files that are not text, ``read_pages`` turns their bytes into
    page texts; ``metadata`` then takes the array of pages.
    """

    name: str
    blocks: Callable[[DataFrame], DataFrame]
    metadata: Callable[[Column], Column]
    failure: Callable[[Column], Column] | None = None
    read_pages: Callable[[bytes], list[str]] | None = None


class ParserRegistry:
    def __init__(self) -> None:
        self._by_extension: dict[str, Parser] = {}

    def register(self, extensions: Iterable[str], parser: Parser) -> None:
        """Later registrations replace earlier ones for the same extension."""
        for ext in extensions:
            ext = ext.lower()
            self._by_extension[ext if ext.startswith(".") else f".{ext}"] = parser

    def get(self, ext: str) -> Parser:
        try:
            return self._by_extension[ext.lower()]
        except KeyError:
            raise ValueError(self.unsupported(ext)) from None

    def unsupported(self, ext: str) -> str:
        return f"{UNSUPPORTED}{ext}{SUPPORTED}{', '.join(self.extensions())}"

    def extensions(self) -> list[str]:
        return sorted(self._by_extension)

    def by_parser(self) -> dict[Parser, list[str]]:
        groups: dict[Parser, list[str]] = {}
        for ext in self.extensions():
            groups.setdefault(self._by_extension[ext], []).append(ext)
        return groups
