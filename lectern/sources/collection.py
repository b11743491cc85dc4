"""The four tables that travel together through every plan and job."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame

Source = DataFrame | Callable[[], DataFrame]


class Collection:
    """Students, shelves, books and loans. A table given as a function is built on first use."""

    def __init__(self, students: Source, shelves: Source, books: Source, loans: Source):
        self._sources = {"students": students, "shelves": shelves, "books": books, "loans": loans}

    def _table(self, name: str) -> DataFrame:
        source = self._sources[name]
        return source if isinstance(source, DataFrame) else source()

    @cached_property
    def students(self) -> DataFrame:
        return self._table("students")

    @cached_property
    def shelves(self) -> DataFrame:
        return self._table("shelves")

    @cached_property
    def books(self) -> DataFrame:
        return self._table("books")

    @cached_property
    def loans(self) -> DataFrame:
        return self._table("loans")

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self._sources}

    def with_tables(self, **changed: Source) -> "Collection":
        kept = {name: (lambda n=name: getattr(self, n)) for name in self._sources}
        return Collection(**{**kept, **changed})
