"""Lending-collection analytics and maintenance as Spark DataFrames."""

from lectern.sources.collection import Collection

__all__ = ["Collection"]
