"""Sources by name: a source says which tables it needs and how its records come out of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from garner.sources.tables import MissingColumns, table

RECORD = ("source", "key", "at", "who", "title", "text")


@dataclass(frozen=True)
class Source:
    """``needs``: columns by table; ``read``: from a session and a folder to rows with the columns ``RECORD``."""

    name: str
    needs: dict[str, tuple[str, ...]]
    read: Callable[[SparkSession, str], DataFrame]


class Registry:
    """Sources in the order in which they were added."""

    def __init__(self) -> None:
        self._held: dict[str, Source] = {}

    def add(self, source: Source) -> None:
        """Take a source in; a name is given once and has the form of links."""
        if not source.name.replace("_", "").isalnum() or source.name != source.name.lower() or not source.name[0].isalpha():
            raise ValueError(f"no name for a source: {source.name!r}")
        if source.name in self._held:
            raise ValueError(f"the source {source.name} is there already")
        self._held[source.name] = source

    def names(self) -> list[str]:
        """Names of all sources."""
        return list(self._held)

    def records(self, name: str, spark: SparkSession, folder: str) -> DataFrame:
        """Records of one source; a result without one of ``RECORD`` is refused."""
        if name not in self._held:
            raise LookupError(f"no source {name!r}")
        rows = self._held[name].read(spark, folder)
        if lacking := [c for c in RECORD if c not in rows.columns]:
            raise MissingColumns(f"{name} gives no {', '.join(lacking)}")
        return rows.select(*RECORD)

    def usable(self, spark: SparkSession, folder: str) -> dict[str, str]:
        """What each source lacks in a folder, '' for those that can be read."""
        out = {}
        for name, source in self._held.items():
            try:
                for t, columns in source.needs.items():
                    table(spark, folder, t, *columns)
                out[name] = ""
            except Exception as fault:  # noqa: BLE001 - a missing file has many forms
                out[name] = str(fault).splitlines()[0]
        return out
