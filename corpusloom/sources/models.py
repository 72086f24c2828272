"""Lists of models from a service's JSON (S11), and settings with their limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def model_ids(body: Column, most: int = 600) -> Column:
    """The sorted ids of a {"data": [{"id": ...}]} reply."""
    ids = F.from_json(body, "data array<struct<id:string>>")["data"]["id"]
    return F.slice(F.array_sort(F.filter(ids, lambda x: x.isNotNull() & (x != ""))), 1, most)


@dataclass(frozen=True)
class Settings:
    """S14."""

    base_url: str = ""
    model: str = ""
    concurrency: int = 4
    length: str = "medium"

    def clamped(self) -> Settings:
        return Settings(self.base_url.strip(), self.model.strip(), min(8, max(1, int(self.concurrency))), self.length if self.length in ("short", "medium", "long") else "medium")
