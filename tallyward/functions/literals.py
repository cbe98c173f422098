"""Small configuration as literal columns.

Configuration objects are held by the caller, so their size is known before
the job starts; as literals they need neither a join nor a broadcast.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_array(values: Iterable[str]) -> Column:
    items = [F.lit(v) for v in values]
    return F.array(*items).cast("array<string>") if items else F.array().cast("array<string>")


def text_map(pairs: Mapping[str, str | None]) -> Column:
    entries = [c for k, v in pairs.items() for c in (F.lit(k), F.lit(v).cast("string"))]
    return F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")


def list_map(pairs: Mapping[str, Iterable[str]]) -> Column:
    entries = [c for k, v in pairs.items() for c in (F.lit(k), text_array(v))]
    return F.create_map(*entries) if entries else F.create_map().cast("map<string,array<string>>")


def lookup(pairs: Column, key: Column) -> Column:
    """Value for ``key`` or null."""
    return F.try_element_at(pairs, key)


def places(names: Iterable[str]) -> Callable[[Column], Column]:
    """A function of a key column: the positions of ``names`` equal to it, found by hash, however many names there are."""
    names = list(names)
    buckets: list[list[dict]] = [[] for _ in range(max(1, len(names)))]
    for at, name in enumerate(names):
        buckets[zlib.crc32(name.encode()) % len(buckets)].append({"n": name, "at": at})
    table = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<n:string,at:int>>>")
    none = F.array().cast("array<int>")

    def find(key: Column) -> Column:
        bucket = F.get(table, (F.crc32(key.cast("binary")) % len(buckets)).cast("int"))
        same = F.filter(bucket, lambda e: e["n"] == key)
        return F.coalesce(F.transform(same, lambda e: e["at"]), none)

    return find


def places_of_any(names: Iterable[str], keys: Column) -> Column:
    """The positions of ``names`` that are among ``keys``, ascending; none if there are no keys."""
    find = places(names)
    found = F.sort_array(F.array_distinct(F.flatten(F.transform(keys, find))))
    return F.coalesce(found, F.array().cast("array<int>"))
