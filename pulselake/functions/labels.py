"""Labels: attribute lists to maps, merging, canonical series keys, selectors."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulselake.functions.values import number_text

ENTRIES_TYPE = "array<struct<key:string,value:string>>"

# The labels that identify a span.
SPAN_IDENTITY = ["trace.id", "span.id", "parent.span.id", "span.name", "status.code", "span.kind"]


def entry(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))


def no_entries() -> Column:
    return F.array().cast(ENTRIES_TYPE)


def attribute_entries(attributes: Column, stringify: bool = False) -> Column:
    """Attribute list to label entries. Only text values are taken, other kinds give ''.

    ``stringify`` writes the other kinds as text too.
    """

    def text(a: Column) -> Column:
        value = a["value"]
        if not stringify:
            return F.coalesce(value["stringValue"], F.lit(""))
        return F.coalesce(
            value["stringValue"],
            value["intValue"],
            number_text(value["doubleValue"]),
            value["boolValue"].cast("string"),
            F.lit(""),
        )

    entries = F.transform(
        attributes,
        lambda a: F.struct(F.coalesce(a["key"], F.lit("")).alias("key"), text(a).alias("value")),
    )
    return F.coalesce(entries, no_entries())


def label_map(entries: Column) -> Column:
    """Map of an entry list; of equal keys the last one wins.

    Give a plain column: the list is read several times. No session setting for duplicate map keys is
    needed, and lists without duplicates take the short way.
    """
    keys = entries["key"]
    last_only = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["key"] == e["key"]),
    )
    return F.when(
        F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_entries(entries)
    ).otherwise(F.map_from_entries(last_only))


def no_labels() -> Column:
    return F.create_map().cast("map<string,string>")


def merge_labels(left: Column, right: Column) -> Column:
    """Union of two label maps; the right side wins. Maps without a common key are simply put together."""
    return F.when(
        F.arrays_overlap(F.map_keys(left), F.map_keys(right)),
        F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right),
    ).otherwise(F.map_concat(left, right))


def drop_labels(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, _: ~k.isin(*names))


def span_labels(labels: Column) -> Column:
    """Labels of a span without its identity; ``service.name`` stays."""
    return drop_labels(labels, SPAN_IDENTITY)


def decode_labels(text: Column) -> Column:
    """Label map from its JSON text."""
    return F.from_json(text, "map<string,string>")


def series_key(labels: Column) -> Column:
    """Canonical text of a label set: JSON with sorted keys, equal for equal sets."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def series_labels(key: Column) -> Column:
    """The label set a ``series_key`` stands for."""
    return decode_labels(key)


def selector_pairs(text: str) -> list[tuple[str, str]]:
    """``"a=1, b=2"`` as pairs, repeated keys included; parts without '=' are ignored."""
    pairs = (part.split("=", 1) for part in text.split(",") if "=" in part)
    return [(key.strip(), value.strip()) for key, value in pairs]


def selector(text: str) -> dict[str, str]:
    """``"a=1, b=2"`` as a dict; of a repeated key the last value."""
    return dict(selector_pairs(text))


def label_match(
    wanted: dict[str, str] | str,
    labels: str = "labels",
    promoted: dict[str, str] | None = None,
) -> Column:
    """All wanted labels are present with exactly these values.

    ``promoted`` names the plain columns that carry a label; only those reach the parquet reader.
    """
    pairs = selector_pairs(wanted) if isinstance(wanted, str) else list(wanted.items())
    promoted = promoted or {}
    tests = [
        (F.col(promoted[k]) if k in promoted else F.col(labels)[k]) == F.lit(v) for k, v in pairs
    ]
    return reduce(and_, tests, F.lit(True))


def label_match_map(wanted: Column, labels: Column) -> Column:
    """As ``label_match`` with the selector held in a map column."""
    return F.forall(F.map_entries(wanted), lambda e: labels[e["key"]].eqNullSafe(e["value"]))


def label_match_text(text: Column, labels: Column) -> Column:
    """As ``label_match`` with the selector held in a text column, such as ``a=1, b=2``."""
    parts = F.filter(F.split(text, ","), lambda p: F.instr(p, "=") > 0)
    return F.forall(
        parts,
        lambda p: labels[F.trim(F.substring_index(p, "=", 1))].eqNullSafe(
            F.trim(F.substr(p, F.instr(p, "=") + 1))
        ),
    )


def label_rlike(name: str, pattern: str, labels: str = "labels", promoted: dict[str, str] | None = None) -> Column:
    """A label matches the whole pattern (anchored at both ends)."""
    col = F.col(promoted[name]) if promoted and name in promoted else F.col(labels)[name]
    return col.rlike(f"^(?:{pattern})\\z")


def label_contains(name: str, text: str, labels: str = "labels", promoted: dict[str, str] | None = None) -> Column:
    """A label contains the text (case counts)."""
    col = F.col(promoted[name]) if promoted and name in promoted else F.col(labels)[name]
    return F.contains(col, F.lit(text))
