"""JSON as strictly as a JSON parser reads it.

Spark's own parsers accept single quotes and trailing garbage, so model responses and fact files go
through Arrow batches of ``json.loads``; fields of clean JSON stay in the JVM.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

_FACTS = ArrayType(
    StructType(
        [
            StructField("is_object", BooleanType()),
            StructField("has_source", BooleanType()),
            StructField("source", StringType()),
            StructField("truthy", BooleanType()),
            StructField("fact", StringType()),
        ]
    )
)


def _list(text: str | None) -> list | None:
    try:
        value = json.loads(text) if text is not None else None
    except ValueError:
        return None
    return value if isinstance(value, list) else None


def _shown(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _fact(item: object) -> dict:
    known = item if isinstance(item, dict) else {}
    return {
        "is_object": isinstance(item, dict),
        "has_source": "source" in known,
        "source": _shown(known.get("source")),
        "truthy": bool(known.get("fact")),
        "fact": _shown(known.get("fact")),
    }


def _each(one, read):
    def run(batch: pd.Series) -> pd.Series:
        lists = [read(x) for x in batch]
        return pd.Series([None if x is None else [one(y) for y in x] for x in lists], dtype=object)

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return run


def parse_list(text: Column) -> Column:
    """The elements of a JSON list as strings (other kinds as JSON text); null for bad JSON and for anything but a list."""
    return F.pandas_udf(_each(_shown, _list), ArrayType(StringType()))(text)


def parse_facts(text: Column) -> Column:
    """The items of a fact file in order; null if it is no JSON list.  ``truthy`` is false for null, "", 0, false, [] and {}."""
    return F.pandas_udf(_each(_fact, _list), _FACTS)(text)


def field(text: Column, name: str, default: str) -> Column:
    """A top-level field of clean JSON objects as a string; the default where it is absent, null where it is an explicit null."""
    present = F.array_contains(F.json_object_keys(text), name)
    return F.when(present, F.get_json_object(text, f"$.{name}")).otherwise(F.lit(default))
