"""Find the schema of JSON text, keep it as a file, load it again."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType


def discover_schema(df: DataFrame, column: str = "json", sample: float | None = None) -> StructType:
    """Infer the schema of a column of JSON text in one distributed pass, or over a ``sample`` fraction of the rows. Rows
    are merged where they are read and only the schema reaches the driver. Where types conflict, or only null was seen,
    the field is a string; text that is no JSON says nothing."""
    rows = df.select(F.try_parse_json(F.col(column).cast("string")).alias("v")).filter("v is not null")
    if sample is not None:
        rows = rows.sample(sample, seed=0)
    found = rows.agg(F.schema_of_variant_agg("v")).first()[0]
    return _fields(_Reader(found).kind()) if found else StructType([])


def _fields(kind: DataType) -> StructType:
    return kind if isinstance(kind, StructType) else StructType([])


class _Reader:
    """Reads what ``schema_of_variant`` prints: ``OBJECT<name: KIND, ...>``, ``ARRAY<KIND>`` and names of simple kinds."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def kind(self) -> DataType:
        if self._next("OBJECT<"):
            fields = []
            while not self._next(">"):
                name = self._name()
                fields.append(StructField(name, self.kind()))
                self._next(", ")
            # An object that was always empty says nothing.
            told = [f for f in fields if not (isinstance(f.dataType, StructType) and not f.dataType.fields)]
            return StructType(sorted(told, key=lambda f: f.name))
        if self._next("ARRAY<"):
            inner = self.kind()
            self._next(">")
            return ArrayType(inner)
        word = re.compile(r"[A-Z_]+(\(\d+,\s*\d+\))?").match(self.text, self.at)
        self.at = word.end()
        name = word.group().split("(")[0]
        return {"BIGINT": LongType(), "DOUBLE": DoubleType(), "DECIMAL": DoubleType(), "BOOLEAN": BooleanType()}.get(name, StringType())

    def _next(self, part: str) -> bool:
        found = self.text.startswith(part, self.at)
        self.at += len(part) * found
        return found

    def _name(self) -> str:
        if self._next("`"):
            end = re.compile(r"(?:[^`]|``)*").match(self.text, self.at).end()
            name, self.at = self.text[self.at : end].replace("``", "`"), end + 1
        else:
            end = self.text.index(":", self.at)
            name, self.at = self.text[self.at : end], end
        self._next(": ")
        return name


def save_schema(schema: StructType, path: str) -> None:
    """Sorted, indented JSON."""
    with open(path, "w", encoding="utf-8") as out:
        json.dump(json.loads(schema.json()), out, indent=4, sort_keys=True)


def load_schema(path: str) -> StructType:
    with open(path, encoding="utf-8") as text:
        return StructType.fromJson(json.load(text))
