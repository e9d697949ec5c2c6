"""Small literal tables that a query and its SQL share: for inputs that the driver's tables do not have."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Fixture:
    """Rows with Spark types by column name: `a long, b string`. Arrays of strings and scalars."""

    schema: str
    rows: tuple[tuple, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in r) for r in self.rows], self.schema)

    @property
    def sql(self) -> str:
        """The same table for a FROM clause."""
        names = [c.split()[0] for c in self.schema.split(", ")]
        kinds = [_KINDS[c.split()[1]] for c in self.schema.split(", ")]
        rows = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in self.rows)
        casts = ", ".join(f"{n}::{k} AS {n}" for n, k in zip(names, kinds, strict=True))
        return f"(SELECT {casts} FROM (VALUES {rows}) f({', '.join(names)}))"


_KINDS = {
    "long": "BIGINT", "int": "INT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]",
    "array<int>": "INT[]", "array<long>": "BIGINT[]"
}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return "[" + ", ".join(map(_literal, v)) + "]" if isinstance(v, tuple) else repr(v)
