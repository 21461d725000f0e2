"""Adapters that users write: a class that makes records of a document's cells, run as a table function over all documents.

An adapter declares the fields of its records and yields them as dicts; it sees one document at a time, its cells in
the order of rows and columns. A record with a field that is not declared, or without a required one, and an adapter
that raises, are violations; a document with one has no records.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

RESULT = "doc string, locator string, fields map<string,string>, violation string"


class Adapter:
    """What a user's adapter has: its fields, which of them are required, and `records`."""

    fields: tuple[str, ...] = ()
    required: tuple[str, ...] = ()

    def records(self, cells: list[tuple[str, int, str, str]]) -> Iterator[tuple[str, dict[str, str]]]:
        """(locator, values) of the records in a document's cells (sheet, row, col, value)."""
        raise NotImplementedError


def register(spark: SparkSession, name: str, adapter: type[Adapter]) -> None:
    """Makes an adapter a table function of this name. One that declares no field, or requires what it does not declare, is refused."""
    if not adapter.fields or set(adapter.required) - set(adapter.fields):
        raise ValueError(f"the declaration of adapter {name}")

    class Extract:
        def __init__(self):
            self.doc, self.cells = None, []

        def eval(self, row):
            self.doc = row["doc"]
            self.cells.append((row["sheet"], row["row"], row["col"], row["value"]))

        def terminate(self):
            if self.doc is None:
                return
            out, wrong = [], []
            try:
                for locator, values in adapter().records(self.cells):
                    out.append((self.doc, locator, {k: v for k, v in values.items() if v is not None}, None))
                    wrong += [(locator, f"undeclared:{f}") for f in values if f not in adapter.fields] + [(locator, f"missing:{f}") for f in adapter.required if not values.get(f)]
            except Exception as e:  # a user's code may fail in any way; its document says so
                wrong = [(None, f"{type(e).__name__}: {e}")]
            yield from ((self.doc, locator, None, why) for locator, why in wrong) if wrong else out

    spark.udtf.register(name, udtf(Extract, returnType=RESULT))


def extract(cells: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Records (doc, locator, fields) of cells (doc, sheet, row, col, value) by a registered adapter, and violations (doc, locator, violation)."""
    spark = cells.sparkSession
    rows = spark.sql(f"SELECT * FROM {name}(TABLE(SELECT doc, sheet, row, col, value FROM {{cells}}) PARTITION BY doc ORDER BY (sheet, row, col))", cells=cells)
    return rows.where("violation is null").drop("violation"), rows.where(F.col("violation").isNotNull()).select("doc", "locator", "violation")
