"""Policy inputs as JSON documents: record tables under their names, each a list of records; test cases an object by id.

A document may hold any part of the tables; reading many of them is the union of their records. Each table is read with
a schema of that table only, and only from documents in which its name stands, so a rule parses no more than what it asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.sources.schemas import TABLES

#: The tables of a policy input.
INPUT_TABLES = "documents access_reviews risks incidents requirements test_cases suppliers periodic_evaluations gxp_systems access_records changes change_actions".split()
#: Flags that count as false where a record lacks the key; one that is null stays null.
FALSE_IF_MISSING = {"incidents": ["rca_started"]}


def to_json_documents(rows: DataFrame, name: str) -> DataFrame:
    """Records of a table -> (raw), a document for each record; columns that the table hasn't are left out, times are in ISO form."""
    known = [c for c in T.StructType.fromDDL(TABLES[name]).names if c in rows.columns]
    record = F.struct(*known)
    held = F.create_map(F.col("id"), record) if name == "test_cases" else F.array(record)
    return rows.select(F.to_json(F.struct(held.alias(name)), {"ignoreNullFields": "false"}).alias("raw"))


class PolicyInputs:
    """The record tables of a table of JSON documents (raw string), by name. Null and malformed documents hold nothing."""

    def __init__(self, documents: DataFrame) -> None:
        self.documents = documents

    def __getitem__(self, name: str) -> DataFrame:
        record = T.StructType.fromDDL(TABLES[name])
        held = T.MapType(T.StringType(), record) if name == "test_cases" else T.ArrayType(record)
        # A name can be spelled otherwise only by escapes, of which the parser knows those with a backslash.
        named = self.documents.where(F.col("raw").contains(name) | F.col("raw").contains("\\u"))
        parsed = named.select(self._part(name, held).alias("held"), "raw")
        if name == "test_cases":
            return parsed.select(F.explode("held").alias("id", "record")).select("id", *[F.col(f"record.{c}").alias(c) for c in record.names if c != "id"])
        if name not in FALSE_IF_MISSING:
            return parsed.select(F.inline("held"))
        keys = self._part(name, T.ArrayType(T.MapType(T.StringType(), T.StringType()))).alias("keys")
        both = parsed.select("held", keys).select(F.explode(F.arrays_zip("held", "keys")).alias("x")).select("x.held.*", "x.keys")
        return both.withColumns({c: F.when(F.map_contains_key("keys", c), F.col(c)).otherwise(F.lit(False)) for c in FALSE_IF_MISSING[name]}).drop("keys")

    @staticmethod
    def _part(name: str, held: T.DataType) -> Column:
        return F.from_json("raw", T.StructType([T.StructField(name, held)]))[name]
