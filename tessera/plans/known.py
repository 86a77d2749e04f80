"""Queries of known answers: the rows of a driver table are dealt fixed cases by their key, edge values among them, and the
SQL says what must come out for each case. The operators see tables of full size; the answers stand beside the inputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.plans.session import spread, table

#: Documents a task.
DOCS = 10_000


def sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(sql, v)) + "]"
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _values(name: str, columns: Sequence[str], rows: Sequence[Sequence]) -> str:
    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(sql, r)) + ')' for r in rows)})"


def cases(spark, sf_dir: str, schema: str, rows: Sequence[Sequence[tuple]]) -> DataFrame:
    """doc and the schema's columns: the rows of case number doc modulo the number of cases."""
    types = [f.split()[:2] for f in schema.split(",")]
    deal = lambda case: F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, types)]) for r in case])
    doc = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc")), "doc", DOCS)
    every = F.array(*map(deal, rows))
    return doc.select("doc", F.inline(F.element_at(every, (F.col("doc") % len(rows) + 1).cast("int"))))


def known_values(name: str, note: str, schema: str, answers: Sequence[tuple], build: Callable[..., Column], kind: str = "VARCHAR") -> None:
    """A function of one row's columns; answers are (inputs.., output)."""

    def run(spark, sf_dir):
        rows = cases(spark, sf_dir, schema, [[a[:-1]] for a in answers])
        return rows.select("doc", build(*[F.col(f.split()[0]) for f in schema.split(",")]).alias("value"))

    run.__doc__ = note
    expected = _values("e", ["i", "value"], [(i, a[-1]) for i, a in enumerate(answers)])
    query(name, f"WITH {expected} SELECT c_custkey AS doc, value::{kind} AS value FROM customer JOIN e ON c_custkey % {len(answers)} = i")(run)


def known_rows(name: str, note: str, columns: Sequence[str], answers: Sequence[Sequence[tuple]], build: Callable, types: dict[str, str] | None = None) -> None:
    """An operator on whole tables; build(spark, sf_dir) gives doc and columns, answers the rows of each case."""

    def run(spark, sf_dir):
        return build(spark, sf_dir).select("doc", *columns)

    run.__doc__ = note
    rows = [(i, *r) for i, case in enumerate(answers) for r in case]
    cast = ", ".join(f"{c}::{types[c]} AS {c}" if types and c in types else c for c in columns)
    query(name, f"WITH {_values('e', ['i', *columns], rows)} SELECT c_custkey AS doc, {cast} FROM customer JOIN e ON c_custkey % {len(answers)} = i")(run)
