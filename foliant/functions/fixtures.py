"""Small frames given as literals, for Spark and as a SQL sub-query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Frame:
    """Rows with a schema of `name type` pairs; `sql` gives the same rows to another engine."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.columns = [c.strip().split(" ", 1) for c in schema.split(",")]

    def df(self, spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        names = ", ".join(n for n, _ in self.columns)
        casts = ", ".join(f"CAST({n} AS {'VARCHAR' if t == 'string' else t.upper()}) AS {n}" for n, t in self.columns)
        body = ", ".join("(" + ", ".join(self._literal(v) for v in r) + ")" for r in self.rows)
        return f"(SELECT {casts} FROM (VALUES {body}) v({names}))"

    @staticmethod
    def _literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"
