"""A catalog of tables, as temporary views of the session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import columns, indexes
from .scratch import materialize


@dataclass(frozen=True)
class TableProperty:
    length: int
    sorted_by: str | None


class Catalog:
    """Named tables. A name can be taken once; ids are in the order of adding."""

    def __init__(self, spark: SparkSession):
        self.spark, self._names, self._sorted, self._indexes = spark, [], {}, {}

    def check(self, name: str) -> bool:
        return name in self._names and self.spark.catalog.tableExists(name)

    def add(self, name: str, df: DataFrame, sorted_by: str | None = None) -> None:
        if name in self._names:
            raise ValueError(f"table {name} is there already")
        df.createTempView(name)
        self._names.append(name)
        self._sorted[name] = sorted_by

    def drop(self, name: str) -> None:
        self._names.remove(name)
        self._sorted.pop(name)
        for t, c in [k for k in self._indexes if k[0] == name]:
            self.drop_index(t, c)
        self.spark.catalog.dropTempView(name)

    def table(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(f"no table {name}")
        return self.spark.table(name)

    def column(self, name: str) -> DataFrame:
        """``T.c``: one column of a table."""
        t, _, c = name.partition(".")
        return self.table(t).select(c)

    def names(self) -> list[str]:
        return list(self._names)

    def id(self, name: str) -> int:
        return self._names.index(name)

    def length(self, name: str) -> int:
        return self.table(name).count()

    def property(self, name: str) -> TableProperty:
        return TableProperty(self.length(name), self._sorted[name])

    def sort(self, name: str, column: str) -> None:
        """Sort a table by a column. It is written once: each file holds one range of the column, in order, so
        later scans sort nothing and skip what a condition on the column rules out."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df = materialize(self.table(name).repartitionByRange(n, column).sortWithinPartitions(column), "sorted")
        self.spark.catalog.dropTempView(name)
        df.createTempView(name)
        self._sorted[name] = column

    # -- indexes ------------------------------------------------------------------------------

    def build_index(self, name: str, column: str, buckets: int) -> indexes.Index:
        """A copy of a table in sorted buckets, found again by ``index``."""
        if (name, column) in self._indexes:
            raise ValueError(f"{name}.{column} has an index")
        self._indexes[name, column] = indexes.build_index(self.table(name), column, buckets)
        return self._indexes[name, column]

    def index(self, name: str, column: str) -> indexes.Index | None:
        return self._indexes.get((name, column))

    def drop_index(self, name: str, column: str) -> None:
        indexes.drop_index(self.spark, self._indexes.pop((name, column)))

    # -- configuration files: [Tables] name path ... [/Tables] --------------------------------

    def load(self, path: str) -> list[str]:
        """Add the tables that a configuration file lists; columns of one table, ``T.c``, become one
        table aligned by rid. Parquet where the path says so, else text column files."""
        listed = parse_config("\n".join(r.value for r in self.spark.read.text(path).collect()))
        tables: dict[str, dict[str, str]] = {}
        for name, file in listed.items():
            t, _, c = name.partition(".")
            tables.setdefault(t, {})[c] = file
        for t, files in tables.items():
            if "" in files:
                df = self.spark.read.parquet(files[""])
            else:
                df = None
                for c, file in files.items():
                    one = columns.read_column(self.spark, file).withColumnRenamed("value", c)
                    df = one if df is None else df.join(one, "rid")
            self.add(t, df)
        return list(tables)

    def dump(self, path: str, folder: str) -> None:
        """Write all tables as text column files below ``folder`` and the configuration to ``path``.
        A table needs a column rid; its other columns are written."""
        lines = ["[Tables]"]
        for t in self._names:
            df = self.table(t)
            for c in (c for c in df.columns if c != "rid"):
                columns.write_column(df.select("rid", df[c].alias("value")), f"{folder}/{t}.{c}")
                lines += [f"{t}.{c}", f"{folder}/{t}.{c}"]
        text = self.spark.createDataFrame([(x,) for x in [*lines, "[/Tables]"]], "value string").coalesce(1)
        text.write.mode("overwrite").text(path)


def parse_config(text: str) -> dict[str, str]:
    """{name: path}. Other sections, such as [Indexes], are known and have no effect."""
    out, lines, inside = {}, [x.strip() for x in text.splitlines()], False
    pending = None
    for x in lines:
        if x.startswith("["):
            inside = x == "[Tables]"
            if pending:
                raise ValueError(f"no path for {pending}")
        elif inside and x:
            if pending is None:
                pending = x
            else:
                if pending in out:
                    raise ValueError(f"table {pending} is listed twice")
                out[pending], pending = x, None
    if pending:
        raise ValueError(f"no path for {pending}")
    return out
