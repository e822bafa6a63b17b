"""SQLite files as tables, and the package headers in them."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values: tags of a package header, and the types that they have
NAME, VERSION, RELEASE, EPOCH, ARCH, SOURCE = 1000, 1001, 1002, 1003, 1022, 1044
TEXT_TYPES, INT32 = (6, 8, 9), 4


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").option("table", t).schema(...).load(file)``: one table of a file, read only.

    Columns are those of the schema by name; a value of another type is null.
    The file is opened with its write-ahead log, if there is one.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("a table of a SQLite file needs a schema")

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options["path"].removeprefix("file:"), self.options["table"], [(f.name, f.dataType.simpleString()) for f in schema])


class SqliteReader(DataSourceReader):
    KINDS = {"string": str, "bigint": int, "int": int, "double": float, "binary": bytes}

    def __init__(self, path: str, table: str, columns: list[tuple[str, str]]):
        self.path, self.table, self.columns = path, table, columns

    def partitions(self):
        return [InputPartition(self.path)]

    def read(self, partition):
        import sqlite3

        quoted = ", ".join('"' + n.replace('"', '""') + '"' for n, _ in self.columns)
        source = '"' + self.table.replace('"', '""') + '"'
        con = sqlite3.connect(f"file:{partition.value}?mode=ro", uri=True)
        try:
            for row in con.execute(f"SELECT {quoted} FROM {source}"):  # noqa: S608 - names are quoted
                yield tuple(self._held(v, t) for v, (_, t) in zip(row, self.columns))
        finally:
            con.close()

    def _held(self, value, kind: str):
        if isinstance(value, int) and kind == "double":
            return float(value)
        return value if isinstance(value, self.KINDS[kind]) and not isinstance(value, bool) else None


def header_values(blob: bytes) -> dict[int, object]:
    """Texts and 32-bit numbers of a package header by tag: its index of 16-byte entries, then its data."""
    count, size = struct.unpack_from(">II", blob)
    data = blob[8 + 16 * count : 8 + 16 * count + size]
    if len(data) < size:
        raise ValueError("a header is cut short")
    out: dict[int, object] = {}
    for i in range(count):
        tag, kind, at, _ = struct.unpack_from(">IIII", blob, 8 + 16 * i)
        if kind in TEXT_TYPES:
            out[tag] = data[at : data.index(b"\0", at)].decode("utf-8", "replace")
        elif kind == INT32:
            out[tag] = struct.unpack_from(">I", data, at)[0]
    return out


RPM = "manager string, name string, version string, arch string, state string, source string, source_version string"


def rpm_packages(headers: DataFrame, column: str = "blob") -> DataFrame:
    """Packages from package headers (bytes); damaged ones, keys and those without name or version are left out."""

    def work(batches):
        for pdf in batches:
            out = []
            for blob in pdf[column]:
                try:
                    h = header_values(bytes(blob))
                except (ValueError, struct.error, IndexError):
                    continue
                if not h.get(NAME) or not h.get(VERSION) or h[NAME] == "gpg-pubkey":
                    continue
                full = f"{h[VERSION]}-{h[RELEASE]}" if h.get(RELEASE) else str(h[VERSION])
                full = f"{h[EPOCH]}:{full}" if h.get(EPOCH) else full
                built = str(h.get(SOURCE, "")).removesuffix(".src.rpm").rsplit("-", 2)
                out.append(("rpm", h[NAME], full, h.get(ARCH), "installed", built[0] or h[NAME], "-".join(built[1:]) if len(built) == 3 else full))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RPM.split(", ")])

    return headers.select(column).where(F.col(column).isNotNull()).mapInPandas(work, RPM)
