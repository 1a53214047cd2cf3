"""Database dumps as data sources: INSERT statements of a MySQL or MariaDB dump, and COPY blocks of a PostgreSQL dump.

Both are Python data sources: ``spark.read.format("sqldump").option("table", "games").load(path)``. Rows are read in
one streaming pass with no more than a statement (or a line) in memory; other tables are passed over without parsing
their values. Files are the partitions, as a dump can only be read from its start. Compression is told by the first
bytes, not by the name.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

# The tokens of SQL literals.
_QUOTED = r"'(?:[^'\\]|\\.|'')*'"
_INSIDE = re.compile(r"(?:[^'\\]|\\.|'')*'", re.S)
_PIECE = re.compile(rf"{_QUOTED}|[^';]+|[';]", re.S)
_CREATE = re.compile(r"\s*CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?`?(\w+)`?\s*\(", re.I)
_COLUMN = re.compile(r"^\s*`(\w+)`\s+(\w+)", re.M)
_INSERT = re.compile(r"\s*(?:INSERT(?:\s+IGNORE)?|REPLACE)\s+INTO\s+`?(\w+)`?\s*(?:\(([^)]*)\))?\s*VALUES\s*", re.I)
_VALUE = re.compile(rf"\s*(?:(?P<text>{_QUOTED})|(?P<hex>0x[0-9A-Fa-f]*)|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|(?P<word>[A-Za-z_]\w*)|(?P<sign>[(),]))", re.S)
# Characters behind a backslash in MySQL strings that stand for others; "%" and "_" keep it.
_MYSQL = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a", "%": "\\%", "_": "\\_"}
# The same in COPY text.
_COPY_CHARS = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
_WHOLE, _REAL = ("int", "tinyint", "smallint", "mediumint", "bigint", "integer", "year", "bit"), ("float", "double", "decimal", "numeric", "real")


class DumpError(ValueError):
    """A dump that is not laid out as expected."""


def open_text(path: str) -> io.TextIOBase:
    with open(path, "rb") as f:
        packed = f.read(2) == b"\x1f\x8b"
    raw = gzip.open(path, "rb") if packed else open(path, "rb")
    return io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="\n")


def statements(lines: Iterable[str]) -> Iterator[str]:
    """The statements of a script without their ";". A ";" or a line end inside quotes does not end one; comment lines are dropped.

    Each line is looked at once, also within a quoted value of many lines.
    """
    held: list[str] = []
    quoted = False
    for line in lines:
        at = 0
        if quoted:
            closed = _INSIDE.match(line)
            if closed is None:
                held.append(line)
                continue
            held.append(closed[0])
            at, quoted = closed.end(), False
        elif not held and (line.startswith(("--", "/*", "#")) or not line.strip()):
            continue
        for m in _PIECE.finditer(line, at):
            piece = m[0]
            if piece == ";":
                yield "".join(held)
                held = []
            elif piece == "'":  # a quote that is not closed on this line
                held.append(line[m.start() :])
                quoted = True
                break
            else:
                held.append(piece)
    if "".join(held).strip():
        yield "".join(held)


def _text(quoted: str) -> str:
    return re.sub(r"\\(.)|''", lambda m: "'" if m[1] is None else _MYSQL.get(m[1], m[1]), quoted[1:-1], flags=re.S)


def insert_rows(values: str, width: int, table: str) -> Iterator[list]:
    """The rows of a VALUES list: None, int, float or str in each field. A charset mark before a string is passed over."""
    row: list | None = None
    at, end = 0, len(values.rstrip())
    while at < end:
        m = _VALUE.match(values, at)
        if m is None:
            raise DumpError(f"{table}: cannot read {values[at : at + 40]!r}")
        at = m.end()
        kind, piece = m.lastgroup, m[m.lastgroup]
        if kind == "sign":
            if piece == "(":
                if row is not None:
                    raise DumpError(f"{table}: a bracket within a row")
                row = []
            elif piece == ")":
                if row is None or len(row) != width:
                    raise DumpError(f"{table}: {len(row or ())} values for {width} columns")
                yield row
                row = None
        elif row is None:
            if kind != "word":
                raise DumpError(f"{table}: a value outside a row")
            return  # what follows the rows, such as ON DUPLICATE KEY UPDATE
        elif kind == "text":
            row.append(_text(piece))
        elif kind == "number":
            row.append(int(piece) if re.fullmatch(r"[-+]?\d+", piece) else float(piece))
        elif kind == "hex":
            row.append(bytes.fromhex(piece[2:].zfill(len(piece[2:]) + len(piece[2:]) % 2)).decode("utf-8", "replace"))
        elif piece.upper() == "NULL":
            row.append(None)
        elif piece.upper() in ("TRUE", "FALSE"):
            row.append(int(piece.upper() == "TRUE"))
        elif not piece.startswith("_"):
            row.append(piece)


def dump_rows(lines: Iterable[str], table: str) -> Iterator[dict]:
    """The rows inserted into one table, by column name. Names come from the INSERT or from the CREATE TABLE before it."""
    columns: list[str] = []
    for s in statements(lines):
        if m := _CREATE.match(s):
            if m[1] == table:
                columns = [c for c, _ in _COLUMN.findall(s[m.end() :])]
        elif (m := _INSERT.match(s)) and m[1] == table:
            names = [n.strip(" `\n\t") for n in m[2].split(",")] if m[2] else columns
            if not names:
                raise DumpError(f"{table}: rows before its CREATE TABLE")
            for row in insert_rows(s[m.end() :], len(names), table):
                yield dict(zip(names, row))


def _copy_field(text: str) -> str | None:
    if text == "\\N":
        return None
    if "\\" not in text:
        return text

    def plain(m: re.Match) -> str:
        code = m[1]
        if code[0] in "01234567":
            return chr(int(code, 8))
        if code[0] == "x" and len(code) > 1:
            return chr(int(code[1:], 16))
        return _COPY_CHARS.get(code, code)

    return re.sub(r"\\([0-7]{1,3}|x[0-9A-Fa-f]{1,2}|.)", plain, text, flags=re.S)


_COPY = re.compile(r'COPY (?:\w+\.)?"?(\w+)"? \(([^)]*)\) FROM stdin;')


def copy_rows(lines: Iterable[str], table: str) -> Iterator[dict]:
    """The rows of one table's COPY blocks, by column name; all values are text, "\\N" is None."""
    names: list[str] | None = None
    skipping = False
    for line in lines:
        line = line.rstrip("\n")
        if names is None and not skipping:
            if m := _COPY.match(line):
                skipping = m[1] != table
                names = None if skipping else [c.strip(' "') for c in m[2].split(",")]
        elif line == "\\.":
            names, skipping = None, False
        elif not skipping:
            fields = line.split("\t")
            if len(fields) != len(names):
                raise DumpError(f"{table}: {len(fields)} fields for {len(names)} columns")
            yield {n: _copy_field(f) for n, f in zip(names, fields)}


def _declared(path: str, table: str, copied: bool) -> list[tuple[str, object]]:
    """Columns and types of a table as a dump declares them."""
    with open_text(path) as f:
        if copied:
            for line in f:
                if (m := _COPY.match(line)) and m[1] == table:
                    return [(c.strip(' "'), StringType()) for c in m[2].split(",")]
        else:
            for s in statements(f):
                if (m := _CREATE.match(s)) and m[1] == table:
                    kinds = _COLUMN.findall(s[m.end() :])
                    return [(c, LongType() if k.lower() in _WHOLE else DoubleType() if k.lower() in _REAL else StringType()) for c, k in kinds]
                if (m := _INSERT.match(s)) and m[1] == table and m[2]:
                    return [(n.strip(" `\n\t"), StringType()) for n in m[2].split(",")]
    raise DumpError(f"{path} has no table {table}")


class _File(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], table: str, copied: bool, schema: StructType, renamed: dict[str, str]):
        self.paths, self.table, self.copied, self.schema, self.renamed = paths, table, copied, schema, renamed

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        kinds = [(f.name, f.dataType) for f in self.schema.fields]
        old = {new: name for name, new in self.renamed.items()}
        with open_text(partition.value) as f:
            for row in (copy_rows if self.copied else dump_rows)(f, self.table):
                out = []
                for name, kind in kinds:
                    v = row.get(name, row.get(old.get(name, "")))
                    if v is not None:
                        v = int(v) if isinstance(kind, LongType) else float(v) if isinstance(kind, DoubleType) else v if isinstance(v, str) else str(v)
                    out.append(v)
                yield tuple(out)


class SqlDump(DataSource):
    """Options: ``path`` (a file or pattern), ``table``, ``columns`` ("a, b", all if not given), and ``rename`` ("new=old, ...") for columns that newer dumps name otherwise.

    Values of columns that are not asked for are passed over without being converted or sent to Spark.
    """

    copied = False

    @classmethod
    def name(cls):
        return "sqldump"

    def _paths(self) -> list[str]:
        path = re.sub("^file:(//)?", "", self.options["path"])
        found = sorted(glob.glob(path)) or [path]
        return [q for p in found for q in (sorted(glob.glob(os.path.join(p, "*"))) if os.path.isdir(p) else [p])]

    def _renamed(self) -> dict[str, str]:
        return dict(tuple(x.strip() for x in pair.split("=")) for pair in self.options.get("rename", "").split(",") if "=" in pair)

    def schema(self):
        renamed = self._renamed()
        fields = [StructField(renamed.get(n, n), k) for n, k in _declared(self._paths()[0], self.options["table"], self.copied)]
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        if missing := [c for c in wanted if c not in {f.name for f in fields}]:
            raise DumpError(f"{self.options['table']} has no column {', '.join(missing)}")
        return StructType([f for f in fields if not wanted or f.name in wanted])

    def reader(self, schema):
        return _Reader(self._paths(), self.options["table"], self.copied, schema, self._renamed())


class CopyDump(SqlDump):
    """The same for COPY blocks; all columns are text."""

    copied = True

    @classmethod
    def name(cls):
        return "pgcopy"


def register(spark: SparkSession) -> None:
    """Make "sqldump" and "pgcopy" known to ``spark.read.format``."""
    spark.dataSource.register(SqlDump)
    spark.dataSource.register(CopyDump)
