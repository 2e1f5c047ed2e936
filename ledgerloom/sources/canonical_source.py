"""A data source of canonical statements: folders of JSON lines, read whole or followed as a stream.

``spark.dataSource.register(CanonicalStatements)``, then ``spark.read.format("canonical_statements").load(path)`` or
``spark.readStream...``. A file is read in pieces of ``pieceBytes`` (option; 8 MB), a statement belonging to the piece in which
its line begins. A stream goes by file names: they must grow in the order in which files arrive, and files are complete
when they appear (written elsewhere and renamed).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PIECE_BYTES = 8_000_000
FIELDS = ("txn_date", "value_date", "description", "amount", "direction", "balance_after", "reference")
ROWS = "fixture string, source_row int, " + ", ".join(f"{f} string" for f in FIELDS) + ", malformed string"


def _opened(path: str):
    """pyarrow's file system of a path or address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the folder's files, but for hidden ones and marks, by name."""
    from pyarrow import fs

    system, folder = _opened(path)
    found = system.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=True))
    return sorted((i.base_name, i.size) for i in found if i.is_file and not i.base_name.startswith((".", "_")))


@dataclass
class Piece(InputPartition):
    name: str
    start: int
    end: int


def _pieces(files: list[tuple[str, int]], size: int) -> list[Piece]:
    return [Piece(name, at, min(at + size, length)) for name, length in files for at in range(0, length, size)]


def _lines(path: str, piece: Piece) -> Iterator[bytes]:
    """The lines that begin in the piece; the last one may end beyond it."""
    system, folder = _opened(path)
    with system.open_input_file(f"{folder.rstrip('/')}/{piece.name}") as file:
        at = max(piece.start - 1, 0)
        file.seek(at)
        rest, first = b"", piece.start > 0  # what goes before the first line end belongs to the piece before
        while True:
            block = file.read(1 << 20)
            parts = (rest + block).split(b"\n")
            rest = parts.pop() if block else b""
            for line in parts:
                if first:
                    first = False
                elif at >= piece.end:
                    return
                else:
                    yield line
                at += len(line) + 1
            if not block:
                return


def _rows(path: str, piece: Piece) -> Iterator[tuple]:
    for line in _lines(path, piece):
        if not line.strip():
            continue
        try:
            whole = json.loads(line)
            lines = whole.get("transactions") or []
            made = [(whole.get("fixture"), n, *(_text(t.get(f)) for f in FIELDS), None) for n, t in enumerate(lines)]
        except (ValueError, AttributeError):
            made = [(None, None, *[None] * len(FIELDS), line.decode("utf-8", "replace"))]
        yield from made


def _text(value) -> str | None:
    return None if value is None else str(value)


class CanonicalStatements(DataSource):
    @classmethod
    def name(cls) -> str:
        return "canonical_statements"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Whole(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Followed(self.options)


class _Whole(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("pieceBytes", PIECE_BYTES))

    def partitions(self) -> list[InputPartition]:
        return _pieces(_files(self.path), self.size)

    def read(self, partition: Piece) -> Iterator[tuple]:
        return _rows(self.path, partition) if partition is not None else iter(())


class _Followed(DataSourceStreamReader):
    """Offsets are the name of the last file taken."""

    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("pieceBytes", PIECE_BYTES))

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max((name for name, _ in _files(self.path)), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _pieces([f for f in _files(self.path) if start["after"] < f[0] <= end["after"]], self.size)

    def read(self, partition: Piece) -> Iterator[tuple]:
        return _rows(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


def typed(c: str) -> Column:
    """A column of the source as the ledger holds it: money as decimals, days as dates."""
    return F.col(c).try_cast("decimal(18,2)" if c in ("amount", "balance_after") else "date" if c.endswith("_date") else "string").alias(c)
