"""Spreadsheet workbooks, read by the standard library: one workbook is one task.

Strings and rows are streamed from the package, so a task holds its bytes, the shared strings and a few thousand rows.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Rows in which a header may stand.
HEADER_ROWS = 25
_REF = re.compile(r"([A-Z]+)(\d+)")


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def column_index(ref: str) -> int:
    """From 0: A is 0, AA is 26."""
    n = 0
    for c in _REF.match(ref)[1]:
        n = 26 * n + ord(c) - 64
    return n - 1


def number_text(raw: str) -> str:
    """A numeric cell as text: whole numbers without a point."""
    value = float(raw)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


class WorkbookError(ValueError):
    """A package that is damaged or no workbook, or lacks a column."""


_escaped = re.compile(r"_x([0-9A-Fa-f]{4})_")


def unescape(text: str) -> str:
    """_xHHHH_ stands for a character that XML can't hold; halves of a surrogate pair become U+FFFD."""
    return _escaped.sub(lambda m: "\ufffd" if 0xD800 <= int(m[1], 16) < 0xE000 else chr(int(m[1], 16)), text)


def string_item(item) -> str:
    """The text of a string item: its own and that of its runs, without the phonetic hints that stand beside them."""
    own = [e for child in item for e in ([child] if _tag(child) == "t" else child if _tag(child) == "r" else ()) if _tag(e) == "t"]
    return unescape("".join(e.text or "" for e in own))


class Workbook:
    """The sheets of a workbook, streamed row by row."""

    def __init__(self, content: bytes, name: str = "workbook"):
        self.name = name
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as e:
            raise WorkbookError(f"{name}: no workbook, or cut off: {e}") from e
        self.names = set(self.zip.namelist())
        self.main = next((self._place("", r.get("Target", "")) for r in self._elements("_rels/.rels") if r.get("Type", "").endswith("/officeDocument")), None) or "xl/workbook.xml"
        if self.main not in self.names:
            raise WorkbookError(f"{name}: {self.main} is missing; no .xlsx workbook?")
        base, leaf = posixpath.split(self.main)
        self.links = {r.get("Id"): self._place(base, r.get("Target", "")) for r in self._elements(f"{base}/_rels/{leaf}.rels") if r.get("TargetMode") != "External"}
        self.date1904 = any(_tag(e) == "workbookPr" and (e.get("date1904") or "").lower() in ("1", "true") for e in self._elements(self.main))
        self.strings = self._shared()

    @staticmethod
    def _place(base: str, target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(base, target))

    def _events(self, part: str) -> Iterator:
        """(event, element) of a part; what can't be read is a WorkbookError."""
        try:
            with self.zip.open(part) as f:
                yield from ElementTree.iterparse(f, events=("start", "end"))
        except ElementTree.ParseError as e:
            raise WorkbookError(f"{self.name}: {part} is no XML: {e}") from e
        except (zipfile.BadZipFile, zlib.error, EOFError) as e:
            raise WorkbookError(f"{self.name}: {part} can't be read from the package: {e}") from e

    def _elements(self, part: str) -> list:
        return [e for event, e in self._events(part) if event == "end"] if part in self.names else []

    def _shared(self) -> list[str]:
        part = next((p for p in self.links.values() if p.endswith("sharedStrings.xml")), "xl/sharedStrings.xml")
        if part not in self.names:
            return []
        out, root = [], None
        for event, e in self._events(part):
            if event == "start":
                root = e if root is None else root
            elif _tag(e) == "si":
                out.append(string_item(e))
                root.clear()
        return out

    def sheets(self) -> list[tuple[str, str]]:
        """(name, path in the package) in workbook order."""
        found = []
        for s in self._elements(self.main):
            if _tag(s) == "sheet":
                rid = next((v for k, v in s.attrib.items() if k.endswith("}id")), None)
                found.append((s.get("name"), self.links.get(rid)))
        if not found:
            raise WorkbookError(f"{self.name}: {self.main} lists no sheets")
        return [(n, p) for n, p in found if p in self.names]

    def rows(self, path: str) -> Iterator[tuple[int, list[str | None], list[bool]]]:
        """(row number, cells as text, which are numbers); a gap between cells is a null."""
        number, root = 0, None
        for event, e in self._events(path):
            if event == "start":
                root = e if _tag(e) == "sheetData" else root
                continue
            if _tag(e) != "row":
                continue
            number = int(e.get("r") or number + 1)
            cells: list[str | None] = []
            numeric: list[bool] = []
            for c in e:
                if _tag(c) == "c":
                    at = column_index(c.get("r")) if c.get("r") else len(cells)
                    gap = max(0, at + 1 - len(cells))
                    cells += [None] * gap
                    numeric += [False] * gap
                    cells[at], numeric[at] = self._value(c)
            yield number, cells, numeric
            if root is not None:
                root.clear()

    def _value(self, cell) -> tuple[str | None, bool]:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return next((string_item(c) for c in cell if _tag(c) == "is"), None), False
        raw = next((v.text for v in cell if _tag(v) == "v"), None)
        if raw is None or kind == "e":
            return None, False
        if kind == "s":
            try:
                return self.strings[int(raw)], False
            except (ValueError, IndexError) as e:
                raise WorkbookError(f"{self.name}: cell {cell.get('r')} has no shared string {raw}") from e
        if kind in ("str", "d", "b"):
            return ({"1": "TRUE", "0": "FALSE"}.get(raw, raw) if kind == "b" else unescape(raw)), False
        try:
            return number_text(raw), True
        except ValueError as e:
            raise WorkbookError(f"{self.name}: cell {cell.get('r')} is no number: {raw}") from e


def header_key(text: str | None) -> str:
    """A header for comparison: lower case, without one bracket at its end, punctuation collapsed."""
    import unicodedata

    low = unicodedata.normalize("NFKC", text or "").casefold().strip()
    return re.sub(r"[\W_]+", " ", re.sub(r"\s*\([^()]*\)$", "", low)).strip()


@dataclass
class Layout:
    """Where a sheet's columns are, and what is odd about its header."""

    row: int
    at: dict[str, int]
    headers: list[str]
    title: str | None = None
    unknown: list[str] = field(default_factory=list)
    repeated: list[str] = field(default_factory=list)


def find_header(rows: list[tuple], aliases: dict[str, list[str]], required: list[str]) -> Layout | None:
    """The first row that has all required headers; of a header that repeats the first counts."""
    names = {header_key(k): name for name, others in aliases.items() for k in (name, *others)}
    title = None
    for number, cells, *_ in rows[:HEADER_ROWS]:
        said = [(i, c.strip()) for i, c in enumerate(cells) if c and c.strip()]
        found = Layout(number, {}, [c for _, c in said], title)
        for i, c in said:
            name = names.get(header_key(c))
            if name is None:
                found.unknown.append(c)
            elif name in found.at:
                found.repeated.append(c)
            else:
                found.at[name] = i
        if found.at and all(r in found.at for r in required):
            return found
        title = title or next((c for _, c in said), None)
    return None


def _diagnosis(heads: dict[str, list[tuple]], aliases: dict[str, list[str]], required: list[str]) -> str:
    """Which row of which sheet comes nearest, and what it lacks."""
    best = (len(required) + 1, "no row looks like a header")
    for sheet, rows in heads.items():
        for number, cells, *_ in rows:
            have = {header_key(c) for c in cells if c}
            lost = [n for n in required if not have & {header_key(k) for k in (n, *aliases.get(n, []))}]
            if len(lost) < best[0]:
                best = (len(lost), f"nearest is row {number} of {sheet}, which lacks {', '.join(lost)}")
    return best[1]


def _open(name: str, content: bytes, aliases: dict[str, list[str]], required: list[str]) -> tuple[Workbook, str, str, Layout]:
    """(workbook, sheet, its path, layout) of the first sheet that has the required headers."""
    book, heads = Workbook(content, name), {}
    for sheet, part in book.sheets():
        heads[sheet] = [r for r, _ in zip(book.rows(part), range(HEADER_ROWS))]
        if found := find_header(heads[sheet], aliases, required):
            return book, sheet, part, found
    raise WorkbookError(f"{name}: no sheet has the column(s) {', '.join(required)}; {_diagnosis(heads, aliases, required)}")


def read_workbooks(spark: SparkSession, path: str, aliases: dict[str, list[str]], required: list[str] = ()) -> DataFrame:
    """All-string columns by canonical name, with file, sheet and source_row, of the first sheet that has the required headers.

    numeric: the columns whose cell in the row is a number, not text; a date among them is a day number. Files come through
    Spark's binary reader, so any store that Spark reads will do. A workbook without such a header is an error.
    """
    names = list(aliases)
    text = [StructField(n, StringType()) for n in names]
    schema = StructType([StructField("file", StringType()), StructField("sheet", StringType()), StructField("source_row", IntegerType()), *text, StructField("numeric", ArrayType(StringType()))])

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                book, sheet, part, layout = _open(name, content, aliases, list(required))
                out = []
                for number, cells, numeric in book.rows(part):
                    if number > layout.row:
                        have = {n: layout.at[n] for n in names if n in layout.at and layout.at[n] < len(cells)}
                        out.append((name, sheet, number, *[cells[have[n]] if n in have else None for n in names], [n for n, i in have.items() if numeric[i]]))
                    if len(out) == 5000:
                        yield pd.DataFrame(out, columns=schema.names)
                        out = []
                yield pd.DataFrame(out, columns=schema.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, schema)


def workbook_layouts(spark: SparkSession, path: str, aliases: dict[str, list[str]], required: list[str] = ()) -> DataFrame:
    """What is read of each workbook, and what isn't: sheet, header row, title, headers that are unknown or repeated, columns that are absent, other sheets, and whether its day numbers count from 1904."""
    lists = "headers unknown repeated absent other_sheets".split()

    def look(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"]):
                book, sheet, _, found = _open(name, content, aliases, list(required))
                rows.append((name, sheet, found.row, found.title, found.headers, found.unknown, found.repeated, [n for n in aliases if n not in found.at], [n for n, _ in book.sheets() if n != sheet], book.date1904))
            yield pd.DataFrame(rows, columns=["file", "sheet", "header_row", "title", *lists, "date1904"])

    shape = "file string, sheet string, header_row int, title string, " + ", ".join(f"{c} array<string>" for c in lists) + ", date1904 boolean"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(look, shape)


def inspect_workbooks(spark: SparkSession, path: str, rows: int = 8) -> DataFrame:
    """(file, sheet, source_row, cells) of the first rows of every sheet."""

    def look(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                book = Workbook(content, name)
                yield pd.DataFrame([(name, s, n, c) for s, p in book.sheets() for (n, c, _), _ in zip(book.rows(p), range(rows))], columns=["file", "sheet", "source_row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(look, "file string, sheet string, source_row int, cells array<string>")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, modified, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
