"""XLSX as a Spark data source: the active sheet's cached values, streamed from the zipped XML."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StringType, StructField, StructType

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_M = "{" + _NS["m"] + "}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _open(path: str) -> zipfile.ZipFile:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)
    return zipfile.ZipFile(system.open_input_file(name))


def _sheet(z: zipfile.ZipFile) -> str:
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    view = book.find("m:bookViews/m:workbookView", _NS)
    sheets = book.findall("m:sheets/m:sheet", _NS)
    active = sheets[min(int(view.get("activeTab", 0)) if view is not None else 0, len(sheets) - 1)]
    links = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = next(x.get("Target") for x in links if x.get("Id") == active.get(_R))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in e.iter(f"{_M}t"))


def rows(path: str) -> Iterator[list[str | None]]:
    """The active sheet's rows, as text; booleans as True and False, errors as null."""
    with _open(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, e in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if e.tag == f"{_M}si":
                    shared.append(_text(e))
                    e.clear()
        at = 0
        for _, e in ElementTree.iterparse(z.open(_sheet(z))):
            if e.tag != f"{_M}row":
                continue
            number = int(e.get("r", at + 1))
            for _ in range(at + 1, number):  # rows that the file leaves out are blank
                yield []
            at, out = number, []
            for c in e.findall("m:c", _NS):
                i = _column(c.get("r")) if c.get("r") else len(out)
                out += [None] * (i + 1 - len(out))
                kind, v = c.get("t", "n"), c.findtext("m:v", None, _NS)
                if kind == "s" and v is not None:
                    v = shared[int(v)]
                elif kind == "inlineStr":
                    v = _text(c)
                elif kind == "b" and v is not None:
                    v = "True" if v == "1" else "False"
                elif kind == "e":
                    v = None
                out[i] = v
            yield out
            e.clear()


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict, width: int):
        self.path, self.skip, self.width = options["path"], int(options.get("skiprows", 0)), width

    def read(self, partition) -> Iterator[tuple]:
        for i, row in enumerate(rows(self.path)):
            if i > self.skip and any(v is not None for v in row):
                yield tuple((row + [None] * self.width)[: self.width])


class XlsxSource(DataSource):
    """Options: path, skiprows (before the header row). All columns are text; ``granary.sources.files.typed`` infers types."""

    @classmethod
    def name(cls) -> str:
        return "granary_xlsx"

    def schema(self) -> StructType:
        skip = int(self.options.get("skiprows", 0))
        header = next((r for i, r in enumerate(rows(self.options["path"])) if i == skip), [])
        from granary.sources.files import _distinct

        return StructType([StructField(n, StringType()) for n in _distinct([h or "" for h in header])])

    def reader(self, schema: StructType) -> XlsxReader:
        return XlsxReader(self.options, len(schema.fields))
