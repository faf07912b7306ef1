"""Spreadsheets (Office Open XML) with the standard library alone: the first sheet, as strings.

Spreadsheets are small by their format (1,048,576 rows); each file is read by one task. Empty cells
are null; a file without a sheet's row has no columns and no rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..store import write_bytes

MAX_ROWS = 1_048_576
CHUNK = 10_000
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(rich: ET.Element) -> str:
    """The text of a string and of its runs, without the reading aids (phonetic runs) that may stand beside them."""
    return "".join(t.text or "" for x in rich if x.tag in (f"{_NS}t", f"{_NS}r") for t in x.iter(f"{_NS}t"))


def rows_of(data: bytes) -> Iterator[list[str | None]]:
    """The cells of the first sheet, row by row, as strings; empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_text(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        first = next(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"))
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[first.get(_REL)].lstrip("/")
        with z.open(target if target.startswith("xl/") else f"xl/{target}") as sheet:
            for _, row in ET.iterparse(sheet):
                if row.tag != f"{_NS}row":
                    continue
                out: list[str | None] = []
                for i, c in enumerate(row.iter(f"{_NS}c")):
                    at = _column(c.get("r")) if c.get("r") else i
                    out += [None] * (at + 1 - len(out))
                    v = c.find(f"{_NS}v")
                    if c.get("t") == "inlineStr":
                        out[at] = "".join(map(_text, c.iter(f"{_NS}is")))
                    elif v is not None and v.text is not None:
                        out[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
                yield out
                row.clear()


def _heads(rows: Iterator[list[str | None]]) -> list[str]:
    """Column names of a sheet: those of its first row, and a made one for each cell beyond; a name that comes again gets a number."""
    first, widest = next(rows, []), 0
    for r in rows:
        widest = max(widest, len(r))
    names: list[str] = []
    for i in range(max(len(first), widest)):
        name = (first[i] if i < len(first) else None) or f"_c{i}"
        k, made = 0, name
        while made.lower() in {n.lower() for n in names}:
            k += 1
            made = f"{name}.{k}"
        names.append(made)
    return names


def read_xlsx(spark: SparkSession, path: str, file_column: str | None = None) -> DataFrame:
    """The first sheet of each file of a path, its first row as column names, all columns nullable strings.

    Files may have different columns: all of them are columns of the result, null for rows of files
    that lack them. ``file_column`` names a column for the file's path.
    """
    binary = spark.read.format("binaryFile").load(path).select("path", "content")

    def look(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame({"path": frame.path, "names": [_heads(rows_of(bytes(data))) for data in frame.content]})

    # a row a file; the files are listed by the driver as it is
    heads = {r.path: r.names for r in binary.mapInPandas(look, "path string, names array<string>").orderBy("path").collect()}
    first: dict[str, str] = {}
    for own in heads.values():
        for n in own:
            first.setdefault(n.lower(), n)
    names, place = list(first.values()), {n: i for i, n in enumerate(first)}

    def run(frames):
        import pandas as pd

        for frame in frames:
            for file, data in zip(frame.path, frame.content):
                to = [place[n.lower()] for n in heads[file]]
                rows, out = rows_of(bytes(data)), []
                next(rows, None)
                for r in rows:
                    row: list[str | None] = [None] * len(names)
                    for i, x in zip(to, r):
                        row[i] = x
                    out.append((*row, file))
                    if len(out) == CHUNK:
                        yield pd.DataFrame(out, columns=[*names, "_file"], dtype=object)
                        out = []
                yield pd.DataFrame(out, columns=[*names, "_file"], dtype=object)

    fields = [T.StructField(n, T.StringType()) for n in [*names, "_file"]]
    rows = binary.mapInPandas(run, T.StructType(fields))
    return rows.withColumnRenamed("_file", file_column) if file_column else rows.drop("_file")


def xlsx_bytes(names: list[str], rows: list[tuple]) -> bytes:
    """A workbook of one sheet of strings."""

    def cell(x) -> str:
        return "<c/>" if x is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>'

    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [tuple(names), *rows])
    main, rel = _NS[1:-1], _REL[1:-3]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def write_xlsx(df: DataFrame, path: str) -> None:
    """A report as a workbook, written by the driver to any store that Spark knows; more rows than a sheet holds are refused."""
    rows = df.limit(MAX_ROWS).collect()
    if len(rows) == MAX_ROWS:
        raise ValueError(f"a sheet holds {MAX_ROWS - 1} rows")
    write_bytes(df.sparkSession, path, xlsx_bytes(df.columns, [tuple(r) for r in rows]))
