"""Workbooks (xlsx) as a data source: a sheet for each partition, more where it has more rows than a sheet holds.

A task writes its sheets as compressed XML beside the workbook, and its commit message
says where. The commit puts these parts into one archive as they are, a buffer at a
time, with the list of sheets; the workbook gets its name when it is whole. Aborted and
committed jobs leave no parts. Reading takes a partition for each sheet.

Cells: numbers and booleans as such; whole numbers beyond 2^53, which a sheet's numbers
can't hold, numbers that aren't finite, dates and all else as text; nulls as no cell;
characters that XML can't hold as _xHHHH_. A text over MOST_TEXT characters is an error,
as it would be cut. An empty table is one sheet with the names of the columns.
"""

from __future__ import annotations

import io
import json
import math
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegralType, StructType

#: Fixed values of the format: rows of a sheet, characters of a cell, namespace.
MOST_ROWS, MOST_TEXT = 1_048_576, 32_767
SPACE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\r]|_(?=x[0-9A-Fa-f]{4}_)")
_HELD = re.compile("_x([0-9A-Fa-f]{4})_")
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


@dataclass
class Written(WriterCommitMessage):
    """Parts of a task: (file, bytes)."""

    parts: list


def _column(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def _text(ref: str, value: str) -> str:
    if len(value) > MOST_TEXT:
        raise ValueError(f"a text of {len(value)} characters in {ref}; a cell holds {MOST_TEXT}")
    safe = escape(_BAD.sub(lambda m: f"_x{ord(m[0]):04X}_", value))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{safe}</t></is></c>'


def _cell(ref: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int) and abs(value) <= 1 << 53 or isinstance(value, float) and math.isfinite(value):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    return _text(ref, str(value))


class _Writer(DataSourceWriter):
    def __init__(self, path: str, names: list[str], most: int):
        self.path, self.names, self.most, self.parts = path.rstrip("/"), names, most, f"{path.rstrip('/')}._parts-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        files, folder = fs.FileSystem.from_uri(self.parts)
        files.create_dir(folder, recursive=True)
        done, sheet = [], None
        columns = [_column(k) for k in range(len(self.names))]

        def line(n: int, values) -> bytes:
            return f'<row r="{n}">{"".join(_cell(f"{c}{n}", v) for c, v in zip(columns, values, strict=True))}</row>'.encode()

        def close() -> None:
            if sheet:
                sheet[1].write(b"</sheetData></worksheet>")
                sheet[1].close()
                sheet[2].close()
                sheet[3].close()
                done.append(sheet[0])

        n = 0
        for row in rows:
            if sheet is None or n >= self.most:
                close()
                name = f"{uuid.uuid4().hex}.zip"
                sink = files.open_output_stream(f"{folder}/{name}")
                archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
                sheet = (name, archive.open("sheet.xml", "w", force_zip64=True), archive, sink)
                sheet[1].write(f'{HEAD}<worksheet xmlns="{SPACE}"><sheetData>'.encode() + line(1, self.names))
                n = 1
            n += 1
            sheet[1].write(line(n, row))
        close()
        return Written(done)

    def commit(self, messages) -> None:
        """One archive of all parts, in the order of partitions."""
        files, folder = fs.FileSystem.from_uri(self.parts)
        _, target = fs.FileSystem.from_uri(self.path)
        files.create_dir(folder, recursive=True)
        sheets = [p for m in messages if m is not None for p in m.parts]
        with files.open_output_stream(f"{folder}/whole") as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
            for k, name in enumerate(sheets, 1):
                with files.open_input_file(f"{folder}/{name}") as raw, zipfile.ZipFile(raw) as part:
                    _copied(z, part, raw, f"xl/worksheets/sheet{k}.xml")
            if not sheets:
                head = "".join(_cell(f"{_column(k)}1", v) for k, v in enumerate(self.names))
                z.writestr("xl/worksheets/sheet1.xml", f'{HEAD}<worksheet xmlns="{SPACE}"><sheetData><row r="1">{head}</row></sheetData></worksheet>')
            every = range(1, max(1, len(sheets)) + 1)
            z.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{SPACE}" xmlns:r="{OFFICE}"><sheets>{"".join(f"""<sheet name="Sheet{k}" sheetId="{k}" r:id="rId{k}"/>""" for k in every)}</sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">{"".join(f"""<Relationship Id="rId{k}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>""" for k in every)}</Relationships>')
            z.writestr("_rels/.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
            z.writestr("[Content_Types].xml", f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{"".join(f"""<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>""" for k in every)}</Types>')
        files.move(f"{folder}/whole", target)
        files.delete_dir(folder)

    def abort(self, messages) -> None:
        files, folder = fs.FileSystem.from_uri(self.parts)
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)


def _copied(z: zipfile.ZipFile, part: zipfile.ZipFile, raw, name: str) -> None:
    """The one member of a part under another name, its compressed bytes as they are."""
    old = part.infolist()[0]
    raw.seek(old.header_offset)
    head = raw.read(30)
    raw.seek(old.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    new = zipfile.ZipInfo(name)
    new.compress_type, new.CRC, new.file_size, new.compress_size = old.compress_type, old.CRC, old.file_size, old.compress_size
    new.header_offset = z.fp.tell()
    z.fp.write(new.FileHeader(zip64=None))
    left = old.compress_size
    while left:
        block = raw.read(min(left, 1 << 20))
        z.fp.write(block)
        left -= len(block)
    z.filelist.append(new)
    z.NameToInfo[name] = new
    z.start_dir, z._didModify = z.fp.tell(), True


class _Sheet(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.kinds = path, schema

    def partitions(self):
        with _opened(self.path) as z:
            names = [n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
        return [_Sheet(n) for n in sorted(names, key=lambda n: (len(n), n))]

    def read(self, part):
        with _opened(self.path) as z, z.open(part.name) as xml:
            head = None
            for row in _rows(xml):
                if head is None:
                    head = {v: c for c, v in row.items()}
                else:
                    yield tuple(_of(f.dataType, row.get(head.get(f.name))) for f in self.kinds)


def _of(kind, text: str | None):
    if text is None:
        return None
    if isinstance(kind, BooleanType):
        return text in ("1", "true", "True")
    if isinstance(kind, IntegralType):
        return int(float(text)) if "." in text or "e" in text else int(text)
    return float(text) if isinstance(kind, DoubleType | FloatType) else text


def _rows(xml) -> Iterator[dict[str, str]]:
    """The cells of each row by column."""
    for _, e in ElementTree.iterparse(xml, events=("end",)):
        if e.tag == f"{{{SPACE}}}row":
            out = {}
            for c in e:
                value = c.find(f"{{{SPACE}}}v") if c.get("t") != "inlineStr" else c.find(f"{{{SPACE}}}is/{{{SPACE}}}t")
                if value is not None:
                    text = value.text or ""
                    out[re.match("[A-Z]+", c.get("r"))[0]] = _HELD.sub(lambda m: chr(int(m[1], 16)), text) if c.get("t") == "inlineStr" else text
            yield out
            e.clear()


def _opened(path: str) -> zipfile.ZipFile:
    files, place = fs.FileSystem.from_uri(path)
    return zipfile.ZipFile(io.BufferedReader(files.open_input_file(place), 1 << 16))


class Workbook(DataSource):
    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        return StructType.fromJson(json.loads(self.options["kinds"]))

    def reader(self, schema):
        return _Reader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], schema.names, int(self.options.get("rows", MOST_ROWS)))


def write(df: DataFrame, path: str, rows: int = MOST_ROWS) -> None:
    """df as the workbook at path, which is replaced; rows: of a sheet, its head included."""
    df.sparkSession.dataSource.register(Workbook)
    df.write.format("workbook").mode("append").option("rows", rows).save(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of `schema` from all sheets of a workbook; a sheet's first row names its columns."""
    spark.dataSource.register(Workbook)
    kinds = spark.createDataFrame([], schema).schema
    return spark.read.format("workbook").option("kinds", kinds.json()).load(path)
