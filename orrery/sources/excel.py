"""XLSX workbooks: the first sheet, whose first row has the names."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .files import write_bytes

# The format's row limit and name spaces.
MOST_ROWS = 1_048_576
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _position(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def parse(data: bytes) -> Iterator[list]:
    """The rows of the first sheet, header included: str, float, bool or None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_MAIN}t")))
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        with z.open(sheet) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                out: list = []
                for k, c in enumerate(row.iter(f"{_MAIN}c")):
                    at = _position(c.get("r")) if c.get("r") else k
                    out += [None] * (at + 1 - len(out))
                    kind, v = c.get("t"), c.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        out[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif v is None or v.text is None:
                        out[at] = None
                    elif kind == "s":
                        out[at] = shared[int(v.text)]
                    elif kind == "b":
                        out[at] = v.text == "1"
                    elif kind in ("str", "e", "d"):
                        out[at] = v.text
                    else:
                        out[at] = float(v.text)
                yield out
                row.clear()


def _kind(values: list) -> str:
    known = [v for v in values if v is not None]
    if known and all(isinstance(v, bool) for v in known):
        return "boolean"
    if known and all(isinstance(v, float) for v in known):
        return "bigint" if all(v.is_integer() and abs(v) < 2**53 for v in known) else "double"
    return "string"


def _text(v) -> str | None:
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return str(v).lower()
    return str(int(v)) if v.is_integer() else repr(v)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """Columns of long, double, boolean or string, an empty cell null. Workbooks are parsed by the executors."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def kinds(batches):
        for batch in batches:
            for data in batch["content"]:
                rows = list(parse(data))
                head, body = (rows[0], rows[1:]) if rows else ([], [])
                columns = [[r[i] if i < len(r) else None for r in body] for i in range(len(head))]
                yield pd.DataFrame({"i": range(len(head)), "name": [_text(h) or f"column_{i}" for i, h in enumerate(head)], "kind": list(map(_kind, columns))})

    found = files.mapInPandas(kinds, "i int, name string, kind string").distinct().orderBy("i").collect()
    if len({r["i"] for r in found}) != len(found):
        raise ValueError(f"the workbooks of {path} differ in their columns")
    types = [r["kind"] for r in found]

    def body(batches):
        fit = {"bigint": int, "double": float, "boolean": bool, "string": _text}
        for batch in batches:
            for data in batch["content"]:
                rows = parse(data)
                next(rows, None)
                held = []
                for r in rows:
                    held.append([None if i >= len(r) or r[i] is None else fit[k](r[i]) for i, k in enumerate(types)])
                    if len(held) == 10_000:
                        yield frame(held)
                        held = []
                yield frame(held)

    def frame(rows):
        pandas = {"bigint": "Int64", "double": "Float64", "boolean": "boolean", "string": "object"}
        return pd.DataFrame({str(i): pd.array([r[i] for r in rows], dtype=pandas[k]) for i, k in enumerate(types)})

    schema = ", ".join(f"`{i}` {k}" for i, k in enumerate(types))
    return files.mapInPandas(body, schema).toDF(*[r["name"] for r in found])


def _cell(ref: str, v) -> str:
    if v is None or isinstance(v, float) and v != v:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    text = v.isoformat(sep=" ") if isinstance(v, datetime.datetime) else str(v)
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_excel(df: DataFrame, path: str) -> None:
    """One workbook of one sheet, with nulls as empty cells; more rows than a sheet can hold are an error."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
            letters = [_letters(i) for i in range(len(df.columns))]
            for n, row in ((1, df.columns),):
                sheet.write(f'<row r="{n}">{"".join(_cell(f"{a}{n}", v) for a, v in zip(letters, row, strict=True))}</row>'.encode())
            for n, row in enumerate(df.toLocalIterator(), 2):
                if n > MOST_ROWS:
                    raise ValueError(f"a sheet holds at most {MOST_ROWS} rows")
                sheet.write(f'<row r="{n}">{"".join(_cell(f"{a}{n}", v) for a, v in zip(letters, row, strict=True))}</row>'.encode())
            sheet.write(b"</sheetData></worksheet>")
    write_bytes(df.sparkSession, path, out.getvalue())
