"""Specifications as tables in Word documents, written and read with the standard library alone."""

from __future__ import annotations

import re
import zipfile
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from tabwright.plans.schema import typed_values
from tabwright.spec import ColumnSpec, SpecCollection, SpecError

#: Fixed column titles of the two layouts.
LONG = ("Variable Name", "Variable Label", "Type", "Length", "Format", "Nullable", "Description")
SHORT = ("Variable Name", "Variable Label", "Type", "Format", "Nullable", "Description")
FIELDS = ("id", "label", "type", "length", "format", "nullable", "description")
VALUES, PATTERN = "#@values:", "#@pattern:"
NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _plain(value: object) -> str:
    return "" if value is None else str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def spec_rows(spec: SpecCollection, titles: tuple[str, ...] = LONG) -> list[dict[str, str]]:
    """A row per column; allowed values and pattern stand as lines of the description."""
    if tuple(titles) not in (LONG, SHORT):
        raise SpecError(f"titles must be {LONG} or {SHORT}")
    rows = []
    for c in spec.columns.values():
        text = [c.description or ""]
        if c.values:
            text.append(f"{VALUES} {'; '.join(_plain(v) for v in typed_values(c))}")
        if c.pattern is not None:
            text.append(f"{PATTERN} {c.pattern}")
        length = _plain(c.length) if c.length is not None else re.sub(r"[^0-9.-]", "", _plain(c.format))
        row = dict(zip(LONG, (c.id, c.label or "", c.type or "", length, _plain(c.format), "Yes" if c.nullable else "No", "\n".join(text).strip("\n")), strict=True))
        rows.append({t: row[t] for t in titles})
    return rows


def spec_frame(spark: SparkSession, spec: SpecCollection, titles: tuple[str, ...] = LONG) -> DataFrame:
    """The documentation table as a DataFrame."""
    return spark.createDataFrame([tuple(r[t] for t in titles) for r in spec_rows(spec, titles)], ", ".join(f"`{t}` string" for t in titles))


def _cell(text: str, bold: bool = False) -> str:
    lines = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(line)}</w:t>' for line in text.split("\n"))
    return f"<w:tc><w:tcPr/><w:p><w:r><w:rPr>{'<w:b/>' * bold}</w:rPr>{lines}</w:r></w:p></w:tc>"


def write_docx(path: str, titles: tuple[str, ...], rows: list[tuple[str, ...]], overwrite: bool = False) -> None:
    """A document that holds one table."""
    if Path(path).exists() and not overwrite:
        raise FileExistsError(path)
    edges = "".join(f'<w:{e} w:val="single" w:sz="4"/>' for e in ("top", "left", "bottom", "right", "insideH", "insideV"))
    body = "".join("<w:tr>" + "".join(_cell(x, k == 0) for x in row) + "</w:tr>" for k, row in enumerate([titles, *rows]))
    document = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{NS}"><w:body><w:tbl><w:tblPr><w:tblBorders>{edges}</w:tblBorders></w:tblPr><w:tblGrid>{"<w:gridCol/>" * len(titles)}</w:tblGrid>{body}</w:tbl><w:p/></w:body></w:document>'
    types = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    links = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("[Content_Types].xml", types), ("_rels/.rels", links), ("word/document.xml", document)):
            z.writestr(name, text)


def read_docx_tables(path: str) -> list[list[list[str]]]:
    """All tables of a document, as rows of texts; lines and paragraphs of a cell are joined by line feeds."""
    with zipfile.ZipFile(path) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    w = f"{{{NS}}}"

    def text(cell: ElementTree.Element) -> str:
        return "\n".join("".join(n.text or "" if n.tag == f"{w}t" else "\n" if n.tag in (f"{w}br", f"{w}cr") else "\t" if n.tag == f"{w}tab" else "" for n in p.iter()) for p in cell.iter(f"{w}p"))

    return [[[text(c) for c in row.findall(f"{w}tc")] for row in t.findall(f"{w}tr")] for t in root.iter(f"{w}tbl")]


def write_spec_table(spec: SpecCollection, path: str = "spec_table.docx", overwrite: bool = False, titles: tuple[str, ...] = LONG) -> list[dict[str, str]]:
    """The documentation table as a Word document; returns its rows."""
    rows = spec_rows(spec, titles)
    write_docx(path, tuple(titles), [tuple(r.values()) for r in rows], overwrite)
    return rows


def write_value_table(spec: SpecCollection, path: str, column_id: str, overwrite: bool = False) -> list[str]:
    """The allowed values of one column as a Word table; returns them."""
    column = spec.get(column_id)
    if column is None or not column.values:
        raise SpecError(f"column {column_id} has no allowed values")
    values = [_plain(v) for v in column.values]
    write_docx(path, (column_id,), [(v,) for v in values], overwrite)
    return values


def _directive(text: str, mark: str) -> str | None:
    """What follows the mark on its line, without quotes around it."""
    m = re.search(rf"{re.escape(mark)}[ \t]*([^\n]*)", text)
    return None if m is None else m[1].strip()


def _unquoted(text: str) -> str:
    return re.sub(r"^[\"']|[\"']$", "", text)


def read_spec_table(path: str, table_position: int = 1, fields: tuple[str, ...] = FIELDS, value_sep: str = ";") -> SpecCollection:
    """A specification from the n-th table of a Word document; its first row holds titles. Rules aren't documented there."""
    tables = read_docx_tables(path)
    if not 1 <= table_position <= len(tables):
        raise SpecError(f"{path} has {len(tables)} tables, not {table_position}")
    columns = []
    for row in tables[table_position - 1][1:]:
        cell = dict(zip(fields, row, strict=False))
        name = re.sub(r"\s+", "", cell.get("id", ""))
        if not name:
            continue
        text = cell.get("description", "")
        values, pattern = _directive(text, VALUES), _directive(text, PATTERN)
        length = cell.get("length", "").strip()
        columns.append(
            ColumnSpec(
                id=name,
                label=cell.get("label") or None,
                type=cell.get("type", "").strip() or "Char",
                format=cell.get("format") or None,
                length=float(length) if re.fullmatch(r"-?\d+(\.\d*)?", length) else None,
                nullable=bool(re.search("Yes|yes", cell.get("nullable", ""))),
                values=tuple(_unquoted(v.strip()) for v in values.split(value_sep)) if values else None,
                pattern=_unquoted(pattern) if pattern else None,
                description=re.sub(rf"[ \t]*(?:{VALUES}|{PATTERN})[^\n]*", "", text).strip() or None,
            )
        )
    return SpecCollection(columns)
