"""Small stored tables for the tests."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

from millrace.sources.tables import SCHEMAS, Tables, empty_table


def utc(*parts: int) -> dt.datetime:
    return dt.datetime(*parts, tzinfo=dt.UTC)


def naive(value):
    return value.replace(tzinfo=None) if isinstance(value, dt.datetime) else value


def stored(spark, **rows) -> Tables:
    """Tables from row tuples in schema order; tables not named are empty."""
    def opener(name):
        if name in rows:
            return lambda: spark.createDataFrame(rows[name], SCHEMAS[name])
        return lambda: empty_table(spark, name)

    return Tables({name: opener(name) for name in SCHEMAS})


def plant_with_tags(spark, tags, **more) -> Tables:
    """One plant, one line, one device ``D1``; ``tags`` are (id, code, type, low, high)."""
    return stored(
        spark,
        plant=[(1, "P1", "Plant", "active", None)],
        production_line=[(1, 1, "L1", "Line", "active", None)],
        device=[(1, 1, "D1", "Device", "active", None)],
        tag=[(i, 1, c, c, k, None, lo, hi, 1000, True) for i, c, k, lo, hi in tags],
        **more,
    )


_SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'
_BOOK = (
    '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
    '<bookViews><workbookView activeTab="1"/></bookViews><sheets>'
    '<sheet name="other" sheetId="1" r:id="rId1"/><sheet name="data" sheetId="2" r:id="rId2"/></sheets></workbook>'
)
_RELS = (
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/>'
    "</Relationships>"
)
_STYLES = (
    '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    '<numFmts><numFmt numFmtId="165" formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts>'
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="165"/></cellXfs></styleSheet>'
)


def workbook_bytes(rows_xml: str) -> bytes:
    """A workbook whose second sheet is active and holds the given rows."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as book:
        book.writestr("xl/workbook.xml", _BOOK)
        book.writestr("xl/_rels/workbook.xml.rels", _RELS)
        book.writestr("xl/styles.xml", _STYLES)
        book.writestr("xl/worksheets/sheet1.xml", _SHEET.format(""))
        book.writestr("xl/worksheets/sheet2.xml", _SHEET.format(rows_xml))
    return buffer.getvalue()
