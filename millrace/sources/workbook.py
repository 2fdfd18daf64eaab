"""Read the active sheet of an XLSX workbook from its bytes, with the standard library."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_EPOCH = dt.datetime(1899, 12, 30)
# Number formats that show dates or times, by their built-in ids.
_DATE_FORMAT_IDS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


class WorkbookError(ValueError):
    pass


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as source:
        root = ElementTree.parse(source).getroot()
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Indexes of the cell styles that show a date or a time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    with book.open("xl/styles.xml") as source:
        root = ElementTree.parse(source).getroot()
    dates = set(_DATE_FORMAT_IDS)
    for custom in root.iter(f"{_MAIN}numFmt"):
        shown = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get("formatCode", ""))
        if re.search("[dmhysDMHYS]", shown):
            dates.add(int(custom.get("numFmtId", "0")))
    formats = root.find(f"{_MAIN}cellXfs")
    if formats is None:
        return set()
    return {n for n, style in enumerate(formats) if int(style.get("numFmtId", "0")) in dates}


def _active_sheet(book: zipfile.ZipFile) -> tuple[str, str]:
    with book.open("xl/workbook.xml") as source:
        root = ElementTree.parse(source).getroot()
    view = root.find(f"{_MAIN}bookViews/{_MAIN}workbookView")
    sheets = list(root.find(f"{_MAIN}sheets") or [])
    if not sheets:
        raise WorkbookError("the workbook has no sheet")
    sheet = sheets[int(view.get("activeTab", "0")) if view is not None else 0]
    with book.open("xl/_rels/workbook.xml.rels") as source:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(source).getroot()}
    target = targets[sheet.get(_REL)]
    return sheet.get("name", ""), target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _column_index(reference: str) -> int:
    index = 0
    for letter in reference:
        if not letter.isalpha():
            break
        index = index * 26 + ord(letter.upper()) - ord("A") + 1
    return index - 1


def _number_text(raw: str, as_date: bool) -> str:
    if as_date:
        days = float(raw)
        if 0 <= days < 1:
            return (dt.datetime.min + dt.timedelta(seconds=round(days * 86400, 3))).time().isoformat()
        return (_EPOCH + dt.timedelta(seconds=round(days * 86400, 3))).isoformat()
    return str(int(raw)) if re.fullmatch(r"-?\d+", raw) else str(float(raw))


def _cell_text(cell: ElementTree.Element, strings: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    value = cell.find(f"{_MAIN}v")
    if value is None or value.text is None:
        return None
    if kind == "s":
        return strings[int(value.text)]
    if kind == "b":
        return "True" if value.text == "1" else "False"
    if kind == "n":
        return _number_text(value.text, int(cell.get("s", "0")) in dates)
    return value.text


def sheet_rows(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells as text) of the active sheet, blank rows in between included."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        _, path = _active_sheet(book)
        strings, dates = _shared_strings(book), _date_styles(book)
        sheet = book.open(path)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
        raise WorkbookError("unable to read the workbook") from error
    with book, sheet:
        expected = 1
        for _, row in ElementTree.iterparse(sheet):
            if row.tag != f"{_MAIN}row":
                continue
            number = int(row.get("r", expected))
            while expected < number:
                yield expected, []
                expected += 1
            cells: list[str | None] = []
            for cell in row.iter(f"{_MAIN}c"):
                index = _column_index(cell.get("r", "")) if cell.get("r") else len(cells)
                cells.extend([None] * (index + 1 - len(cells)))
                cells[index] = _cell_text(cell, strings, dates)
            yield number, cells
            expected = number + 1
            row.clear()


def sheet_name(content: bytes) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            return _active_sheet(book)[0]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
        raise WorkbookError("unable to read the workbook") from error
