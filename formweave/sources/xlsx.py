"""Spreadsheet files as DataFrames, and mapped rows as spreadsheet files.

Reading: files come through Spark's binary reader and are parsed on executors (zip and
XML) into long cell rows and a sheet dimension; what follows (headers, last row,
merged ranges, vocabulary) is relational.  A Python data source, ``workbook_cells``, gives the
same cells to ``spark.read.format``.  Writing edits a template's XML on the driver, row by row.
"""

from __future__ import annotations

import hashlib
import io
import re
import shutil
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from pathlib import Path
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from formweave.functions.text import normalize_case_insensitive, strip

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_N = f"{{{MAIN}}}"
#: Number formats of dates (fixed values of the format), besides custom ones with day, month or year letters.
_DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
MAX_CELL_CHARS = 32767
CELLS = "workbook string, sheet string, row int, col int, value struct<kind:string,s:string,n:double,d:date,b:boolean>, formula string"
SHEETS = "workbook string, sheet string, position int, frozen_panes string, merged_ranges array<string>, data_validations array<string>, named_ranges array<string>, sheet_names array<string>"


@dataclass
class Sheet:
    name: str
    cells: dict[tuple[int, int], tuple[str | None, object, str | None]] = field(default_factory=dict)  # kind, value, formula
    merged: list[str] = field(default_factory=list)
    panes: str | None = None
    validations: list[str] = field(default_factory=list)


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def position(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref)
    return int(m[2]), column_number(m[1])


def span(ref: str) -> tuple[int, int, int, int]:
    """First row, first column, last row, last column."""
    a, _, b = ref.partition(":")
    return *position(a), *position(b or a)


def parse(data: bytes) -> tuple[list[Sheet], list[str]]:
    """Sheets in order and the defined names."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        book = ET.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(_N + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        dates = _date_styles(z.read("xl/styles.xml")) if "xl/styles.xml" in names else set()
        epoch = book.find(_N + "workbookPr")
        base = date(1904, 1, 1) if epoch is not None and epoch.get("date1904") in ("1", "true") else date(1899, 12, 30)
        sheets = []
        for s in book.iter(_N + "sheet"):
            target = rels[s.get(f"{{{REL}}}id")]
            sheets.append(_sheet(s.get("name"), z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"), shared, dates, base))
        # names of one sheet and reserved ones are not the workbook's
        defined = [d.get("name") for d in book.iter(_N + "definedName") if d.get("localSheetId") is None and not d.get("name").startswith("_xlnm.")]
    return sheets, defined


def _date_styles(data: bytes) -> set[int]:
    root = ET.fromstring(data)
    custom = {int(f.get("numFmtId")) for f in root.iter(_N + "numFmt") if re.search(r"[dmy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    cells = root.find(_N + "cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | custom}


def _sheet(name: str, data: bytes, shared: list[str], dates: set[int], base: date) -> Sheet:
    root, out = ET.fromstring(data), Sheet(name)
    for c in root.iter(_N + "c"):
        v, f, kind = c.findtext(_N + "v"), c.findtext(_N + "f"), c.get("t", "n")
        value: object = None
        if kind == "s" and v is not None:
            mark, value = "s", shared[int(v)]
        elif kind == "inlineStr":
            mark, value = "s", "".join(t.text or "" for t in c.iter(_N + "t"))
        elif kind in ("str", "e"):
            mark, value = "s", v
        elif kind == "b":
            mark, value = "b", v == "1"
        elif kind == "d" and v is not None:
            mark, value = "d", datetime.fromisoformat(v).date()
        elif v is not None:
            number = float(v)
            mark, value = ("d", base + timedelta(days=int(number))) if int(c.get("s", 0)) in dates else ("n", number)
        if value is not None or f is not None:
            out.cells[position(c.get("r"))] = (mark if value is not None else None, value, f"={f}" if f is not None else None)
    out.merged = [m.get("ref") for m in root.iter(_N + "mergeCell")]
    pane = next(root.iter(_N + "pane"), None)
    out.panes = pane.get("topLeftCell") if pane is not None else None
    out.validations = [ref for d in root.iter(_N + "dataValidation") for ref in (d.get("sqref") or "").split()]
    return out


def _text(kind: str | None, value: object) -> str | None:
    """A value's text: whole numbers without a fraction."""
    if kind == "n":
        return str(int(value)) if value == int(value) else repr(value)
    return None if value is None else str(value)


def cell_rows(workbook: str, sheets: list[Sheet]) -> Iterator[tuple]:
    for s in sheets:
        for (r, c), (kind, value, formula) in s.cells.items():
            v = (kind, _text(kind, value), value if kind == "n" else None, value if kind == "d" else None, value if kind == "b" else None)
            yield workbook, s.name, r, c, v, formula


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """All stored cells of the workbooks under ``path``."""
    return cells_of(_files(spark, path))


def cells_of(files: DataFrame) -> DataFrame:
    """All stored cells of workbooks given as (path, content)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = pa.struct([("kind", pa.string()), ("s", pa.string()), ("n", pa.float64()), ("d", pa.date32()), ("b", pa.bool_())])
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(cell_rows(path, parse(content)[0]))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32()]
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]
                structs = pa.array([dict(zip(("kind", "s", "n", "d", "b"), v, strict=True)) for v in cols[4]], value)
                yield pa.RecordBatch.from_arrays([*arrays, structs, pa.array(cols[5], pa.string())], names=["workbook", "sheet", "row", "col", "value", "formula"])

    return files.mapInArrow(run, CELLS)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """One row a sheet: its place, panes, merged and validated ranges, the workbook's names."""
    return sheets_of(_files(spark, path))


def sheets_of(files: DataFrame) -> DataFrame:
    """The sheets of workbooks given as (path, content)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = pa.list_(pa.string())
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sheets, names = parse(content)
                n = len(sheets)
                arrays = [pa.array([path] * n), pa.array([s.name for s in sheets], pa.string()), pa.array(range(n), pa.int32()), pa.array([s.panes for s in sheets], pa.string()), pa.array([s.merged for s in sheets], many), pa.array([s.validations for s in sheets], many), pa.array([names] * n, many), pa.array([[s.name for s in sheets]] * n, many)]
                yield pa.RecordBatch.from_arrays(arrays, names=["workbook", "sheet", "position", "frozen_panes", "merged_ranges", "data_validations", "named_ranges", "sheet_names"])

    return files.mapInArrow(run, SHEETS)


def expand_merges(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Every covered coordinate takes the origin's value and formula; is_merged_origin and merged_from say which."""
    m = sheets.select("workbook", "sheet", F.explode("merged_ranges").alias("ref"))
    part = [F.regexp_extract("ref", r"([A-Z]+)(\d+)(?::([A-Z]+)(\d+))?", i) for i in (1, 2, 3, 4)]

    def number(letters):
        chars = F.filter(F.split(letters, ""), lambda x: x != "")
        return F.aggregate(chars, F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64)

    m = m.select("workbook", "sheet", part[1].cast("int").alias("r0"), number(part[0]).alias("c0"), F.coalesce(part[3].try_cast("int"), part[1].try_cast("int")).alias("r1"), F.when(part[2] != "", number(part[2])).otherwise(number(part[0])).alias("c1"))
    origin = cells.select("workbook", "sheet", F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("value").alias("mv"), F.col("formula").alias("mf"))
    area = m.join(origin, ["workbook", "sheet", "r0", "c0"]).withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    both = cells.join(area, ["workbook", "sheet", "row", "col"], "full")
    covered = F.col("r0").isNotNull()
    at_origin = covered & (F.col("row") == F.col("r0")) & (F.col("col") == F.col("c0"))
    return both.select("workbook", "sheet", "row", "col", F.when(covered, F.col("mv")).otherwise(F.col("value")).alias("value"), F.when(covered, F.col("mf")).otherwise(F.col("formula")).alias("formula"), F.coalesce(at_origin, F.lit(False)).alias("is_merged_origin"), F.when(covered & ~at_origin, F.struct(F.col("r0").alias("row"), F.col("c0").alias("col"))).alias("merged_from"))


def sheet_dimension(cells: DataFrame, sheets: DataFrame, header_row: int, sheet: str) -> DataFrame:
    """Headers (trailing blanks dropped) and data rows of one sheet per workbook; fails where the sheet is missing.

    ``cells`` are those stored: with merged ranges expanded, headers would repeat and rows be too many."""
    missing = F.assert_true(F.array_contains("sheet_names", sheet), F.concat(F.lit(f"no sheet {sheet} in "), F.col("workbook")))
    sheets = sheets.where(missing.isNull()).where(F.col("sheet") == sheet)
    heads = cells.where((F.col("sheet") == sheet) & (F.col("row") == header_row) & (strip(F.coalesce("value.s", F.lit(""))) != ""))
    named = heads.groupBy("workbook").agg(F.map_from_entries(F.collect_list(F.struct("col", F.col("value.s")))).alias("by_col"), F.max("col").alias("width"))
    named = named.select("workbook", "width", F.transform(F.sequence(F.lit(1), "width"), lambda i: F.coalesce(F.try_element_at("by_col", i), F.lit(""))).alias("headers"))
    inside = cells.where(F.col("sheet") == sheet).join(named.select("workbook", "width"), "workbook").where((F.col("col") <= F.col("width")) & (F.coalesce("value.s", F.lit("")) != ""))
    last = inside.groupBy("workbook").agg(F.max("row").alias("last"))
    out = sheets.join(named, "workbook", "left").join(last, "workbook", "left")
    return out.select("workbook", "sheet", F.lit(header_row).alias("header_row"), F.coalesce("headers", F.array().cast("array<string>")).alias("headers"), F.lit(header_row + 1).alias("data_start_row"), F.greatest(F.coalesce("last", F.lit(header_row)), F.lit(header_row)).alias("data_end_row"), "merged_ranges", "frozen_panes", "data_validations", "named_ranges", "sheet_names")


def controlled_vocabulary(cells: DataFrame, column: str = "C", sheet: str = "Values") -> DataFrame:
    """workbook, row, value of the vocabulary in its order, first spelling of each entry."""
    v = cells.where((F.col("sheet") == sheet) & (F.col("col") == column_number(column))).select("workbook", "row", strip(F.coalesce("value.s", F.lit(""))).alias("value"))
    v = v.where((F.col("value") != "") & ~F.lower("value").isin("questiontype", "question type"))
    first = Window.partitionBy("workbook", normalize_case_insensitive("value")).orderBy("row")
    return v.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WorkbookSource(DataSource):
    """``spark.read.format("workbook_cells").load(folder or file)``, one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "workbook_cells"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        p = Path(self.path.removeprefix("file://"))
        return [_File(str(f)) for f in (sorted(p.glob("*.xlsx")) if p.is_dir() else [p])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from cell_rows(partition.path, parse(Path(partition.path).read_bytes())[0])


_ESCAPE = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"})


def _cell_xml(row: int, col: int, value: object) -> str:
    ref = f"{column_letters(col)}{row}"
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value}</v></c>'
    text = str(value)
    if len(text) > MAX_CELL_CHARS:
        raise ValueError(f"cell {ref} is longer than {MAX_CELL_CHARS} characters")
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text.translate(_ESCAPE)}</t></is></c>'


def write_workbook(path: str | Path | io.BytesIO, sheets: dict[str, list[list[object]]], merged: dict[str, list[str]] | None = None, panes: dict[str, str] | None = None) -> None:
    """A new workbook from rows by sheet."""
    merged, panes = merged or {}, panes or {}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{n.translate(_ESCAPE)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, (name, rows) in enumerate(sheets.items(), 1):
            body = "".join(f'<row r="{r}">{"".join(_cell_xml(r, c, v) for c, v in enumerate(row, 1))}</row>' for r, row in enumerate(rows, 1))
            view = f'<sheetViews><sheetView workbookViewId="0"><pane topLeftCell="{panes[name]}" state="frozen"/></sheetView></sheetViews>' if name in panes else ""
            area = f'<mergeCells>{"".join(f"""<mergeCell ref="{m}"/>""" for m in merged[name])}</mergeCells>' if merged.get(name) else ""
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet xmlns="{MAIN}">{view}<sheetData>{body}</sheetData>{area}</worksheet>')


def write_from_template(template: str | Path, out: str | Path, sheet: str, header_row: int, rows: Iterable[tuple] = ()) -> dict[str, object]:
    """Clone a template, blank what stands below the header, write ``rows`` there; other parts stay byte for byte.

    ``rows`` may be a DataFrame's ``toLocalIterator()`` in sequence order.  Returns a report."""
    out = Path(out)
    out.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(template) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        ids = {s.get("name"): s.get(f"{{{REL}}}id") for s in book.iter(_N + "sheet")}
        if sheet not in ids:
            shutil.copyfile(template, out)
            return {"path": str(out), "rows_written": 0, "sheet_found": False}
        target = rels[ids[sheet]]
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        xml = z.read(part).decode()
        kept = re.sub(r"<row\b[^>]*?\br=\"(\d+)\"[^>]*?(?:/>|>.*?</row>)", lambda m: m[0] if int(m[1]) <= header_row else "", xml, flags=re.S)
        written = 0
        body = []
        for row in rows:
            written += 1
            r = header_row + written
            body.append(f'<row r="{r}">{"".join(_cell_xml(r, c, v) for c, v in enumerate(row, 1))}</row>')
        new = "".join(body)
        kept = kept.replace("</sheetData>", new + "</sheetData>", 1) if "</sheetData>" in kept else kept.replace("<sheetData/>", f"<sheetData>{new}</sheetData>", 1)
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
            for item in z.infolist():
                w.writestr(item, kept if item.filename == part else z.read(item.filename))
    return {"path": str(out), "rows_written": written, "sheet_found": True}


#: Fixed value of the format: rows of a sheet.
MAX_ROWS = 1_048_576


def build_workbooks(rows: DataFrame, merged: dict[str, list[str]] | None = None, panes: dict[str, str] | None = None) -> DataFrame:
    """(path, content) of a workbook for each ``workbook``, written on executors.

    ``rows`` are (workbook, sheet, row, values); rows that are missing are blank, sheets come by name.  A workbook is
    one file and so one group; more rows than a sheet can hold fail."""

    def build(table: pa.Table) -> pa.Table:
        sheets: dict[str, list[list[object]]] = {}
        for r in sorted(table.select(["sheet", "row", "values"]).to_pylist(), key=lambda r: (r["sheet"], r["row"])):
            if r["row"] > MAX_ROWS:
                raise ValueError(f"row {r['row']} of sheet {r['sheet']} is beyond {MAX_ROWS}")
            body = sheets.setdefault(r["sheet"], [])
            body.extend([] for _ in range(r["row"] - 1 - len(body)))
            body.append(r["values"])
        out = io.BytesIO()
        write_workbook(out, sheets, merged, panes)
        return pa.table({"path": table["workbook"][:1], "content": pa.array([out.getvalue()], pa.binary())})

    return rows.select("workbook", "sheet", "row", "values").groupBy("workbook").applyInArrow(build, "path string, content binary")


#: The template's header row and number of columns.
TEMPLATE_HEADER_ROW, TEMPLATE_COLUMNS = 13, 28


def lint_template(template: str | Path, sheet: str, header_row: int = TEMPLATE_HEADER_ROW, columns: int = TEMPLATE_COLUMNS, names: Iterable[str] = ()) -> list[str]:
    """What is wrong with a template, in words; nothing if its header row, columns and named ranges are as they must be."""
    sheets, defined = parse(Path(template).read_bytes())
    found = next((s for s in sheets if s.name == sheet), None)
    if found is None:
        return [f"no sheet {sheet}"]
    heads = [c for (r, c), (kind, value, _) in found.cells.items() if r == header_row and (_text(kind, value) or "").strip()]
    problems = [] if len(heads) == columns and sorted(heads) == list(range(1, columns + 1)) else [f"row {header_row} has {len(heads)} headers up to column {max(heads, default=0)}, not {columns}"]
    return problems + [f"no named range {n}" for n in names if n not in defined]


def version_of(template: str | Path, version: str) -> str:
    """A template's version: the given one and the start of the file's digest."""
    return f"{version}+sha:{hashlib.sha256(Path(template).read_bytes()).hexdigest()[:12]}"


def require_version(template: str | Path, pinned: str) -> None:
    """Refuses a template whose content is not that of the pinned version."""
    found = version_of(template, pinned.partition("+")[0])
    if found != pinned:
        raise ValueError(f"template {template} has version {found}, not {pinned}")
