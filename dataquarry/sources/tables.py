"""Reading tables: Parquet, CSV with a sniffed delimiter, Excel workbooks."""

from __future__ import annotations

import csv
import io
import logging
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import groupby
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataquarry.functions.scalars import nan_to_null
from dataquarry.operators.columns import col
from dataquarry.runtime import materialise

log = logging.getLogger(__name__)

SIZE_WARNING_MB = 1500
DELIMITERS = ",;\t|"
# CSV records that a task hands over at a time.
RECORDS = 4096
_END = "\u0001end\u0001"

# The tokens read as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# The tokens read as booleans.
TRUE_TOKENS, FALSE_TOKENS = ["True", "TRUE", "true"], ["False", "FALSE", "false"]

_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?inf(inity)?\s*$"


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with NaN read as null; columns and filters still reach the scan."""
    return nan_to_null(spark.read.parquet(path))


def sniff_delimiter(header: str) -> str:
    """The delimiter of a header line; a comma when none stands out."""
    try:
        return csv.Sniffer().sniff(header, DELIMITERS).delimiter
    except csv.Error:
        found = [d for d in DELIMITERS if d in header]
        return max(found, key=header.count) if found else ","


def header_names(cells: list[str | None]) -> list[str]:
    """Column names of a header: empty cells are ``Unnamed: i``, repeated names get ``.1``, ``.2``, ..."""
    plain = [c if c else f"Unnamed: {i}" for i, c in enumerate(cells)]
    out: list[str] = []
    for name in plain:
        new, n = name, 0
        while new in out or (n and new in plain):
            n += 1
            new = f"{name}.{n}"
        out.append(new)
    return out


class CsvLines:
    """Where records end, seen line by line: a line break within a quoted field is none.

    A field is quoted if it begins with a quote; a doubled quote within it is a quote, and
    what follows the closing quote up to the delimiter belongs to the field.
    """

    def __init__(self, sep: str):
        other = f"[^{re.escape(sep)}]*+"
        quoted = '"[^"]*+(?:""[^"]*+)*+"(?!")' + other
        field = f'(?:{quoted}|(?!"){other})'
        #: A line that is a whole record; Java and Python read this pattern alike.
        self.pattern = f"{field}(?:{re.escape(sep)}{field})*+"
        self.sep = sep
        self._whole = re.compile(self.pattern, re.DOTALL)
        self._rest = re.compile('[^"]*+(?:""[^"]*+)*+"(?!")', re.DOTALL)

    def ends_inside(self, line: str, inside: bool) -> bool:
        """Whether a quoted field is still open at the line's end, if one was or was not at its begin."""
        if inside:
            closed = self._rest.match(line)
            if not closed:
                return True
            at = line.find(self.sep, closed.end())
            if at < 0:
                return False
            line = line[at + len(self.sep) :]
        return '"' in line and not self._whole.fullmatch(line)


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The lines of every input split of a task: ``((file, where it begins), lines)``."""
    rows = ((f, b, t) for batch in batches for f, b, t in zip(*(c.to_pylist() for c in batch.columns)))
    for at, lines in groupby(rows, key=lambda r: (r[0], r[1])):
        yield at, (line for _, _, line in lines)


def _split_states(lines: DataFrame, csv_lines: CsvLines) -> dict[tuple[str, int], tuple[bool, int, bool]]:
    """By split: whether it begins inside a record, where that record began, and whether its own first record is the file's first.

    Every split is read for both states it may begin in, as how it truly begins is only known
    from the splits before it; one row for a split comes back, of which the driver holds a record anyway.
    """

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), texts in _by_split(batches):
            out, inside, returned = False, True, False
            for text in texts:
                returned = returned or not inside
                out, inside = csv_lines.ends_inside(text, out), csv_lines.ends_inside(text, inside)
                if out == inside and returned:
                    for text in texts:  # noqa: B020  both are the same from here on
                        out = csv_lines.ends_inside(text, out)
                    inside = out
            yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "out": [out], "inside": [inside], "returned": [returned]})

    found = lines.mapInArrow(both, "file string, block bigint, out boolean, inside boolean, returned boolean").collect()
    states: dict[tuple[str, int], tuple[bool, int, bool]] = {}
    for file, splits in groupby(sorted(found, key=lambda r: (r["file"], r["block"])), key=lambda r: r["file"]):
        open_, origin, first = False, 0, True
        for r in splits:
            states[file, r["block"]] = (open_, origin, first)
            begins = not open_ or r["returned"]
            open_ = r["inside"] if open_ else r["out"]
            if begins:
                origin, first = r["block"], False
    return states


def _records_with_breaks(lines: DataFrame, csv_lines: CsvLines) -> DataFrame:
    """``record`` texts of files in which records may go over several lines; headers are left out.

    Splits are read in parallel.  Records that cross a border come as pieces, which meet
    again under the split in which the record began.
    """
    states = lines.sparkSession.sparkContext.broadcast(_split_states(lines, csv_lines))
    kinds = pa.schema([
        ("file", pa.string()), ("origin", pa.int64()), ("block", pa.int64()), ("piece", pa.bool_()), ("header", pa.bool_()), ("record", pa.string()),
    ])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)
            held.clear()
            return out

        for (file, block), texts in _by_split(batches):
            inside, origin, header = states.value[file, block]
            piece, parts = inside, []
            for text in texts:
                parts.append(text)
                inside = csv_lines.ends_inside(text, inside)
                if not inside:
                    held.append((file, origin if piece else block, block, piece, header and not piece, "\n".join(parts)))
                    header, piece, parts = header and piece, False, []
                    if len(held) >= RECORDS:
                        yield batch()
            if parts:
                held.append((file, origin if piece else block, block, True, header and not piece, "\n".join(parts)))
        if held:
            yield batch()

    found = materialise(
        lines.mapInArrow(assemble, "file string, origin bigint, block bigint, piece boolean, header boolean, record string"), "csv-records"
    )
    joined = (
        found.filter("piece").groupBy("file", "origin")
        .agg(F.max("header").alias("header"), F.array_sort(F.collect_list(F.struct("block", "record"))).alias("parts"))
        .filter("not header").select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    )
    return found.filter("not piece and not header").select("record").unionByName(joined)


def _first_record(lines: DataFrame) -> str:
    """The first record of a file, with the line breaks in its quoted fields."""
    few, at = 1, lines.select("file").first()
    if at is None:
        return ""
    own = lines.filter(F.col("file") == at["file"])
    while True:
        texts = [r["value"] for r in own.limit(few).collect()]
        inside = False
        for n, text in enumerate(texts, 1):
            # Before the delimiter is known, a record ends where the quotes are in pairs.
            inside ^= text.count('"') % 2 == 1
            if not inside:
                return "\n".join(texts[:n])
        if len(texts) < few:
            return texts[0] if texts else ""
        few *= 16


def scan_csv_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """CSV as strings, delimiter sniffed from the header.

    Large files are read in splits, also where quoted fields (header names too) hold line
    breaks: see ``_records_with_breaks``; without such breaks every line is a record, and
    nothing leaves the JVM.  Lines end with LF or CR LF; blank ones are left out.  Every file
    has a header.  Rows with too few fields are padded with nulls, rows with too many are left
    out, and empty fields are null.
    """
    source = spark.read.option("lineSep", "\n").text(path)
    lines = source.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    head = _first_record(lines).rstrip("\r")
    if not head:
        raise ValueError(f"no columns in {path}")
    sep = sniff_delimiter(head)
    names = header_names(next(csv.reader(io.StringIO(head.lstrip("\ufeff"), newline=""), delimiter=sep)))
    csv_lines = CsvLines(sep)
    fields = [f"c{i}" for i in range(len(names))]
    options = {"sep": sep, "escape": '"', "nullValue": "", "emptyValue": "", "mode": "PERMISSIVE"}

    def parsed(record: Column) -> Column:
        """The fields of a record with ``_END`` behind the last one: it is missing if there are too many."""
        wider = ", ".join(f"{f} string" for f in [*fields, "extra"])
        return F.from_csv(F.concat(record, F.lit(sep + _END)), wider, {**options, "multiLine": "true"})

    fits = lambda r: F.array_contains(F.array(*[r[f] for f in [*fields, "extra"]]), _END)
    broken = lines.filter(F.contains("value", F.lit('"')) & ~F.col("value").rlike(f"(?s)^{csv_lines.pattern}$"))
    if broken.isEmpty():
        # Only malformed rows carry their raw text; a pruned parser does not count the fields.
        rows = (
            spark.read.options(**options, header=True, enforceSchema=True, columnPruning=False, columnNameOfCorruptRecord="_raw")
            .schema(", ".join(f"{f} string" for f in [*fields, "_raw"])).csv(path)
        )
        # Spark refuses to read the raw text alone (as a count would): always read a field too.
        kept = rows.filter((F.col("_raw").isNull() | fits(parsed(F.col("_raw")))) & (F.length(F.concat_ws("", "c0")) >= 0)).drop("_raw")
    else:
        records = _records_with_breaks(lines, csv_lines).select(F.regexp_replace("record", "\r$", "").alias("r"))
        rows = records.filter(F.trim("r") != "").select(parsed(F.col("r")).alias("r")).filter(fits(F.col("r")))
        kept = rows.select(*[F.nullif(F.col("r")[f], F.lit(_END)).alias(f) for f in fields])
    return kept.toDF(*names)


def infer_types(df: DataFrame) -> DataFrame:
    """Cast string columns to BIGINT, DOUBLE or BOOLEAN where every value allows it; one pass.

    A column of missing values only becomes DOUBLE.
    """
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not strings:
        return df
    value = {c: F.when(~col(c).isin(NA_TOKENS), col(c)) for c in strings}

    def misses(c: str):
        v = value[c]
        return F.struct(
            F.count_if(v.isNotNull() & ~(v.rlike(_INTEGER) & F.trim(v).try_cast("bigint").isNotNull())).alias("bigint"),
            F.count_if(v.isNotNull() & ~v.rlike(_NUMBER)).alias("double"),
            F.count_if(v.isNotNull() & ~v.isin(TRUE_TOKENS + FALSE_TOKENS)).alias("boolean"),
            F.count(v).alias("n"),
        )

    row = df.agg(*[misses(c).alias(str(i)) for i, c in enumerate(strings)]).first()
    kinds = {}
    for i, c in enumerate(strings):
        m = row[i]
        fits = [k for k in ("bigint", "double", "boolean") if m[k] == 0]
        kinds[c] = "double" if m["n"] == 0 else (fits[0] if fits else "string")
    out = []
    for f in df.schema:
        kind = kinds.get(f.name)
        if kind is None:
            out.append(col(f.name))
        elif kind == "string":
            out.append(value[f.name].alias(f.name))
        else:
            out.append(F.trim(value[f.name]).try_cast(kind).alias(f.name))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return infer_types(scan_csv_sniffed(spark, path))


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# The built-in number formats that show dates or times.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
_DATE_CELL = "timestamp "


def _column_number(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _first_sheet_name(book: zipfile.ZipFile) -> str:
    """The part that holds the first sheet in the workbook's own order."""
    names = book.namelist()
    sheet = next(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"), None) if "xl/workbook.xml" in names else None
    if sheet is not None and "xl/_rels/workbook.xml.rels" in names:
        for relation in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            if relation.get("Id") == sheet.get(f"{_RELATION}id"):
                target = relation.get("Target", "")
                return target[1:] if target.startswith("/") else f"xl/{target}"
    return min((n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n)), key=lambda n: int(re.search(r"\d+", n)[0]))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = set()
    for f in root.iter(f"{_SHEET}numFmt"):
        letters = re.sub(r'"[^"]*"|\\.|\[(?![hms]+\])[^\]]*\]', "", f.get("formatCode", "").lower())
        if re.search(r"[dmyhs]", letters.split(";")[0]) and "general" not in letters:
            custom.add(int(f.get("numFmtId")))
    cells = root.find(f"{_SHEET}cellXfs")
    formats = [int(x.get("numFmtId", 0)) for x in cells] if cells is not None else []
    return {i for i, f in enumerate(formats) if f in _DATE_FORMATS or f in custom}


def _as_timestamp(serial: str, from_1904: bool) -> str:
    """A serial day number as a timestamp, to the millisecond."""
    days = float(serial)
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30 if days >= 60 else 31)
    return _DATE_CELL + (start + timedelta(milliseconds=round(days * 86_400_000))).isoformat(sep=" ")


def _first_sheet(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first worksheet of an .xlsx file."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_SHEET}t")))
        dates = _date_styles(book)
        properties = next(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}workbookPr"), None) if "xl/workbook.xml" in names else None
        from_1904 = properties is not None and properties.get("date1904") in ("1", "true")
        for row in ElementTree.fromstring(book.read(_first_sheet_name(book))).iter(f"{_SHEET}row"):
            cells: list[str | None] = []
            for at, c in enumerate(row.iter(f"{_SHEET}c")):
                place = _column_number(c.get("r")) if c.get("r") else at
                cells += [None] * (place + 1 - len(cells))
                kind, v = c.get("t"), c.find(f"{_SHEET}v")
                if kind == "inlineStr":
                    cells[place] = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
                elif v is not None and v.text is not None:
                    text = shared[int(v.text)] if kind == "s" else v.text
                    if kind in (None, "n") and int(c.get("s", 0)) in dates:
                        text = _as_timestamp(text, from_1904)
                    cells[place] = {"0": "False", "1": "True"}[text] if kind == "b" else text
            yield cells


def parse_workbooks(files: DataFrame) -> DataFrame:
    """``(path, row_no, cells)`` of the first sheet of every workbook in ``(path, content)``.

    One workbook is one record: it is parsed where it is read.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                header: list[str] | None = None
                rows: list[tuple] = []
                for cells in _first_sheet(bytes(content)):
                    if header is None:
                        header = header_names([(c or "").removeprefix(_DATE_CELL) for c in cells])
                        continue
                    pairs = {h: cells[i] if i < len(cells) else None for i, h in enumerate(header)}
                    rows.append((name, len(rows) + 1, pairs))
                yield pd.DataFrame(rows, columns=["path", "row_no", "cells"])

    return files.select("path", "content").mapInPandas(parse, "path string, row_no bigint, cells map<string,string>")


def workbook_table(rows: DataFrame) -> DataFrame:
    """Parsed workbooks as one typed table; only the header names reach the driver."""
    heads = rows.filter("row_no = 1").select(F.posexplode(F.map_keys("cells")).alias("at", "name"))
    names = [r["name"] for r in heads.groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()]
    table = rows.select(*[F.col("cells")[n].alias(n) for n in names])
    if not names:
        return table
    # A column of dates only becomes a timestamp; among other values a date stays text.
    other = table.agg(*[F.count_if(~col(n).startswith(_DATE_CELL)).alias(str(i)) for i, n in enumerate(names)],
                      *[F.count(col(n)).alias(f"n{i}") for i, n in enumerate(names)]).first()
    dated = {n for i, n in enumerate(names) if other[f"n{i}"] and not other[str(i)]}
    text = {n: F.when(col(n).startswith(_DATE_CELL), F.substring(col(n), len(_DATE_CELL) + 1, 40)).otherwise(col(n)) for n in names}
    return infer_types(table.select(*[(text[n].cast("timestamp") if n in dated else text[n]).alias(n) for n in names]))


def scan_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheets of the .xlsx files under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return workbook_table(materialise(parse_workbooks(files), "workbooks"))


def path_size(spark: SparkSession, path: str) -> tuple[bool, int]:
    """Whether a path exists, and its total length in bytes, from the file system's listing."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return False, 0
    return True, fs.getContentSummary(jvm_path).getLength()


def scan_auto(spark: SparkSession, path: str, warning_mb: float = SIZE_WARNING_MB) -> DataFrame:
    """Read by extension; missing files and unknown extensions are errors."""
    exists, size = path_size(spark, path)
    if not exists:
        raise FileNotFoundError(path)
    if size > warning_mb * 1024 * 1024:
        log.warning("%s holds %.0f MB, above %s MB", path, size / 1024 / 1024, warning_mb)
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if name.endswith(".parquet"):
        return scan_parquet(spark, path)
    if name.endswith(".csv"):
        return read_csv(spark, path)
    if name.endswith(".xlsx"):
        return scan_excel(spark, path)
    raise ValueError(f"unsupported file type: {path}")
