"""JSON logs, score manifests, code books and workbooks."""

from __future__ import annotations

import csv
import io
import os
import re
import subprocess
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORE_SCHEMA = "agent string, metric string, value_num double, value_str string, doc_id string, run_id string, metadata map<string,string>, ts double, seq bigint"
#: Rows that a workbook or a report takes at most; both are made on the driver.
SHEET_LIMIT = 100_000
#: Bytes of a workbook or code book that is read on the driver.
SHEET_BYTES = 200_000_000


def read_records(spark: SparkSession, path: str, schema: str | T.StructType, task: str | None = None) -> DataFrame:
    """Lines of JSON with a declared layout; blank lines are skipped, broken ones raise."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows if task is None else rows.where(F.col("task") == task)


def default_log(variable: str = "GAUGEWORKS_LOG") -> str:
    """Where run records go if no path is given: the environment's, else one below the home folder."""
    return os.environ.get(variable) or os.path.join(os.path.expanduser("~"), ".gaugeworks", "runs.jsonl")


def git_snapshot(folder: str = ".") -> dict[str, object]:
    """Commit, branch and whether files are changed, of a work tree; empty outside one."""

    def git(*words: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True, timeout=10, check=True)
        except (OSError, subprocess.SubprocessError):
            return None
        return done.stdout.strip()

    commit = git("rev-parse", "HEAD")
    if commit is None:
        return {}
    return {"commit": commit, "branch": git("rev-parse", "--abbrev-ref", "HEAD"), "changed": bool(git("status", "--porcelain"))}


def record_day(timestamp: Column) -> Column:
    """The UTC day of a record's ISO timestamp; null for other texts. The session's zone is UTC."""
    return F.to_date(F.try_to_timestamp(timestamp))


def append_records(df: DataFrame, path: str, timestamp: str = "timestamp") -> None:
    """Appends records as lines of JSON; a missing timestamp is now."""
    if timestamp in df.columns:
        df = df.withColumn(timestamp, F.coalesce(timestamp, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")))
    else:
        df = df.withColumn(timestamp, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
    df.write.mode("append").json(path)


def emit_scores(scores: DataFrame, metrics: DataFrame, path: str) -> None:
    """Appends scores to a manifest, one line of JSON each with its keys in order. A metric that
    the catalog lacks is an error before anything is written."""
    from gaugeworks.operators.scorecard import checked

    line = F.to_json(F.struct(*sorted(scores.columns)), {"ignoreNullFields": "false"})
    checked(scores, metrics).select(line.alias("value")).write.mode("append").text(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORE_SCHEMA).json(path)


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def dotted(record: Column, path: str) -> Column:
    """A value inside raw JSON by its dotted path, as text; null if a hop is missing."""
    return F.get_json_object(record, "$." + path)


def workbook_kind(columns: list[str], name: str = "") -> str:
    """What a workbook holds, from its headers and name."""
    low = " ".join(columns).lower()
    if "sweep" in name.lower() or "notes" in [c.lower() for c in columns]:
        return "sweep"
    if "subtype accuracy" in low or "subtype_accuracy" in low:
        return "sorter"
    return "extraction" if "overall" in low or "extraction" in low else "unknown"


def export_columns(specs: list[dict]) -> list[Column]:
    """Columns from specs {header, expr}: ordered projections over nested records."""
    return [F.expr(s["expr"]).alias(s["header"]) for s in specs]


def _cell(value: object) -> str:
    if value is None or value != value:
        return "<c/>"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
    return f"<c><v>{value!r}</v></c>"


def workbook_bytes(sheets: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """A minimal workbook: a frozen header row and an automatic filter on each sheet."""
    ns = "http://schemas.openxmlformats.org"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        ids = range(1, len(sheets) + 1)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in ids) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="rId1" Type="{ns}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(ids, sheets, strict=True)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{ns}/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{ns}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids) + "</Relationships>")
        for i, (header, rows) in zip(ids, sheets.values(), strict=True):
            body = "".join(f"<row>{''.join(map(_cell, r))}</row>" for r in [header, *rows])
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{ns}/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


CODEBOOK = ["column", "type", "description", "source", "example"]


_URL = re.compile(r"[A-Za-z][\w+.-]+:")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a small file wherever the session's file systems reach."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file from wherever the session's file systems reach; at most SHEET_BYTES."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).getLen() > SHEET_BYTES:
        raise ValueError(f"{path} is larger than {SHEET_BYTES} bytes")
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def write_workbook(path: str, df: DataFrame, sheet: str, codebook: list[tuple] | None = None) -> None:
    """Writes a bounded frame (and a code book) as a workbook on the driver."""
    from gaugeworks.runtime import bounded_rows

    sheets = {sheet: (df.columns, [tuple(r) for r in bounded_rows(df, SHEET_LIMIT, "a sheet")])}
    if codebook is not None:
        sheets["Codebook"] = (CODEBOOK, codebook)
    _put(df.sparkSession, path, workbook_bytes(sheets))


def _put(spark: SparkSession | None, path: str, data: bytes) -> None:
    if spark is not None and _URL.match(path):
        write_bytes(spark, path, data)
    else:
        with open(path, "wb") as f:
            f.write(data)


def write_codebook(path: str, codebook: list[tuple], spark: SparkSession | None = None) -> None:
    out = io.StringIO(newline="")
    w = csv.writer(out)
    w.writerow(CODEBOOK)
    w.writerows(codebook)
    _put(spark, path, out.getvalue().encode())


def write_sweep(log: DataFrame, raw: str, row_id: str, folder: str, version: str | None = None, notes: dict[str, str] | None = None) -> tuple[str, int]:
    """The workbook and the code book of the champion's runs; the workbook's path and rows."""
    from gaugeworks.operators.export import codebook, sorter_columns, sweep_frame

    frame = sweep_frame(log, raw, row_id, version, notes).drop(row_id)
    columns = sorter_columns() + ([("Notes", F.lit(None))] if notes else [])
    book, path = codebook(columns, frame), f"{folder.rstrip('/')}/model_sweep.xlsx"
    write_workbook(path, frame, "Eval Results", book)
    write_codebook(f"{folder.rstrip('/')}/codebook.csv", book, log.sparkSession)
    return path, read_sheet(log.sparkSession, path, "Eval Results").count()


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """A sheet of a workbook as text and double columns; names are compared without case. A
    sheet with more than SHEET_LIMIT rows is an error."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(read_bytes(spark, path)) if _URL.match(path) else path) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        names = {s.get("name").lower(): s.get(rel) for s in book.find("m:sheets", ns)}
        if sheet.lower() not in names:
            raise KeyError(sheet)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        root = ElementTree.fromstring(z.read("xl/" + targets[names[sheet.lower()]].lstrip("/").removeprefix("xl/")))
    rows: list[list] = []
    for row in root.iter(f"{{{ns['m']}}}row"):
        line: list = []
        for c in row:
            ref = re.match(r"[A-Z]+", c.get("r") or "")
            if ref:
                at = 0
                for ch in ref[0]:
                    at = at * 26 + ord(ch) - 64
                line += [None] * (at - 1 - len(line))
            v = c.find("m:v", ns)
            if c.get("t") == "inlineStr":
                line.append("".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")))
            elif v is None:
                line.append(None)
            elif c.get("t") == "s":
                line.append(shared[int(v.text)])
            else:
                line.append(v.text if c.get("t") == "str" else float(v.text))
        rows.append(line)
        if len(rows) > SHEET_LIMIT + 1:
            raise ValueError(f"{sheet} has more than {SHEET_LIMIT} rows")
    header = [str(h) for h in rows[0]] if rows else []
    body = [r + [None] * (len(header) - len(r)) for r in rows[1:]]
    number = [all(isinstance(r[i], float) or r[i] is None for r in body) and any(r[i] is not None for r in body) for i in range(len(header))]
    schema = T.StructType([T.StructField(h, T.DoubleType() if n else T.StringType()) for h, n in zip(header, number, strict=True)])
    data = [tuple(v if n or v is None else str(v) for v, n in zip(r, number, strict=False)) for r in body]
    return spark.createDataFrame(data, schema)


# Headers of workbooks and the columns of a table of runs.
RUN_HEADERS = {
    "DATE": "run_date", "Experiment Name": "experiment_name", "SAMPLE (n)": "sample_n", "MODEL": "model", "Prompt Version": "prompt_version", "Temperature": "temperature",
    "Doc Type Accuracy": "doc_type_accuracy", "Subtype Accuracy": "subtype_accuracy", "Subtype Accuracy (equiv)": "subtype_accuracy_equiv", "Average Confidence": "average_confidence",
    "Rows Completed": "rows_completed", "Rows Failed": "rows_failed", "Subtype Accuracy CI (lo)": "subtype_ci_lo", "Subtype Accuracy CI (hi)": "subtype_ci_hi",
    "Failures: n Failed": "failures_n", "Cost Estimated USD": "cost_estimated_usd", "Overall Extraction": "overall_extraction",
}


def run_table(frame: DataFrame) -> DataFrame:
    """A workbook's sheet or an export as a table of runs: known headers get its column names,
    others stay; ``result_id`` numbers the rows if there is none."""
    out = frame.withColumnsRenamed({h: c for h, c in RUN_HEADERS.items() if h in frame.columns})
    words = {"run_date", "experiment_name", "model", "prompt_version"}
    kinds = dict(out.dtypes)  # an empty column of a sheet or a CSV file is text
    measures = [c for c in out.columns if kinds[c] == "string" and (c in RUN_HEADERS.values() and c not in words or c.startswith(("Accuracy: ", "Failures: ")))]
    out = out.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in measures})
    out = out.withColumns({c: F.col(c).cast("bigint") for c in ("sample_n", "rows_completed", "rows_failed", "failures_n") if c in out.columns})
    if "result_id" not in out.columns:
        out = out.withColumn("result_id", F.monotonically_increasing_id())
    if "run_date" in out.columns:
        out = out.withColumn("run_date", F.try_to_timestamp(F.col("run_date").cast("string")))
    return out


def read_runs(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A table of runs from Parquet, CSV, a workbook (sheet Eval Results) or a run log in lines
    of JSON, by the ending of ``path``; of a log the sorter's runs, or the extractor's if
    ``kind`` is extraction."""
    from gaugeworks.operators.export import export_frame, extraction_columns, sorter_columns
    from gaugeworks.taxonomy import EXTRACTION_TASK, SORTER_TASK

    low = path.lower()
    if low.endswith(".xlsx"):
        return run_table(read_sheet(spark, path, "Eval Results"))
    if low.endswith(".csv"):
        return run_table(spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"'))
    if low.endswith((".jsonl", ".json")):
        extraction = kind == "extraction"
        lines = spark.read.text(path).where("trim(value) <> ''")
        return run_table(export_frame(lines, "value", extraction_columns() if extraction else sorter_columns(), task=EXTRACTION_TASK if extraction else SORTER_TASK))
    return run_table(spark.read.parquet(path))
