"""Lines of exports into valid records and, apart from them, the failed lines with their reason and place."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.functions.grammar import SyntaxFault, csv_record, csv_run, json_record, starts_record, whole_record
from tidewrack.functions.keys import blank
from tidewrack.operators.ranking import running
from tidewrack.session import materialize

#: Columns of a CSV file whose first line is missing. The layout of the exports.
CSV_COLUMNS = ("artifact_id", "source", "container_id", "parent_id", "sender_id", "ts", "text")
_BOM = "﻿"
#: ``fields`` are all fields of a loaded line in their order: name, type, and the value as text (of objects and arrays their JSON).
_PARSED = T.StructType(
    [T.StructField("reason", T.StringType()), T.StructField("fault_at", T.IntegerType()), T.StructField("fault", T.StringType()), T.StructField("artifact_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("fields", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "type", "value")])))]
)
Parsed = tuple[str | None, int | None, str | None, str | None, str | None, list[tuple[str, str, str | None]] | None]


def parse_json_line(line: str, whole: bool = True) -> Parsed:
    """(reason or None, place, what is wrong, artifact_id, text, all fields if ``whole``) of a line of a .jsonl file."""
    try:
        kind, found = json_record(line, None if whole else ("artifact_id", "text"))
    except SyntaxFault as e:
        return "bad_json", e.at, e.why, None, None, None
    if kind != "object":
        return "not_object", 0, kind, None, None, None
    id_kind, id_ = found.get("artifact_id", ("null", ""))
    text_kind, text = found.get("text", ("null", ""))
    if id_kind == "null" or (id_kind == "string" and not id_.strip()):
        return "no_id", None, None, None, None, None
    if id_kind not in ("string", "number"):
        return "bad_value", None, f"artifact_id is {id_kind}", None, None, None
    if text_kind not in ("string", "null"):
        return "bad_value", None, f"text is {text_kind}", None, None, None
    fields = [(name, k, None if k == "null" else v) for name, (k, v) in found.items()] if whole else None
    return None, None, None, id_.strip(), text if text_kind == "string" else None, fields


def parse_csv_line(line: str, header: list[str], whole: bool = True) -> Parsed:
    """As parse_json_line, of a line of a .csv file whose header has these names; all its fields are strings."""
    try:
        values = csv_record(line.rstrip("\r\n"))
    except SyntaxFault as e:
        return "bad_quoting", e.at, e.why, None, None, None
    if len(values) != len(header):
        return "column_count", None, f"{len(values)} values, {len(header)} columns", None, None, None
    row = dict(zip(header, values, strict=True))
    id_ = row.get("artifact_id", "").strip()
    if not id_:
        return "no_id", None, None, None, None, None
    return None, None, None, id_, row.get("text"), [(name, "string", v) for name, v in zip(header, values, strict=True)] if whole else None


class Headers:
    """Column names of header lines, each read once."""

    def __init__(self):
        self.known: dict[str | None, list[str]] = {}

    def __call__(self, line: str | None) -> list[str]:
        if line not in self.known:
            try:
                self.known[line] = [c.strip() for c in csv_record(line.lstrip(_BOM).rstrip("\r\n"))] if line else [*CSV_COLUMNS]
            except SyntaxFault:
                self.known[line] = [*CSV_COLUMNS]
        return self.known[line]


def _parser(whole: bool) -> Callable[..., Column]:
    @F.pandas_udf(_PARSED)
    def parse(name: pd.Series, line: pd.Series, first: pd.Series) -> pd.DataFrame:
        header = Headers()
        rows = [parse_csv_line(x, header(h), whole) if n.lower().endswith(".csv") else parse_json_line(x, whole) for n, x, h in zip(name, line, first, strict=True)]
        return pd.DataFrame(rows, columns=_PARSED.names).astype({"fault_at": "Int32"})

    return parse


def parse_lines(lines: DataFrame, whole: bool = True) -> DataFrame:
    """Each line that is neither blank nor a header: file_name, line_no, line, reason (null: loaded), fault_at, fault, artifact_id, text, fields (null unless ``whole``).

    Null, empty and blank lines and a byte-order mark on line 1 are no failures. ``duplicate_id`` goes to every
    line but the first (file_name, then line_no) that loads with an artifact_id. A line delivered twice under one
    number counts twice. The first line of an id comes from a pre-aggregated minimum, so a hot id never gathers in
    one task; the join back is split by adaptive execution where an id is hot.
    """
    is_csv = F.lower("file_name").endswith(".csv")
    x = lines.select("file_name", "line_no", "line").where(F.col("file_name").isNotNull())
    header = x.where(is_csv & (F.col("line_no") == 1)).groupBy("file_name").agg(F.min("line").alias("first"))
    body = F.when(F.col("line_no") == 1, F.regexp_replace("line", "^﻿", "")).otherwise(F.col("line"))
    x = x.withColumn("body", body).where(~blank(F.col("body")))
    csv = x.where(is_csv & (F.coalesce(F.col("line_no"), F.lit(0)) != 1)).join(header, "file_name", "left")
    x = x.where(~is_csv).withColumn("first", F.lit(None).cast("string")).unionByName(csv)
    p = materialize(x.withColumn("p", _parser(whole)("file_name", "body", "first")).select("file_name", "line_no", "line", "p.*"))
    firsts = p.where(F.col("reason").isNull()).groupBy("artifact_id").agg(F.min(F.struct("file_name", "line_no")).alias("first"), F.count("*").alias("n")).where("n > 1")
    p = p.join(firsts, "artifact_id", "left")
    again = F.col("reason").isNull() & F.col("first").isNotNull() & (F.col("first") != F.struct("file_name", "line_no"))
    return p.select(
        "file_name", "line_no", "line", F.when(again, F.lit("duplicate_id")).otherwise(F.col("reason")).alias("reason"), "fault_at",
        F.when(again, F.concat(F.lit("first in "), F.col("first.file_name"), F.lit(":"), F.col("first.line_no").cast("string"))).otherwise(F.col("fault")).alias("fault"), "artifact_id", "text", "fields",
    )


def valid_records(lines: DataFrame) -> DataFrame:
    """file_name, line_no, artifact_id, text, fields of the lines that load; ``fields`` are all of the line, in order, with type and value."""
    return parse_lines(lines).where(F.col("reason").isNull()).select("file_name", "line_no", "artifact_id", "text", "fields")


def failed_lines(lines: DataFrame) -> DataFrame:
    """file_name, line_no, reason, fault_at, fault, line of the lines that don't load."""
    return parse_lines(lines, whole=False).where(F.col("reason").isNotNull()).select("file_name", "line_no", "reason", "fault_at", "fault", "line")


_RECOVERED = T.ArrayType(
    T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("lines", T.IntegerType()), T.StructField("reason", T.StringType()), T.StructField("fault", T.StringType()), T.StructField("artifact_id", T.StringType()), T.StructField("text", T.StringType())])
)


@F.pandas_udf(T.StringType())
def _role(line: pd.Series, first: pd.Series) -> pd.Series:
    """``whole``, ``start`` or ``part`` of a record."""
    header = Headers()
    return pd.Series(["whole" if whole_record(x, n := len(header(h))) is not None else "start" if starts_record(x, n) else "part" for x, h in zip(line, first, strict=True)])


@F.pandas_udf(_RECOVERED)
def _recover(run: pd.Series, first: pd.Series) -> pd.Series:
    header, out = Headers(), []
    for lines, h in zip(run, first, strict=True):
        names, found = header(h), []
        for i, n, values, fault in csv_run([x["line"] for x in lines], len(names)):
            row = dict(zip(names, values, strict=True)) if values and len(values) == len(names) else {}
            reason = "bad_quoting" if values is None else "column_count" if not row else None if row.get("artifact_id", "").strip() else "no_id"
            loaded = reason is None
            found.append({"line_no": int(lines[i]["line_no"]), "lines": n, "reason": reason, "fault": str(fault) if fault else None, "artifact_id": row["artifact_id"].strip() if loaded else None, "text": row.get("text") if loaded else None})
        out.append(found)
    return pd.Series(out)


def recovered_records(lines: DataFrame) -> DataFrame:
    """file_name, line_no, lines, reason (null: loaded), fault, artifact_id, text of each record of the .csv files, read as files: quoted values may hold line breaks.

    A line that proves to start a record is an anchor. The lines from one anchor to the next are read together, so a broken
    quote costs no more than these, and a file is never one task: anchors before a line are counted by ranges, and whole
    one-line records are not grouped at all. Null and blank lines and headers are no records; a line delivered twice under one number counts once.
    """
    x = lines.select("file_name", "line_no", "line").where(F.lower("file_name").endswith(".csv") & F.col("line_no").isNotNull() & F.col("line").isNotNull())
    x = x.groupBy("file_name", "line_no").agg(F.min("line").alias("line"))
    header = x.where("line_no = 1").select("file_name", F.col("line").alias("first"))
    x = x.where("line_no > 1").join(header, "file_name", "left").withColumn("role", _role("line", "first"))
    x = running(x.withColumn("anchor", F.when(F.col("role") != "part", 1).otherwise(0).cast("bigint")), ["file_name"], ["line_no"], "anchor", F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "before")
    at = (F.col("before") + F.col("anchor")).alias("run")
    alone = x.where("role = 'whole'").select("file_name", "first", F.array(F.struct("line_no", "line")).alias("lines"))
    runs = x.where("role <> 'whole'").groupBy("file_name", "first", at).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines")).drop("run")
    return alone.unionByName(runs).select("file_name", F.explode(_recover("lines", "first")).alias("r")).select("file_name", "r.*")


def shortened(line: Column, most: int = 200) -> Column:
    """The beginning of a line for a report, with its line breaks written as ``\\n``."""
    return F.replace(F.left(line, F.lit(most)), F.lit("\n"), F.lit("\\n"))
