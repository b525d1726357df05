"""Delimited text with either quote character, and its writer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fields(line: str, separator: str) -> list[str]:
    """Fields of a line. A field may be enclosed by " or ', from its first character on; a doubled quote in it stays doubled.

    White space before a field is skipped; behind it only for white-space separators and in the last field. An empty line or an
    open quote is an error.
    """
    if not line.strip():
        raise ValueError("empty line")
    out, at, n = [], 0, len(line)
    while True:
        while at < n and line[at].isspace() and line[at] != separator:
            at += 1
        if at < n and line[at] in "\"'":
            quote, start = line[at], at + 1
            at = start
            while True:
                end = line.find(quote, at)
                if end < 0:
                    raise ValueError("open quote")
                if line[end + 1 : end + 2] != quote:
                    break
                at = end + 2
            out.append(line[start:end])
            at = line.find(separator, end)
            at = n if at < 0 else at
        else:
            end = line.find(separator, at)
            end = n if end < 0 else end
            text = line[at:end]
            out.append(text.rstrip() if separator.isspace() or end == n else text)
            at = end
        if at >= n:
            return out
        at += 1
        if at == n:
            return [*out, ""]


def tokenize(lines: Column, separator: str) -> Column:
    """Struct of fields and error; one of them is null."""

    @F.pandas_udf("fields array<string>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for x in s:
                try:
                    rows.append((fields(x, separator), None))
                except ValueError as e:
                    rows.append((None, str(e)))
            yield pd.DataFrame(rows, columns=["fields", "error"])

    return run(lines)


_GUESS = {"csv": ",", "tsv": "\t", "psmtsv": "\t", "txt": "\t", "ssl": "\t", "deepnovo_denovo": "\t"}


def guess_separator(path: str) -> str:
    return _GUESS.get(re.sub(r"\.gz$", "", path.lower()).rsplit(".", 1)[-1], ",")


def read_delimited(spark: SparkSession, path: str, separator: str | None = None, header: list[str] | None = None) -> DataFrame:
    """line, values (map of lower-case header to text), error: of every line but the header.

    Compressed files by extension; a byte-order mark is dropped; a first line such as sep=; sets the separator. A header given here
    is used as it is, and the first line skipped only if it is the same. A line of another width has an error and no values.
    """
    lines = spark.read.text(path)
    head = [r["value"].lstrip("﻿") for r in lines.limit(2).collect()]
    own = head[0] if head else ""
    skip = []
    if own.lower().startswith("sep=") and len(own) > 4:
        separator = separator or own[4]
        skip.append(own)
        own = head[1] if len(head) > 1 else ""
    separator = separator or guess_separator(path)
    names = [x.lower() for x in fields(own, separator)] if own.strip() else []
    if header is None:
        skip.append(own)
    else:
        skip += [own] if names == [x.lower() for x in header] else []
        names = [x.lower() for x in header]
    rows = lines.select(F.regexp_replace("value", "^﻿", "").alias("line"))
    rows = rows.where(~F.col("line").isin(skip)) if skip else rows
    rows = rows.withColumn("t_", tokenize(F.col("line"), separator))
    wide = F.when(F.size("t_.fields") != len(names), F.concat(F.lit(f"{len(names)} columns expected, found "), F.size("t_.fields").cast("string")))
    rows = rows.withColumn("error", F.coalesce("t_.error", wide))
    keys = F.array(*(F.lit(x) for x in names)) if names else F.array().cast("array<string>")
    return rows.select("line", F.when(F.col("error").isNull(), F.map_from_arrays(keys, F.col("t_.fields"))).alias("values"), "error")


def text_column(values: Column | str, *names: str, empty: tuple[str, ...] = ("", "-")) -> Column:
    """The trimmed text under the first of the names that is there; null for the texts in `empty`."""
    values = F.col(values) if isinstance(values, str) else values
    text = F.trim(F.coalesce(*(values[n.lower()] for n in names)))
    return F.when(~text.isin(*empty), text) if empty else text


def number_column(values: Column | str, *names: str, kind: str = "double") -> Column:
    """A number, null where the text is none."""
    text = text_column(values, *names)
    return F.try_to_number(text, F.lit("")) if kind == "" else text.try_cast(kind)


def or_empty(text: Column) -> Column:
    """Null for an empty text and for a dash."""
    return F.when(~text.isin("", "-"), text)


def ignore(text: Column, pattern: str) -> Column:
    """Null for exactly this text."""
    return F.when(text != pattern, text)


def skip(text: Column, n: int) -> Column:
    """Without the first n characters."""
    return F.substring(text, F.lit(n + 1), F.greatest(F.length(text) - n, F.lit(0)))


def trim_matches(text: Column, start: str = "", end: str = "") -> Column:
    """Without repeats of `start` at the beginning and of `end` at the end."""
    text = F.regexp_replace(text, f"^(?:{re.escape(start)})+", "") if start else text
    return F.regexp_replace(text, f"(?:{re.escape(end)})+$", "") if end else text


def split_once(text: Column, separator: str) -> tuple[Column, Column]:
    """Text before and behind the first separator; nulls without one."""
    at = F.instr(text, separator)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)), F.when(at > 0, F.substring(text, at + len(separator), F.length(text)))


def between(text: Column, first: str, last: str) -> tuple[Column, Column, Column]:
    """Text before the first `first`, up to the last `last` behind it, and behind that."""
    m = f"(?s)^(.*?){re.escape(first)}(.*){re.escape(last)}(.*)$"
    return tuple(F.regexp_extract(text, m, k) for k in (1, 2, 3))  # type: ignore[return-value]


def good_and_bad(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())


def to_lines(rows: DataFrame, separator: str = ",") -> DataFrame:
    """value: one line per row, without a header. Quotes only around fields that hold the separator or begin with a quote, " in them becomes '."""

    def field(c: str) -> Column:
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        return F.when(F.contains(text, F.lit(separator)) | F.rlike(text, F.lit("^\\s*[\"']")), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit("'")), F.lit('"'))).otherwise(text)

    return rows.select(F.concat_ws(separator, *(field(c) for c in rows.columns)).alias("value"))


def write_delimited(tables: list[DataFrame], path: str, separator: str = ",", one_file: bool = False) -> list[str]:
    """Rows of all tables, over the union of their columns in the order they are first met; returns the header, which is the first line of each file."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t, allowMissingColumns=True)
    header = separator.join(rows.columns)
    lines = to_lines(rows, separator)
    lines = lines.coalesce(1) if one_file else lines

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [header]})
        yield from batches

    lines.mapInPandas(headed, "value string").write.text(path)
    return rows.columns
