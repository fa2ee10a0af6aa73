"""Dictionaries and schemas that aren't XML: i18n CSV files and GraphQL definitions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces

ROWS = "array<struct<key: string, value: string, line: int>>"
TYPES = "array<struct<kind: string, name: string, line: int, interfaces: array<string>, members: array<string>, fields: array<struct<name: string, type: string, line: int, resolver: string>>>>"


def csv_rows(text: str | None) -> list[dict]:
    """Rows of two fields or more, with the line on which each begins. Quoted fields may hold lines and doubled quotes."""
    out: list[dict] = []
    fields, field, line, begins, at, quoted = [], "", 1, 1, 0, False
    text = (text or "").removeprefix("﻿")

    def close():
        if len(fields) >= 2:
            out.append({"key": fields[0], "value": fields[1], "line": begins})

    while at < len(text):
        c = text[at]
        line += c == "\n"
        if quoted:
            if c == '"' and text[at + 1 : at + 2] == '"':
                field += c
                at += 1
            elif c == '"':
                quoted = False
            else:
                field += c
        elif c == '"' and not field:
            quoted = True
        elif c == ",":
            fields.append(field)
            field = ""
        elif c == "\n":
            fields.append(field)
            close()
            fields, field, begins = [], "", line
        elif c != "\r":
            field += c
        at += 1
    if field or fields:
        fields.append(field)
        close()
    return out


def translations(files: DataFrame) -> DataFrame:
    """The rows of CSV dictionaries: the files' columns but content and piece, key, value, line, and reset where both are equal."""
    kept = [c for c in files.columns if c not in ("content", *pieces.PIECES)]
    before = F.coalesce("before", F.lit(0)).alias("__before") if "before" in files.columns else F.lit(0).alias("__before")
    rows = files.select(*kept, before, F.explode(F.udf(csv_rows, ROWS, useArrow=True)("content")).alias("r"))
    return rows.select(*kept, "r.key", "r.value", (F.col("r.line") + F.col("__before")).cast("int").alias("line"), (F.col("r.key") == F.col("r.value")).alias("reset"))


def dictionary(rows: DataFrame, order: list[str]) -> DataFrame:
    """The last value of each key; a row of equal key and value takes back what came before."""
    last = rows.groupBy("key").agg(F.max_by(F.struct("value", "reset"), F.struct(*order)).alias("r"))
    return last.filter("NOT r.reset").select("key", "r.value")


def graphql_types(text: str | None) -> list[dict]:
    """Types of a schema with their fields and resolver directives; comments and descriptions are passed over."""
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())
    code = re.sub(r'"""(?:.|\n)*?"""', blank, text or "")
    code = re.sub(r"#[^\n]*", blank, code)
    out = []
    for m in re.finditer(r"\b(?:extend\s+)?(type|interface|input|enum|union|scalar)\s+(\w+)([^{}=]*)(\{|=([^{}]*?)(?=\b(?:extend|type|interface|input|enum|union|scalar)\s+\w|\Z))?", code):
        kind, name, head, opens, union = m.groups()
        body, end = "", m.end()
        if opens == "{":
            depth, end = 1, m.end()
            while end < len(code) and depth:
                depth += {"{": 1, "}": -1}.get(code[end], 0)
                end += 1
            body = code[m.end() : end - 1]
        line = lambda at: code.count("\n", 0, at) + 1
        interfaces = re.findall(r"\w+", re.search(r"\bimplements\s+([\w\s,&]+)", head).group(1)) if "implements" in head else []
        fields = []
        if kind in ("type", "interface", "input"):
            for f in re.finditer(r"(\w+)\s*(\((?:[^()]|\([^()]*\))*\))?\s*:\s*([\w\[\]!]+)((?:[^\S\n]*(?:@\w+\s*(?:\((?:[^()]|\([^()]*\))*\))?|=\s*\S+))*)", body):
                resolver = re.search(r'@resolver\s*\(\s*class:\s*"((?:[^"\\]|\\.)*)"', f.group(4))
                fields.append({"name": f.group(1), "type": f.group(3), "line": line(m.end() + f.start()), "resolver": resolver.group(1).replace("\\\\", "\\").lstrip("\\") if resolver else None})
        members = re.findall(r"\w+", union) if union else re.findall(r"^\s*(\w+)", body, re.M) if kind == "enum" else []
        out.append({"kind": kind, "name": name, "line": line(m.start()), "interfaces": interfaces, "members": members, "fields": fields})
    return out


def schemas(files: DataFrame) -> DataFrame:
    """A row per type definition: the files' columns but content, and kind, name, line, interfaces, members, fields."""
    kept = [c for c in files.columns if c != "content"]
    return files.select(*kept, F.inline(F.udf(graphql_types, TYPES, useArrow=True)("content")))
