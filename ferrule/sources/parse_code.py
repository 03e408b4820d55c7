"""Methods of a source module. One Arrow-batched function; what follows it is DataFrame work."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions import constants as K

METHOD = "struct<method_type: string, method_name: string, params: string, signature: string, is_export: boolean, directive: string, code: string, body: string, comments: array<string>, module_variables: array<string>>"
_PREPROCESSOR = re.compile(r"(?im)^[ \t]*#(?:Если|Иначе|ИначеЕсли|КонецЕсли|Область|КонецОбласти|If|Else|ElsIf|EndIf|Region|EndRegion)\b[^\n]*$")
_HEAD = re.compile(r"(?im)^[ \t]*(Процедура|Функция|Procedure|Function)\s+(\w+)\s*\(([^)]*)\)[ \t]*(Экспорт|Export)?[ \t]*(?://[^\n]*)?$")
_END = re.compile(r"(?im)^[ \t]*(?:КонецПроцедуры|КонецФункции|EndProcedure|EndFunction)\b")
_VARIABLE = re.compile(r"(?im)^[ \t]*(?:Перем|Var)\s+(\w+)")
_DIRECTIVE = re.compile(r"(?i)&(" + "|".join(K.DIRECTIVES) + r")\b")
_RUSSIAN = {"procedure": "Процедура", "function": "Функция"}
LOOK_BACK = 10


def parse_module(text: str | None) -> list[dict]:
    """Methods in order; for a module without any, one row for its code; nothing for a blank one."""
    text = (text or "").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    text = _PREPROCESSOR.sub("", text)
    variables = _VARIABLE.findall(text[: m.start()] if (m := _HEAD.search(text)) else text)
    out, at = [], 0
    while head := _HEAD.search(text, at):
        end = _END.search(text, head.end())
        if end is None:
            break
        above = text[: head.start()].rstrip("\n").split("\n")[-LOOK_BACK:]
        comments, directive = [], ""
        for line in reversed(above):
            line = line.strip()
            if line.startswith("//"):
                comments.append(line.lstrip("/").strip())
            elif line.startswith("&"):
                directive = directive or (d[1] if (d := _DIRECTIVE.match(line)) else "")
            elif line:
                break
        kind = head[1].lower()
        kind = _RUSSIAN.get(kind, kind.capitalize())
        params = head[3].strip()
        out.append({
            "method_type": kind, "method_name": head[2], "params": params, "signature": f"{kind} {head[2]}({params})" + (" Экспорт" if head[4] else ""), "is_export": bool(head[4]),
            "directive": directive, "code": text[head.start() : end.end()].strip("\n"), "body": text[head.end() : end.start()].strip("\n"), "comments": comments[::-1], "module_variables": variables or None,
        })
        at = end.end()
    if not out and text.strip():
        out.append({"method_type": "Модуль", "method_name": "", "params": "", "signature": "", "is_export": False, "directive": "", "code": text, "body": text, "comments": [], "module_variables": variables or None})
    return out


def methods_of(text: Column) -> Column:
    @F.pandas_udf(f"array<{METHOD}>")
    def run(texts: pd.Series) -> pd.Series:
        def safe(x):
            try:
                return parse_module(x)
            except Exception:  # one bad file is no reason to lose the scan
                return []

        return texts.map(safe)

    return run(text)


def methods(files: DataFrame) -> DataFrame:
    """A row a method of files with column text."""
    return files.withColumn("m", F.explode(methods_of(F.col("text")))).drop("text").select("*", "m.*").drop("m")


def module_info(files: DataFrame) -> DataFrame:
    """Directives in use, size and lines of each module."""
    return files.select("file_path", F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?iuU)&(" + "|".join(K.DIRECTIVES) + r")\b"), F.lit(1))).alias("directives"), F.length("text").alias("size"), F.size(F.split("text", "\n", -1)).alias("line_count"))
