"""Line operators: grep with the enclosing method, and the overlap chunker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import text as T

HEADER = r"(?iuU)^\s*(?:Процедура|Функция|Procedure|Function)\s+(\w+)\s*\("


def lines(files: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """One row a line, numbered from 1."""
    whole = F.regexp_replace(F.regexp_replace(F.col(text), "^﻿", ""), "\r\n?", "\n")
    return files.select(*keep, F.posexplode(F.split(whole, "\n", -1)).alias("n", "line")).withColumn("line_number", F.col("n") + 1).drop("n")


def with_header(rows: DataFrame, file: str, header: Column, name: str = "in_method") -> DataFrame:
    """Carries the last header at or above a row (by line_number) along."""
    w = Window.partitionBy(file).orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(header, ignorenulls=True).over(w))


def _last_part(x) -> Column:
    return F.nullif(F.regexp_extract(x, HEADER, 1), F.lit(""))


def grep(files: DataFrame, name: str, file: str = "file_path", text: str = "text", limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Whole-word, case-blind usages of a name with the method around them.

    Files without the name drop out first. The others' lines are folded inside the row: the fold carries the last header
    along and keeps the lines that hit, so no line is shuffled and rows of one file key never mix.
    """
    hit = T.usage_pattern(name)
    keep = [c for c in files.columns if c != text]
    whole = F.regexp_replace(F.regexp_replace(F.col(text), "^﻿", ""), "\r\n?", "\n")
    start = F.expr("named_struct('n', 0, 'header', cast(null as string), 'hits', cast(array() as array<struct<line_number: int, line: string, header: string>>))")

    def step(acc, line):
        n, header = acc["n"] + 1, F.coalesce(_last_part(line), acc["header"])
        one = F.array(F.struct(n.alias("line_number"), line.alias("line"), header.alias("header")))
        return F.struct(n.alias("n"), header.alias("header"), F.when(line.rlike(hit), F.concat(acc["hits"], one)).otherwise(acc["hits"]).alias("hits"))

    found = F.aggregate(F.split(whole, "\n", -1), start, step, lambda acc: acc["hits"])
    rows = files.where(F.col(text).rlike(hit)).select(*keep, F.explode(found).alias("_hit"))
    rows = rows.select(*keep, "_hit.line_number", T.line_content(F.col("_hit.line")).alias("line_content"), F.coalesce("_hit.header", F.lit("")).alias("in_method"))
    rows = rows.orderBy(*(order or [file]), "line_number") if limit else rows
    return rows.limit(limit) if limit else rows


def chunks(code, most: int = 844, overlap: int = 165) -> Column:
    """Array of parts of at most ``most`` characters of whole lines, each but the first led by the last lines of the one before.

    A fold in the row itself: pending lines are closed when the next one would not fit.
    """
    carry = max(1, overlap // 40)
    start = F.expr("named_struct('done', cast(array() as array<string>), 'cur', cast(array() as array<string>), 'len', 0)")

    def step(acc, line):
        cost = F.length(line) + 1
        full = (acc["len"] + cost > most) & (F.size(acc["cur"]) > 0)
        tail = F.slice(acc["cur"], F.greatest(F.lit(1), F.size(acc["cur"]) - carry + 1), F.lit(carry))
        tail_len = F.aggregate(tail, F.lit(0), lambda s, x: s + F.length(x) + 1)
        one = F.array(line)
        closed = F.concat(acc["done"], F.array(F.array_join(acc["cur"], "\n")))
        return F.when(full, F.struct(closed.alias("done"), F.concat(tail, one).alias("cur"), (tail_len + cost).alias("len"))).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["cur"], one).alias("cur"), (acc["len"] + cost).alias("len")))

    done = F.aggregate(F.split(T._c(code), "\n", -1), start, step)
    return F.concat(done["done"], F.when(F.size(done["cur"]) > 0, F.array(F.array_join(done["cur"], "\n"))).otherwise(F.expr("cast(array() as array<string>)")))


def method_chunks(code, most: int = 844, overlap: int = 165) -> Column:
    """Parts of a method, each between its first and last line; whole where it is short, one line, or its body fits."""
    x = T._c(code)
    own = F.split(x, "\n", -1)
    body = F.array_join(F.slice(own, F.lit(2), F.greatest(F.lit(0), F.size(own) - 2)), "\n")
    whole = (F.length(x) <= most) | (F.size(own) < 3) | (F.length(body) <= most)
    return F.when(whole, F.array(x)).otherwise(F.transform(chunks(body, most, overlap), lambda p: F.concat_ws("\n", own[0], p, F.element_at(own, -1))))
