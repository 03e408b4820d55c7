"""WARC derivative builder: responses become linked metadata and plain-text conversion records.

Every response record gives two new ones. Both carry its target URI and date, refer to it by ``WARC-Refers-To``, and the
metadata record (``application/warc-fields``) keeps its source's HTTP status line, each header line as it stands, its
digests as they stand, whether they hold, and the links to the conversion. The conversion record holds the plain text of
an HTML payload: comments, scripts, styles and tags go, blocks end lines, character references of all kinds are read.
Record ids are UUIDs made from the response's id and the record's kind, so that a job that runs again writes the same
records. Digests are SHA-256 over the new block.

``write`` and ``read`` keep records whose blocks are UTF-8 text in WARC/1.1 files, which Spark splits between records.

Defined results: a null or empty block gives empty headers, payload and text; a block without HTTP headers is all
payload; a response without an id of its own gets one made from URI, date and block; a response that stands on several
rows is one record on several rows, and its derived records have equal ids; equal pages of different page_id are different
records. All is built row by row, without a shuffle; a text of any length takes time linear in it. Columns other than a
record's go along, unless they have the name of one that is added.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ferrule.llm.common import prepare, row_of

RECORD = "record_id string, warc_type string, target_uri string, date string, refers_to string, content_type string, block string, block_digest string, payload_digest string"
CRLF = "\r\n"


def _uuid(*parts) -> Column:
    """A UUID of version 8 layout from an MD5 of the parts."""
    h = F.md5(F.concat_ws("\n", *parts))
    cut = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _digest(block) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(block, "UTF-8"), 256))


#: What is markup. Whatever is opened and not closed runs to the end of the text, so nothing is looked at twice.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|</?(?P<tag>[a-z][^\s>/]*+)(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_BLOCKS = frozenset("br p div li ul ol h1 h2 h3 h4 h5 h6 tr table title head body article section nav header footer".split())
_SPACE, _LINES = re.compile(r"[ \t\r\f\xa0]+"), re.compile(r" ?\n[ \n]*")


def _instead(m: re.Match) -> str:
    if m["tag"] is None:
        return " "
    return "\n" if m["tag"].lower() in _BLOCKS else ""


def text_of(page: str) -> str:
    """The plain text of HTML."""
    x = html.unescape(_MARKUP.sub(_instead, page))
    return _LINES.sub("\n", _SPACE.sub(" ", x)).strip(" \n")


@F.pandas_udf(StringType())
def plain_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in pages:
        yield part.map(text_of, na_action="ignore")


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of fetched pages (page_id, url, html): the page under an HTTP header of its own."""
    body = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(head, body)
    uri = F.coalesce(F.col("url"), F.lit(""))
    own = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return pages.select(
        "page_id", _uuid(F.lit("response"), own, uri, F.lit(date), _digest(block)).alias("record_id"), F.lit("response").alias("warc_type"), uri.alias("target_uri"), F.lit(date).alias("date"), F.lit(None).cast("string").alias("refers_to"),
        F.lit("application/http; msgtype=response").alias("content_type"), block.alias("block"), _digest(block).alias("block_digest"), _digest(body).alias("payload_digest"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """The metadata and the conversion record of every response among records, with source_payload_digest."""
    prepare(records.sparkSession)
    added = {x.split()[0] for x in RECORD.split(", ")} | {"source_payload_digest"}
    own = [F.col(f"row.`{c}`") for c in records.columns if c not in added]
    rows = row_of(records.where("warc_type = 'response'"))
    block = F.coalesce("row.block", F.lit(""))
    crlf, lf = F.position(F.lit(CRLF + CRLF), block), F.position(F.lit("\n\n"), block)
    gap = F.when((lf > 0) & ((crlf == 0) | (lf < crlf)), 2).otherwise(4)
    end = F.when(gap == 2, lf).otherwise(crlf)
    http = block.startswith("HTTP/")
    parts = rows.select(
        "row",
        F.when(~http, "").when(end > 0, F.substr(block, F.lit(1), end - 1)).otherwise(block).alias("head"),
        F.when(~http, block).when(end > 0, F.substr(block, end + gap)).otherwise("").alias("payload"),
        F.coalesce("row.record_id", _uuid(F.lit("response"), F.coalesce("row.target_uri", F.lit("")), F.coalesce("row.date", F.lit("")), _digest(block))).alias("source"),
    )
    parts = parts.select("row", "head", "source", plain_text("payload").alias("text"), _uuid(F.lit("conversion"), "source").alias("conversion"))
    lines = F.split("head", "\r\n|\r|\n", -1)
    headers = F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.concat(F.lit("http-header: "), x))

    def line(name: str, value) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(name + ": "), value))

    given = F.col("row.block_digest")
    holds = F.when(given.isNull(), F.lit(None)).when(~given.startswith("sha256:"), "unchecked").when(given == _digest(block), "yes").otherwise("no")
    fields = F.concat_ws(
        CRLF, line("http-status", F.get(lines, F.lit(0))), F.when(F.size(headers) > 0, F.array_join(headers, CRLF)), line("source-content-type", F.col("row.content_type")), line("source-block-digest", given), line("source-payload-digest", F.col("row.payload_digest")),
        line("source-block-digest-holds", holds), line("conversion", F.col("conversion")), line("conversion-digest", _digest(F.col("text"))), F.lit(""),
    )

    def record(kind: str, rid: Column, content: str, body: Column) -> Column:
        return F.struct(rid.alias("record_id"), F.lit(kind).alias("warc_type"), F.col("row.target_uri").alias("target_uri"), F.col("row.date").alias("date"), F.col("source").alias("refers_to"), F.lit(content).alias("content_type"), body.alias("block"))

    both = F.array(record("metadata", _uuid(F.lit("metadata"), "source"), "application/warc-fields", fields), record("conversion", F.col("conversion"), "text/plain; charset=utf-8", F.col("text")))
    out = parts.select("row", F.explode(both).alias("r"))
    digest = _digest(F.col("r.block"))
    return out.select(*own, "r.*", digest.alias("block_digest"), digest.alias("payload_digest"), F.col("row.payload_digest").alias("source_payload_digest"))


def serialized(records: DataFrame) -> DataFrame:
    """Adds record: the WARC/1.1 bytes of each row."""
    head = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "warc_type"), F.concat(F.lit("WARC-Record-ID: "), "record_id"), F.when(F.col("target_uri") != "", F.concat(F.lit("WARC-Target-URI: "), "target_uri")), F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Refers-To: "), "refers_to"), F.concat(F.lit("WARC-Block-Digest: "), "block_digest"), F.concat(F.lit("WARC-Payload-Digest: "), "payload_digest"), F.concat(F.lit("Content-Type: "), "content_type"), F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    )
    return records.withColumn("record", F.encode(F.concat(head, F.lit(CRLF + CRLF), "block", F.lit(CRLF + CRLF)), "UTF-8"))


def write(records: DataFrame, path: str, compression: str = "none") -> None:
    """WARC/1.1 files of records, a file a task."""
    whole = F.decode("record", "UTF-8")
    # The writer ends every record with what parts it from the next.
    rows = serialized(records).select(F.substr(whole, F.lit(1), F.length(whole) - 4).alias("value"))
    rows.write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records (columns of RECORD) of WARC/1.1 files whose blocks are UTF-8 text, and whole: whether the block has its stated length.

    Files are split between records; a block that itself holds the first line of a record falls apart and is not whole.
    """
    rows = spark.read.option("lineSep", f"{CRLF}{CRLF}WARC/1.1{CRLF}").text(path).select(F.regexp_replace("value", rf"^WARC/1\.1{CRLF}", "").alias("v"))
    cut = F.position(F.lit(CRLF + CRLF), F.col("v"))
    head, rest = F.substr("v", F.lit(1), cut - 1), F.substr("v", cut + 4)
    size = F.regexp_extract(head, rf"(?i)(?:^|{CRLF})Content-Length: *([0-9]+)", 1)
    # The last record of a file ends with what parts records.
    block = F.when(rest.endswith(CRLF + CRLF) & (F.octet_length(rest).cast("string") != size), F.substr(rest, F.lit(1), F.length(rest) - 4)).otherwise(rest)

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract(head, rf"(?i)(?:^|{CRLF}){name}: *([^\r\n]*)", 1), F.lit(""))

    names = {"record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "content_type": "Content-Type"}
    digests = {"block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest"}
    return rows.where(cut > 0).select(*[field(v).alias(k) for k, v in names.items()], block.alias("block"), *[field(v).alias(k) for k, v in digests.items()], (F.octet_length(block).cast("string") == size).alias("whole"))
