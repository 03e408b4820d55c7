"""Token ids in a binary file format: every document compressed by itself under one shared zstandard dictionary.

A set is a folder with two Parquet tables, written and read by Spark alone, so any store will do and a lost
executor's files are written again by Spark's committer:

* ``dictionary``: one row, the trained dictionary and its SHA-256.
* ``shards``: runs of documents in ascending doc_id order. ``body`` holds one zstandard frame a document over its
  ids (little-endian unsigned 32-bit), end id included; ``index`` is the offset index: doc_id, offset of the frame,
  ids before it in the partition, number of ids (four little-endian signed 64-bit columns, one after the other;
  a doc_id mask follows as bytes, 0 for null). ``dictionary_sha256`` names the dictionary the frames need.

A short document is read by its shard's ``first_id``/``last_id`` (Parquet statistics prune the rest), one look in
the index and one frame. Partitions are cut by range of doc_id, so their starts are the running sums of as many
numbers as there are partitions.

Texts are parted at spaces and line feeds, which the tokenizer drops, and each distinct part is encoded once and
kept in a bounded memo if it is short: plain parts piece by piece with the library's model, others with its whole pipeline.
For another tokenizer, ``split=False`` gives it whole texts.

Defined results: a null text is empty and has the end id alone; null doc_ids come first; rows with equal doc_id
follow each other in order of a hash of their ids, and may lie in several partitions, however many they are; an empty
table gives an empty set; extra columns are ignored. Id arrays of more than ``LONG`` bytes don't train the dictionary,
which is for short ones.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import Scratch, prepare, tidy

END_ID, SHARD_BYTES, MEMO, LONGEST = 1, 4 << 20, 800_000, 14
#: Bytes of ids of one partition, about, and of the longest sample.
PART_BYTES, LONG = 64 << 20, 20_000
#: Documents, about, that the dictionary is trained on (by hash of the id; at most twice as many) and its size.
SAMPLE, DICTIONARY_BYTES, LEVEL = 2000, 64 << 10, 3
SHARD_SCHEMA = "part int, shard int, first_id long, last_id long, n_docs long, n_ids long, dictionary_sha256 string, index binary, body binary"


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), {}


#: Parts of these characters alone are the same under the tokenizer's normalizer but for case, and its pattern
#: cuts them into runs of letters, single digits and runs of the rest; the model then takes each by itself.
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level letters: printable bytes stand for themselves, the others for code points from 256 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in same]
    return {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


def encode_texts(texts: list[str | None], path: str, split: bool = True, end: int = END_ID) -> list[bytes]:
    """Little-endian 32-bit ids of each text, with the end id."""
    tok, memo = _encoder(path)
    tail = np.uint32(end).tobytes()
    if not split:
        return [np.array(e.ids, "<u4").tobytes() + tail for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    model = tok.model

    def piece(p: str) -> bytes:
        letters = p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in model.tokenize(letters)]).tobytes()

    out = []
    for i in range(0, len(texts), 64):
        group = [(t or "").replace("\n", " ").split(" ") for t in texts[i : i + 64]]
        if len(memo) > MEMO:
            memo.clear()
        rest, once = [], []
        for w in set().union(*group).difference(memo):
            if len(w) > LONGEST:
                once.append(w)
            low = w.lower()
            if low.isalpha() and (low.isascii() or _PLAIN.fullmatch(low)):  # ASCII letters are plain
                ids = memo.get(low) or piece(low)
                memo[w] = ids
                if len(w) <= LONGEST:
                    memo[low] = ids
            elif "<|" not in w and _PLAIN.fullmatch(w):
                pieces = _PIECES.findall(low)
                for p in pieces:
                    if p not in memo:
                        memo[p] = piece(p)
                memo[w] = b"".join([memo[p] for p in pieces])
            else:
                rest.append(w)
        for w, e in zip(rest, tok.encode_batch(rest, add_special_tokens=False), strict=True):
            memo[w] = np.array(e.ids, "<u4").tobytes()
        out += [b"".join(map(memo.__getitem__, words)) + tail for words in group]
        for w in once:  # long words seldom come again
            del memo[w]
    return out


def _encode(path, split):
    def run(batches):
        for batch in batches:
            narrow, wide = [], []
            for x in encode_texts(batch.column(1).to_pylist(), path, split):
                ids = np.frombuffer(x, "<u4")
                small = ids.max() < 65536
                narrow.append(ids.astype("<u2").tobytes() if small else None)
                wide.append(None if small else x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(narrow, pa.binary()), pa.array(wide, pa.binary())], ["doc_id", "narrow", "wide"])

    return run


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from serialized id arrays; a raw one of their bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, threads=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _write_shards(dictionary: bytes, level: int, shard_bytes: int):
    digest = hashlib.sha256(dictionary).hexdigest()

    def run(batches):
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        part, shard, before = None, 0, 0
        docs, frames, sizes = [], [], []
        held = 0

        def flush():
            nonlocal shard, before, docs, frames, sizes, held
            n = np.array(sizes, "<i8")
            starts = before + np.concatenate(([0], np.cumsum(n)))
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype("<i8")
            known = [d for d in docs if d is not None]
            index = b"".join(x.astype("<i8").tobytes() for x in (np.array([d or 0 for d in docs]), offsets[:-1], starts[:-1], n)) + bytes(d is not None for d in docs)
            row = [part, shard, known[0] if known else None, known[-1] if known else None, len(docs), int(n.sum()), digest, index, b"".join(frames)]
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32()] * 2 + [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()], strict=True)], ["part", "shard", "first_id", "last_id", "n_docs", "n_ids", "dictionary_sha256", "index", "body"])
            shard, before, docs, frames, sizes, held = shard + 1, int(starts[-1]), [], [], [], 0
            return out

        for batch in batches:
            for p, d, narrow, wide in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = p
                ids = wide if wide is not None else np.frombuffer(narrow, "<u2").astype("<u4").tobytes()
                frames.append(press.compress(ids))
                docs.append(d)
                sizes.append(len(ids) // 4)
                held += len(frames[-1])
                if held >= shard_bytes:
                    yield flush()
        if docs:
            yield flush()

    return run


def frames_of(index: bytes, body: bytes, n: int):
    """doc_id, ids before it in the partition, number of ids, frame of each document of a shard."""
    docs, offsets, starts, sizes = np.frombuffer(index, "<i8", 4 * n).reshape(4, n)
    known = np.frombuffer(index, np.uint8, n, 32 * n)
    ends = np.append(offsets[1:], len(body))
    for i in range(n):
        yield int(docs[i]) if known[i] else None, int(starts[i]), int(sizes[i]), body[offsets[i] : ends[i]]


class TokenSet:
    """A written set in ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def shards(self) -> DataFrame:
        return self.spark.read.schema(SHARD_SCHEMA).parquet(f"{self.root}/shards")

    def dictionary(self) -> bytes:
        row = self.spark.read.parquet(f"{self.root}/dictionary").first()
        if hashlib.sha256(row.bytes).hexdigest() != row.sha256:
            raise ValueError("the dictionary's digest does not hold")
        return bytes(row.bytes)

    def get(self, doc_id: int) -> list[list[int]]:
        """The id arrays of one document (as many as rows had its id)."""
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(self.dictionary()))
        found = []
        for r in self.shards().where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("part", "shard").toLocalIterator():
            found += [np.frombuffer(plain.decompress(f), "<u4").tolist() for d, _, _, f in frames_of(r["index"], r.body, r.n_docs) if d == doc_id]
        return found

    def documents(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32, read back from the files."""
        sums = {r.part: r.n for r in self.shards().groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one number a partition
        base, total = {}, 0
        for p in sorted(sums):
            base[p], total = total, total + sums[p]
        dictionary = self.dictionary()
        digest = hashlib.sha256(dictionary).hexdigest()

        def run(batches):
            plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
            for batch in batches:
                for p, n, sha, index, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if sha != digest:
                        raise ValueError("a shard needs another dictionary")
                    rows = [(d, base[p] + s, k, zlib.crc32(plain.decompress(f))) for d, s, k, f in frames_of(index, body, n)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

        return self.shards().select("part", "n_docs", "dictionary_sha256", "index", "body").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_tokens(docs: DataFrame, root: str | None = None, path: str | None = None, split: bool = True, partitions: int | None = None) -> TokenSet:
    """Encode docs (doc_id, text) and write a set; without root, into the shared folder until the session ends."""
    spark = docs.sparkSession
    prepare(spark)
    path = path or tokenizer_file()
    scratch = Scratch(spark, "tokens")
    if root is None:
        root = scratch.path("set")
        scratch.at_exit()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = scratch.keep(docs.mapInArrow(tidy(_encode(path, split)), "doc_id long, narrow binary, wide binary"), "ids")
    held = ids.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.coalesce(F.octet_length("narrow"), F.octet_length("wide"))), F.lit(0)).alias("bytes")).first()
    share = int(1_000_000 * min(1, SAMPLE / max(1, held.n)))
    sample = ids.select("narrow", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).alias("h")).where(F.col("h") <= share).where(F.octet_length("narrow").between(1, LONG)).orderBy("h", "narrow").limit(2 * SAMPLE).collect()
    dictionary = train([np.frombuffer(r.narrow, "<u2").astype("<u4").tobytes() for r in sample] or [b"\0" * 64])
    row = spark.createDataFrame([(bytearray(dictionary), hashlib.sha256(dictionary).hexdigest())], "bytes binary, sha256 string")
    row.coalesce(1).write.parquet(f"{root}/dictionary")
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held.bytes // PART_BYTES))
    # Rows of one id are told apart by a hash, equal rows by their place in the table: no id fills a partition.
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("at")]
    parts = ids.withColumns({"tie": F.xxhash64("narrow", "wide"), "at": F.monotonically_increasing_id()})
    parts = parts.repartitionByRange(n, *order).sortWithinPartitions(*order)
    parts = parts.select(F.spark_partition_id().alias("part"), "doc_id", "narrow", "wide")
    parts.mapInArrow(tidy(_write_shards(dictionary, LEVEL, SHARD_BYTES)), SHARD_SCHEMA).write.parquet(f"{root}/shards")
    scratch.drop(ids)
    return TokenSet(spark, root)
