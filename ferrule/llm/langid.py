"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A word is a run of letters (ASCII letters and bytes beyond ASCII). The first bytes of its letters' UTF-8 tell the scripts
it is written in; only languages that were learned in one of them are its candidates (all, if there is none). Its
score for a candidate is the sum of log-probabilities of its byte trigrams, of a start and end mark's too, and of
the word itself, less the best candidate's, no lower than ``-FLOOR``. Viterbi finds the labelling of all words of
the text with the largest sum of scores less ``SWITCH`` for each change of language; it runs over many texts at
once, a word of each at a time. The prediction is the language with the most letter bytes in its spans, its score
the part of letter bytes that it has.

The model is a table of counts of 2**BITS hashed features for each language, whatever the input; it is fitted on
about ``SAMPLE`` labelled documents (by hash of the id; all, if there are no more).

Defined results: null, empty or letterless texts (numbers like a half or squared are no letters) are ``und`` with score 0
and no spans; ties go to the language first in sorted order; repeated rows stay; rows of null doc_id or null lang are
not learned from; without any labelled row all is ``und``; an empty table gives an empty one; a text of any length is
labelled whole; further columns, whatever their names, don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import StructField, StructType

from ferrule.llm.common import chunks, field, hash_words, prepare, row_of, tidy

BITS, SAMPLE, FLOOR, SWITCH = 16, 6000, 4.0, 9.0
UND = "und"
SPAN = "array<struct<lang: string, first_word: int, n_words: int>>"

_byte = np.arange(256)
LETTERS = np.where((_byte >= 128) | ((_byte | 32) >= 97) & ((_byte | 32) <= 122), _byte + 1, 0).astype(np.uint16)
LETTERS[65:91] += 32


#: Scripts by the first bytes of their letters' UTF-8 (fixed values: the ranges of Unicode's blocks). Two-byte ones by
#: the leading byte; those under E0 and E1 by the second byte; the others by the leading byte again.
BY_LEAD = [("Latin", 0x41, 0x5A), ("Latin", 0x61, 0x7A), ("Latin", 0xC3, 0xCA), ("Greek", 0xCD, 0xCF), ("Cyrillic", 0xD0, 0xD3), ("Armenian", 0xD4, 0xD5), ("Hebrew", 0xD6, 0xD7), ("Arabic", 0xD8, 0xDB), ("Syriac, Thaana, NKo", 0xDC, 0xDF), ("kana", 0xE3, 0xE3), ("Han", 0xE4, 0xE9), ("Hangul", 0xEA, 0xED)]
BY_E0 = [("Arabic", 0xA0, 0xA3), ("Devanagari", 0xA4, 0xA5), ("Bengali", 0xA6, 0xA7), ("Gurmukhi", 0xA8, 0xA9), ("Gujarati", 0xAA, 0xAB), ("Odia", 0xAC, 0xAD), ("Tamil", 0xAE, 0xAF), ("Telugu", 0xB0, 0xB1), ("Kannada", 0xB2, 0xB3), ("Malayalam", 0xB4, 0xB5), ("Sinhala", 0xB6, 0xB7), ("Thai", 0xB8, 0xB9), ("Lao", 0xBA, 0xBB), ("Tibetan", 0xBC, 0xBF)]
BY_E1 = [("Myanmar", 0x80, 0x81), ("Georgian", 0x82, 0x83), ("Hangul", 0x84, 0x87), ("Ethiopic", 0x88, 0x8D), ("Cherokee", 0x8E, 0x8F), ("Khmer", 0x9E, 0x9F), ("Mongolian", 0xA0, 0xA2), ("Latin", 0xB4, 0xBB), ("Greek", 0xBC, 0xBF)]
SCRIPT_NAMES = sorted({name for name, _, _ in BY_LEAD + BY_E0 + BY_E1})


def _bits(ranges) -> np.ndarray:
    t = np.zeros(256, np.uint32)
    for name, a, b in ranges:
        t[a : b + 1] |= np.uint32(1 << SCRIPT_NAMES.index(name))
    return t


LEAD, SECOND = _bits(BY_LEAD), {0xE0: _bits(BY_E0), 0xE1: _bits(BY_E1)}


def script_bits(buf: np.ndarray) -> np.ndarray:
    """A bit for each script, at the bytes that tell it."""
    out = LEAD[buf]
    for lead, table in SECOND.items():
        at = np.flatnonzero(buf[:-1] == lead)
        out[at] = table[buf[at + 1]]
    return out


def _features(buf, offs):
    """Word hashes, first word of each text, spans; per byte the bucket of the trigram that ends there; scripts of words."""
    h, first, s, e = hash_words(buf, offs, LETTERS)
    c = LETTERS[buf].astype(np.uint32)
    p1, p2 = np.zeros_like(c), np.zeros_like(c)
    p1[1:], p2[2:] = c[:-1], c[:-2]
    # What lies before a word's first letter counts as the mark (0), text edges included.
    p1[s] = 0
    p2[s] = 0
    after = s[s + 1 < e] + 1
    p2[after] = 0
    key = (c + 257 * p1 + 66049 * p2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    gram = (key >> np.uint64(64 - BITS)).astype(np.int64)
    end = ((c[e - 1] + np.uint32(257) * p1[e - 1] + np.uint32(70000 * 257)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)
    word = (h >> np.uint64(64 - BITS)).astype(np.int64)
    scripts = np.bitwise_or.reduceat(script_bits(buf), np.stack([s, e], 1).ravel()[:-1])[::2] if len(s) else np.zeros(0, np.uint32)
    return first, s, e, gram, end, word, scripts


class Model:
    """log-probabilities (features x languages) and, for each language, the scripts it is written in."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        # Grams and words have tables of their own, each smoothed by itself.
        self.gram, self.word = (np.log((x + 0.1) / (x.sum(0, keepdims=True) + 0.1 * len(x))).astype(np.float32) for x in counts)
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        self.scripts = np.array([sum(1 << k for k in np.flatnonzero(own >= 0.01)) for own in share], np.uint32)

    def allowed(self, scripts: np.ndarray) -> np.ndarray:
        """Which languages are candidates of words in these scripts: those written in one of them, else all."""
        distinct, at = np.unique(scripts, return_inverse=True)
        yes = (distinct[:, None] & self.scripts[None]) != 0
        yes[~yes.any(1)] = True
        return yes[at]

    def emissions(self, s, e, gram, end, word, scripts) -> np.ndarray:
        out = np.empty((len(s), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            total = np.concatenate(([0.0], np.cumsum(self.gram[gram, k], dtype=np.float64)))
            out[:, k] = total[e] - total[s] + self.gram[end, k] + self.word[word, k]
        allowed = self.allowed(scripts)
        out[~allowed] = -np.inf
        out -= out.max(1, keepdims=True)
        return np.maximum(out, np.where(allowed, -FLOOR, -3 * FLOOR).astype(np.float32))


def viterbi(score: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word; text d has the words first[d] to first[d + 1]."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    labels = np.zeros(len(score), np.int16)
    # Texts of like length go together, so that short ones do not wait for long ones.
    at = 0
    while at < len(order):
        longest = sizes[order[at]]
        group = order[at : at + int(np.searchsorted(-sizes[order[at:]], -(longest // 4), "right")) if longest >= 32 else len(order)]
        if not len(group):
            group = order[at : at + 1]
        at += len(group)
        begin, size = first[group], sizes[group]
        alive = np.searchsorted(-size, -np.arange(longest), "left")  # texts longer than t, a prefix of the group
        v = score[begin].copy()
        n_lang = v.shape[1]
        back = []
        for t in range(1, longest):
            k = alive[t]
            head = v[:k]
            best = head.argmax(1)
            jump = head[np.arange(k), best] - switch
            move = head < jump[:, None]
            back.append(np.where(move, best[:, None], np.arange(n_lang)).astype(np.int16))
            v[:k] = np.where(move, jump[:, None], head) + score[begin[:k] + t]
        now = v.argmax(1).astype(np.int16)
        for t in range(longest - 1, 0, -1):
            k = alive[t]
            labels[begin[:k] + t] = now[:k]
            now[:k] = back[t - 1][np.arange(k), now[:k]]
        labels[begin] = now
    return labels


def _learn(langs):
    rank = {x: i for i, x in enumerate(langs)}

    def run(batches):
        counts = np.zeros((2, len(langs), 1 << BITS), np.int64)
        scripts = np.zeros((len(langs), len(SCRIPT_NAMES)), np.int64)
        for batch in batches:
            own = np.array([rank.get(x, -1) for x in batch.column(0).to_pylist()])
            for i, j, buf, offs in chunks(batch.column(1)):
                first, s, e, gram, end, word, bits = _features(buf, offs)
                inside = LETTERS[buf] > 0
                for d in range(j - i):
                    k, a, b = own[i + d], first[d], first[d + 1]
                    if k < 0 or a == b:
                        continue
                    x, y = s[a], e[b - 1]
                    counts[0, k] += np.bincount(np.concatenate((gram[x:y][inside[x:y]], end[a:b])), minlength=1 << BITS)
                    counts[1, k] += np.bincount(word[a:b], minlength=1 << BITS)
                    scripts[k] += [int(((bits[a:b] >> m) & 1).sum()) for m in range(len(SCRIPT_NAMES))]
        for kind in (0, 1):
            for k in range(len(langs)):
                hit = np.flatnonzero(counts[kind, k])
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), kind), pa.int32()), pa.array(np.full(len(hit), k), pa.int32()), pa.array(hit, pa.int32()), pa.array(counts[kind, k][hit], pa.int64())], ["kind", "lang", "feature", "n"])
        m = len(SCRIPT_NAMES)
        for k in range(len(langs)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, 2), pa.int32()), pa.array(np.full(m, k), pa.int32()), pa.array(np.arange(m), pa.int32()), pa.array(scripts[k], pa.int64())], ["kind", "lang", "feature", "n"])

    return run


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from columns doc_id, text, lang. At most 2 * 2**BITS counts a language come to the driver."""
    prepare(labelled.sparkSession)
    labelled = labelled.where("doc_id is not null and lang is not null")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    langs, total = sorted(sizes), sum(sizes.values())
    part = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1, sample / total)) + (sample >= total))
    counts, scripts = np.zeros((2, 1 << BITS, len(langs))), np.zeros((len(langs), len(SCRIPT_NAMES)))
    rows = part.select("lang", "text").mapInArrow(tidy(_learn(langs)), "kind int, lang int, feature int, n long")
    for r in rows.groupBy("kind", "lang", "feature").agg(F.sum("n").alias("n")).toLocalIterator():
        if r.kind < 2:
            counts[r.kind, r.feature, r.lang] = r.n
        else:
            scripts[r.lang, r.feature] = r.n
    return Model(langs, counts, scripts)


def has_letter(text: bytes) -> bool:
    """Whether a text without ASCII letters has one (Unicode's categories L)."""
    return any(map(str.isalpha, text.decode("utf-8", "ignore")))


def _label(model, with_spans):
    def run(batches):
        m: Model = model.value
        for batch in batches:
            n = batch.num_rows
            pred, score, spans = [UND] * n, [0.0] * n, [[] for _ in range(n)]
            for i, j, buf, offs in chunks(field(batch, "text", pa.string()), 2 << 20):
                first, s, e, *rest = _features(buf, offs)
                if not len(s):
                    continue
                labels = viterbi(m.emissions(s, e, *rest), first)
                size = e - s
                for d in range(j - i):
                    a, b = first[d], first[d + 1]
                    if a == b:
                        continue
                    own = labels[a:b]
                    text = buf[offs[d] : offs[d + 1]]
                    ascii_letter = ((text | 32) >= 97) & ((text | 32) <= 122)
                    if not ascii_letter.any() and not has_letter(text.tobytes()):
                        continue
                    share = np.bincount(own, weights=size[a:b], minlength=len(m.langs))
                    k = int(share.argmax())
                    pred[i + d], score[i + d] = m.langs[k], float(share[k] / share.sum())
                    if with_spans:
                        cuts = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1, [b - a]))
                        spans[i + d] = [{"lang": m.langs[own[x]], "first_word": int(x), "n_words": int(y - x)} for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))
            cols, names = [batch.column("row"), pa.array(pred), pa.array(score)], ["row", "lang_pred", "score"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, kind)] if with_spans else cols, [*names, "spans"] if with_spans else names)

    return run


def identified(docs: DataFrame, model: Model | None, spans: bool = True) -> DataFrame:
    """Every row of docs as the struct row, with lang_pred, score and, if asked for, spans (language, first word, number of words); only text is read."""
    prepare(docs.sparkSession)
    more = f"lang_pred string, score double{f', spans {SPAN}' if spans else ''}"
    rows = row_of(docs)
    if model is None:
        none = [F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.expr(f"cast(array() as {SPAN})").alias("spans")]
        return rows.select("row", *none[: 2 + spans])
    schema = StructType([StructField("row", docs.schema), *StructType.fromDDL(more).fields])
    return rows.mapInArrow(tidy(_label(docs.sparkSession.sparkContext.broadcast(model), spans)), schema)


def identify(docs: DataFrame, model: Model | None, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and, if asked for, spans of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return identified(docs, model, spans).select("row.doc_id", "lang_pred", "score", *["spans"][:spans])


def held_out(column: str = "doc_id"):
    return F.coalesce(F.expr(f"crc32(cast({column} as string)) % 4 = 2"), F.lit(False))


def languages(docs: DataFrame, spans: bool = True) -> DataFrame:
    """doc_id, held_out, lang_pred, score and, if asked for, spans; learned from the rows that are not held out."""
    model = fit(docs.where(~held_out()))
    return identify(docs, model, spans).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", *["spans"][:spans])
