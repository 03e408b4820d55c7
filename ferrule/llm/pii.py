"""Personal data in plain sight and in disguise, with offsets into the text as it stands.

Plain finds come from fixed patterns. For disguises the text goes through two transducers that keep the source
place of every character: the first replaces look-alike characters one by one (full-width and styled letters and
digits, Cyrillic and Greek look-alikes, foreign digits, odd dashes and spaces) and drops invisible ones; the second
rewrites passages: ``(at)``, ``[dot]``, ``user at host dot tld``, ``user@host . tld`` become ``@`` and ``.``, runs of
spelled digits become digits, ``plus`` before digits ``+``. The same patterns then run on the result, and what they
find is mapped back; a find that meets a plain one of its kind is left out. Every step takes time linear in the text.

The words for digits, "at", "dot" and "plus" are those of English, German, French and Spanish; other disguises are not read.

Defined results: a null text is empty and has no finds; offsets count code points, ends are exclusive; repeated rows
stay; a null doc_id keeps its row; an empty table gives an empty one; further columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import prepare, tidy

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit before it never starts a match: the run's first digit would have, or a match took the whole run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = []
    at, pos = text.find("@"), 0
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
        pos = m.end() if m else at + 1
        at = text.find("@", pos)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


# Characters that look like ASCII ones, by script.
_CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјоруԁһԛԝхсӏ", "ABESIJKMHOPCTYXaesijopydhqwxcl", strict=True))
_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυχϲ", "ABEZHIKMNOPTYXaivopuxc", strict=True))
_SIGNS = dict(zip("‐‑‒–—―−﹣－․。﹒．﹫＠⁺＋     　", "---------....@@++      ", strict=True))
_INVISIBLE = "­​‌‍⁠﻿"
# Words for digits (English, German, French, Spanish), "at", "dot" and "plus".
_DIGITS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_AT, _DOT, _PLUS = ("at", "arroba", "arobase", "chez"), ("dot", "punkt", "punto", "point"), ("plus", "más")

_any = "|".join
_dot_word = _any(_DOT)
_OPEN, _CLOSE = dict(zip("[({<*_-", "])}>*_-", strict=True)), frozenset("])}>*_-")
#: Every pattern here starts at a fixed character or word and gives nothing back, so the work is linear in the text.
_AT_SIGN = re.compile(rf"@|(?<!\w)(?:{_any(_AT)})(?!\w)|(?<=[_*-])(?:{_any(_AT)})(?=[_*-])")
_HOST_DOT = rf"(?:\.|\s\.\s|\s++(?:{_dot_word})\s++|\s*+[\[({{<]\s*+(?:{_dot_word}|\.)\s*+[\])}}>]\s*+|[*_-](?:{_dot_word})[*_-])"
_HOST = re.compile(rf"[a-z0-9]++(?:-++[a-z0-9]++)*+(?:{_HOST_DOT}[a-z0-9]++(?:-++[a-z0-9]++)*+)++")
_HOST_DOTS = re.compile(rf"{_HOST_DOT}(?=[a-z0-9])")
_TOP = re.compile(r"[a-z]{2,}$")
_NUMBER = re.compile(rf"(?<!\w)(?:(?P<n>{_any(sorted(_DIGITS, key=len, reverse=True))})|[0-9]++)(?!\w)")
_GAP = re.compile(rf"\s++(?:{_dot_word})\s++|\s*+[\[({{<]\s*+(?:{_dot_word}|\.)\s*+[\])}}>]\s*+|[*_-](?:{_dot_word})[*_-]|(?P<s>[\s,.()-]{{1,3}})")
_PLUS_BEFORE = re.compile(rf"(?<!\w)(?:{_any(_PLUS)})\s++(?=\(?$)")
#: What a text must hold for some run of digits to be in disguise.
_SPELLED = re.compile(rf"(?<!\w)(?:{_any(sorted(_DIGITS, key=len, reverse=True))}|{_any(_PLUS)})(?!\w)|(?<![^\W_])(?:{_dot_word})(?![^\W_])|[\[({{<]\s*+\.")
_ODD = re.compile("[^\u0000-\u009f¡-¬®-ÿ]")


class _Folds(dict):
    """One character for one: what each character counts as."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        to = _CYRILLIC.get(c) or _GREEK.get(c) or _SIGNS.get(c)
        if to is None and code > 127 and c not in _INVISIBLE:
            digit = unicodedata.digit(c, None)
            folded = unicodedata.normalize("NFKC", c)
            to = str(digit) if digit is not None else folded if len(folded) == 1 and folded.isascii() and folded.isprintable() else None
        self[code] = out = ord(to) if to else code
        return out


_folds = _Folds()


def _spaces_before(text: str, i: int, least: int) -> int:
    while i > least and text[i - 1].isspace():
        i -= 1
    return i


def _spaces_after(text: str, i: int) -> int:
    n = len(text)
    while i < n and text[i].isspace():
        i += 1
    return i


def _dot_before(low: str, end: int, least: int) -> int:
    """Where a disguised dot that ends at ``end`` starts, with the space around it; -1 if there is none."""
    i = _spaces_before(low, end, least)
    if i <= least:
        return -1
    if low[i - 1] in "])}>":
        j = _spaces_before(low, i - 1, least)
        word = next((w for w in (".", *_DOT) if low.endswith(w, least, j)), None)
        if word is None:
            return -1
        j = _spaces_before(low, j - len(word), least)
        return _spaces_before(low, j - 1, least) if j > least and _OPEN.get(low[j - 1]) == low[i - 1] else -1
    if i == end - 1 and low[i - 1] == "." and i - 2 >= least and low[i - 2].isspace():
        return i - 2
    word = next((w for w in _DOT if low.endswith(w, least, i)), None) if i < end else None
    if word is None:
        return -1
    j = i - len(word)
    k = _spaces_before(low, j, least)
    return k if k < j else -1


def _mail_edits(low: str) -> list[tuple[int, int, str]]:
    """user (at) host.tld and the like; user at host dot tld; user.name7 at host.tld; with dots in disguise in either."""
    out: list[tuple[int, int, str]] = []
    least = 0  # where the last sign or address ended: nothing before it is looked at again
    for m in _AT_SIGN.finditer(low):
        if m.start() < least:
            continue
        i, j = m.span()
        marked = weak = False
        p, q = _spaces_before(low, i, least), _spaces_after(low, j)
        if p > least and q < len(low) and _OPEN.get(low[p - 1]) == low[q]:
            weak = low[q] in "*_-"
            if not weak or (p == i and q == j):
                marked, p, q = True, p - 1, q + 1
                if not weak:
                    p, q = _spaces_before(low, p, least), _spaces_after(low, q)
        bare = m[0] != "@" and not marked
        floor, least = least, j
        if bare and (p == i or q == j) or p <= floor or low[p - 1] not in _LOCAL:
            continue
        host = _HOST.match(low, q)
        if not host:
            continue
        dots = [d.span() for d in _HOST_DOTS.finditer(low, q, host.end())]
        hidden = any(not low[a:b].strip() == "." for a, b in dots)
        if (bare or weak) and not hidden and not (bare and low[p - 1] in "0123456789._" and all(b - a == 1 for a, b in dots) and _TOP.search(low, dots[-1][1], host.end())):
            continue
        start, at = p, p
        while at > floor and low[at - 1] in _LOCAL:
            at -= 1
        edits = [(p, q, "@")] if low[p:q] != "@" else []
        while at < start:
            start = at
            k = _dot_before(low, at, floor)
            if k <= floor or low[k - 1] not in _LOCAL:
                break
            edits.append((k, at, "."))
            start = at = k
            while at > floor and low[at - 1] in _LOCAL:
                at -= 1
        out += sorted(edits + [(a, b, ".") for a, b in dots if low[a:b] != "."])
        least = host.end()
    return out


def _digit_edits(low: str) -> list[tuple[int, int, str]]:
    """Runs of spelled digits, numbers, dots and plus in words."""
    out: list[tuple[int, int, str]] = []
    run: list[re.Match] = []
    gaps: list[re.Match] = []

    def close():
        if len(run) > 1:
            before = low[max(0, run[0].start() - 24) : run[0].start()]
            plus = _PLUS_BEFORE.search(before)
            if plus or any(m["n"] for m in run) or any(g["s"] is None for g in gaps):
                if plus:
                    a = run[0].start() - len(before)
                    out.append((a + plus.start(), a + plus.end(), "+"))
                for k, m in enumerate(run):
                    if m["n"]:
                        out.append((*m.span(), str(_DIGITS[m["n"]])))
                    if k + 1 < len(run):
                        g = gaps[k]
                        if g["s"] is None:
                            out.append((m.end(), run[k + 1].start(), "."))
                        elif m["n"] and run[k + 1]["n"] and not set(g["s"]) & set(".()"):
                            out.append((m.end(), run[k + 1].start(), ""))
        run.clear()
        gaps.clear()

    for m in _NUMBER.finditer(low):
        if run:
            gap = _GAP.fullmatch(low, run[-1].end(), m.start())
            if gap:
                gaps.append(gap)
            else:
                close()
        run.append(m)
    close()
    return out


class Rewritten:
    """A text after edits (start, end, instead), and where its characters come from."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, self.starts, self.sources, at, size = [], [0], [(0, 0)], 0, 0
        for a, b, to in edits:
            if a < at:  # meets the one before
                continue
            parts += [text[at:a], to]
            size += a - at
            if to:
                self.starts.append(size)
                self.sources.append((a, b))
            size += len(to)
            self.starts.append(size)
            self.sources.append((b, b))
            at = b
        self.text = "".join(parts) + text[at:]

    def span(self, i: int, j: int) -> tuple[int, int]:
        def source(i: int, last: bool) -> int:
            k = bisect_right(self.starts, i) - 1
            a, b = self.sources[k]
            return (b if last else a) if a < b else a + i - self.starts[k] + last

        return source(i, False), source(j - 1, True)


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def disguised(text: str, taken: list[tuple[int, int, int]], gate: bool = True) -> list[tuple[int, int, int]]:
    """Finds of the normalised text, as source spans, but for those that meet one of ``taken`` of their kind.

    ``gate=False`` runs every pattern over every text; the result is the same.
    """
    steps = []
    now = text
    if not gate or (not text.isascii() and _ODD.search(text)):
        now = text.translate(_folds)
        steps.append(Rewritten(now, [(*m.span(), "") for m in re.finditer(f"[{_INVISIBLE}]+", now)]))
        now = steps[-1].text
    low = _lower(now)
    edits = _mail_edits(low)
    if not gate or _SPELLED.search(low):
        edits = sorted(edits + _digit_edits(low))
    if edits:
        steps.append(Rewritten(now, edits))
        now = steps[-1].text
    if now == text:
        return []
    out = []
    for kind, x, y in plain(now):
        for step in reversed(steps):
            x, y = step.span(x, y)
        if not any(k == kind and x < d and c < y for k, c, d in taken):
            out.append((kind, x, y))
    return out


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain finds, and all finds, as (kind, start, end)."""
    if not text:
        return [], []
    base = plain(text)
    return base, sorted(base + disguised(text, base))


def _text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _scan(batches):
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            base, every = find(text)
            n = [0, 0, 0, 0]
            for k, _, _ in base:
                n[k] += 1
            rows.append((*n, hashlib.sha256(_text(base).encode()).hexdigest(), _text(every)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of plain finds by kind, base_sha256, spans of every row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_scan), SCHEMA)
