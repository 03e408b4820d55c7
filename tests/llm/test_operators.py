"""The operators on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from ferrule.llm import decontam, knn, langid, mixing, ngram, pii, tokens, toxicity, urls, warc
from ferrule.llm import urls as urls_module

WORDS = [a + b for a in ("ba", "ko", "ti", "mu", "se", "la") for b in ("n", "r", "st", "mo", "pe", "lu", "gi")]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = [" ".join(r.choices(WORDS, k=n)) for n in (120, 90, 60, 200, 40, 7, 3)]
    near = [base[0].replace(" ", "  ", 3).upper(), base[0] + " extra", " ".join(base[1].split()[:85]), base[3] + " " + " ".join(WORDS[:8])]
    return [*base, *near, None, "", "   \n", "one", "one", base[0], "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "xx", "s", 1, 2, 3) for i, t in enumerate(texts)] + [(0, texts[0], "xx", "s", 1, 2, 3), (None, texts[2], "xx", "s", 1, 2, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, key long, token long").repartition(3)


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and comp[i] != comp[j]:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    return [len(s) for s in sets], comp


def test_ngram(docs, texts):
    sizes, comp = brute_components(texts)
    got = ngram.jaccard_links(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (sizes[r.doc_id], comp[r.doc_id])
    assert ngram.jaccard_links(docs.limit(0)).count() == 0


def test_ngram_large_group(spark):
    """A group of many near copies of which only some link directly."""
    r = random.Random(3)
    base = r.choices([f"w{i}" for i in range(2000)], k=150)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice((1, 2, 3, 6))):
            w[r.randrange(len(w))] = f"x{r.random()}"
        rows.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    _, comp = brute_components(rows)
    assert {x.doc_id: x.component_id for x in ngram.jaccard_links(df).collect()} == dict(enumerate(comp))


def test_ngram_many_blocks(spark, monkeypatch):
    """Open sets over many blocks, dealt out a few queries at a time, give the same classes."""
    monkeypatch.setattr(ngram, "BLOCK", 1000)
    monkeypatch.setattr(ngram, "FAN", 5)
    r = random.Random(5)
    base = r.choices([f"w{i}" for i in range(500)], k=80)
    rows = []
    for _ in range(120):
        w = list(base)
        for _ in range(r.choice((1, 2, 3, 4))):
            w[r.randrange(len(w))] = f"x{r.random()}"
        rows += [" ".join(w)] * r.choice((1, 1, 3))
    _, comp = brute_components(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)
    assert {x.doc_id: x.component_id for x in ngram.jaccard_links(df).collect()} == dict(enumerate(comp))


def test_ngram_sets_go_out_in_parts(spark, monkeypatch):
    """However many sets the tests and searches need, few go out at once (on disk), and no link is lost."""
    sent, whole = [], ngram.wanted_filter
    monkeypatch.setattr(ngram, "wanted_filter", lambda ids: sent.append(ids.count()) or whole(ids))
    monkeypatch.setattr(ngram, "FAN", 5)
    monkeypatch.setattr(ngram, "ASKS", 4)
    monkeypatch.setattr(ngram, "BLOCK", 1000)
    r = random.Random(11)
    rows = []
    for _ in range(30):
        base = r.choices([f"w{i}" for i in range(300)], k=60)
        for _ in range(10):
            w = list(base)
            for _ in range(r.choice((0, 1, 2, 3))):
                w[r.randrange(len(w))] = f"x{r.random()}"
            rows.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    _, comp = brute_components(rows)
    for most, percent in ((100, 1000), (1 << 20, 20)):
        monkeypatch.setattr(ngram, "PART_ROWS", most, raising=False)
        monkeypatch.setattr(ngram, "PART_PERCENT", percent, raising=False)
        sent.clear()
        assert {x.doc_id: x.component_id for x in ngram.jaccard_links(df).collect()} == dict(enumerate(comp))
        assert max(sent) < 250 < sum(sent)  # the first round alone needs more


def test_ngram_rows_without_id_link(spark):
    r = random.Random(7)
    base = r.choices([f"w{i}" for i in range(500)], k=40)
    a, b, c = (" ".join(base[i : i + 30]) for i in (0, 2, 4))
    rows = [(1, a), (None, b), (3, c), (None, "alone " * 9), (None, b), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((x.doc_id, x.component_id) for x in ngram.jaccard_links(df).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (3, 1), (None, None), (None, 1), (5, 5)], key=str)


def test_ngram_dealt_lists(spark, docs, texts, monkeypatch):
    """Lists over many places, joins by shuffle: the same classes."""
    from ferrule.llm import common

    monkeypatch.setattr(ngram, "LIST", 2)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    sizes, comp = brute_components(texts)
    for x in ngram.jaccard_links(docs).collect():
        assert x.doc_id is None or (x.n_shingles, x.component_id) == (sizes[x.doc_id], comp[x.doc_id])


def test_keys_of_twins():
    s = np.sort(np.random.default_rng(0).integers(0, 1 << 60, 50).astype(np.uint64))
    key = ngram.key_of(s)
    other = ngram.key_of(s, frozenset([ngram.set_key(s)[0] & ~255]))
    assert key != other and key & 255 == other & 255 == ngram.size_class(50)


def test_lists_search_is_exact():
    g = np.random.default_rng(2)
    base = np.unique(g.integers(0, 1 << 40, 300).astype(np.uint64))
    sets = []
    for k in g.integers(0, 60, 200):
        s = base.copy()
        s[g.choice(len(s), k, replace=False)] = g.integers(0, 1 << 40, k).astype(np.uint64)
        sets.append(np.unique(s[: len(s) - int(g.integers(0, 40))]))
    lists = ngram.Lists(sets)
    among = np.ones(len(sets), bool)
    for s in sets[:60]:
        want = {j for j, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= 80 * len(np.union1d(s, o))}
        assert set(lists.search(s, among)) == want
    assert not list(lists.search(np.arange(5, dtype=np.uint64), among))


def test_probe_and_required():
    a = np.arange(0, 1000, dtype=np.uint64)
    assert [ngram.size_class(n) for n in (1, 2, 3, 4, 5)] == [0, 8, 12, 16, 18]
    assert ngram.probe(a, a) and not ngram.probe(a, a[:700]) and ngram.probe(a, a[:800]) and not ngram.probe(a, a[:799])
    assert [ngram.required(n) for n in (1, 5, 10, 11)] == [1, 4, 8, 9]


def test_decontamination_blocks_agree(spark, docs, texts):
    items = spark.createDataFrame([(7, " ".join(texts[0].split()[10:25])), (8, "One"), (9, None), (10, ""), (7, texts[3]), (None, "x y")], "item_id long, text string")
    one = sorted(map(tuple, decontam.contamination(docs, items).collect()), key=str)
    many = sorted(map(tuple, decontam.contamination(docs, items, block_bytes=100).collect()), key=str)
    assert one == many and len(one) == len(texts) + 2
    by = {r[0]: r for r in one}
    assert by[0][2] == 15 and by[0][3] == 1 and by[14][2] == 1 and by[14][3] == 1 and by[11][1] == 0 and not by[0][5]
    assert by[0][4] == hashlib.sha256(b"7").hexdigest() and by[12][4] == hashlib.sha256(b"").hexdigest()
    assert decontam.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("block_bytes", [8 << 20, 200], ids=["one block", "many"])
def test_decontamination_against_brute_force(spark, block_bytes):
    r = random.Random(21)
    vocabulary = ["ab", "Cd", "é", "x1", "12", "ÜB", "q"]

    def text(n):
        return "".join(w + r.choice([" ", ", ", "  ", "\n", "-"]) for w in r.choices(vocabulary, k=n))

    items = [(i, text(r.choice((1, 3, 7, 8, 9, 20)))) for i in range(12)] + [(3, text(9)), (20, ""), (21, " ,"), (22, None), (None, "ab")]
    texts = [text(r.randrange(0, 60)) for _ in range(80)] + [None, "", "ab " * 30_000] + [text(20) + items[k][1].upper().replace(" ", "-") + text(9) for k in range(12)]
    rows = [(i, t, "x", 1, ["z"]) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1, ["z"]), (None, texts[90], "x", 1, ["z"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string, n_hit int, spans array<string>").repartition(3)

    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - min(8, len(w)) + 1) if w and i is not None else ():
            windows.setdefault(tuple(w[k : k + 8]), set()).add(str(i))
    want = []
    for i, t, *_ in rows:
        w, hit, own = words(t), set(), set()
        for g, ids in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    own |= ids
        want.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), len(own) >= 2))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontam.contamination(docs, table, block_bytes=block_bytes).collect()), key=str)
    assert got == sorted(want, key=str)
    kept = decontam.decontaminated(docs, table, block_bytes=block_bytes)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted((x for x, w in zip(rows, want, strict=True) if not w[3]), key=str)
    assert decontam.contamination(docs.limit(0), table).count() == 0


@pytest.mark.parametrize("small", [False, True], ids=["usual", "many slabs"])
def test_knn(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(knn, "SLAB", 40)
        monkeypatch.setattr(knn, "GROUP", 4)
        monkeypatch.setattr(knn, "SAMPLE", 12)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)).round(1)
    x[50:120] = x[50]
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1040, [float("nan")] * 6), (1060, [1.0]), (None, [0.0] * 6), (1080, [1e300] * 6), (1081, [])]
    rows += [rows[7]] * 50 + [rows[40]] * 3  # repeated rows of one id count once
    rows = [(*r, "a", 3, 4, 5) for r in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ids string, cell int, g int, side int").repartition(3)
    got = knn.top_k(df, k=5).collect()
    q = np.floor(64 * x).astype(int)
    s = q @ q.T
    want = {(i, n + 1, j, s[i, j]) for i in range(0, 300, 20) for n, j in enumerate(sorted((j for j in range(300) if j != i), key=lambda j: (-s[i, j], j))[:5])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert knn.top_k(df.limit(0)).count() == 0


def base_by_contract(text):
    """The contract's patterns as they stand, leftmost and non-overlapping; failing matches are dropped."""
    out = []
    for k, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            d = [int(c) for c in m[0] if c in "0123456789"]
            double = [sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))]
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 16 <= len(d) <= 19 and sum(double) % 10 == 0 or k == 3 and 8 <= len(d) <= 15:
                out.append(("email", "ip", "card", "phone")[k] + f":{m.start()}:{m.end()}")
    return out


PIECES = ["a", "b.c", "@", ".", " ", "at", " dot ", "(at)", "[.]", "+", "1", "192.168.0.1", "4111 1111 1111 1111", "+49 151 23456789", "one", "two", "-", "(", ")", "\u200b", "＠", "é", "x@y.z", "256.1.1.1", "\n", "0", "%", "plus "]


def test_pii_base_is_the_contract(spark):
    r = random.Random(8)
    texts = ["".join(r.choices(PIECES, k=r.randrange(1, 40))) for _ in range(1500)] + [None, "", "x" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0]), (None, "a@b.c")], "doc_id long, text string").repartition(4)
    got = pii.personal_data(df).collect()
    assert len(got) == len(texts) + 2
    for x in got:
        want = base_by_contract(texts[x.doc_id]) if x.doc_id is not None else ["email:0:5"]
        assert x.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(w.startswith(k) for w in want) for k in pii.KINDS)
        assert set(want) <= set(x.spans.split(",")) | {""}
    assert pii.personal_data(df.limit(0)).count() == 0


def test_pii_gate_loses_nothing(spark, sf):
    r = random.Random(9)
    texts = ["".join(r.choices(PIECES, k=r.randrange(1, 60))) for _ in range(4000)]
    texts += [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [x.html for x in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    found = 0
    for t in filter(None, texts):
        base, every = pii.find(t)
        assert sorted(base + pii.disguised(t, base, gate=False)) == every
        found += len(every) > len(base)
    assert found > 50


@pytest.mark.parametrize("text", ["a." * 50_000 + "a@ !", "at " * 33_000, "@ " * 50_000, " dot at" * 14_000, "(" * 100_000, "one " * 25_000, "x" + " " * 50_000 + "@" + " " * 50_000 + "y", "a@" + "b." * 50_000, "a at " + "b dot " * 16_000, "+1(" * 33_000, "a-" * 50_000 + " at b", "[.]" * 33_000, "a . " * 25_000 + "@b", "a [at] " * 14_000, " " * 100_000 + "plus 1 2"], ids=range(15))
def test_pii_takes_linear_time(text):
    began = time.time()
    pii.find(text)
    assert time.time() - began < 1


def test_pii_disguises():
    def kinds(t):
        return [(pii.KINDS[k], t[a:b]) for k, a, b in pii.find(t)[1]]

    for whole, kind in (
        ("john.doe (at) example (dot) com", "email"), ("ј\u200bоhn@ехample.com", "email"), ("john@example . com", "email"), ("john @ example . com", "email"), ("john dot doe at example dot com", "email"), ("john.doe7 at example.com", "email"), ("user[at]host[dot]org", "email"),
        ("plus one five five five one two three four", "phone"), ("plus four nine 151 2345678", "phone"), ("4111 1111 1111 1111", "card"), ("four one one one one one one one one one one one one one one one", "card"),
        ("one nine two dot one six eight dot one dot one", "ip"), ("192[.]168(.)1[.]1", "ip"), ("１９２.168.0.1", "ip"),
    ):
        assert kinds(whole) == [(kind, whole)]
        assert kinds(f"(see {whole} )") == [(kind, whole)]
    for clean in ("we met at noon. one dot, two three at that point.", "", "999.1.1.1", "he was at example.com", "look-at-home.com", "meet @ home. Then", "a at b at c"):
        assert kinds(clean) == []
    assert pii.plain("a@b.c@d.e") == [(0, 0, 5)]


def test_language(spark):
    r = random.Random(2)
    en, de = ["the", "and", "with", "that", "street"], ["der", "und", "nicht", "straße", "über"]
    rows = [(i, " ".join(r.choices(en if i % 2 else de, k=30)), "en" if i % 2 else "de") for i in range(80)]
    odd = [(100, None, "en"), (101, "12 34 !", "de"), (102, " ".join(en * 10 + de * 12), None), (None, "the and", "en"), (103, "", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.languages(df).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert got[100].lang_pred == got[101].lang_pred == got[103].lang_pred == "und" and got[100].score == 0
    assert [(s.lang, s.first_word, s.n_words) for s in got[102].spans] == [("en", 0, 50), ("de", 50, 60)]
    assert langid.languages(df.limit(0)).count() == 0


def test_language_of_odd_rows(spark):
    r = random.Random(3)
    words = {"aa": ["the", "and", "with"], "bb": ["der", "und", "nicht"], "cc": ["и", "не", "что"], "dd": ["और", "नहीं"], "ee": ["และ", "ไม่"]}
    rows = [(i, " ".join(r.choices(words[k], k=20)), k) for i in range(100) for k in words if i % 5 == "abcde".index(k[0])]
    odd = [(200, "½ ²", None), (201, "à", None), (202, "the and " * 40_000, None), (203, "नहीं और", None), (204, "ไม่", None), (205, "和", None), (206, "１２ ٣", None)]
    full = [(*x, "l", 0.5, 7) for x in [*rows, *odd, rows[0], rows[0]]]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, lang_pred string, score double, spans int").repartition(3)
    got = langid.languages(df, spans=False).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(full) and set(got[0].asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    assert all(by[i].lang_pred == k for i, _, k in rows)
    assert by[200].lang_pred == by[206].lang_pred == "und" and by[200].score == 0 and by[201].lang_pred in words and by[202].lang_pred == "aa"
    assert (by[203].lang_pred, by[204].lang_pred) == ("dd", "ee") and by[205].lang_pred in words
    assert langid.languages(df.limit(0)).count() == 0
    assert {x.lang_pred for x in langid.languages(df.where("lang is null")).collect()} == {"und"}  # nothing to learn from


def test_many_languages(spark):
    """More labels than a byte tells apart."""
    rows = [(i, f"w{chr(97 + i // 26)}{chr(97 + i % 26)}zz " * 5, f"l{i:03}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    got = {x.doc_id: x.lang_pred for x in langid.identify(df, model, spans=False).collect()}
    assert sum(got[i] == k for i, _, k in rows) > 290


def held_out_rows(spark, sf, query, keys):
    from ferrule.llm.queries import QUERIES

    big = sf.replace("sf0.001", "sf0.1")
    truth = spark.read.parquet(f"{big}/{'documents' if query == 'op7_langid' else 'labels'}.parquet").select("doc_id", keys[1])
    return [(x[keys[0]], x[keys[1]]) for x in QUERIES[query](spark, big).where("held_out").join(truth, "doc_id").where(f"{keys[1]} is not null").collect()]


def test_language_held_out(spark, sf):
    rows = held_out_rows(spark, sf, "op7_langid", ("lang_pred", "lang"))
    assert len(rows) > 2000 and sum(a == b for a, b in rows) > 0.99 * len(rows)


def test_toxicity_held_out(spark, sf):
    rows = held_out_rows(spark, sf, "op10_toxicity", ("predicted", "toxic"))
    found, toxic, both = sum(a for a, _ in rows), sum(b for _, b in rows), sum(a and b for a, b in rows)
    assert len(rows) > 1000 and both > 0.6 * toxic and both > 0.9 * found


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    first = np.array([0, 4, 4, 11, 12])
    score = rng.normal(size=(12, 3)).astype(np.float32) * 3
    got = langid.viterbi(score, first, 2.0)
    import itertools

    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            value = lambda y, a=a: sum(score[a + i, k] for i, k in enumerate(y)) - 2.0 * sum(p != q for p, q in itertools.pairwise(y))
            best = max(itertools.product(range(3), repeat=int(b - a)), key=value)
            assert value(got[a:b]) == pytest.approx(value(best), abs=1e-4)


def test_tokens(spark, docs, texts):
    path = tokens.tokenizer_file()
    odd = ["it's 'RE <|endoftext|> ß İ x", "a\x1cb\tc", "ª²½ ÀÖ×÷ 12.5%", "́x"]
    assert tokens.encode_texts(odd + texts, path) == tokens.encode_texts(odd + texts, path, split=False)
    written = tokens.write_tokens(docs)
    got = sorted(written.documents().collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 0, *range(len(texts))]
    at = 0
    for r in got:
        ids = tokens.encode_texts([texts[r.doc_id if r.doc_id is not None else 2]], path)[0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += r.n_tokens
    assert written.get(4) == [np.frombuffer(tokens.encode_texts([texts[4]], path)[0], "<u4").tolist()] and len(written.get(0)) == 2
    assert tokens.write_tokens(docs.limit(0)).documents().count() == 0


def test_mixing(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(["aa", "bb", "cc"] if i % 3 else ["dd", "ee", "ff"], k=20 + i % 7))) for i in range(90)] + [(3, None), (None, ""), (200, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "x" if i % 3 else "y") for i in range(0, 60)] + [(None, "x")], "doc_id long, domain string")
    out = mixing.mixing_rates(df, labels, {"x": 1, "y": 1}).toPandas()
    n = out.n_words.sum()
    for k in ("x", "y"):
        assert (out.rate * out.n_words * out[f"p_{k}"]).sum() / n == pytest.approx(0.5, abs=1e-5)
    assert len(out) == 93 and (out.rate >= 0).all()
    assert mixing.mixing_rates(df, labels.limit(0), {"x": 1}).where("rate <> 1").count() == 0
    assert mixing.mixing_rates(df.limit(0), labels, {"x": 1}).count() == 0


def test_mixing_against_brute_force(spark):
    """Naive Bayes by dictionaries, and the least squares by many steps on arrays."""
    import math

    r = random.Random(12)
    kinds = {"x": ["aa", "bb", "cc", "shared"], "y": ["dd", "ee", "shared"], "z": ["ff", "gg", "aa"]}
    texts = [" ".join(r.choices(kinds[r.choice("xyz")], k=r.randrange(1, 30)) + r.choices(["shared", "Aa", "new"], k=3)) for _ in range(150)] + [None, "", " \n\t", "zz " * 20_000]
    rows = [(i, t, "w", 1, 2.0, 3) for i, t in enumerate(texts)]
    rows += [rows[5]] * 4 + [(7, "aa bb", "w", 1, 2.0, 3), (None, "dd ee", "w", 1, 2.0, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, copies int, rate double, n int").repartition(3)
    owner = {i: "xyz"[i % 3] for i in range(60)}
    labels = spark.createDataFrame([*owner.items(), (None, "x"), (200, "x")], "doc_id long, domain string")
    targets = {"x": 0.5, "y": 0.2, "z": 0.3}
    got = mixing.mixing_rates(df, labels, targets).toPandas()
    words = lambda t: [w for w in re.split("[ \t\n\x0b\x0c\r]", (t or "").lower()) if w]
    counts = {k: {} for k in kinds}
    for i, t, *_ in rows:
        for w in words(t) if i in owner else ():
            counts[owner[i]][w] = counts[owner[i]].get(w, 0) + 1
    sizes = {k: sum(counts[k].values()) for k in kinds}
    labelled = [*owner.values(), "x"]
    n, p, of = [], [], []
    for i, t, *_ in rows:
        s = [math.log(labelled.count(k) / len(labelled)) + sum(math.log((counts[k].get(w, 0) + 0.5) / (sizes[k] + 0.5 * (1 << mixing.BITS))) for w in words(t)) for k in sorted(kinds)]
        e = [math.exp(v - max(s)) for v in s]
        n.append(len(words(t)))
        p.append([v / sum(e) for v in e])
        of.append((i, t))
    n, p, goal = np.array(n, float), np.array(p), np.array([0.5, 0.2, 0.3])
    w = np.linalg.inv((p * n[:, None]).T @ p / n.sum())
    rate = np.ones(len(n))
    for _ in range(3000):
        rate = np.maximum(0, rate - p @ (w @ ((rate * n) @ p / n.sum() - goal)))
    by = {(x.doc_id if x.doc_id == x.doc_id else None, x.n_words, round(x.p_x, 6)): x for x in got.itertuples()}
    assert len(got) == len(set(of)) and got.copies.sum() == len(rows)
    for (i, _), size, own, want in zip(of, n, p, rate, strict=True):
        x = by[i, int(size), round(own[0], 6)]
        assert (x.p_x, x.p_y, x.p_z) == pytest.approx(tuple(own), abs=1e-9) and x.rate == pytest.approx(want, abs=1e-3)
    shares = [(got.rate * got.n_words * got.copies * got[f"p_{k}"]).sum() / n.sum() for k in "xyz"]
    assert shares == pytest.approx(goal, abs=1e-5)


def test_mixing_tells_what_it_cannot_meet(spark):
    df = spark.createDataFrame([(i, "aa bb") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "x") for i in range(6)], "doc_id long, domain string")
    with pytest.warns(UserWarning, match="shares of"):
        out = mixing.mixing_rates(df, labels, {"x": 0.5, "y": 0.5})
    assert out.count() == 1 * 6 and out.where("rate < 0").count() == 0


def brute_urls(urls, rules, labels):
    """Host, path, rule, verdict, template, purity of each url, by plain loops."""
    out = []
    for url, label in zip(urls, labels, strict=True):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        out.append({"host": host, "path": path, "rule": best and best[1] + best[2], "verdict": best and best[0], "label": {"allow": 1, "block": 0}.get(best and best[0], label), "segs": [s for s in path.split("/") if s], "tmpl": ""})

    def grow(rows, level):
        rows = [r for r in rows if len(r["segs"]) > level]
        by = {}
        for r in rows:
            by.setdefault(r["segs"][level], []).append(r)
        found = []
        for seg, own in sorted(by.items()):
            if len(rows) >= urls_module.MIN_COUNT and len(own) >= urls_module.MIN_COUNT and urls_module.wilson_low(len(own), len(rows)) >= urls_module.MIN_SHARE:
                deep = [len(r["segs"]) - level for r in own]
                one = {"segs": [seg], "n": len(own), "good": sum(r["label"] == 1 for r in own), "bad": sum(r["label"] == 0 for r in own), "deep": sum(deep), "deep2": sum(d * d for d in deep)}
                for g in found:
                    if min(g["good"] + g["bad"], one["good"] + one["bad"]) >= urls_module.MIN_LABELLED and urls_module._alike(g, one):
                        g["segs"].append(seg)
                        for k in ("n", "good", "bad", "deep", "deep2"):
                            g[k] += one[k]
                        break
                else:
                    found.append(one)
        name = {s: "|".join(sorted(g["segs"])) for g in found for s in g["segs"]}
        nodes = {}
        for r in rows:
            r["tmpl"] += "/" + name.get(r["segs"][level], "*")
            nodes.setdefault(r["tmpl"], []).append(r)
        for own in nodes.values():
            grow(own, level + 1)

    hosts = {}
    for r in out:
        hosts.setdefault(r["host"], []).append(r)
    for own in hosts.values():
        grow(own, 0)
    for r in out:
        own = [x["label"] for x in out if (x["host"], x["tmpl"]) == (r["host"], r["tmpl"]) and x["label"] is not None]
        r["purity"] = (sum(own) + urls_module.PRIOR * urls_module.STRENGTH) / (len(own) + urls_module.STRENGTH)
        r["verdict"] = r["verdict"] or ("block" if r["purity"] < urls_module.CUT else "allow")
    return [(r["host"], r["path"], r["rule"], r["verdict"], r["tmpl"], round(r["purity"], 9)) for r in out]


@pytest.mark.parametrize("small", [False, True], ids=["broadcast", "dealt"])
def test_urls_against_brute_force(spark, monkeypatch, small):
    from ferrule.llm import common

    if small:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    r = random.Random(3)
    names = ["ann", "bob", "cat", "dan", "eve", "fay", "gus", "hal"]
    pages = [f"https://{r.choice(['a.h.io', 'h.io', 'x.org'])}/{r.choice(['ads', 'ads', 'news', 'blog', 'v2', ''])}/{r.choice(names + [str(r.randrange(10**6))])}/{'/'.join(r.choices(['p', 'q', str(r.random())], k=r.randrange(4)))}{r.choice(['', '?u=/z', '#f', '/'])}" for _ in range(700)]
    pages += [f"http://few.io/{n}" for n in names] + ["http://deep.io/" + "/".join("abcdefghijkl")] * 12 + ["http://deep.io/" + "/".join("abcdefghijkm") + "/1/2"]
    pages += [None, None, "nothing", "http://h.org#frag", "http://h.org?q=http://z/", "HTTP://UPPER.Io/É/ß", "http://Www.Example.com/en/7?x", "http://a.com/en/1", "https://de.net/de/8", "https://b.example.net/de/8", "http://x.org/es/" + "y/" * 300]
    rules = [*urls.RULES, ("block", "h.io", "/ads/1"), ("allow", "h.io", "/news/1"), ("block", "a.h.io", "/blog/b"), ("allow", "deep.io", "/a/b")]
    labels = [r.choice([None, None, None, 0, 1]) for _ in pages]
    df = spark.createDataFrame([(i, u, m, "s", 1, True) for i, (u, m) in enumerate(zip(pages, labels, strict=True))], "page_id long, url string, label int, seg string, size int, open boolean").repartition(3)
    want = brute_urls(pages, rules, labels)
    got = {x.page_id: x for x in urls.judged(df, rules, "label").collect()}
    assert len(got) == len(pages)
    for i, w in enumerate(want):
        x = got[i]
        assert (x.host, x.path, x.rule, x.verdict, x.template, round(x.purity, 9)) == w
    made = {w[4] for w in want if w[0] == "few.io"}
    assert made == {"/*"} and any("|" in w[4] or "*" in w[4] for w in want) and {w[3] for w in want if w[2] is None} == {"allow", "block"}


def test_urls(spark):
    rows = ["http://Www.Example.com/en/7?x", "http://a.com/en/1", "https://de.net/de/8", "https://b.example.net/de/8"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judged(df).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(4)] == [("example.com/en/7", "allow"), ("com/en/", "block"), ("net/de/", "allow"), ("example.net/de/8", "block")]
    assert urls.judged(df.limit(0)).count() == 0 and urls.judged(df.union(df)).count() == 8


PAGES = [
    "<html><head><title>T</title><script>x('</p>')</script></head><p>Tom &amp; Jerry&#8217;s caf&eacute;&nbsp;&hearts;<br>end</p></html>", None, "", "a < b and c > d", "<p title='a > b'>in</p>out", "<!-- no -- end", "<b>bo</b>ld<style>p{}</style>x",
    "<SCRIPT src=a>1</SCRIPT >two", "<p", "&lt;b&gt;", "x" * 200_000, "<" * 50_000, "<a " * 30_000, "<!-- " * 20_000, "é\u2028ß <ul><li>1<li>2</ul>",
]


def test_warc(spark, sf, tmp_path):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.parts, self.off = [], None

        def handle_starttag(self, tag, attrs):
            self.off = tag if tag in ("script", "style", "noscript") else self.off

        def handle_endtag(self, tag):
            self.off = None if tag == self.off else self.off

        def handle_data(self, data):
            self.parts += [data] * (self.off is None)

    tables = [spark.createDataFrame([(i, f"http://a/{i}", p, "x", "y") for i, p in enumerate(PAGES)] + [(50, "http://a/b", PAGES[0], "x", "y"), (51, "http://a/b", PAGES[0], "x", "y"), (None, None, "t", "x", "y")], "page_id long, url string, html string, row string, r string")]
    tables.append(spark.read.parquet(f"{sf}/pages.parquet"))
    for k, pages in enumerate(tables):
        source = warc.responses(pages)
        out = warc.serialized(warc.derivatives(source)).collect()
        by, rows = {r.page_id: r for r in source.collect()}, {r.page_id: r.html or "" for r in pages.collect()}
        assert len(out) == 2 * len(rows) and len({r.record_id for r in out}) == len(out)
        links = {r.page_id: r for r in out if r.warc_type == "conversion"}
        for r in out:
            src, body = by[r.page_id], r.block.encode()
            digest = "sha256:" + hashlib.sha256(body).hexdigest()
            assert r.refers_to == src.record_id and r.target_uri == src.target_uri and r.date == src.date and r.block_digest == digest
            assert r.source_payload_digest == "sha256:" + hashlib.sha256(rows[r.page_id].encode()).hexdigest()
            head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
            assert rest == body + b"\r\n\r\n" and f"Content-Length: {len(body)}".encode() in head.split(b"\r\n") and head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.warc_type.encode())
            if r.warc_type == "metadata":
                lines = r.block.split("\r\n")
                assert {"http-status: HTTP/1.1 200 OK", "http-header: Content-Type: text/html; charset=utf-8", "source-block-digest-holds: yes", f"conversion: {links[r.page_id].record_id}", f"conversion-digest: {links[r.page_id].block_digest}", f"source-block-digest: {src.block_digest}"} <= set(lines)
            elif k:
                plain = Plain()
                plain.feed(rows[r.page_id])
                assert "".join(r.block.split()) == "".join("".join(plain.parts).split())
        where = f"{tmp_path}/{k}"
        warc.write(warc.derivatives(source), where)
        again = warc.read(spark, where)
        assert sorted((r.record_id, r.warc_type, r.refers_to, r.block, r.block_digest) for r in again.collect()) == sorted((r.record_id, r.warc_type, r.refers_to, r.block, r.block_digest) for r in out)
        assert again.where("whole").count() == len(out)
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_warc_texts_and_headers(spark):
    assert [warc.text_of(PAGES[i]) for i in (0, 2, 3, 4, 5, 6, 7, 8, 9, 14)] == ["T\nTom & Jerry’s café ♥\nend", "", "a < b and c > d", "in\nout", "", "bold x", "two", "", "<b>", "é\u2028ß\n1\n2"]
    began = time.time()
    for p in PAGES:
        warc.text_of(p or "")
    assert time.time() - began < 2
    blocks = ["HTTP/1.0 404 Not Found\nX-A: 1\n\tfolded\nno colon\nSet-Cookie: B\n\n<p>x</p>\r\n\r\ny", "HTTP/1.1 200 OK\r\nA:b", "no head", None, ""]
    rows = [(i, None, "response", None, None, None, None, b, "md5:0", None) for i, b in enumerate(blocks)] + [(9, "<x>", "request", None, None, None, None, "", None, None)]
    df = spark.createDataFrame(rows, "i int, record_id string, warc_type string, target_uri string, date string, refers_to string, content_type string, block string, block_digest string, payload_digest string")
    got = {(r.i, r.warc_type): r for r in warc.derivatives(df).collect()}
    assert len(got) == 10 and got[0, "metadata"].block.split("\r\n")[:5] == ["http-status: HTTP/1.0 404 Not Found", "http-header: X-A: 1", "http-header: \tfolded", "http-header: no colon", "http-header: Set-Cookie: B"]
    assert "source-block-digest-holds: unchecked" in got[0, "metadata"].block
    assert [got[i, "conversion"].block for i in range(5)] == ["x\ny", "", "no head", "", ""]


def test_toxicity(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choices(WORDS, k=40) + (["vile", "foul", "nasty"] if i % 4 == 0 else []))) for i in range(400)]
    df = spark.createDataFrame([*rows, (500, None), (501, ""), (None, "vile foul")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(df, labels).collect()}
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in range(300, 400)]) > 0.95
    assert got[500].predicted == 0 and len(got) == 403 and all(0 <= x.score <= 1 for x in got.values())
    assert {x.score for x in toxicity.toxicity(df, labels.limit(0)).collect()} == {0.0}


def test_toxicity_of_odd_rows(spark):
    rows = [(i, "vile foul " * (i % 3 == 0) + "quiet calm day", "e", 1.0, "p") for i in range(120)] + [(500, "vile foul " * 30_000, "e", 1.0, "p"), (501, None, "e", 1.0, "p"), (0, "vile foul quiet calm day", "e", 1.0, "p"), (0, "vile foul quiet calm day", "e", 1.0, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, evidence string, score double, terms string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, labels).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(rows) and by[500].predicted == 1 and by[501].predicted == 0 and [by[i].predicted for i in range(90, 93)] == [1, 0, 0]
    assert set(by[99].evidence) <= set(range(90)) and len(by[99].evidence) > 0 and by[501].evidence == []
    assert toxicity.toxicity(df.limit(0), labels).count() == 0 and toxicity.toxicity(df, labels, evidence=False).columns == ["doc_id", "score", "predicted"]


def brute_nearest(texts, examples, k):
    """Cosines over the whole TF-IDF vectors, terms as strings."""
    import collections
    import math

    def terms(t):
        words = re.findall(rb"[A-Za-z\x80-\xff]+", (t or "").encode())
        return collections.Counter(p for w in words for w in [bytes(c | 32 if 65 <= c <= 90 else c for c in w)] for p in [(0, w), *((n, w[:n]) for n in toxicity.PREFIXES if len(w) > n)])

    bags = [terms(t) for t in texts]
    df = collections.Counter(x for b in bags for x in b)
    seen = {x for i in examples for x in bags[i]}
    vectors = []
    for b in bags:
        v = {x: (1 + math.log(n)) * math.log((1 + len(texts)) / (1 + df[x] * (x in seen))) for x, n in b.items()}
        size = math.sqrt(sum(w * w for w in v.values())) or 1
        vectors.append({x: w / size for x, w in v.items()})
    return [sorted((sum(w * vectors[j].get(x, 0) for x, w in v.items()) for j in examples), reverse=True)[:k] for v in vectors]


def test_toxicity_index_is_exact(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdefgé", k=r.randrange(2, 9))) for _ in range(300)]
    texts = [" ".join(r.choices(vocabulary[: r.choice((20, 100, 300))], k=r.randrange(1, 60))) for _ in range(420)] + [None, "", "12"]
    texts += texts[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 420, 2)], "doc_id long, toxic int")
    from ferrule.llm.common import Scratch

    index = toxicity.fit(df, labels, Scratch(spark, "test"))
    assert index.n == 210 and index.n_blocks == 2 and 0 < index.long.shape[0] < len(index.keys)
    want = brute_nearest(texts, range(0, 420, 2), 10)
    import pyarrow as pa

    found = {row: index.weigh(t, n) for row, t, n in toxicity.per_text(pa.array(texts, pa.string()))}
    rows = list(found)
    who, cos = index.nearest([found[i] for i in rows], 10)
    for i, own, near in zip(rows, cos, who, strict=True):
        assert np.allclose(own, want[i] + [0] * (10 - len(want[i])), atol=1e-5)
        assert len(set(near[near >= 0])) == (near >= 0).sum() and (np.diff(own) <= 1e-6).all()
    assert set(range(len(texts))) - set(rows) == {420, 421, 422}


def test_blocks_out_of_reach_change_nothing():
    rng = np.random.default_rng(0)
    import pickle

    index = toxicity.Index(np.arange(400, dtype=np.uint64), rng.integers(1, 500, 400), 1000)
    bags = []
    for i in range(900):
        t = np.unique(np.concatenate([rng.integers(0, 20, 6), 20 + 38 * (i % 10) + rng.integers(0, 38, 12)]))
        bags.append((t, rng.integers(1, 5, len(t))))
    index.build(bags, np.zeros(900), np.arange(900))
    index = pickle.loads(pickle.dumps(index))
    vectors = [index.weigh(t.astype(np.uint64), n) for t, n in bags]
    dense = np.zeros((900, 400), np.float32)
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    full = dense @ dense.T
    who, cos = index.nearest(vectors[:50], 15, skip=np.argsort(index.ids)[:50])
    full[np.arange(50), np.arange(50)] = 0
    assert np.allclose(cos, -np.sort(-full[:50], 1)[:, :15], atol=1e-5)
    assert np.allclose(np.take_along_axis(full[:50], index.ids[who], 1), cos, atol=1e-5)
