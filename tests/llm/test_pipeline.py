"""The pipeline's stages, each against a brute-force version on rows of its own, and the whole on the smallest tables."""

import random

import pytest

import corpus_pipeline
from ferrule.llm import langid, mixing, ngram, tokens

WORDS = [a + b for a in ("ba", "ko", "ti", "mu", "se", "la") for b in ("n", "r", "st", "mo", "pe", "lu", "gi")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, items string, rid int, comp int"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    base = [" ".join(r.choices(WORDS, k=60)) for _ in range(6)]
    return base


@pytest.fixture(scope="module")
def rows(texts):
    a, b, c, d, e, f = texts
    near, nearer = a + " extra", a + " extra words"
    out = [(1, a), (None, near), (3, nearer), (4, b), (4, c), (4, b), (None, d), (None, d), (6, None), (7, ""), (None, ""), (8, " \n"), (9, "12 ½ ²"), (10, e), (11, e.upper().replace(" ", "  ")), (12, f * 50)]
    return [(i, t, "xx" if k % 2 else "yy", f"s{k}", k, "r", "i", 5, 6) for k, (i, t) in enumerate(out)]


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def sf_dir(spark, texts, tmp_path):
    words = texts[1].split()
    items = [(1, " ".join(words[5:20])), (2, None), (3, ""), (None, texts[3]), (4, " ".join(reversed(texts[4].split())))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, i % 2, int(i == 3)) for i in (1, 3, 4, 6, 10, 12)] + [(None, 1, 0), (4, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_language_id_drops_letterless_rows_alone(spark, docs, rows, sf_dir):
    got = STAGE["language ID"](spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert held(got) == sorted((r for r in rows if r[1] and any(map(str.isalpha, r[1]))), key=str)


def test_join_keeps_one_of_each_group(spark, docs, rows, texts, sf_dir):
    got = held(STAGE["n-gram Jaccard join"](spark, docs, sf_dir))

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    want = set()
    for g in set(group):
        own = [r for r, x in zip(rows, group, strict=True) if x == g]
        want.add(min((r[0] is None, r[0] or 0, r[1] or "") for r in own) if shingles(own[0][1]) else (own[0][0] is None, own[0][0] or 0, own[0][1] or ""))
    assert len(got) == len(want) and {(r[0] is None, r[0] or 0, r[1] or "") for r in got} == want
    assert set(got) <= set(rows)  # whole rows, none put together from two
    assert [r for r in got if r[:2] == (4, texts[1])] == [min(r for r in rows if r[:2] == (4, texts[1]))]
    # The row without id joins the two beside it.
    assert [r[0] for r in got if r[1] and "extra" in r[1]] == [] and sum(r[0] == 1 for r in got) == 1


def test_decontamination_drops_rows_with_one_item(spark, docs, rows, texts, sf_dir):
    got = held(STAGE["benchmark decontamination"](spark, docs, sf_dir))
    assert got == sorted((r for r in rows if r[1] != texts[1]), key=str)  # the clean row of the same id stays, null ids too


def test_mixing_repeats_rows_by_their_rates(spark, docs, rows, sf_dir):
    labels = mixing.labelled_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rates = mixing.mixing_rates(docs, labels, mixing.TARGETS).select("doc_id", "h", "rate").collect()
    by = {(r.doc_id, r.h): r.rate for r in rates}
    import pyspark.sql.functions as F

    keyed = docs.select("*", F.xxhash64("text").alias("_h"), F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1_000_000)).alias("_p")).collect()
    want = []
    for r in keyed:
        rate = by[r.doc_id, r._h]
        want += [tuple(r)[:-2]] * (int(rate) + (r._p < (rate - int(rate)) * 1_000_000))
    assert held(STAGE["mixing sources to target weights"](spark, docs, sf_dir)) == sorted(want, key=str)


def test_token_files_hold_every_row(spark, docs, rows, sf_dir):
    got = sorted(STAGE["token-ID / binary output"](spark, docs, sf_dir).collect(), key=lambda r: r.start)
    path = tokens.tokenizer_file()
    sizes = sorted((r[0] is not None, r[0] or 0, len(tokens.encode_texts([r[1]], path, split=False)[0]) // 4) for r in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in got) == sizes
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_empty_tables(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), sf_dir)
        assert out.count() == 0 and (name.startswith("token") or out.columns == docs.columns)


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert set(out.columns) >= {"doc_id", "start", "n_tokens", "ids_crc32"}
    rows = sorted(out.collect(), key=lambda r: r.start)
    assert 0 < len(rows) and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    known = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in rows} <= known and len({r.doc_id for r in rows}) > 0.5 * len(known)
    # No word run of eight that is a benchmark item's is left.
    import re

    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower() if t.isascii() else "".join(c.lower() if c.isascii() else c for c in t))
    windows = {tuple(w[i : i + 8]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in [words(r.text or "")] for i in range(len(w) - 7)}
    kept = {r.doc_id for r in rows}
    for r in docs.collect():
        w = words(r.text or "")
        if r.doc_id in kept:
            assert not windows & {tuple(w[i : i + 8]) for i in range(len(w) - 7)}


def test_language_model_without_labels(spark, docs):
    assert langid.identified(docs, None, spans=False).where("lang_pred <> 'und'").count() == 0


def test_jaccard_stage_sends_sets_in_parts(spark, docs, sf_dir, monkeypatch):
    """Stage 2 keeps the same rows when few sets may go out at once."""
    whole = held(STAGE["n-gram Jaccard join"](spark, docs, sf_dir))
    sent, bits = [], ngram.wanted_filter
    monkeypatch.setattr(ngram, "wanted_filter", lambda ids: sent.append(ids.count()) or bits(ids))
    monkeypatch.setattr(ngram, "PART_ROWS", 1, raising=False)
    assert held(STAGE["n-gram Jaccard join"](spark, docs, sf_dir)) == whole
    assert len(sent) > 2  # two rounds send all at once otherwise
