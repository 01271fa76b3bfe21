"""Runs, manifest and prefix encoding: the jobs against brute force, and the defined cases of each operator."""

import hashlib
import json
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle_manifest, periodic_runs, prefix_bpe
from tessera.llm.queries import QUERIES, _planted

SF = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


# ---------------------------------------------------------------- runs

def test_run_job(spark, docs):
    got = {r.doc_id: tuple(r)[2:] for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    want = {r.doc_id: brute.run_row(r.doc_id, r.text) for r in docs if len(brute.words(r.text)) < 3000}
    assert len(got) == len(docs) and {i: got[i] for i in want} == want
    assert sum(w[0] > 0 for w in want.values()) > len(want) // 20


@pytest.mark.parametrize("least", [2, 4, 7, 12, 20])
def test_runs_are_those_of_brute_force(least):
    rnd = random.Random(least)
    for _ in range(400):
        w = [rnd.randrange(rnd.choice([1, 2, 3, 5])) for _ in range(rnd.randint(0, 90))]
        for _ in range(rnd.randint(0, 3)):
            if len(w) > 5:
                a = rnd.randrange(len(w))
                p, m = rnd.randint(1, max(1, (len(w) - a) // 2)), rnd.randint(0, len(w) - a)
                w[a:a + m] = [w[a + i % p] for i in range(m)]
        assert list(zip(*(x.tolist() for x in periodic_runs.find_runs(np.array(w, np.int64), least)))) == brute.runs(w, least)


def test_runs_of_long_and_hard_texts():
    for n in (1, 11, 12, 50_000):
        got = [x.tolist() for x in periodic_runs.find_runs(np.zeros(n, np.int64))]
        assert got == ([[0], [n], [1]] if n >= 12 else [[], [], []])
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    assert list(zip(*(x.tolist() for x in periodic_runs.find_runs(np.array(b))))) == brute.runs(b)
    assert not len(periodic_runs.find_runs(np.empty(0, np.int64))[0])


def test_runs_odd(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "GROUP", 50)  # several passes in a batch; no effect on results
    texts = [None, "", " \n\t", "a", "a b " * 6, "a b " * 6, "x " + "a " * 11, "a\u00a0b c\x0b" * 9, "é " * 30 + "z " + "é " * 30, "w " * 40_000,
             " ".join(f"v{i % 700}" for i in range(5000)), " ".join(f"u{i}" for i in range(500))]
    rows = [(i, t, "s", 1.0, "k") for i, t in enumerate(texts)] + [(None, "a b " * 6, None, None, None), (4, "a b " * 6, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words double, key string")
    got = periodic_runs.collapse_runs(df)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        text = texts[4] if r.doc_id is None else texts[r.doc_id]
        w = brute.words(text)
        assert r.n_words == len(w)
        if len(w) < 6000:
            found = brute.runs(w)
            gone = {i for s, length, q in found for i in range(s + q, s + length)}
            assert [tuple(x) for x in r.runs] == found
            assert r.collapsed == b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
    assert [tuple(x) for r in out if r.doc_id == 9 for x in r.runs] == [(0, 40_000, 1)]
    assert [r.collapsed for r in out if r.doc_id == 9] == ["w"]
    assert periodic_runs.collapse_runs(df.where("false")).count() == 0


def test_every_tenth_text_is_made_periodic(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:6] + [1, None]
    texts = ["", None, "one", "a b c", " ".join(map(str, range(97))), "x\ty " * 40, "left as is  ", " also "]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    for r in _planted(df).collect():
        assert periodic_runs.collapse_runs(spark.createDataFrame([r], "doc_id long, text string")).first().n_words == len(brute.words(texts[ids.index(r.doc_id)]))
    assert {r.doc_id: r.text for r in _planted(df).collect() if r.doc_id in (1, None)} == {1: "left as is  ", None: " also "}


# ---------------------------------------------------------------- manifest

def test_manifest_job(spark, docs):
    def row(r):
        text = r.text
        if zlib.crc32(str(r.doc_id).encode()) % 3 == 0:
            text = text.translate({c: c + 32 for c in range(65, 91)})
        return r.lang, r.doc_id, brute.leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text), brute.leaf(r.doc_id, r.source, r.lang, r.n_chars, text)

    got = sorted(tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, SF).collect())
    assert got == sorted((*p, p[-1] == p[3]) for p in brute.proofs([row(r) for r in docs]))
    assert 0 < sum(r[-1] for r in got) < len(got)


def _manifest(spark, rows):
    """rows: (group, key, text)"""
    df = spark.createDataFrame(rows, "lang string, id long, text string").withColumns({"path": F.lit("p"), "n": F.lit(1), "digest": F.lit("d"), "rank": F.lit(0)})
    df = df.withColumn("own", merkle_manifest.leaf_digest([F.col("id"), F.col("lang"), F.col("text")]))
    return df, merkle_manifest.build(df, "lang", "id", "own")


def _answers(proofs):
    path = F.col("path")
    return sorted((tuple(r) for r in proofs.select("id", "own", "subroot", "root", merkle_manifest.siblings_digest(path),
                                                   merkle_manifest.folded(F.col("own"), path)).collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [8], [9], [1, 1], [65, 3, 1, 8], [1] * 70, [513]])
def test_manifest_shapes(spark, sizes):
    rows = [(None if g == 1 else f"g{g}", i, f"t{g}-{i}") for g, n in enumerate(sizes) for i in range(n)]
    df, manifest = _manifest(spark, rows)
    want = brute.proofs([(g, i, own := brute.leaf(i, g, t), own) for g, i, t in rows])
    assert _answers(manifest.prove()) == sorted(want, key=repr)
    assert all(w[3] == w[5] == manifest.root for w in want)


def test_manifest_odd(spark):
    """Null keys, groups and texts, ties, repeated rows, a long text, clashing columns; requests for some rows; a null group."""
    rows = [(g, i, t) for g in (None, "", "é", "Z") for i, t in [(None, "a"), (None, "a"), (None, None), (3, "x"), (3, "y"), (3, "x"), (5, "long " * 50_000), (6, "")]]
    rows += [("Z", 7, None)] * 20
    df, manifest = _manifest(spark, rows)
    want = brute.proofs([(g, i, own := brute.leaf(i, g, t), own) for g, i, t in rows])
    assert _answers(manifest.prove()) == sorted(want, key=repr)
    proofs = manifest.prove(df.where("id = 3 or lang is null and id is null"))
    assert proofs.columns == ["lang", "id", "text", "n", "digest", "rank", "own", "subroot", "root", "path"]
    asked = {w for w in want if w[0] == 3} | {w for w in want if w[0] is None and w[2] == want[0][2]}
    assert set(_answers(proofs)) == asked and proofs.count() == 15
    store = {r.digest: r.children for r in manifest.store().collect()}
    assert all(brute.digest(*c) == d for d, c in store.items()) and manifest.root in store
    _, none = _manifest(spark, [])
    assert none.root is None and none.prove().count() == 0


def test_manifest_notices_every_change(spark):
    rows = [("a", i, f"t{i}") for i in range(20)]
    _, before = _manifest(spark, rows)
    for changed in (rows[1:], rows + [("a", 20, "t20")], [("a", 0, "T0")] + rows[1:], [("b", 0, "t0")] + rows[1:]):
        assert _manifest(spark, changed)[1].root != before.root
    assert _manifest(spark, rows[::-1])[1].root == before.root


# ---------------------------------------------------------------- prefix encoding

def _library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


def test_prefix_job(spark, docs):
    t = _library("word_bpe_49k.json")

    def row(text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_prefix_bpe"](spark, SF).collect()} == {r.doc_id: row(r.text) for r in docs}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_prefix_ids_are_the_librarys(name):
    from test_tokens import PIECES

    rnd = random.Random(9)
    texts = ["", None] + ["".join(rnd.choices([*PIECES, "<|startoftext|>", "<|EndOfText|>", "a" * 300, "İ", "H\u0331"], k=rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rnd.choices("aeinst", k=rnd.randint(1, 60))) for _ in range(2000)]
    t, parts = _library(name), prefix_bpe.tables(P.path(name))
    encode, read = prefix_bpe.PrefixEncoder(P.path(name), parts, cache_bytes=1 << 18), prefix_bpe.decoder(parts)
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for lo in range(0, len(texts), 100) for x in encode(texts[lo:lo + 100])]
    assert got == want
    assert [read(ids) for ids in want] == [t.decode(ids, skip_special_tokens=False) for ids in want]


def test_prefix_tokens_that_are_not_their_own_encoding(tmp_path):
    """Merges that keep others from coming about: every text of four letters, against the library."""
    from itertools import product

    from tokenizers import Tokenizer, models

    merges = [("b", "c"), ("a", "b"), ("ab", "c"), ("c", "c"), ("cc", "a"), ("a", "a"), ("aa", "aa"), ("bc", "c")]
    words = ["a", "b", "c"] + ["".join(m) for m in merges]
    t = Tokenizer(models.BPE(vocab={w: i for i, w in enumerate(words)}, merges=merges))
    t.save(str(tmp_path / "own.json"))
    encode = prefix_bpe.PrefixEncoder(str(tmp_path / "own.json"), prefix_bpe.tables(str(tmp_path / "own.json")))
    texts = ["".join(x) for n in range(1, 9) for x in product("abc", repeat=n)] + ["", "axbz"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_prefix_files_not_covered(tmp_path):
    settings = json.load(open(P.path("word_bpe_49k.json")))
    for change in ({"dropout": 0.1}, {"unk_token": "x"}, {"type": "Unigram"}, {"byte_fallback": True}, {"merges": settings["model"]["merges"][::-1]}):
        (tmp_path / "t.json").write_text(json.dumps({**settings, "model": {**settings["model"], **change}}))
        with pytest.raises(ValueError):
            prefix_bpe.tables(str(tmp_path / "t.json"))


def test_prefix_odd(spark):
    name = P.path("word_bpe_49k.json")
    t = _library("word_bpe_49k.json")
    texts = [None, "", "  ", "One two", "One two", "<|endoftext|>x<|startoftext|>", "y" * 100_000, "word " * 30_000]
    rows = [(i, x, "i", "d", 0) for i, x in enumerate(texts)] + [(None, "One two", None, None, None), (3, "One two", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string, key int")
    got = prefix_bpe.encode_documents(df, name, with_text=True)
    out = got.collect()
    assert got.columns == ["doc_id", "ids", "decoded"] and len(out) == len(rows)
    for r in out:
        ids = t.encode((texts[3] if r.doc_id is None else texts[r.doc_id]) or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    plain = prefix_bpe.encode_documents(df, name)
    assert plain.columns == ["doc_id", "ids"]
    back = prefix_bpe.decode_documents(plain.withColumn("decoded", F.lit(1)), name)
    assert sorted(back.collect(), key=repr) == sorted(got.select("doc_id", "decoded").collect(), key=repr)
    lists = spark.createDataFrame([(1, None), (2, []), (3, [49407, None, 10**6, -1, 320])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in prefix_bpe.decode_documents(lists, name).collect()} == {1: None, 2: "", 3: t.decode([49407, 320], skip_special_tokens=False)}
    assert prefix_bpe.encode_documents(df.where("false"), name).count() == 0
