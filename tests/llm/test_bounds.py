"""Bounds, orders and odd rows of the operators, against plain versions."""

import json
import random
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import components, decontam, encoding, licences, packing, pii, repair, shared, simhash, toxicity, warc


# encoding


def test_memo_is_bounded(monkeypatch):
    enc = encoding.Encoder(encoding.vocabulary("byte_bpe_50k.json"))
    monkeypatch.setattr(encoding, "MEMO_BYTES", 20_000)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    text = " ".join(words) + " " + "日本語" * 30_000
    want = enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(enc.ids(text), "<u4").tolist() == want
    assert all(len(part) <= encoding.MEMO_PART for memo in (enc.first, enc.rest) for part in memo)
    assert len(enc.rest) < 100 and enc.rest.size <= 20_000


def test_other_vocabularies_encode_whole_texts(tmp_path):
    """A vocabulary that splits in another way isn't cut at spaces."""
    with open(encoding.vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        described = json.load(f)
    described["pre_tokenizer"]["use_regex"] = False
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(described, f)
    enc = encoding.Encoder(path)
    text = "to be or not to be, that is  the\nquestion"
    assert not enc.known and encoding.encoder(encoding.vocabulary("word_bpe_49k.json")).known
    assert np.frombuffer(enc.ids(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def odd_texts(rng, n):
    """Texts of letters, marks, digits, contractions, all white space, special tokens and other scripts."""
    white = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    parts = [*"aZé ßÿ×÷ªº0９'.,-_~\x00\x7f\n ", "'s", "'ll", " ", "  ", "\n", "\n\n", " the", "<|endoftext|>", "日本", "\u0301", "🙂"]
    return ["".join(rng.choices(parts + white if k % 2 else parts, k=rng.randint(0, 12))) for k in range(n)]


@pytest.mark.parametrize("together", [1, 50, 1 << 20])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_many_texts_at_once(name, together, monkeypatch):
    monkeypatch.setattr(encoding, "TOGETHER", together)
    enc = encoding.Encoder(encoding.vocabulary(name))
    texts = ["", "", *odd_texts(random.Random(together), 1500), "\nline", ""]
    want = [enc.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    for kind in (pa.string(), pa.large_string()):
        got = list(enc.many(pa.array(texts, kind).slice(1)))
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == want[1:]
    assert list(enc.many(pa.array([], pa.string()))) == [] and list(enc.many(pa.array(["", ""]))) == [b"", b""]


def test_new_words_are_merged_together(monkeypatch):
    """New words of all texts go to the library in calls of CALL_WORDS, not one by one; marks and line ends beside them make no other words."""
    enc = encoding.Encoder(encoding.vocabulary("byte_bpe_50k.json"))
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abcdefghijé", k=9)) for _ in range(2000)})
    texts = [" " + " ".join(w + rng.choice(["", ",", ".", "!", ".\n9"]) for w in words[k : k + 100]) for k in range(0, len(words), 100)]
    want = [enc.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    alone, tokenize, encode = [], enc.tokenize, enc._encode
    monkeypatch.setattr(enc, "tokenize", lambda x: alone.append(x) or tokenize(x))
    monkeypatch.setattr(enc, "_encode", lambda x: alone.append(x) or encode(x))
    for _ in range(2):
        assert [np.frombuffer(g, "<u4").tolist() for g in enc.many(pa.array(texts))] == want
    assert len(alone) < 10 and not any(c.isalpha() for x in alone for c in x)
    assert {w.decode()[1:] for w in enc.parts if w[-1:].isalnum() or w[-1] > 127} - {""} == set(words)


@pytest.mark.parametrize("byte", ["\u0120", "\u0100", "e"])
def test_many_without_a_byte(byte, tmp_path):
    """A vocabulary that lacks a byte (of the space, of NUL, a letter) drops it, with no ids for some parts."""
    with open(encoding.vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        described = json.load(f)
    model = described["model"]
    model["vocab"] = {t: i for t, i in model["vocab"].items() if byte not in t or t == "<|endoftext|>"}
    model["merges"] = [m for m in model["merges"] if byte not in "".join(m)]
    path = str(tmp_path / "less.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(described, f)
    enc = encoding.Encoder(path)
    texts = ["to be  or e\x00e eee", "\x00", "e", " e e", "\x00 e\x00", "more of these words"]
    want = [enc.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    for _ in range(2):
        assert [np.frombuffer(g, "<u4").tolist() for g in enc.many(pa.array(texts))] == want


def test_memo_of_parts_is_bounded(monkeypatch):
    """A full memo keeps the parts that were met again."""
    monkeypatch.setattr(encoding, "MEMO_BYTES", 20_000)
    monkeypatch.setattr(encoding, "TOGETHER", 200)
    enc = encoding.Encoder(encoding.vocabulary("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = [" often met " + " ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(20)) for _ in range(100)] + ["日本語" * 3000]
    for k, ids in enumerate(enc.many(pa.array(texts))):
        assert np.frombuffer(ids, "<u4").tolist() == enc.tokenizer.encode(texts[k], add_special_tokens=False).ids
        assert enc.held <= 20_000 and encoding._memo_size(enc.parts) == enc.held
        if k > 1:
            assert b" often" in enc.parts
    assert all(len(p) <= encoding.MEMO_PART for p in enc.parts)
    many_words = " ".join(str(k) + "x" for k in range(5000))
    assert np.frombuffer(next(enc.many(pa.array([many_words]))), "<u4").tolist() == enc.tokenizer.encode(many_words, add_special_tokens=False).ids
    assert enc.held <= 20_000


# Re-Pair


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4097, 100_000])
def test_runs_of_one_id(n):
    ids = np.full(n, 7, "<u4")
    g = repair.compress(ids, np.array([n]), 50_257)
    assert len(g.symbols) <= 2 + n // 500 + (n < 20) * n
    assert (repair.RepairFile(repair.pack_file(g, [1], np.array([n]))).document(0) == ids).all()


def test_copies_are_rules():
    """Thousands of copies take little more than one, and what is seldom stays as it is."""
    rng = np.random.default_rng(1)
    one = rng.integers(0, 50_000, 400).astype("<u4")
    sizes = np.array([400] * 2000 + [3])
    ids = np.concatenate([np.tile(one, 2000), np.array([1, 2, 3], "<u4")])
    g = repair.compress(ids, sizes, 50_257)
    assert len(g.symbols) < 2000 * 4
    f = repair.RepairFile(repair.pack_file(g, list(range(2001)), sizes))
    assert (f.document(1999) == one).all() and f.document(2000).tolist() == [1, 2, 3] and (f.document(7, 100, 300) == one[100:300]).all()


@pytest.mark.parametrize("vocab", [60, 65_530, 70_000])
def test_rules_at_the_edge_of_two_bytes(vocab):
    rng = np.random.default_rng(vocab)
    ids = (rng.zipf(1.6, 60_000) % 50).astype("<u4") + vocab - 60
    sizes = np.array([20_000, 0, 40_000])
    g = repair.compress(ids, sizes, vocab)
    f = repair.RepairFile(repair.pack_file(g, [None, 2, 3], sizes))
    assert (f.document(0) == ids[:20_000]).all() and (f.document(2) == ids[20_000:]).all() and len(f.document(1)) == 0
    assert g.symbols.itemsize == (2 if vocab < 1 << 16 else 4) and (vocab == 65_530 or len(g.symbols) < 40_000)


# packing


@pytest.mark.parametrize("length,windows,slack", [(64, 4, 3), (32, 1, 0), (100, 8, 100)])
def test_best_fit_and_fullest_out(length, windows, slack):
    rng = random.Random(length)
    packer, open_, closed, fresh = packing.Packer(0, length, windows, slack), {}, [], 0
    got = []
    for doc in range(400):
        size = rng.choice([1, 3, length // 2, length - 1, length, 2 * length + 5, rng.randint(1, length)])
        got += [(r[4], r[0], r[1], r[2]) for r in packer.add(doc, 0, b"\0\0\0\0" * size, size)]
        at = 0
        while size - at >= length:  # whole sequences first
            closed.append((fresh, doc, at, length))
            fresh, at = fresh + 1, at + length
        while at < size:
            room = {w: length - sum(p[2] for p in ps) for w, ps in open_.items()}
            fits = [w for w in open_ if room[w] >= size - at]
            if fits:
                w = min(fits, key=lambda w: (room[w], w))  # least room left
            elif len(open_) < windows:
                w, fresh = fresh, fresh + 1
                open_[w], room[w] = [], length
            else:
                w = min(open_, key=lambda w: (room[w], w))  # the fullest goes
                if room[w] <= slack:
                    closed += [(w, *p) for p in open_.pop(w)]
                    continue
            take = min(size - at, room[w])
            open_[w].append((doc, at, take))
            at += take
            if take == room[w]:
                closed += [(w, *p) for p in open_.pop(w)]
    assert sorted(got) == sorted(closed)
    assert sorted((r[4], r[0], r[1], r[2]) for r in packer.rest()) == sorted((w, *p) for w, ps in open_.items() for p in ps)


# toxicity


def naive_bins(text):
    codes, out = [ord(c) for c in text.lower()], set()
    for n in toxicity.ORDERS:
        for i in range(len(codes) - n + 1):
            h = 0
            for c in codes[i : i + n]:
                h = (h * 0x01000193 + c) % 2**32
            out.add((h * 0x9E3779B1) % 2**32 >> (32 - toxicity.BITS))
    return out


def test_scores_against_a_plain_version(spark):
    """The whole classifier once more: dictionaries for counts, a dense matrix for the regression."""
    rng = random.Random(8)
    bad, good = ["idiot", "moron", "scum"], ["garden", "river", "window"]
    texts = [(i, " ".join(rng.choice((bad if i % 3 == 0 else good) + ["the", "and"]) for _ in range(rng.randint(3, 12))), int(i % 3 == 0)) for i in range(90)]
    texts += [(200, None, 0), (201, "", 1), (202, "garden " * 5000, 0), (203, "ab", 0)]
    docs = spark.createDataFrame([(d, x) for d, x, _ in texts] + [(0, texts[0][1]), (300, "unlabelled idiot"), (None, "river")], "doc_id long, text string")
    labels = spark.createDataFrame([(d, t) for d, _, t in texts] + [(400, 1), (None, 1), (300, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    train = [(naive_bins(x or ""), t) for d, x, t in texts if zlib.crc32(str(d).encode()) % 5]
    pos, neg = {}, {}
    for bins, t in train:
        for b in bins:
            side = pos if t else neg
            side[b] = side.get(b, 0) + 1
    p_all, n_all, ratio = sum(pos.values()) + 1, sum(neg.values()) + 1, {}
    for b in pos.keys() | neg.keys():
        p, n = pos.get(b, 0) + 1, neg.get(b, 0) + 1
        r = np.log(p / p_all) - np.log(n / n_all)
        drawn = np.sign(r) * max(abs(r) - toxicity.SIGMAS * np.sqrt(1 / p + 1 / n), 0)
        if drawn:
            ratio[b] = drawn
    names = sorted(ratio)
    x = np.array([[ratio[b] if b in bins else 0.0 for b in names] for bins, _ in train])
    y = np.array([t for _, t in train], float)
    w, b0 = np.zeros(len(names)), np.log(y.mean() / (1 - y.mean()))
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, 201):
        err = 1 / (1 + np.exp(-(x @ w + b0))) - y
        g = np.append(x.T @ err / len(y) + 1e-4 * w, err.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b0 = w - step[:-1], b0 - step[-1]
    assert len(names) > 20
    for d, text in [(d, x) for d, x, _ in texts] + [(300, "unlabelled idiot"), (None, "river")]:
        z = b0 + sum(ratio[b] * w[k] for k, b in enumerate(names) if b in naive_bins(text or ""))
        assert got[d] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(2, f"text {i}") for i in range(100)] + [(2, "text 1"), (3, "x"), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, 5).count() == 5
    rows = toxicity.training_rows(docs, labels, 1000).collect()
    assert len(rows) == 101 and sum(r.toxic for r in rows) == 100


# odd columns and long rows


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cc", 1, 2), (2, "clean words", 3, 4)], "doc_id long, text string, `a.b` int, `c``d` int")
    bench = spark.createDataFrame([(1, "no such item in any of these texts")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for out in (pii.redact(docs), simhash.drop_near_duplicates(docs), decontam.drop_contaminated(docs, bench), toxicity.drop_toxic(docs, labels)):
        assert out.columns == docs.columns and sorted((r[0], r[2], r[3]) for r in out.collect()) == [(1, 1, 2), (2, 3, 4)]


def test_long_payloads(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 3_000_000), (2, "u", "y"), (3, "u", "x" * 3_000_000), (4, None, None)], "page_id long, url string, html string").coalesce(1)
    index = warc.write_bundles(pages, shared.scratch(spark, "w"), bundle_bytes=1 << 16, frame_bytes=1 << 12)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_bundles(index).collect()}
    assert got == {1: (3_000_000, "response", None), 2: (1, "response", None), 3: (3_000_000, "revisit", 1), 4: (0, "response", None)}


def test_long_and_repeated_texts_score(spark):
    docs = spark.createDataFrame([(1, "word " * 100_000), (1, "word " * 100_000), (2, "x" * 500_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).agg(F.count("*").alias("n"), F.min("score").alias("a"), F.max("score").alias("b")).first()
    assert rows.n == 3 and 0 <= rows.a <= rows.b <= 1


def test_pii_sql_on_odd_rows(spark):
    """The SQL of op8 on account numbers, edges and odd characters, which the driver's texts lack."""
    import duckdb
    import pandas as pd
    from oracle import rows_of

    from quillspark.llm.sql import OP8

    de, gb = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    texts = [None, "", f"pay {de} BIC COBADEFF now", f"{de} {gb}", f"REF AB12 3456 {de} OK", f"bank é {de} 12 34", f"iban {de.replace(' ', '')} EUR 500", de[:-1] + "1 BIC", f"x{de}", f"{de}"]
    texts += ["mail a.b@x.example.com_c@y.org, +49 (30) 123-45678. Card 4111 1111 1111 1111; 1.2.3.4.5.6.7.8 and 300.1.1.1", "\U0001f600 a@b.cc éé +123456789 000.0.0.0255 x", "@ @@ a@b a@b.c-d.e.", "4111111111111111 " * 400]
    rng = random.Random(12)
    parts = ["a", "b.c", "@", "@x.y", "_", "-", ".", " ", "1", "22", "255", "256", "+", "+4", "(3)", "4111111111111111", "é", "\U0001f600", de, "DE", gb, "79927398713", "10.0.0.1", "card ", "tel"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(600)]
    rows = list(enumerate(texts))
    got = pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string"))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    cur = con.execute(OP8)
    a, b = rows_of(got.columns, got.collect()), rows_of([d[0] for d in cur.description], cur.fetchall())
    assert a[0] == b[0] and [x for x in a[1] if x not in set(b[1])] == [] and len(a[1]) == len(b[1])


def test_licence_identifiers_and_names(spark):
    """Short identifiers and licences by name; words alone or out of order are none."""
    texts = {
        "SPDX-License-Identifier: MIT": "mit", "# SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3", "SPDX-License-Identifier: Apache-2.0": "apache-2", "// SPDX-License-Identifier: BSD-3-Clause": "bsd",
        "under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa", "the Eclipse Public License v. 2.0": "epl-2", "Boost Software License, Version 1.0. (See file)": "bsl-1",
        "In no event will the authors be held liable for any damages arising from the use of this software.": "zlib", "BSD 3-Clause License": "bsd", "Mozilla Public License, version 2.0": "mpl-2", "the SIL Open Font License, Version 1.1": "ofl",
        "license identifier spdx mit": "", "SPDX-License-Identifier: unknown": "", "eclipse of the public license": "", None: "", "boost your software": "",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licences.licence_scan(docs).collect()}
    assert [got[k] for k in range(len(texts))] == list(texts.values())
    assert len({label for label, _, _ in licences.TEMPLATES}) >= 30


# memory of executors between stages


def test_no_links_start_no_python_workers(spark, monkeypatch):
    """createDataFrame of an empty list is a Python RDD: its workers stay in each executor."""
    none = spark.sql("select 1L a, 1L b")  # a loop isn't a link

    def refuse(*_, **__):
        raise AssertionError("a Python RDD was made")

    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    for edges in (none, none.limit(0)):
        found = components.connected_components(edges)
        assert found.dtypes == [("node", "bigint"), ("root", "bigint")] and found.count() == 0


def test_idle_encoders_leave_the_worker(monkeypatch):
    """Tasks of other operators drop an encoder that is no longer used, memo included; one in use stays."""
    path = encoding.vocabulary("word_bpe_49k.json")
    enc = encoding.encoder(path)
    enc.ids("some words of a text")
    held = weakref.ref(enc)
    del enc
    list(shared.batches_of(iter([])))
    assert encoding._encoders[path] is held()
    monkeypatch.setattr(encoding, "IDLE_S", -1)
    list(shared.batches_of(iter([])))
    assert path not in encoding._encoders and held() is None
    assert encoding.encoder(path).ids("some words")


def test_scores_of_a_batch_are_read_text_by_text(spark):
    """The texts of an Arrow batch aren't all made Python strings at once."""
    weights = np.zeros(1 << toxicity.BITS)
    weights[toxicity.present("some words é 日本")] = 0.25
    model = toxicity.Model(weights, -1.0)
    texts = ["some words", "日本語 é", "", None, "x" * 50_000]
    scored = toxicity.score_table(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model)
    got = {r.doc_id: r.score for r in scored.collect()}
    assert got == pytest.approx({i: model.score(t or "") for i, t in enumerate(texts)})
