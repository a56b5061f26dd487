"""Every operator against a brute-force version on a small table, with odd rows added."""

import hashlib
import os
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import chat, components, decontam, embeddings, encoding, licences, packing, pii, repair, shared, simhash, toxicity, warc

SMALL = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, start int, spans string, label int, h string, words string"


def odd_docs():
    long_word = "x" * 30_000
    texts = [
        None, "", " \t\n ", "one", "one two", "one two three", "ONE two THREE", "a " * 5000, long_word, "1" * 20_000,
        "mail me: a.b@x.example.com_c@y.org, +49 (30) 123-45678. Card 4111 1111 1111 1111; 1.2.3.4.5.6.7.8 and 300.1.1.1",
        "DE89 3704 0044 0532 0130 00 is my IBAN; call +1 2; @ @@ a@b a@b.c-d.e.", "\U0001f600 a@b.cc éé +123456789 0.0.0.0 x",
        "Licensed under the MIT License. Under THE mit license! CC BY-NC 4.0; Apache License, Version 2.0.", "<|endoftext|> x　 y  z\r\n",
        "This work is licensed under the GNU General Public License, version 3.", "cc by cc by nc", "K apache license version 2",
    ]
    rows = [(1_000_000 + i, t, None, None, None, "c", 1, "s", 1, "h", "w") for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[11], (None, "one two three", "en", "s", 3, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame(odd_docs(), DOC_SCHEMA)
    return base.unionByName(extra, allowMissingColumns=True).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def pairs(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


# op1


def test_chat_round_trip(spark):
    odd = [(7, 0, None, None), (7, 1, "assistant", "<|im_end|>\\n\\|x\\"), (7, 1, "assistant", "<|im_end|>\\n\\|x\\"), (None, 1, "user", "<\\|"), (8, None, "assistant", ""), (9, 3, "a\nb\\n\r", "\\\\<|<|"), (9, 4, "\x00a\\e\\\\n\x00<|<\\|", "\x00\\")]
    base = spark.read.parquet(f"{SMALL}/conversations.parquet").withColumn("start", F.lit(1))
    conv = base.unionByName(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"), allowMissingColumns=True)
    got = {r.conv_id: r for r in chat.format_conversations(conv).collect()}
    want = defaultdict(list)
    for c, t, r, x in [*((r.conv_id, r.turn, r.role, r.text) for r in conv.collect()), *chat.PROBE]:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars >= sum(len(x) for *_, x in turns)


def test_chat_examples(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "<|a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "end")]
    folder = shared.scratch(spark, "t")
    chat.write_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), folder)
    parts = defaultdict(dict)
    for r in chat.materialise(spark, folder).collect():
        parts[r.target][r.part] = r
    text = {t: "".join(p[k].text for k in sorted(p)) for t, p in parts.items()}
    assert text[1] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<\\|a<|im_end|>\n"
    assert text[3] == text[1] + "<|im_start|>user\nr<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert [[r.text[r.loss_start : r.loss_end] for r in p.values() if r.loss_end is not None] for _, p in sorted(parts.items())] == [["<\\|a"], ["b"]] and sorted(parts) == [1, 3]


def test_chat_long_conversations(spark):
    """Conversations over many ranges and batches: every place and every example is right, nothing is left out."""
    rows = [(c, t, "assistant" if t % 2 else "user", "x" * ((t * 7 + (c or 0)) % 50)) for c in (None, 1, 2) for t in range(400 if c == 1 else 30)] + [(3, 0, "assistant", "y" * 2_000_000), (3, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        folder = shared.scratch(spark, "t")
        chat.write_examples(df, folder)
        got = defaultdict(list)
        for r in chat.turns(spark, folder).collect():
            got[r.conv_id].append(r)
        assert spark.read.parquet(f"{folder}/offsets").count() > 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c in (None, 1, 2, 3):
        at = 0
        for k, r in enumerate(sorted(got[c], key=lambda r: r.position)):
            assert (r.position, r.start) == (k, at)
            at += len(r.formatted)
        assert len(got[c]) == sum(x[0] == c for x in rows)
    full = chat.materialise(spark, folder).groupBy("conv_id", "target").agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("parts")).collect()
    assert len(full) == sum(r[2] == "assistant" for r in rows) and all(r.parts == r.target + 1 for r in full)
    assert {r.n for r in full if r.conv_id == 3 and r.target == 1} == {sum(len(r.formatted) for r in got[3])}


def test_chat_examples_hold_their_contexts(spark, monkeypatch):
    """Every example is its whole context and reply, in parts of blocks; the query reads them."""
    rows = [(c, t, "assistant" if t % 3 else "user", "é<|" * (t * 5 % 17)) for c in (None, 1, 2) for t in range(40)]
    folder = shared.scratch(spark, "t")
    chat.write_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), folder)
    lines = {c: [r.formatted for r in sorted(chat.turns(spark, folder).where(F.col("conv_id").eqNullSafe(F.lit(c))).collect(), key=lambda r: r.position)] for c in (None, 1, 2)}
    parts = defaultdict(list)
    for r in chat.examples(spark, folder, 200).collect():
        parts[r.conv_id, r.target].append(r)
    assert len(parts) == sum(r[2] == "assistant" for r in rows)
    for (c, target), got in parts.items():
        got.sort(key=lambda r: r.part)
        assert "".join(r.text for r in got) == "".join(lines[c][: target + 1])
        assert [r.loss_end is None for r in got] == [True] * (len(got) - 1) + [False] and (target < 20 or len(got) > 3)
        assert got[-1].text[got[-1].loss_start : got[-1].loss_end] == "é<\\|" * (target * 5 % 17)
    assert chat.read_back(spark, folder).where("loss is not null").count() == len(parts)
    full = chat.examples
    monkeypatch.setattr(chat, "examples", lambda *a: full(*a).withColumn("text", F.expr("if(target = 38, substr(text, 2), text)")))
    with pytest.raises(Exception, match="lacks a part of its context"):
        chat.read_back(spark, folder).collect()


def test_chat_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.format_conversations(none).collect()] == [-1]


# op2 and op3


def encoded(docs, name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoding.vocabulary(name))
    return [(d, t.encode(x, add_special_tokens=False).ids + [end]) for d, x in texts_of(docs)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(name):
    from tokenizers import Tokenizer

    rng, enc, ref = random.Random(5), encoding.encoder(encoding.vocabulary(name)), Tokenizer.from_file(encoding.vocabulary(name))
    parts = [" ", " ", "  ", "\n", "\t", "\x1c", "　", "\xa0", "a", "B", "é", "e", "́", "1", "'s", ".", "<|endoftext|>", "Σ", "日", "The", "Été", "ß", "***", "_", "İ", "\x00"]
    for _ in range(3000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        assert np.frombuffer(enc.ids(x), "<u4").tolist() == ref.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_plain_words_are_merged_alone(name, monkeypatch):
    """Latin words go straight to the merge model, also at the start of a line or text; with a stop they aren't kept beside the word."""
    enc = encoding.Encoder(encoding.vocabulary(name))
    enc.ids("\n . , \n.")
    whole, encode = [], enc._encode
    monkeypatch.setattr(enc, "_encode", lambda x: whole.append(x) or encode(x))
    text = "Étonnant commencement\nligne été.\nautre déjàvuencore, élémentaire. Fin"
    assert enc.ids(text) == encode(text)
    assert not any(c.isalpha() for x in whole for c in x)
    assert "déjàvuencore," not in enc.rest and "déjàvuencore" in enc.rest


def test_token_files(docs, empty, spark):
    got = pairs(repair.token_digest(repair.token_files(docs, encoding.vocabulary("byte_bpe_50k.json"), 0, shard_ids=20_000)), "start", "doc_id", "n_tokens", "ids_crc32")
    rows = encoded(docs, "byte_bpe_50k.json", 0)
    assert sorted((d, n, c) if d is not None else (-1, n, c) for _, d, n, c in got) == sorted((d if d is not None else -1, len(i), crc(i)) for d, i in rows)
    got.sort(key=lambda r: r[0])
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    ids = [d if d is not None else -1 for _, d, *_ in got]
    assert ids == sorted(ids)
    assert repair.token_files(empty, encoding.vocabulary("byte_bpe_50k.json")).count() == 0


def test_repair_grammar():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 0, 700, 3000, 1, 2, 9000])
    ids = rng.choice([3, 4, 5, 5, 5, 6], sizes.sum()).astype("<u4")
    g = repair.compress(ids, sizes, 50257)
    assert len(g.left) and len(g.symbols) < len(ids) / 2
    f = repair.RepairFile(repair.pack_file(g, [1, None, 3, 4, 5, 6, 7], sizes))
    at = np.concatenate([[0], np.cumsum(sizes)])
    for k in range(len(sizes)):
        want = ids[at[k] : at[k + 1]]
        assert (f.document(k) == want).all() and len(f.document(k)) == sizes[k]
        for a, b in [(0, 1), (5, 9), (100, 101), (650, 2000), (0, 10**6)]:
            assert f.document(k, a, b).tolist() == want[a:b].tolist()
    assert f.doc_ids == [1, None, 3, 4, 5, 6, 7]
    wide = repair.compress(ids + 100_000, sizes, 200_000)
    assert (repair.RepairFile(repair.pack_file(wide, [None] * 7, sizes)).document(6) == ids[at[6] :] + 100_000).all()


@pytest.mark.parametrize("length,windows", [(4096, 64), (256, 4), (64, 2)])
def test_packing(docs, empty, length, windows):
    rows = packing.pack_documents(docs, encoding.vocabulary("word_bpe_49k.json"), 2, length, windows).collect()
    seqs = defaultdict(list)
    for r in rows:
        assert r.length > 0 and len(r.ids) == 4 * r.length
        seqs[r.sequence_id].append(r)
    used = 0
    padded = 0
    for seq in seqs.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        used += at
        padded += at if at & (at - 1) == 0 else length
    assert padded <= 1.02 * used or length < 4096
    want = encoded(docs, "word_bpe_49k.json", 2)
    assert used == sum(len(i) for _, i in want)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for d, ids in want:
        if sum(x == d for x, _ in want) == 1:
            got = sorted(by_doc[d], key=lambda r: r.start)
            assert b"".join(r.ids for r in got) == np.array(ids, "<u4").tobytes() and {r.doc_tokens for r in got} == {len(ids)}
            assert [r.start for r in got] == [sum(x.length for x in got[:k]) for k in range(len(got))]
    assert packing.pack_documents(empty, encoding.vocabulary("word_bpe_49k.json"), 2).count() == 0


# op4


def naive_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def naive_shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} or {" ".join(words)} - {""}


def naive_components(n, linked):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_simhash(docs, empty):
    got = simhash.simhash_groups(docs).select("doc_id", simhash.fingerprint_hex().alias("f"), "component_id").collect()
    rows = sorted(texts_of(docs), key=lambda r: (r[0] is None, r[0] or 0))
    fps = [naive_fingerprint(x) for _, x in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    roots = naive_components(len(rows), links)
    want = sorted((repr(d), f"{f:016x}", rows[r][0]) for (d, _), f, r in zip(rows, fps, roots))
    assert sorted((repr(r.doc_id), r.f, r.component_id) for r in got) == want
    assert simhash.simhash_groups(empty).count() == 0


def test_bk_trees_small_and_large(monkeypatch):
    rng = random.Random(3)
    for radius in (0, 1, 3, 5):
        fps = {rng.getrandbits(64) for _ in range(40)}
        for f in list(fps):
            for _ in range(rng.randint(0, 12)):
                for _ in range(rng.randint(1, 6)):
                    f ^= 1 << rng.randrange(64)
                fps.add(f)
        fps = [f - (1 << 64 if f >> 63 else 0) for f in fps]
        want = naive_components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= radius])
        for leaf in (1, 16, 10_000):
            monkeypatch.setattr(simhash, "LEAF", leaf)
            edges = simhash.tree_links(np.array(fps, np.int64), radius)
            assert naive_components(len(fps), edges) == want and len(edges) == len(fps) - len(set(want))
        groups = np.arange(len(fps)) // 2
        linked = [(i, i + 1) for i in range(0, len(fps) - 1, 2)]
        assert naive_components(len(fps), linked + simhash.tree_links(np.array(fps, np.int64), radius, groups)) == naive_components(len(fps), linked + [(want[i], i) for i in range(len(fps))])


def test_simhash_shards(spark):
    """Every link lies in some shard, also where all shards are dealt anew."""
    rng = random.Random(1)
    fps = [rng.getrandbits(63) for _ in range(300)]
    flips = [(0, 40, 62), (1, 2, 3), (15, 16, 17), (63, 0, 31), (20, 33, 47)]
    fps += [f ^ sum(1 << b for b in flips[i % 5]) for i, f in enumerate(fps[:100])]
    fps = [f - (1 << 64 if f >> 63 else 0) for f in fps]
    df = spark.createDataFrame(list(zip(fps, range(len(fps)))), "fp long, rep long")
    for shard, hot in ((simhash.SHARD, simhash.HOT_SHARD), (4, 10_000), (4, 2)):
        edges = {tuple(sorted((r.a, r.b))) for r in simhash.fingerprint_links(df, 3, shard, hot).collect()}
        assert edges == {(i, 300 + i) for i in range(100)}


@pytest.mark.parametrize("hot", [simhash.HOT_SHARD, 40])
def test_near_duplicates_by_similarity(spark, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_SHARD", hot)
    base = "the quick brown fox jumps over the lazy dog while seven wise men sail a small boat".split()
    long = [f"{w}{k}" for k in range(12) for w in base]
    edit = lambda at: " ".join("changed" if k in at else w for k, w in enumerate(long))
    extra = [(4_000_000, " ".join(long)), (4_000_001, edit({50})), (4_000_002, edit({20, 90, 150})), (4_000_003, edit(set(range(0, 192, 9)))), (4_000_004, " ".join(long).upper()), (4_000_005, " ".join(base)), (None, " ".join(long))]
    both = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicate_groups(both).collect()), key=repr)
    rows = sorted(texts_of(both), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [naive_shingles(x) for _, x in rows]
    like = lambda x, y: x == y or (x and y and len(x & y) >= 0.8 * len(x | y))
    roots = naive_components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if like(sets[i], sets[j])])
    want = sorted(((d is None, d or 0, rows[r][0]) for (d, _), r in zip(rows, roots)), key=repr)
    assert got == want
    by_id = {r[1]: r[2] for r in got if not r[0]}
    assert by_id[4_000_001] == by_id[4_000_002] == by_id[4_000_004] == 4_000_000 and by_id[4_000_003] == 4_000_003
    assert simhash.near_duplicate_groups(empty).count() == 0
    dotted = spark.createDataFrame([(1, "a b", 1), (2, "a b", 2)], "doc_id long, text string, `a.b` int")
    kept = simhash.drop_near_duplicates(dotted)
    assert kept.columns == dotted.columns and [r.doc_id for r in kept.collect()] == [1]


def test_sifted_rows(spark):
    """All rows whose key is wanted pass, and few others; other columns stay."""
    rows = spark.range(20_000).select((F.col("id") * 7919 - 5000).alias("key"), F.col("id").alias("a.b"))
    for n in (0, 1, 500):
        keys = shared.staged(rows.where("key % 40 = 3").limit(n).select("key"), "keys")
        got = shared.sifted(rows, keys, "key")
        assert got.columns == rows.columns
        assert got.join(keys, "key", "left_semi").count() == keys.count() and got.count() <= 2 * n + 20_000 // 8


def test_staged_batches_are_small(spark):
    """While a table is staged, a worker gets at most BATCH_ROWS rows at once; the session's setting stays."""
    key, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "n int"
    before = spark.conf.get(key)

    def sizes(it):
        for batch in it:
            yield batch.from_pydict({"n": [batch.num_rows]}).cast(pa.schema([("n", pa.int32())]))

    assert shared.staged(spark.range(0, 5000, 1, 1).mapInArrow(sizes, size), "t").agg(F.max("n")).first()[0] <= shared.BATCH_ROWS
    assert spark.conf.get(key) == before


def test_near_duplicates_join_groups_once(spark, docs, monkeypatch):
    """After the good links only groups are joined: no second graph of all links, which cost the driver its memory in rounds."""
    graphs, find = [], simhash.connected_components

    def seen(edges):
        graphs.append({(r.a, r.b) for r in edges.collect()})
        return find(edges)

    monkeypatch.setattr(simhash, "connected_components", seen)
    words = [f"w{k}" for k in range(120)]
    edit = lambda at: " ".join("changed" if k in at else w for k, w in enumerate(words))
    # a chain, whose ends aren't like each other, and texts that are not quite like its first
    cuts = [set(range(0, 4 * i, 4)) for i in range(20)] + [{i, i + 30, i + 60, i + 90} for i in range(5, 25)]
    extra = spark.createDataFrame([(5_000_000 + i, edit(c)) for i, c in enumerate(cuts)], "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(docs.unionByName(extra, allowMissingColumns=True)).collect()}
    assert len(graphs) == 2
    ids = sorted({x for e in graphs[0] for x in e})
    joined = naive_components(len(ids), [(ids.index(a), ids.index(b)) for a, b in graphs[0]])
    assert all(joined[ids.index(x)] == ids.index(x) for e in graphs[1] for x in e if x in ids)  # groups, by their least
    assert all(groups[a] == groups[b] for g in graphs for a, b in g)


def test_near_duplicates_leave_no_tables(spark, docs):
    """What the stage stages is deleted when it is done, but for the list of those that go."""
    root = shared.shared_root(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    out = simhash.drop_near_duplicates(docs)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
    assert left <= {"gone", "edges"} and out.count() > 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (9, 3), (5, 5), (None, 4), (200, 100)] + [(1000, 1000 + i) for i in range(300)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in [*range(101, 161), 200]}, 7: 3, 9: 3, **{1000 + i: 1000 for i in range(1, 300)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# op5


def test_warc(spark):
    body = "p" * 100
    odd = [(5001, "http://a b\r\nX: y", body), (5000, None, body), (5002, "u", "short"), (5003, "u", "short"), (5004, "", None), (None, "u", body), (5000, None, body), (5005, "u", body + "é"), (5006, "u", body + "é")]
    base = spark.read.parquet(f"{SMALL}/pages.parquet").withColumn("path", F.lit(1))
    pages = base.unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"), allowMissingColumns=True).repartition(3)
    index = warc.write_bundles(pages, shared.scratch(spark, "w"), bundle_bytes=50_000, frame_bytes=20_000)
    got = sorted((repr(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_bundles(index).collect())
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for p, x in rows:
        if p is not None and len(x) >= 100:
            first[x] = min(p, first.get(x, p))
    want = []
    for p, x in rows:
        again = p is not None and len(x) >= 100 and first[x] != p
        want.append((repr(p), len(x), hashlib.sha256(x).hexdigest(), "revisit" if again else "response", first[x] if again else None))
    assert got == sorted(want)
    one = index.where("page_id = 5005").first()
    reader = warc.BundleReader(one.path)
    head, block = reader.record(one.frame, one.offset)
    assert head["x-page-id"] == "5005" and block.endswith(("p" * 100 + "é").encode())
    whole = b"".join(reader.frame(k) for k in range(len(reader.sizes)))
    at = 0
    while at < len(whole):
        at = warc.parse(whole, at)[2]
    assert at == len(whole)
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# op6


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 8))
    rows = []
    for k, v in enumerate(base):
        for _ in range(6):
            rows.append((len(rows), (v + rng.standard_normal(8) * 0.09 * rng.random()).astype(np.float32).tolist(), k % 3, "x"))
    hot = base[0].astype(np.float32).tolist()
    rows += [(1000 + i, hot, 0, "x") for i in range(40)] + [(1100, [2 * x for x in hot], 0, "x"), (1101, hot, None, "x"), (1102, None, 0, "x"), (1103, [0.0] * 8, 0, "x"), (1104, [float("nan")] + hot[1:], 0, "x"), (1105, [None, *hot[1:]], 0, "x"), (1106, [float("inf")] * 8, 0, "x"), (1107, [], 0, "x"), (1108, hot[:4], 0, "x"), (1000, hot, 0, "x"), (1109, [0.0, -0.0, 1.0], 1, "x"), (1110, [0.0, 0.0, 1.0], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string").repartition(5)
    got = sorted(map(tuple, embeddings.embedding_groups(df, block=64).select("vec_id", "n_links", "component_id", "kept").collect()))
    rows.sort(key=lambda r: r[0])

    def vec(r):
        v = r[1]
        ok = r[2] is not None and v and None not in v and np.isfinite(v).all() and any(v)
        return np.array(v, np.float64) if ok else None

    vs = [vec(r) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if vs[i] is not None and vs[j] is not None and rows[i][2] == rows[j][2] and len(vs[i]) == len(vs[j]) and vs[i] @ vs[j] / np.linalg.norm(vs[i]) / np.linalg.norm(vs[j]) >= 0.98]
    roots, n = naive_components(len(rows), links), defaultdict(int)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    assert len(links) > 300
    assert got == sorted((r[0], n[i], rows[roots[i]][0], r[0] == rows[roots[i]][0]) for i, r in enumerate(rows))
    assert embeddings.embedding_groups(df.limit(0)).count() == 0


def test_collision_candidates():
    """Far fewer pairs than all reach the count, every link among them."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((1500, 64))
    v = np.concatenate([v, v[:300] + 0.1 * rng.standard_normal((300, 64)), v[:300] + 0.17 * rng.standard_normal((300, 64))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    p = v @ embeddings.directions(64)
    order = np.argsort(p[:, 0])
    v, p = v[order], p[order]
    width, need = embeddings.calibrate()
    got = [np.stack(c) for c in embeddings.candidates(p, p, width, need, embeddings.wide_window())]
    got = {(a, b) for a, b in np.concatenate(got, axis=1).T.tolist() if a < b}
    a, b = np.nonzero(np.triu(v @ v.T >= embeddings.THRESHOLD, 1))
    assert 300 < len(a) and set(zip(a.tolist(), b.tolist())) <= got
    assert len(got) < len(v) ** 2 / 500


# op7


def test_regression_memory(monkeypatch):
    """The driver holds the bins of the training rows once, not arrays of 8 bytes for each step; blocks don't change the fit."""
    rng = np.random.default_rng(1)
    ratios, size = rng.normal(size=1 << toxicity.BITS), 1500
    bins = [np.sort(rng.choice(30_000, size, False).astype("<u4")) for _ in range(4000)] + [np.empty(0, "<u4")]
    data = pa.table({"bins": pa.array([x.tobytes() for x in bins], pa.binary()), "toxic": np.arange(len(bins), dtype=np.int32) % 2})
    tracemalloc.start()
    toxicity._logistic(data, ratios, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 14 * size * len(bins)
    coef, bias = toxicity._logistic(data.slice(3950), ratios, 50)
    monkeypatch.setattr(toxicity, "BLOCK", 1)
    alone = toxicity._logistic(data.slice(3950), ratios, 50)
    assert np.abs(coef).max() > 0.1 and np.allclose(coef, alone[0], atol=1e-6) and abs(bias - alone[1]) < 1e-6


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(90001, None), (90002, ""), (90003, "stupid idiot moron, you worthless scum and pathetic loser " * 3), (None, "x")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True).withColumn("score", F.lit("clash"))
    scored = toxicity.toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted").toPandas()
    assert scored["score"].between(0, 1).all() and len(scored) == docs.count()
    for r in scored.dropna(subset=["doc_id"]).itertuples():
        assert r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5)
    assert scored.set_index("doc_id")["predicted"][90003] == 1 and scored.set_index("doc_id")["predicted"][90002] == 0
    both = scored.merge(labels.toPandas(), on="doc_id")
    test = both[both["held_out"]]
    assert (test["predicted"] == test["toxic"]).mean() > 0.9
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).agg(F.max("score")).first()[0] < 0.5


def test_toxicity_learns_only_from_training_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, x) for x in (labels, flipped))
    assert (a.weights == b.weights).all() and a.bias == b.bias


# op8

PII_KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def naive_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(PII_KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), no, kind, m.end()))
    return sorted(out)


def test_pii(docs, empty, spark):
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "@x.y", "_", "-", ".", " ", "1", "22", "255", "256", "+", "+4", "(3)", "4111111111111111", "é", "\U0001f600", "4111 1111 1111 1111", "79927398713", "10.0.0.1"]
    fuzz = spark.createDataFrame([(2_000_000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))) for i in range(1500)], "doc_id long, text string")
    both = docs.unionByName(fuzz, allowMissingColumns=True)
    got = sorted(((repr(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.pii_digest(both).collect()))
    want = []
    for d, x in texts_of(both):
        spans = naive_spans(x)
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
        want.append((repr(d), *(sum(k == q for *_, k, _ in spans) for q in PII_KINDS), hashlib.sha256(joined.encode()).hexdigest()))
    assert got == sorted(want)
    all_spans = {r.doc_id: r.spans for r in pii.pii_digest(docs).collect()}
    assert "iban:0:27" in all_spans[1_000_011]
    assert pii.pii_digest(empty).count() == 0


def test_pii_redaction(docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[1_000_010].startswith("mail me: [EMAIL][EMAIL], [PHONE]. Card [CARD]; [IP]")
    assert texts[1_000_000] is None and texts[1_000_011].startswith("[IBAN] is my IBAN")
    before = {r.doc_id: r.text for r in docs.collect()}
    for d, x in before.items():
        if x is not None and not naive_spans(x) and d != 1_000_011:
            assert texts[d] == x


def test_iban_among_capitals(spark):
    de, gb = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    texts = [f"pay {de} BIC COBADEFF now", f"{de} {gb}", f"REF AB12 3456 {de} OK", f"é {de} 12 34", f"{de.replace(' ', '')} EUR 500", de[:-1] + "1 BIC COBADEFF", f"x{de}", f"{de} Bank"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("iban")] for r in pii.pii_digest(df).collect()}
    assert spans == {0: ["iban:4:31"], 1: ["iban:0:27", "iban:28:55"], 2: ["iban:14:41"], 3: ["iban:2:29"], 4: ["iban:0:22"], 5: [], 6: [], 7: ["iban:0:27"]}
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[0] == "pay [IBAN] BIC COBADEFF now"


def test_mod97_and_luhn(spark):
    df = spark.createDataFrame([("GB82WEST12345698765432", True), ("GB82WEST12345698765431", False), ("DE89370400440532013000", True)], "x string, ok boolean")
    assert all(r.ok == r.got for r in df.select("ok", pii.mod97(F.col("x")).alias("got")).collect())


# op9


def test_decontamination(spark, docs, empty):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    q = "Alice Brown bought 12 apples and walked 5 miles before lunch so how many apples does Alice Brown have left"
    who = "{} bought red apples then {} sold green pears before {} ate ripe plums while {} drank cold water"
    items = spark.createDataFrame([(904, who.format(*["Alice"] * 4)), (900, q), (901, None), (902, "short item here"), (None, "a b c d e f g h i j"), (903, "")], "item_id long, text string")
    bench = bench.unionByName(items)
    changed = q.replace("Alice Brown", "Carol Green").replace("12", "34").replace("5", "7")
    mixed = "Dora Grey bought 12 apples and walked 5 miles before lunch so how many apples does Erik Black have left"
    planted = spark.createDataFrame([(3_000_000, f"junk words first {changed} and more"), (3_000_001, f"x {mixed} y"), (3_000_002, "a short item here b"), (3_000_003, "apples and miles before lunch"), (3_000_004, q.lower()[:40]), (3_000_005, "and " + q.upper().replace("12", "13") + " end"), (3_000_006, "so " + who.format(*["Carol"] * 4)), (3_000_007, who.format("Carol", "Dora", "Erik", "Fred") + " too")], "doc_id long, text string")
    both = docs.unionByName(planted, allowMissingColumns=True)
    got = {(r.doc_id, r.item_id): r for r in decontam.contamination(both, bench).collect()}
    texts = {r.item_id: r.text for r in bench.where("item_id is not null and item_id < 900").collect()}
    for d, x in texts_of(both):
        for i, t in texts.items():
            if t in x:
                assert (d, i) in got and got[d, i].n_changed == 0
    # names exchanged one for one are a leak; exchanged at random they are not
    assert {d for d, i in got if i == 904} == {3_000_006}
    # 3_000_001 shares 15 words of 20 as they are
    assert {d for d, i in got if i == 900} == {3_000_000, 3_000_001, 3_000_005} and got[3_000_000, 900].n_changed > 3 and got[3_000_005, 900].n_changed == 2  # the number, and the unit in capitals
    assert (3_000_002, 902) in got
    assert all(d is not None for d, _ in got)
    clean = {d for d, x in texts_of(both)} - {d for d, _ in got}
    assert {r.doc_id for r in decontam.drop_contaminated(both, bench).collect()} == clean
    assert decontam.contamination(empty, bench).count() == 0 and decontam.contamination(docs, bench.limit(0)).count() == 0


def test_decontamination_of_edited_copies(spark):
    plain = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(38)]
    edited = ["other" if k in (8, 18, 28) else w for k, w in enumerate(plain)]
    wide = "a farmer from {a} bought {n} old sheep and then sold them again near the river before winter came so that {b} people who lived in {a} had wool and meat for many cold nights of snow and the rest was kept"
    item, copy = wide.format(a="Paris", n="12", b="7"), wide.format(a="New York", n="1,200", b="3.5")
    mixed = copy.replace("New York", "Oslo", 1)
    unrelated = " ".join(plain[:9] + [f"z{w}" for w in plain[9:]])
    bench = spark.createDataFrame([(1, " ".join(plain)), (2, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some text " + " ".join(edited) + " more"), (2, "it says that " + copy + " too"), (3, unrelated), (4, mixed), (5, "x " + item.upper())], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contamination(docs, bench).collect()}
    # (4, 2) is no one-to-one exchange, but nearly all words stand there as they are
    assert got.keys() == {(1, 1), (2, 2), (4, 2), (5, 2)}
    assert got[1, 1].matched_words == 35 and got[2, 2].n_changed == 4 and got[2, 2].consistent
    assert [r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()] == [3]


def test_decontamination_of_numeric_items(spark):
    numbers, table = "1 2 3 5 8 13 21 34 what is next", "12 km 5 km 40 km 7 km 19 km 23 km 31 km 3 km which is best"
    bench = spark.createDataFrame([(1, numbers), (2, table)], "item_id long, text string")
    rows = [(1, f"so {numbers} he said"), (2, f"see {table} here"), (3, "2 4 6 8 10 12 14 16 what is next"), (4, table.replace("1", "6").replace("3", "8")), (5, "1 2 3 5 8 13 21 34 and so on")]
    got = {(r.doc_id, r.item_id): r for r in decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got.keys() == {(1, 1), (2, 2)} and all(r.n_changed == 0 for r in got.values())


def test_decontamination_of_odd_rows(spark):
    long = " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(30))
    other = " ".join(f"z{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(30))
    bench = spark.createDataFrame([(1, long), (1, other), (1, long), (2, None), (3, " .,"), (4, "word"), (5, "7 8 9")], "item_id long, text string")
    rows = [(1, "a " + long, 0), (1, "nothing", 0), (2, "b " + other, 0), (3, "x " * 30_000 + long, 0), (3, "x " * 30_000 + long, 0), (4, "one word", 0), (5, "6 7 8 9", 0), (6, "5 6 7 8", 0), (7, None, 0), (None, long, 0), (8, long.upper().replace("W", "\u0130"), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int")
    want = {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
    for limit in (decontam.BROADCAST_WINDOWS, 0):  # both ways to join
        got = decontam.contamination(docs, bench, broadcast_windows=limit).collect()
        assert len(got) == len(want) and {(r.doc_id, r.item_id) for r in got} == want
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 6, 7, 8]


def test_templates_agree(spark, docs):
    """The pattern form and the word-by-word form of a template are the same."""
    odd = spark.createDataFrame([(1, "12 13 km km Km 5 Km Paris New York 7km \u01c5x \u0130x \x01\x02 A\x03b 4,000.5 MILES 3 Miles"), (2, "\u0663 km 1e5 Éa ßb 'S 5 km 6")], "doc_id long, text string")
    both = docs.select("text").unionByName(odd.select("text")).select(decontam.words(F.col("text")).alias("raw"), *(decontam.template(F.col("text"), k).alias(f"t{k}") for k in decontam.KINDS))
    for k in decontam.KINDS:
        rows = both.select(f"t{k}", decontam._full("raw", k)["w"].alias("w")).collect()
        assert all(r[0] == r[1] for r in rows)


# op10


def test_licences(docs, empty):
    got = {}
    for r in licences.licence_scan(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, x in texts_of(docs):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))
        starts, labels = [], set()
        for phrase, label in licences.BASE.items():
            p = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            starts += found
            labels |= {label} if found else set()
        r = got[d][0]
        want = (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[1_000_015][0].labels == "gpl-3" and got[1_000_015][0].n_base == 0
    assert got[1_000_016][0].base_labels == "cc-by-nc" and len(got[1_000_005]) == 2
    assert licences.licence_scan(empty).count() == 0


def test_licence_notices_of_every_kind(spark):
    """One text with all notices has every label; every word of a key phrase must stand there."""
    every = ". Filler words here. ".join(n for _, n, _ in licences.TEMPLATES)
    rows = [(1, every.upper()), (2, "permission was hereby granted free in charge, to any person obtaining a copy"), (3, "permission is hereby granted, free of charge"), (4, "as published " * 2000 + licences.TEMPLATES[16][1]), *[(10 + k, n) for k, (_, n, _) in enumerate(licences.TEMPLATES)]]
    rows += [(100 + i, licences.TEMPLATES[16][1]) for i in range(40)]  # a hot notice
    got = {r.doc_id: r for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == ",".join(sorted({label for label, _, _ in licences.TEMPLATES}))
    assert got[2].labels == "" and got[2].score == 0 and got[3].labels == "mit" and 0 < got[3].score < 1 and got[4].labels == "cc0"
    for k, (label, notice, key) in enumerate(licences.TEMPLATES):
        assert label in got[10 + k].labels.split(",") and got[10 + k].score == 1 and f" {key} " in f" {notice} "
        assert key.split()[0] not in licences.STOP and key.split()[-1] not in licences.STOP
