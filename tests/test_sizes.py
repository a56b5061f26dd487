"""What only large tables hold: large ids, words that cancel out, more files than one listing takes."""

import zlib

import pytest
from pyspark.sql import functions as F


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


DOCUMENTS = "doc_id long, text string, source string"


def test_long_document_of_large_ids(spark, tmp_path):
    """doc_id times 10,000 is above 2^31."""
    from quillspark.plans.statutes import long_document

    text = "\n".join(f"word{i} of a line" for i in range(12))
    folder = written(spark, tmp_path, "documents", [(3 * 10**5, text, "a"), (9 * 10**5, text, "a"), (9 * 10**5 + 1, text, "a")], DOCUMENTS)
    rows = long_document(spark, folder).orderBy("document", "pos").collect()
    assert {p for r in rows for p in r.pages.split(",")} == {"1", "2"} | {str(n * 10**4 + p) for n in (3 * 10**5, 9 * 10**5) for p in (1, 2)}
    assert {r.document.split("_")[0] for r in rows} == {"법0", "법900001"}


def test_embedding_of_words_that_cancel_out(spark, tmp_path):
    from quillspark.plans.retrieval import embed

    hashes = {f"w{i}": zlib.crc32(f"w{i}".encode()) for i in range(2000)}
    plus = next(w for w, h in hashes.items() if h >> 16 & 1)
    minus = next(w for w, h in hashes.items() if not h >> 16 & 1 and h % 64 == hashes[plus] % 64)
    texts = [f"{plus} {minus}", " ", "\x0b　", " \t\r\n\f", "", None, plus]
    folder = written(spark, tmp_path, "documents", [(k, x, "a") for k, x in enumerate(texts)], DOCUMENTS)
    got = {r.chunk_id: (r.dim, r.norm) for r in embed(spark, folder).collect()}
    assert got == {0: (64, 1.0), 1: (64, 1.0), 2: (64, 1.0), 3: (64, 0.0), 4: (64, 0.0), 5: (64, 0.0), 6: (64, 1.0)}


def test_files_are_listed_in_groups(spark, tmp_path, monkeypatch):
    """Subfolders, files beside them, odd names and hidden ones: the rows of one listing."""
    from quillspark.operators import ingest as I
    from quillspark.sources import decode as D
    from quillspark.sources import files as S

    folder = tmp_path / "files"
    rows = [(f"법{k}_법률.txt", b"\xff" if k % 7 == 3 else b"x" * (k + 1)) for k in range(60)]
    D.write_files(spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "name string, content binary"), str(folder), 12)
    assert len(list(folder.glob("files-*/*.txt"))) == 60 and len(list(folder.iterdir())) == 12
    for name in ("b[1]*{a}.txt", "_hidden.txt", ".hidden.txt", "other.pdf", "deep/er/c d?.txt", "_no/x.txt"):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"text")
    whole = D.decoded_files(spark, str(folder), D.text_pages, "*.txt", 50)
    assert len(S.listed_groups(spark, str(folder))) == 1 and len(want := sorted(map(tuple, whole.collect()), key=str)) == 62
    monkeypatch.setattr(S, "LISTED", 10)
    groups = S.listed_groups(spark, str(folder))
    assert len(groups) >= 6
    assert sorted(map(tuple, D.decoded_files(spark, str(folder), D.text_pages, "*.txt", 50).collect()), key=str) == want
    good, failed = I.decode_folder(spark, str(folder), str(tmp_path / "out"), D.text_pages, "*.txt", 50)
    assert (good.count(), failed.count()) == (sum(r[4] is None for r in want), sum(r[4] is not None for r in want))
    assert sum(g.bytes for g in groups) == sum(f.stat().st_size for f in folder.rglob("*") if f.is_file() and not f.name.startswith((".", "_")) and "_no" not in f.parts)
    assert S.listed_groups(spark, f"{folder}/files-*") == [S.Group([f"{folder}/files-*"], None)]


@pytest.mark.parametrize("by_law", [False, True, None])
def test_blocks_of_scores_are_all_pairs(spark, by_law):
    """Copies, scaled copies, repeated ids, null laws and vectors without a direction: the rows of scoring pair by pair."""
    import numpy as np
    from pyspark.sql import Window

    from quillspark.operators import dense as D

    rng = np.random.default_rng(7)
    v = rng.standard_normal((40, 6)).astype(np.float32)
    rows = [(i, None if i % 11 == 0 else f"l{i % 3}", (v[i % 40] * (1 + i // 200)).tolist()) for i in range(400)]
    rows += [(7, "l1", v[7].tolist()), (1000, "l0", None), (1001, "l0", [None] * 6), (1002, "l0", [1.0, 2.0])]
    points = spark.createDataFrame(rows, "chunk_id long, law string, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows if r[0] % 9 == 7 or r[0] % 11 == 0] + [(5000, "none", v[3].tolist()), (5001, None, None)], "qid long, law string, embedding array<float>")
    pairs = D._all_pairs(queries, points, by_law, True).withColumn("score", F.round("score", 12))
    want = pairs.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id"))).where("r <= 8")
    got = D.dense_top_k(queries, points, 8, by_law, exclude_self=True)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    rows_of = lambda df, r: sorted(((x.qid, x[r], x.chunk_id, None if x.score is None else round(x.score, 9)) for x in df.collect()), key=str)
    assert rows_of(got, "dense_rank") == rows_of(want, "r")


@pytest.mark.parametrize("ids", ["long", "string", "double"])
def test_cells_in_blocks(spark, tmp_path, monkeypatch, ids):
    """Probed cells are scored in blocks, in several groups; odd vectors and ids pair by pair: the rows of the exact search."""
    import numpy as np

    from quillspark.operators import cells as C
    from quillspark.operators import dense as D

    monkeypatch.setattr(C, "PROBED_PAIRS", 40)
    v = np.random.default_rng(7).standard_normal((50, 6))
    rows = [(float(i), f"l{i % 3}" if i % 11 else None, (v[i % 50] * (1 + i // 100)).tolist()) for i in range(300)] + [(1000.0, "l0", [1e90, 1.0, 0.0, 0.0, 0.0, 1e90])]
    points = spark.createDataFrame(rows, "chunk_id double, law string, embedding array<double>").withColumn("chunk_id", F.col("chunk_id").cast("long").cast(ids))
    queries = points.where(F.col("chunk_id").cast("long") % 9 == 7).withColumnRenamed("chunk_id", "qid")
    found = C.search(spark, C.build(spark, str(tmp_path / "i"), points, 8), queries, 5, False, probes=3, certified=True, exclude_self=True)
    assert ("MapInArrow" in found.hits._jdf.queryExecution().toString()) == (ids != "double")
    rows_of = lambda df: sorted((x.qid, x.dense_rank, x.chunk_id, x.law, round(x.score, 9)) for x in df.collect())
    assert rows_of(found.hits) == rows_of(D.dense_top_k(queries, points, 5, False, exclude_self=True))


def test_blocks_are_cut_where_they_are_sorted(spark, monkeypatch):
    """Blocks of 3 over small batches and several parts: every posting once, by falling impact, tiers as by each term's first part; postings are shuffled once."""
    from quillspark.operators import segments as G

    monkeypatch.setattr(G, "BLOCK", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = [(c, None if c % 5 == 0 else f"l{c % 3}", t, 1 + c % 4, 2 + c % 7) for c in range(40) for t in ["all", f"t{c % 6}", f"only{c}"] + ["half"] * (c % 2)]
        posts = spark.createDataFrame(rows, "chunk_id long, law string, term string, tf long, dl int")
        blocks = G._blocks(posts)
        got = blocks.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "MapInArrow" not in blocks._jdf.queryExecution().toString() and "Window" not in blocks._jdf.queryExecution().toString()
    entries = [(e.chunk_id, e.law, b.term, e.tf, e.dl) for b in got for e in b.entries]
    assert sorted(entries, key=str) == sorted(rows, key=str)
    for term in {b.term for b in got}:
        own = sorted((b for b in got if b.term == term), key=lambda b: (b.part, b.block))
        flat = [(-e.tf, e.dl, e.chunk_id) for b in own for e in b.entries]
        assert flat == sorted(flat)
        for b in own:
            assert (b.n, b.max_tf, b.min_dl) == (len(b.entries), max(e.tf for e in b.entries), min(e.dl for e in b.entries))
            assert b.tier == (2 if b.part > own[0].part else 1 if b.block else 0)
        for part in {b.part for b in own}:
            sizes = [len(b.entries) for b in own if b.part == part]
            assert [b.block for b in own if b.part == part] == list(range(len(sizes))) and set(sizes[:-1]) <= {3} and sizes[-1] <= 3
    assert G._blocks(posts.limit(0)).count() == 0
