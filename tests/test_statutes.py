"""The heading machine, chunking, validators and indexes on literal rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunk as C
from quillspark.operators import evaluate as M
from quillspark.operators import evalset as E
from quillspark.operators import fusion, index, lexical
from quillspark.operators import parse as P
from quillspark.operators import validate as V

LINES = """앞 문장
제1장 총칙
제1절 목적
제1조(목적) 이 법은 목적을 정한다.
반복 문장
반복 문장
제5조 이 문장은 제목이 아니다
044-123-4567
제2조(정의)
제2장 보칙
제2조의2(특례) 특례를 정한다.
제6장의2 본문에 남는 줄
제3조 삭제
부칙
제1조(시행일) 공포한 날부터 시행한다.
제1장 부칙 안의 장
부칙 <법률 제2호>
제1조(시행일) 다시 시행한다.""".split("\n")


def sequential(lines):
    """An independent reading of the rules, a line at a time."""
    section, chapter, sub, now, out = "본문", None, None, None, []
    for page, line in lines:
        art = re.match(r"^(제\d+조(?:의\d+)?)(?:\(([^)]*)\))?(?:\s+(.*))?$", line)
        titled = re.match(r"^제\d+조(?:의\d+)?\([^)]*\)(?:\s|$)", line)
        if re.match(r"^부칙(?:\s+.*)?$", line):
            section, chapter, sub, now = "부칙", None, None, None
        elif section == "본문" and (m := re.match(r"^(제\d+장)(?:\s+(.+))?$", line)):
            chapter, sub, now = m[1], None, None
        elif section == "본문" and (m := re.match(r"^(제\d+절)(?:\s+(.+))?$", line)):
            sub, now = m[1], None
        elif art and (titled or not art[3] or art[3] in ("삭제", "신설", "생략")):
            now = [section, chapter, sub, art[1], art[2] if titled else None, [art[3]] if art[3] else [], {page}]
            out.append(now)
        elif now:
            now[5].append(line)
            now[6].add(page)
    return [(a[0], a[1], a[2], a[3], a[4], a[5], sorted(a[6])) for a in out if a[5]]


def run_machine(spark, docs):
    rows = [(name, page, n, line) for name, lines in docs.items() for n, (page, line) in enumerate(lines)]
    arts = P.articles(P.clean_lines(spark.createDataFrame(rows, "document string, page int, line_no int, line string")))
    got = {}
    for r in sorted(arts.collect(), key=lambda r: r.pos):
        got.setdefault(r.document, []).append((r.section, r.chapter and r.chapter.number, r.subsection and r.subsection.number, r.article, r.title, list(r.lines), list(r.pages)))
    return got, arts


def test_heading_machine(spark):
    lines = [(1 + n // 9, x) for n, x in enumerate(LINES)]
    got, arts = run_machine(spark, {"법": lines})
    assert got["법"] == sequential([(p, x) for p, x in lines if "044" not in x])
    merged = {(r.section, r.article): r for r in P.merge_articles(arts).collect()}
    assert merged["부칙", "제1조"].lines == ["공포한 날부터 시행한다.", "제1장 부칙 안의 장", "다시 시행한다."]
    assert merged["본문", "제1조"].lines == ["이 법은 목적을 정한다.", "반복 문장", "제5조 이 문장은 제목이 아니다"]
    text = {r.article: r.text for r in P.article_text(P.merge_articles(arts)).where("section = '본문'").collect()}
    assert text["제1조"] == "제1조(목적) 이 법은 목적을 정한다. 반복 문장 제5조 이 문장은 제목이 아니다" and "제2조" not in text


def test_heading_machine_random(spark):
    rng = random.Random(9)
    parts = ["제1장 가", "제2장", "제1절 나", "제1조(가) 라", "제2조(나)", "제2조의3(다) 마", "제3조", "제4조 삭제", "제4조 바", "부칙", "부칙 <법률>", "본문 줄", "다른 줄", "제6장의2 x"]
    docs = {f"d{k}": [(n // 5 + 1, rng.choice(parts)) for n in range(rng.randint(0, 40))] for k in range(60)}
    got, _ = run_machine(spark, docs)
    for name, lines in docs.items():
        assert got.get(name, []) == sequential(lines), name


def greedy(text, size=7000, least=1000, after=1):
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            best = max(text.rfind(m, start, end) for m in C.MARKERS)
            end = best + after if best > start + least else end
        out.append(text[start:end].strip())
        start = end
    return [p for p in out if len(p) >= 20]


def test_sentence_split(spark):
    rng = random.Random(1)
    texts = ["가" * 7000, "가" * 7001, "가" * 500 + "." + "나" * 9000, "가" * 6000 + "." + "나" * 500 + "한다" + "라" * 3000, "", "짧다"]
    texts += ["".join(rng.choice(["가", "나다. ", "한다. ", "한다", "라 ", "1"]) for _ in range(rng.randint(1, 12000))) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, x string").select("k", C.split_sentences(F.col("x")).alias("p"), C.split_sentences(F.col("x"), 300, 40).alias("q"))
    for r in df.collect():
        assert r.p == greedy(texts[r.k])
        assert r.q == greedy(texts[r.k], 300, 40)


def test_structural_units(spark):
    x = "제1조(목적) 앞말 ① 첫째 1. 하나 2. 둘 ② 둘째 3.5는 수"
    units = lambda c, fold=False: [tuple(u) for u in spark.createDataFrame([(c,)], "x string").select(P.structural_units(F.col("x"), fold).alias("u")).first().u]
    assert units(x) == [(None, None, "제1조(목적) 앞말"), ("제1항", None, "① 첫째"), ("제1항", "제1호", "1. 하나"), ("제1항", "제2호", "2. 둘"), ("제2항", None, "② 둘째 3.5는 수")]
    assert units(x, True) == [] and units("없음") == []


def test_long_article_chunks(spark):
    body = "① " + "가나다 " * 30 + "1. " + "라마바 " * 30 + "② " + "사아자 " * 200
    rows = [("법_법률_제1호_20240101", 1, "본문", "제1조", "제1조(목적) 머리말이 조금 있다 " + body), ("법_법률_제1호_20240101", 2, "본문", "제2조", "짧은 조문이지만 스무 글자는 넘습니다 정말로"), ("법_법률_제1호_20240101", 3, "본문", "제3조", "짧은  조문이지만 스무 글자는 넘습니다 정말로"), ("법_법률_제1호_20240101", 4, "부칙", "제1조", "짧다")]
    arts = spark.createDataFrame(rows, "document string, pos int, section string, article string, text string").selectExpr("*", "named_struct('number', '제1장', 'title', '총칙') chapter", "cast(null as struct<number:string,title:string>) subsection", "'t' title", "1 page_start", "1 page_end")
    chunks = C.articles_to_chunks(arts, 300)
    got = {r.id: r for r in chunks.collect()}
    assert set(got) == {"법_본문_제1조", "법_본문_제1조_제1항", "법_본문_제1조_제1항_제1호", *(f"법_본문_제1조_제2항_part{k}" for k in (1, 2, 3)), "법_본문_제2조"}
    assert got["법_본문_제1조_제1항"].parent_id == "법_본문_제1조" and got["법_본문_제1조"].parent_id is None
    assert got["법_본문_제1조_제2항_part2"].chunk_index == 2 and got["법_본문_제1조_제1항_제1호"].chunk_type == "item"
    offences = {(r.check, r.offending_id) for r in V.validate_chunks(chunks).collect()}
    assert offences == set()


def test_validators_find_each_fault(spark):
    good = {"document": "d", "id": "a", "text": "x" * 30, "section": "본문", "chapter": "c", "chunk_type": "article", "paragraph": None, "item": None, "parent_id": None, "page_start": 1, "page_end": 2, "law_name": "l", "article": "제1조", "chunk_index": 1, "chunk_count": 1}
    faults = {"V02": {"chapter": None}, "V04": {"page_start": 3}, "V05": {"text": "x"}, "V06": {"section": "?", "chapter": None}, "V07": {"chunk_type": "?", "parent_id": "a", "item": "i"}, "V08a": {"parent_id": "a"}, "V08": {"chunk_type": "item", "item": "i", "parent_id": "zz"}, "V09": {"chunk_type": "paragraph", "parent_id": "a"}, "V10": {"chunk_type": "item", "item": "i", "parent_id": "kid"}}
    rows = [good, {**good, "id": "kid", "chunk_type": "item", "item": "i", "parent_id": "a"}, {**good, "id": "dup"}, {**good, "id": "dup"}] + [{**good, **change, "id": name} for name, change in faults.items()]
    schema = "document string, id string, text string, section string, chapter string, chunk_type string, paragraph string, item string, parent_id string, page_start int, page_end int, law_name string, article string, chunk_index int, chunk_count int"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    found = {(r.check, r.offending_id) for r in V.validate_chunks(df).collect()}
    assert {(name, name) for name in faults} <= found and ("V01", "dup") in found
    assert not any(i in ("a", "kid") for _, i in found)
    assert {r.offending_id for r in V.missing_keys(df.drop("article")).collect()} == {"article"}


def test_bm25_golden(spark):
    rows = [("c1", "정의 근로자 사용자"), ("c2", "목적 근로조건 기준"), ("c3", "정의 보험 기준 급여"), ("c4", "벌칙"), ("c5", "근로자 보호")]
    chunks = spark.createDataFrame([(a, "L", "", b) for a, b in rows], "chunk_id string, law string, title string, text string")
    q = spark.createDataFrame([(1, "L", "정의 근로자"), (2, "L", "!")], "qid int, law string, query string")
    for by_law in (False, True):
        got = [(r.chunk_id, round(r.bm25_score, 6)) for r in sorted(lexical.bm25_top_k(q, chunks, by_law=by_law).collect(), key=lambda r: r["rank"])]
        assert got == [("c1", 0.629373), ("c5", 0.375463), ("c3", 0.270845), ("c2", 0.0), ("c4", 0.0)]


def test_rrf_golden(spark):
    dense = spark.createDataFrame([(1, k + 1, c, "L", 0.5) for k, c in enumerate("abc")], "qid int, dense_rank int, chunk_id string, law string, score double")
    lex = spark.createDataFrame([(1, k + 1, c, "L", 0.5) for k, c in enumerate("cda")], "qid int, rank int, chunk_id string, law string, bm25_score double")
    got = [(r.chunk_id, round(r.rrf_score, 6)) for r in sorted(fusion.reciprocal_rank_fusion(dense, lex).collect(), key=lambda r: r["rank"])]
    assert got == [("a", 0.291667), ("c", 0.291667), ("b", 0.142857), ("d", 0.142857)]


def test_unsupported_golden(spark):
    df = spark.createDataFrame([("제4조의2 및 제76조", ["제4조의2(x)"]), ("제2조, 제95조, 제107조", [])], "a string, s array<string>")
    first, second = [r.h for r in df.select(M.unsupported_citations(F.col("a"), F.col("s")).alias("h")).collect()]
    assert (first.answer_articles, first.source_articles, first.unsupported, first.flag) == (["제4조", "제76조"], ["제4조"], ["제76조"], True)
    assert second.answer_articles == ["제107조", "제2조", "제95조"]


def test_metrics_golden(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "qid int, expected_chunk_id string")
    hits = spark.createDataFrame([(1, 1, "a"), (2, 4, "b"), (3, 1, "x")], "qid int, rank int, chunk_id string")
    s = M.search_summary(M.first_rank(queries, hits)).first()
    assert (s.top1_correct, s.top3_correct, s.top5_correct) == (1, 1, 2) and abs(s.mrr - 1.25 / 3) < 1e-12


def test_upsert_is_last_wins_and_idempotent(spark):
    old = spark.createDataFrame([("a", 0, "x"), ("b", 0, "x")], "id string, load_seq int, v string")
    load = spark.createDataFrame([("b", 1, "y"), ("b", 2, "z"), ("c", 1, "y")], "id string, load_seq int, v string")
    once = index.upsert(old, load)
    rows = lambda df: sorted((r.id, r.v) for r in df.collect())
    assert rows(once) == [("a", "x"), ("b", "z"), ("c", "y")] == rows(index.upsert(once, load))
    assert rows(index.upsert(old, load.limit(0))) == [("a", "x"), ("b", "x")]


def test_incremental_stream(spark, tmp_path):
    from quillspark.plans.retrieval import hashed_embedding
    from quillspark.streaming.incremental import index_stream

    rows = [("a", "one"), ("b", "two"), ("a", "one")]
    spark.createDataFrame(rows, "chunk_id string, text string").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema("chunk_id string, text string").parquet(f"{tmp_path}/in")
        index_stream(stream, f"{tmp_path}/index", f"{tmp_path}/check", hashed_embedding).trigger(availableNow=True).start().awaitTermination(60)
        spark.createDataFrame([("b", "two"), ("c", "three")], "chunk_id string, text string").write.mode("append").parquet(f"{tmp_path}/in")
    got = spark.read.parquet(f"{tmp_path}/index").collect()
    assert sorted(r.chunk_id for r in got) == ["a", "b", "c"] and all(len(r.embedding) == 64 for r in got)


def test_corrections_and_templates(spark):
    arts = spark.createDataFrame([("L", "제1조", "c", "목적", 1, "1")], "law string, article string, chunk_id string, title string, place int, pos string")
    got = [r.query for r in sorted(E.make_queries(arts).collect(), key=lambda r: r.no)]
    assert got == ["L에서 제1조(목적)의 내용은 무엇인가요?", "L에서 목적에 관한 규정은 어떻게 되어 있나요?", "목적에 대해서 법에서는 어떻게 정하고 있나요?"]
    old = spark.createDataFrame([(1, "q", "L", "A", "c")], "id long, query string, expected_law string, expected_article string, expected_chunk_id string")
    fix = spark.createDataFrame([(1, "fix_answer", "no", None, "B", "d", "")], "id long, action string, new_query string, new_law string, new_article string, new_chunk_id string, reason string")
    assert tuple(E.apply_corrections(old, fix).first()) == (1, "q", "L", "B", "d", True)
    assert {r.field for r in E.changed_queries(old, E.apply_corrections(old, fix)).collect()} == {"expected_article", "expected_chunk_id"}


def test_fingerprint_ignores_white_space(spark):
    a, b = [r.f for r in spark.createDataFrame([("a b　c",), ("abc",)], "x string").select(T.fingerprint(F.col("x")).alias("f")).collect()]
    assert a == b


def test_dense_search_in_groups(spark, monkeypatch):
    """More queries than are broadcast at once give the same hits."""
    from quillspark.operators import dense

    rows = [(i, i % 3, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    points = spark.createDataFrame(rows, "chunk_id int, law int, embedding array<float>")
    queries = points.where("chunk_id < 9").withColumnRenamed("chunk_id", "qid")
    want = sorted(map(tuple, dense.dense_top_k(queries, points, 4).collect()))
    monkeypatch.setattr(dense, "BROADCAST_QUERIES", 2)
    assert sorted(map(tuple, dense.dense_top_k(queries, points, 4).collect())) == want and len(want) == 36


def test_chunk_files_are_checked(spark, tmp_path):
    from quillspark.operators import index
    from quillspark.plans.retrieval import hashed_embedding
    from quillspark.sources import files

    good = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    good.write.json(f"{tmp_path}/good")
    assert files.read_checked_chunks(spark, f"{tmp_path}/good").count() == 2
    good.unionByName(good).write.json(f"{tmp_path}/bad")
    with pytest.raises(ValueError, match="repeated id"):
        files.read_checked_chunks(spark, f"{tmp_path}/bad")
    load = spark.createDataFrame([("a", "x", 1)], "chunk_id string, text string, load_seq int")
    old = index.with_point_id(load.withColumn("embedding", hashed_embedding("text")))
    assert index.embed_and_upsert(old, load, hashed_embedding, 64).count() == 1
    with pytest.raises(ValueError, match="of 32 dimensions"):
        index.embed_and_upsert(old, load, hashed_embedding, 32)
