"""Korean rules and golden rows, which the driver's tables don't cover."""

import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from quillspark.functions import headings as H
from quillspark.functions import text as T
from quillspark.functions.tokens import tokenize


def one(spark, x, f):
    return spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_normalize_unicode(spark):
    for x in ("①（가）", "ﬁ​x ", "　ａ﻿", "plain", None):
        want = None if x is None else unicodedata.normalize("NFKC", x).translate({0x200B: None, 0x200C: None, 0x200D: None, 0xFEFF: None, 0xA0: " ", 0x3000: " "})
        assert one(spark, x, T.normalize_unicode) == want


@pytest.mark.parametrize(
    "x,want",
    [("근로자와 사용자는 어떻게 정의되나요", ["근로자", "사용자", "어떻게", "정의되", "정의"]), ("국가는 A b 제2조(정의)를 2개 이상 정하여야 한다", ["국가", "제2조", "정의", "2개", "이상", "정하여야", "한다"]), ("Été_x l'ÉCOLE 10.5%", ["été_x", "école", "10"]), ("근로조건은 어떤 원칙에 따라 결정되어야 하나요?", ["근로조건", "어떤", "원칙", "따라", "결정되어야", "결정", "하나요"]), ("", [])],
)
def test_tokens(spark, x, want):
    assert one(spark, x, tokenize) == want


def test_article_headings(spark):
    rows = [("제5조",), ("제5조(목적)이 법",), ("제6조 삭제 <2019>",), ("제7조(정의) 이 법",), ("제8조의2 삭제",), ("제9조() x",)]
    h = H.article(F.col("x"))
    got = [(r.ok, r.n, r.t, r.c) for r in spark.createDataFrame(rows, "x string").select(h.is_one.alias("ok"), h.number.alias("n"), h.title.alias("t"), h.content.alias("c")).collect()]
    assert got[0] == (True, "제5조", None, "") and not got[1][0] and not got[2][0]
    assert got[3] == (True, "제7조", "정의", "이 법") and got[4] == (True, "제8조의2", None, "삭제") and got[5] == (True, "제9조", "", "x")


def test_old_headings(spark):
    h, doubled = H.article_old(F.col("x"))
    rows = [("제7조제7조(정의) 이 법",), ("제2조부터 제6조까지 삭제",), ("제3조 무엇",), ("부칙",)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "x string").select(h.is_one, h.number, h.title, h.content, doubled).collect()]
    assert got == [(True, "제7조", "정의", "이 법", True), (True, "제2조부터 제6조까지", None, "삭제", False), (True, "제3조", None, "무엇", False), (False, None, None, None, False)]


def test_noise(spark):
    rows = [("국가법령정보센터 1", True), ("법제처 3", True), ("법제처 장관", False), ("전화 044-123-4567", True), (" ", True), ("제1조", False)]
    got = spark.createDataFrame(rows, "x string, w boolean").select("w", T.is_noise_line(F.col("x")).alias("g")).collect()
    assert all(r.w == r.g for r in got)
    assert one(spark, "국가법령정보센터 제1조 법제처 12", T.drop_noise_words) == "제1조"


def test_names(spark):
    name = "근로기준법_법률_제21533호_20270101_본문"
    meta = spark.createDataFrame([(name,)], "x string").select(*(c.alias(k) for k, c in T.law_metadata(F.col("x")).items())).first()
    assert tuple(meta) == ("근로기준법", "법률", "제21533호", "2027-01-01")
    assert one(spark, "산업법(법률)(제1호)", T.short_law_name) == "산업법" and one(spark, None, T.short_law_name) == ""
    assert one(spark, "a b/c__(가)-", T.safe_id) == "a_b_c_가_-"
    assert one(spark, "법_본문_제1조", T.after_main_section) == "제1조"
    assert one(spark, "제 12 조", T.article_number) == 12 and one(spark, "x", T.article_number) == 999_999
    for x in ("", "chunk_가", "a" * 100):
        assert one(spark, x, T.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_URL, x))
    assert one(spark, "a \t b \n\n\n\n c", lambda c: T.clean_text(c)) == "a b\n\nc"
    assert one(spark, " a\n \n b ", lambda c: T.clean_text_flat(c)) == "a\nb"


def test_texts_that_hold_phrases(spark):
    import random

    from quillspark.operators.evaluate import texts_that_hold

    rng = random.Random(4)
    texts = [(k, " ".join(rng.choice(["a", "b", "c", "ab", "", "a\nb"]) for _ in range(rng.randrange(12)))) for k in range(60)] + [(60, None), (61, ""), (62, "x")]
    phrases = [(k, " ".join(rng.choice(["a", "b", "c", "", "b a"]) for _ in range(rng.randrange(8)))) for k in range(60)] + [(60, None), (61, ""), (62, "a"), (63, "b c")]
    held = texts_that_hold(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(phrases, "qid int, phrase string"))
    got = sorted((r.doc_id, r.qid) for r in held.select("doc_id", "qid").collect())
    want = sorted((d, q) for d, t in texts for q, p in phrases if p and t is not None and p in t)
    assert len(want) > 100 and got == want
    long = spark.createDataFrame([(1, "one two three four five six")], "qid int, phrase string")
    plan = texts_that_hold(spark.createDataFrame(texts, "doc_id int, text string"), long)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sentence_split_is_linear(spark):
    """The same characters in texts of 10^4 and of 10^6: the long ones don't cost much more."""
    import time

    from quillspark.operators.chunk import split_sentences

    def seconds(n):
        text = ("이 법은 직업교육을 정한다. 다음 각 호와 같다 " * (n // 20))[:n]
        df = spark.createDataFrame([(text,)] * (10**6 // n), "t string").coalesce(1)
        took = []
        for _ in range(2):
            began = time.perf_counter()
            assert df.select(F.sum(F.size(split_sentences(F.col("t"))))).first()[0] > 0
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds(10**6) < 4 * seconds(10**4) + 1
