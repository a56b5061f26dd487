"""The pipeline's stages against plain Python over the same rows."""

import re
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import PII_KINDS, luhn, naive_components, naive_shingles

from quillspark.llm import encoding, toxicity
from quillspark.llm.shared import staged

SMALL = "/root/testdata/sf0.001"


def template(text):
    return re.findall(r"[^\W_]+", text)


def redacted(text):
    spans = []
    for no, (kind, pattern) in enumerate(PII_KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                spans.append((m.start(), no, m.end(), kind))
    out, at = [], 0
    for s, _, e, kind in sorted(spans):
        if s >= at:
            out.append(text[at:s] + f"[{kind.upper()}]")
        at = max(at, e)
    return "".join(out) + text[at:]


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("n_chars", F.length("text").cast("long"))
    names = docs.columns
    kept = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = staged(stage(spark, now, SMALL), name)
        if name != "packing":
            assert now.columns == names and now.dtypes == docs.dtypes
        kept[name] = now.collect()
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)

    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = [r for r in rows if model.score(r.text) < 0.5]
    assert {r.doc_id for r in kept["toxicity"]} == {r.doc_id for r in rows}

    sets = [naive_shingles(r.text) for r in rows]
    roots = naive_components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    assert {r.doc_id for r in kept["simhash_near_dedup"]} == {r.doc_id for r in rows}

    items = [template(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in rows if any(" ".join(i) in " ".join(template(r.text)) for i in items)}
    rows = [r for r in rows if r.doc_id not in leaks]
    assert {r.doc_id for r in kept["benchmark_decontamination"]} == {r.doc_id for r in rows}

    texts = {r.doc_id: redacted(r.text) for r in rows}
    assert {r.doc_id: r.text for r in kept["pii"]} == texts
    assert all(r.n_chars == len(r.text) for r in kept["pii"])

    enc = encoding.encoder(encoding.vocabulary("word_bpe_49k.json"))
    want = {d: len(enc.ids(t)) // 4 + 1 for d, t in texts.items()}
    got = defaultdict(int)
    for r in kept["packing"]:
        got[r.doc_id] += r.length
    assert got == want


def test_run_and_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_pass_through(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "x", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    now = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = staged(stage(spark, now, SMALL), name)
        assert now.columns == odd.columns
    # empty texts are copies of each other: the least doc_id stays, and the row without one
    assert sorted((r.doc_id for r in now.collect()), key=lambda d: d or 0) == [None, 1]
