"""Models in Python workers: shipped as files, loaded once a worker, fed in batches, timed by row.

A model is a file that Spark ships to the executors; a worker loads it when its first batch needs
it and keeps it. Pairs for a scorer are sorted by length within an Arrow batch, so that a batch
of the model holds texts of like length, and scores return to the rows' order.
"""

from __future__ import annotations

import json
import posixpath
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.decode import write_files

#: Pairs that a model scores at once.
MODEL_BATCH = 32

_loaded: dict[str, object] = {}


def resource(name: str, load: Callable[[str], object]) -> object:
    """What ``load`` makes of the shipped file ``name``: once in the life of a worker."""
    if name not in _loaded:
        _loaded[name] = load(SparkFiles.get(name))
    return _loaded[name]


def ship(spark: SparkSession, folder: str, name: str, data: bytes) -> str:
    """Write a model file below the shared ``folder`` and send it to every executor; its name there."""
    write_files(spark.createDataFrame([(name, bytearray(data))], "name string, content binary"), folder)
    spark.sparkContext.addFile(posixpath.join(folder, name))
    return name


class OverlapModel:
    """The stand-in for a cross-encoder: weighed shares of the query's words and word pairs that the passage has."""

    def __init__(self, words: float, pairs: float):
        self.words, self.pairs = words, pairs

    @classmethod
    def load(cls, path: str) -> OverlapModel:
        with open(path) as f:
            return cls(**json.load(f))

    def predict(self, pairs: list[tuple[str, str]]) -> list[float]:
        return [self._score(_words(q), _words(p)) for q, p in pairs]

    def _score(self, q: list[str], p: list[str]) -> float:
        share = lambda a, b: len(a & b) / len(a) if a else 0.0
        return self.words * share(set(q), set(p)) + self.pairs * share(set(zip(q, q[1:])), set(zip(p, p[1:])))


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.translate(_LOWER))


def predict_by_length(predict: Callable[[list], list[float]], pairs: list[tuple[str, str]], batch: int = MODEL_BATCH) -> tuple[list[float], list[float]]:
    """(scores, seconds) in the order of ``pairs``; a batch's time is dealt to its pairs by length."""
    size = [len(q) + len(p) + 1 for q, p in pairs]
    order = sorted(range(len(pairs)), key=size.__getitem__)
    scores, seconds = [0.0] * len(pairs), [0.0] * len(pairs)
    for at in range(0, len(order), batch):
        own = order[at : at + batch]
        began = time.perf_counter()
        found = predict([pairs[k] for k in own])
        took, all_ = time.perf_counter() - began, sum(size[k] for k in own)
        if len(found) != len(own):
            raise ValueError(f"the model gave {len(found)} scores for {len(own)} pairs")
        for k, s in zip(own, found):
            scores[k], seconds[k] = float(s), took * size[k] / all_
    return scores, seconds


def timed_scorer(name: str, load: Callable[[str], object], batch: int = MODEL_BATCH) -> Callable[[Column, Column], Column]:
    """(query, passage) -> struct<score, seconds> by the model in the shipped file ``name``; nulls are empty texts."""

    @F.pandas_udf("struct<score:double,seconds:double>")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for queries, passages in parts:
            model = resource(name, load) if len(queries) else None
            pairs = list(zip(queries.fillna("").tolist(), passages.fillna("").tolist()))
            scores, seconds = predict_by_length(model.predict, pairs, batch) if pairs else ([], [])
            yield pd.DataFrame({"score": pd.Series(scores, dtype="float64"), "seconds": pd.Series(seconds, dtype="float64")})

    return lambda query, passage: score(query, passage)


def scorer(name: str, load: Callable[[str], object], batch: int = MODEL_BATCH) -> Callable[[Column, Column], Column]:
    """(query, passage) -> score: a scorer for ``answer.rerank``."""
    timed = timed_scorer(name, load, batch)
    return lambda query, passage: timed(query, passage)["score"]


def timed_text(answer: Callable[[str], str]) -> Callable[[Column], Column]:
    """prompt -> struct<text, seconds>: the time of each call."""

    @F.pandas_udf("struct<text:string,seconds:double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in parts:
            out = []
            for p in prompts:
                began = time.perf_counter()
                text = answer(p)
                out.append((text, time.perf_counter() - began))
            yield pd.DataFrame(out, columns=["text", "seconds"])

    return lambda prompt: run(prompt)
