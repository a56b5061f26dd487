"""Token ids in Re-Pair grammar files.

A shard holds the documents of one range of doc_id. Frequent pairs of neighbouring symbols
are replaced by new symbols (nonterminals), round after round; the file keeps the rules, the
number of ids that each rule stands for, each document's first symbol and its number of ids.
So one document, or any stretch of its ids, is decoded without the rest of the shard.

File, little-endian: magic ``RPR1``; u32 vocabulary size, rules, documents, symbols, bytes a
symbol (2 or 4); then arrays: rules' left and right symbols (u32 each), rules' expansion
lengths (u32), doc_ids (i64), null marks (u8), documents' first symbols (u32, one more as end),
documents' ids (u32), symbols.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import scratch, split_uri, staged, text_or_empty, write_file

MAGIC = b"RPR1"
#: Ids in a shard file at most, but for one longer document.
SHARD_IDS = 4_000_000
#: Bytes that a rule takes in the file; a pair is replaced if its occurrences save more.
RULE_BYTES = 12
#: A round that leaves more than this share of the symbols is the last.
LAST_ROUND = 0.99
#: Expansion lengths stay below this, so that decoding any symbol is bounded work.
MAX_EXPANSION = 1024


@dataclass
class Grammar:
    vocab: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    symbols: np.ndarray
    first: np.ndarray  # of each document, and the end


def compress(ids: np.ndarray, sizes: np.ndarray, vocab: int) -> Grammar:
    """Replace frequent pairs, round after round, until a round saves less than a hundredth.

    A round takes pairs from the most frequent down, to a count that falls from round to round
    as far as a rule pays for itself. No symbol is both a left and a right one among them, so
    no two occurrences overlap and all are replaced at once; a pair of equal symbols is taken
    alone and from the left. Pairs don't cross documents. Symbols of two bytes end where
    rules would make them four.
    """
    narrow = vocab < 1 << 16
    seq = ids.astype(np.uint16 if narrow else np.uint32)
    shift, wide = (np.uint32(16), np.uint32) if narrow else (np.uint64(32), np.uint64)
    least = RULE_BYTES // seq.itemsize + 1
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    left, right, length = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)], np.ones(vocab, np.uint32)
    floor = max(least, len(seq) >> 11)
    while len(seq) > 1 and not (narrow and len(length) == 1 << 16):
        keys = (seq[:-1].astype(wide) << shift) | seq[1:]
        inner = np.ones(len(keys), bool)
        cuts = first[1:-1]
        inner[cuts[(cuts > 0) & (cuts <= len(keys))] - 1] = False
        pairs, counts = _frequent(keys, inner, floor)
        a, b = (pairs >> shift).astype(np.int64), (pairs & wide((1 << int(shift)) - 1)).astype(np.int64)
        room = (1 << 16) - len(length) if narrow else len(pairs)
        chosen = _compatible(a, b, length[a] + length[b] <= MAX_EXPANSION, len(length))[:room]
        if not len(chosen):
            if floor == least:
                break
            floor = max(least, floor >> 3)
            continue
        picked = chosen[np.argsort(pairs[chosen])]
        side = np.zeros(len(length), np.int8)
        side[a[picked]] |= 1
        side[b[picked]] |= 2
        new, sides = len(length), side[seq]
        at = np.nonzero((sides[:-1] & (sides[1:] >> 1) & 1).astype(bool) & inner)[0]
        slot = np.searchsorted(pairs[picked], keys[at])
        slot[slot == len(picked)] = 0
        hit = pairs[picked][slot] == keys[at]
        at, slot = at[hit], slot[hit]
        if (a[picked] == b[picked]).any():
            twice = (a[picked] == b[picked])[slot]
            # in a run of one symbol every second place begins a pair
            begins = np.append(True, (np.diff(at) > 1) | (slot[1:] != slot[:-1]))
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at, slot = at[~twice | (since % 2 == 0)], slot[~twice | (since % 2 == 0)]
        seq[at] = (new + slot).astype(seq.dtype)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        # a document's first symbol moves back by the symbols dropped before it
        first = first - np.searchsorted(at + 1, first)
        before, seq = len(seq), seq[keep]
        left.append(a[picked].astype(np.uint32))
        right.append(b[picked].astype(np.uint32))
        length = np.concatenate([length, length[a[picked]] + length[b[picked]]])
        if floor == least and len(seq) > LAST_ROUND * before:
            break
        floor = max(least, floor >> 3)
    return Grammar(vocab, np.concatenate(left), np.concatenate(right), length[vocab:], seq, first.astype(np.uint32))


def _compatible(a: np.ndarray, b: np.ndarray, fits: np.ndarray, symbols: int) -> np.ndarray:
    """Places of pairs, most frequent first, such that no symbol is on both sides but in a pair of its own."""
    side, chosen = bytearray(symbols), []
    for k, x, y in zip(np.nonzero(fits)[0].tolist(), a[fits].tolist(), b[fits].tolist()):
        if x == y:
            if not side[x]:
                side[x] = 3
                chosen.append(k)
        elif side[x] < 2 and side[y] in (0, 2):
            side[x], side[y] = 1, 2
            chosen.append(k)
    return np.array(chosen, np.int64)


def _frequent(keys: np.ndarray, inner: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that occur ``floor`` times or more, most frequent first.

    Wide keys are counted by hash first: only those in a bucket with enough of them are sorted.
    """
    if keys.itemsize > 4:
        mixed = keys * keys.dtype.type(0x9E3779B1)
        bucket = (mixed >> keys.dtype.type(8 * keys.itemsize - 20)).astype(np.int32)
        inner = (np.bincount(bucket, minlength=1 << 20) >= floor)[bucket] & inner
    keys = np.sort(keys[inner])
    if len(keys) < floor:
        return keys[:0], np.empty(0, np.int64)
    heads = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0]
    counts = np.diff(np.append(heads, len(keys)))
    pairs, counts = keys[heads][counts >= floor], counts[counts >= floor]
    order = np.lexsort((pairs, -counts))
    return pairs[order], counts[order]


def pack_file(g: Grammar, doc_ids: list, sizes: np.ndarray) -> bytes:
    width = g.symbols.dtype.itemsize
    head = MAGIC + struct.pack("<5I", g.vocab, len(g.left), len(sizes), len(g.symbols), width)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    parts = [g.left.astype("<u4"), g.right.astype("<u4"), g.length.astype("<u4"), ids, known, g.first.astype("<u4"), sizes.astype("<u4"), g.symbols.astype(f"<u{width}")]
    return head + b"".join(p.tobytes() for p in parts)


class RepairFile:
    """Random access to a shard file's documents."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a Re-Pair shard")
        vocab, rules, docs, symbols, width = struct.unpack_from("<5I", data, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.vocab = vocab
        self.left, self.right, self.length = take("<u4", rules), take("<u4", rules), take("<u4", rules)
        ids, known = take("<i8", docs), take("u1", docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known)]
        self.first, self.sizes = take("<u4", docs + 1), take("<u4", docs)
        self.symbols = take(f"<u{width}", symbols)
        # every symbol's expansion, one after another
        self.lengths = np.concatenate([np.ones(vocab, np.int64), self.length.astype(np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.empty(self.starts[-1], np.uint32)
        self.flat[:vocab] = np.arange(vocab, dtype=np.uint32)
        for k, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist())):
            s, m = self.starts[vocab + k], self.lengths[a]
            self.flat[s : s + m] = self.flat[self.starts[a] : self.starts[a] + m]
            self.flat[s + m : self.starts[vocab + k + 1]] = self.flat[self.starts[b] : self.starts[b] + self.lengths[b]]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.lengths[symbols]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[symbols] - (ends - n), n) + np.arange(total)]

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the k-th document; only the symbols that hold them are expanded."""
        symbols = self.symbols[self.first[k] : self.first[k + 1]]
        if start or stop is not None:
            stop = int(self.sizes[k]) if stop is None else min(stop, int(self.sizes[k]))
            ends = np.cumsum(self.lengths[symbols])
            lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
            skipped = int(ends[lo - 1]) if lo else 0
            return self._expand(symbols[lo:hi])[start - skipped : stop - skipped]
        return self._expand(symbols)


def write_shards(docs: DataFrame, vocabulary_path: str, end_id: int, folder: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every whole text and write shard files in ascending doc_id order.

    Returns the manifest, staged: (part int, shard int, path string, n_docs long, n_ids long);
    in the order of part and shard the files hold ascending doc_ids. Null doc_ids come first;
    null texts give the end id alone; repeated rows are documents of their own. Files of task
    attempts that failed are named by no manifest row.
    """

    def run(it):
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        enc, tail = encoder(vocabulary_path), end_id.to_bytes(4, "little")
        doc_ids: list = []
        held: list[bytes] = []
        size = 0

        def flush():
            sizes = np.array([len(b) // 4 for b in held], np.int64)
            ids = np.frombuffer(b"".join(held), "<u4")
            path = posixpath.join(folder, f"{part:06d}-{shard:06d}-{uuid.uuid4().hex}.rpr")
            write_file(path, pack_file(compress(ids, sizes, max(enc.vocab_size, end_id + 1)), doc_ids, sizes))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": pa.array([len(held)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64())})

        for batch in it:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.many(batch.column(1))):
                ids += tail
                if held and size + len(ids) // 4 > shard_ids:
                    yield flush()
                    shard, doc_ids, held, size = shard + 1, [], [], 0
                doc_ids.append(doc_id)
                held.append(ids)
                size += len(ids) // 4
        if held:
            yield flush()

    # the second key deals rows of one doc_id, or without any, to several ranges
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("nth"))
    ordered = rows.repartitionByRange("doc_id", "nth").sortWithinPartitions("doc_id", "nth").drop("nth")
    return staged(ordered.mapInArrow(run, "part int, shard int, path string, n_docs long, n_ids long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document, read back from the files.

    The running start needs one row per file in one task: a few dozen bytes per 4 million ids.
    """
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))

    def run(it):
        for pdf in it:
            for path, base in zip(pdf["path"], pdf["base"]):
                store, name = split_uri(path)
                with store.open_input_stream(name) as f:
                    shard = RepairFile(f.read())
                starts = int(base) + np.concatenate([[0], np.cumsum(shard.sizes[:-1].astype(np.int64))]) if len(shard.sizes) else []
                for at in range(0, len(shard.doc_ids), 256):
                    ks = range(at, min(at + 256, len(shard.doc_ids)))
                    yield pd.DataFrame({"doc_id": pd.array([shard.doc_ids[k] for k in ks], "Int64"), "start": [int(starts[k]) for k in ks], "n_tokens": [int(shard.sizes[k]) for k in ks], "ids": [shard.document(k).astype("<u4").tobytes() for k in ks]})

    n = max(1, manifest.count())
    spread = files.select("path", "base").repartition(min(n, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")
    return spread.mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, vocabulary_path: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write ``docs`` as Re-Pair files in the shared folder and read them back, one row per document."""
    folder = scratch(docs.sparkSession, "token-files")
    return read_shards(write_shards(docs, vocabulary_path, end_id, folder, shard_ids))


def token_digest(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned, of little-endian unsigned 32-bit ids)."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
