"""Bounded-space online packing of token ids into sequences.

Each task keeps a fixed number of open windows. A document's piece goes into the window
where it leaves the least room (best fit); where none has room, the fullest window is
emitted and a new one opened. What is open at a task's end is merged with what others left.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import batches_of, staged, text_or_empty

LENGTH = 4096
OPEN_WINDOWS = 64
#: A window is emitted with at most this much padding: where more is left, the piece's head fills it.
SLACK = 32
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, done boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("done", pa.bool_())])


class Packer:
    """Open windows of one task. ``add`` returns the rows of windows that it closed."""

    def __init__(self, first_id: int, length: int = LENGTH, windows: int = OPEN_WINDOWS, slack: int = SLACK):
        self.length, self.windows, self.slack = length, windows, slack
        self.next_id = first_id
        self.open: dict[int, list[tuple]] = {}
        self.room: list[tuple[int, int]] = []  # (room, window), sorted

    def add(self, doc_id, start: int, ids: bytes, total: int) -> list[tuple]:
        out: list[tuple] = []
        at, n = 0, len(ids) // 4
        while n - at >= self.length:
            w = self._new()
            out += self._put(w, self.length, doc_id, start + at, ids[4 * at : 4 * (at + self.length)], total)
            at += self.length
        while at < n:
            need = n - at
            k = bisect_left(self.room, (need, -1))
            if k < len(self.room):
                room, w = self.room.pop(k)
                out += self._put(w, room, doc_id, start + at, ids[4 * at :], total)
                break
            if len(self.room) < self.windows:
                out += self._put(self._new(), self.length, doc_id, start + at, ids[4 * at :], total)
                break
            room, w = self.room.pop(0)  # none fits: the fullest goes
            if room > self.slack:
                out += self._put(w, room, doc_id, start + at, ids[4 * at : 4 * (at + room)], total)
                at += room
            else:
                out += self._close(w)
        return out

    def _new(self) -> int:
        w, self.next_id = self.next_id, self.next_id + 1
        self.open[w] = []
        return w

    def _put(self, w: int, room: int, doc_id, start: int, ids: bytes, total: int) -> list[tuple]:
        n = len(ids) // 4
        self.open[w].append((doc_id, start, n, total, w, self.length - room, ids))
        if n == room:
            return self._close(w)
        insort(self.room, (room - n, w))
        return []

    def _close(self, w: int, done: bool = True) -> list[tuple]:
        return [(*row, done) for row in self.open.pop(w)]

    def rest(self) -> list[tuple]:
        """Rows of the windows still open, marked as not done."""
        self.room.clear()
        return [row for w in list(self.open) for row in self._close(w, False)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_ARROW), _ARROW)], schema=_ARROW)


def _first_id(level: int) -> int:
    """Ids no other task of any level uses: level, partition, then a running number."""
    from pyspark import TaskContext

    return (level << 58) | (TaskContext.get().partitionId() << 32)


def encode_and_pack(docs: DataFrame, vocabulary_path: str, end_id: int, length: int = LENGTH, windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of every whole text's ids and ``end_id``; ``done`` is false for windows left open."""

    def run(it):
        ids_of, tail = encoder(vocabulary_path).ids, end_id.to_bytes(4, "little")
        packer, held, size = Packer(_first_id(0), length, windows), [], 0
        for batch in batches_of(it):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = ids_of(text) + tail
                rows = packer.add(doc_id, 0, ids, len(ids) // 4)
                held += rows
                size += sum(r[2] for r in rows)
            if size > 1 << 20:
                yield _batch(held)
                held, size = [], 0
        yield _batch(held + packer.rest())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)


def merge_leftovers(left: DataFrame, level: int, tasks: int, final: bool, length: int = LENGTH, windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pack the pieces of open windows anew in ``tasks`` groups.

    The final level has one group, bounded by the last level's windows. It leaves nothing
    open: pieces are cut to fill sequences, the last one at powers of two.
    """

    def run(it):
        packer, held = Packer(_first_id(level), length, 1 if final else windows, 0 if final else SLACK), []
        for batch in batches_of(it):
            rows = batch.to_pylist()
            for r in rows:
                held += packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
            if len(held) > 4096:
                yield _batch(held)
                held = []
        rest = packer.rest()
        if final:
            first = packer.next_id
            rest = _powers(rest, first)
        yield _batch(held + rest)

    # neighbouring input partitions are read by one task: each level then has fewer open windows
    return left.coalesce(tasks).sortWithinPartitions(F.desc("length"), "doc_id", "start").mapInArrow(run, SCHEMA)


def _powers(rows: list[tuple], first_id: int) -> list[tuple]:
    """Cut one open window into sequences whose lengths are powers of two; they need no padding."""
    total = sum(r[2] for r in rows)
    cuts = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    out, seq, used = [], first_id, 0
    for doc_id, start, n, tokens, _, _, ids, _ in rows:
        at = 0
        while at < n:
            take = min(n - at, cuts[0] - used)
            out.append((doc_id, start + at, take, tokens, seq, used, ids[4 * at : 4 * (at + take)], True))
            at, used = at + take, used + take
            if used == cuts[0]:
                cuts.pop(0)
                seq, used = seq + 1, 0
    return out


def pack_documents(docs: DataFrame, vocabulary_path: str, end_id: int, length: int = LENGTH, windows: int = OPEN_WINDOWS) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): one row per piece.

    Null texts are empty and give the end id alone; repeated rows and null doc_ids are packed
    as documents of their own; other columns aren't used; an empty table gives no rows.
    ``ids`` are little-endian unsigned 32-bit. Documents longer than a sequence fill whole
    ones; others are cut only where a window would else go out with more than SLACK padding.
    """
    done, level = [], 0
    pieces = staged(encode_and_pack(docs, vocabulary_path, end_id, length, windows), "pack-0")
    while True:
        done.append(pieces.where("done"))
        left = pieces.where("not done")
        n = left.agg(F.countDistinct("sequence_id")).first()[0]
        if not n:
            break
        level += 1
        # a group gets about 4 * windows windows and leaves a quarter of them at most
        final = n <= 4 * windows
        tasks = 1 if final else 1 + n // (4 * windows)
        pieces = staged(merge_leftovers(left, level, tasks, final, length, windows), f"pack-{level}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("done")


def crc32_of(col: str = "ids"):
    """Unsigned CRC-32 of a binary column."""
    return F.crc32(F.col(col))


def piece_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", crc32_of().alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
