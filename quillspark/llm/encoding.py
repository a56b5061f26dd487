"""Token ids of whole texts by the tokenizers library, with a memo of the words seen.

The two public vocabularies used here never join characters across a space that follows a
non-space character: the byte-level one starts a new piece there and the word-level one drops
white space. So a text is cut at those places, each distinct part is encoded once by the
library and the ids are joined. A text with a special token's string in it is encoded whole.
A part of plain Latin letters is one piece for either vocabulary and goes straight to the
library's merge model; marks after the letters are the next piece. A vocabulary that splits
texts in any other way is used on whole texts, without cuts and memo.

``many`` takes an Arrow array of texts. For the byte-level vocabulary it cuts all of them at once,
by pairs of neighbouring bytes, looks up each distinct part once and encodes the new words of all
texts together.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from itertools import compress
from operator import attrgetter
from time import monotonic

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that a memo of a worker process may take, by estimate. It starts anew when it is full.
MEMO_BYTES = 120 << 20
#: Bytes of texts that are cut and looked up together, at least (but for one longer text).
TOGETHER = 4 << 20
#: New words in one text for the library: a few hundred take the least time a word.
CALL_WORDS = 200
#: Longer parts aren't kept: texts without spaces would fill the memo.
MEMO_PART = 64
#: How the two known vocabularies normalise and split texts.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_WORD_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORD_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
KNOWN = ((None, _BYTE_LEVEL), (_WORD_NORMAL, {"type": "Sequence", "pretokenizers": [_WORD_SPLIT, _BYTE_LEVEL | {"use_regex": False}]}))

_SPACE = re.compile(r"(?<=\S)(?= )")
#: White space other than U+0020 that may stand before a space; then the slow cut is needed.
_ODD = tuple(chr(c) + " " for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_ODD_ASCII = tuple(x for x in _ODD if x.isascii())

#: Marks that end a word most often, and the length up to which words with one are kept.
STOPS, SHORT = (".", ","), 6
#: Fixed value: the space in the byte-level alphabet.
SPACE = "\u0120"

#: Seconds after its last task began from which an encoder is dropped by tasks of other operators in its process.
IDLE_S = 10
_encoders: dict[str, "Encoder"] = {}
_last_used: dict[str, float] = {}
_id = attrgetter("id")


#: Latin-1 letters: letters in every Unicode version, unchanged by NFC, one character in lower case.
_L = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
_MARKS = r"[!-&(-/:-@\[-`{-~]*"
_LATIN = re.compile(_L).fullmatch
_WORDS = re.compile(f"({_L})({_MARKS})(?:\n({_L})({_MARKS}))?").fullmatch


def _byte_letters() -> str:
    """The byte-level alphabet by byte: printable Latin-1 stands for itself, other bytes follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


class _Memo(dict):
    """Part of a text -> its ids in bytes."""

    def __init__(self, ids):
        super().__init__()
        self.make, self.size = ids, 0

    def __missing__(self, part: str) -> bytes:
        ids = self.make(part)
        if len(part) <= MEMO_PART and "\n" not in part[1:]:  # the words around a line end seldom meet again
            self.keep(part, ids)
        return ids

    def keep(self, part: str, ids: bytes) -> None:
        self.size += len(part) + len(ids) + 200
        if self.size > MEMO_BYTES:
            self.clear()
            self.size = len(part) + len(ids) + 200
        self[part] = ids


class _Words(_Memo):
    """The memo of words after a space. A word with a stop or comma is put together anew; only short ones, which recur, are kept."""

    def __init__(self, ids, marks: _Memo):
        super().__init__(ids)
        self.marks = marks

    def __missing__(self, part: str) -> bytes:
        if part[-1:] in STOPS and (word := part[:-1]).isalpha() and (word.isascii() or _LATIN(word)):
            ids = self[word] + self.marks[part[-1]]
            if len(part) <= SHORT:
                self.keep(part, ids)
            return ids
        return super().__missing__(part)


def _pair_cuts() -> np.ndarray:
    """Where the byte-level vocabulary always ends a piece between two bytes of a text: [byte before, byte after].

    Letters, digits and marks are ASCII here. A space or line end ends what stands before it. Bytes of
    other characters and control characters give no cut, but for a space after what is surely no white space.
    """
    letter, digit, mark = np.zeros((3, 256), bool)
    letter[[*range(65, 91), *range(97, 123)]] = digit[48:58] = mark[33:127] = True
    mark &= ~letter & ~digit
    cuts = np.zeros((256, 256), bool)
    for one in (letter, digit, mark):
        cuts[np.ix_(one, ~one & (letter | digit | mark))] = True
        cuts[one, 10] = cuts[one, 32] = True
    cuts[ord("'"), letter] = False  # 's, 't and so on are pieces
    # last bytes of white space beyond ASCII
    cuts[sorted({*range(0x80, 0x100)} - {*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF}), 32] = True
    return cuts.ravel()


_CUTS = _pair_cuts()
#: Bytes of ASCII letters, digits and marks.
_VISIBLE = np.array([chr(c).isprintable() and c != 32 for c in range(128)] + [False] * 128)
_SPACED_WORD = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


def _parts(data: np.ndarray, starts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where the parts of texts begin in their joined bytes. ``starts`` has each text's first byte and the end; texts marked ``whole`` aren't cut."""
    kind = data.copy()
    # both bytes of a Latin-1 letter count as a letter
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = ord("a")
    cut = np.append(True, _CUTS[(kind[:-1].astype(np.uint16) << 8) | kind[1:]])
    cut[starts[:-1][starts[:-1] < len(data)]] = True
    # a line end alone is a piece: more white space before it would belong to it
    line = np.flatnonzero(kind[:-1] == 10)
    line = line[cut[line] & _VISIBLE[kind[line + 1]]]
    cut[line + 1] = True
    for k in np.flatnonzero(whole):
        cut[starts[k] + 1 : starts[k + 1]] = False
    return np.flatnonzero(cut)


class Encoder:
    """``ids(text)`` are the ids as little-endian unsigned 32-bit integers, in bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.known = (described["normalizer"], described["pre_tokenizer"]) in KNOWN
        self.tokenize = self.tokenizer.model.tokenize
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.letters = _byte_letters()
        # a word-level vocabulary gives the same ids with and without the space, and in lower case
        self.fold = self._encode("A b") == self._encode("a") + self._encode("b")
        self.lead = "" if self.fold else " "
        self.first = _Memo(self._start)
        self.rest = _Words(self._word, self.first)
        if self.known and not self.fold:
            # the merge model alone, on words in the byte-level alphabet with a space (from byte 0) between them
            self.merger = Tokenizer(self.tokenizer.model)
            self.merger.pre_tokenizer = CharDelimiterSplit(" ")
            self.spaced = " " + self.letters[1:]
            known = self.tokenizer.get_vocab()
            self.opens = np.zeros(max(known.values()) + 1, bool)
            self.opens[[i for t, i in known.items() if t.startswith(SPACE)]] = True
            self.parts: dict[bytes, bytes] = {}
            self.again: set[bytes] = set()
            self.held = 0

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _merged(self, letters: str) -> bytes:
        """Ids of one piece, in the byte-level alphabet."""
        return array("I", map(_id, self.tokenize(letters))).tobytes()

    def _start(self, part: str) -> bytes:
        """Ids of a part without a space before it."""
        if part.isalpha() and _LATIN(part):
            return self._merged(charmap_decode((part.lower() if self.fold else part).encode(), "strict", self.letters)[0])
        return self._encode(part)

    def _word(self, word: str) -> bytes:
        """Ids of a word after a space."""
        if word.isascii() and word.isalpha():
            # ASCII letters stand for themselves in the byte-level alphabet
            if self.fold:
                if not word.islower():
                    return self.rest[word.lower()]
                return self._merged(word)
            return self._merged(SPACE + word)
        if word.isalpha() and _LATIN(word):
            if self.fold:
                if (low := word.lower()) != word:
                    return self.rest[low]
            else:
                word = " " + word
            return self._merged(charmap_decode(word.encode(), "strict", self.letters)[0])
        if m := _WORDS(word):
            # letters, marks and perhaps a line end before another word
            first, marks, second, more = m.groups()
            ids = self.rest[first]
            if marks:
                ids += self.first[marks]
            if second:
                ids += self.rest[second] if self.fold else self.first["\n"] + self.first[second]
                if more:
                    ids += self.first[more]
            return ids
        return self._encode(" " + word)

    def ids(self, text: str) -> bytes:
        if not self.known or any(s in text for s in self.special):
            return self._encode(text)
        if not any(x in text for x in (_ODD_ASCII if text.isascii() else _ODD)):
            words = text.split(" ")
        else:
            words = [w[1:] if k else w for k, w in enumerate(_SPACE.split(text))]
        head = self.first[words[0]] if words[0] else b""
        return head + b"".join(map(self.rest.__getitem__, words[1:]))

    def many(self, texts: pa.Array) -> Iterator[bytes]:
        """``ids`` of each of an Arrow array of texts without nulls, in order."""
        if not self.known or self.fold:
            yield from map(self.ids, texts.to_pylist())
            return
        texts = texts.cast(pa.large_string())
        starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        at = 0
        while at < len(texts):
            end = min(len(texts), max(at + 1, int(np.searchsorted(starts, starts[at] + TOGETHER))))
            yield from self._together(texts.slice(at, end - at), starts[at : end + 1])
            at = end

    def _together(self, texts: pa.Array, starts: np.ndarray) -> Iterator[bytes]:
        size = int(starts[-1] - starts[0])
        if not size:
            return iter([b""] * len(texts))
        buffer = texts.buffers()[2].slice(int(starts[0]), size)
        starts = starts - starts[0]
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        at = _parts(np.frombuffer(buffer, np.uint8), starts, whole)
        parts = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, size).astype(np.int64)), buffer]).dictionary_encode()
        # to_pylist takes several times as long here
        distinct = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(self._looked_up(distinct), pa.large_binary()).take(parts.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(at, starts)].tolist()
        data = ids.buffers()[2].to_pybytes()
        return (data[a:b] for a, b in zip(ends, ends[1:]))

    def _looked_up(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts."""
        found = list(map(self.parts.get, parts))
        self.again.update(compress(parts, found))
        new = [p for p, ids in zip(parts, found) if ids is None]
        words = list(filter(_SPACED_WORD, new))
        fresh = dict(zip(words, self._merge_all(words)))
        fresh |= {p: self._start(p.decode()) for p in new if p not in fresh}
        found = [fresh[p] if ids is None else ids for p, ids in zip(parts, found)]
        self._keep(fresh)
        return found

    def _merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters, each after a space, so that their first ids tell where one begins."""
        if not words:
            return []
        calls = [charmap_decode(b"\0".join(words[k : k + CALL_WORDS]), "strict", self.spaced)[0] for k in range(0, len(words), CALL_WORDS)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.merger.encode_batch_fast(calls, add_special_tokens=False)])
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(words):  # a vocabulary without the space's byte
            return [self._encode(w.decode()) for w in words]
        data, starts = ids.tobytes(), (4 * starts).tolist()
        return [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])]

    def _keep(self, new: dict[bytes, bytes]) -> None:
        """Put parts in the memo. When it is full it starts anew with the parts that were met again, where these leave half of the room."""
        new = {p: ids for p, ids in new.items() if len(p) <= MEMO_PART}
        size = _memo_size(new)
        if self.held + size > MEMO_BYTES:
            self.parts = {p: self.parts[p] for p in self.again if p in self.parts}
            self.held, self.again = _memo_size(self.parts), set()
            if self.held > MEMO_BYTES // 2:
                self.parts, self.held = {}, 0
        if self.held + size <= MEMO_BYTES:
            self.parts.update(new)
            self.held += size


def _memo_size(memo: dict[bytes, bytes]) -> int:
    return sum(map(len, memo)) + sum(map(len, memo.values())) + 200 * len(memo)


def encoder(path: str) -> Encoder:
    """The worker process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _last_used[path] = monotonic()
    return _encoders[path]


def drop_idle() -> None:
    """Drop encoders not used for IDLE_S, with their memos: the worker process that holds them now runs another operator."""
    idle = [p for p in _encoders if monotonic() - _last_used[p] > IDLE_S]
    for path in idle:
        del _encoders[path]
    if idle:
        gc.collect()  # an encoder and its memos refer to each other


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
