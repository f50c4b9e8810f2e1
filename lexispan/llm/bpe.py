"""Byte-level BPE read from a tokenizer file: merges, pre-tokens, prefix counts, streaming.

Nothing is trained here: ``MergeTable`` only reads the merge list of a ``tokenizers`` JSON file.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain
from operator import itemgetter

import numpy as np
import regex

# Fixed value: how byte-level BPE files of this kind split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: visible Latin-1 stands for itself, others follow U+0100."""
    visible = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    out = {chr(b): b for b in visible}
    rest = (b for b in range(256) if b not in set(visible))
    return out | {chr(256 + k): b for k, b in enumerate(rest)}


_beyond = re.compile("[\u0530-\U0010ffff]")


@lru_cache(maxsize=1)
def _unassigned() -> re.Pattern:
    """Characters that have no category in this Python's Unicode tables; split engines differ on them."""
    spans, start = [], None
    for c in range(0x530, sys.maxunicode + 2):
        odd = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if odd and start is None:
            start = c
        elif not odd and start is not None:
            spans.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile("[" + "".join(spans) + "]")


class MergeTable:
    """Vocabulary and merge list of one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True):
            raise ValueError(f"{path}: a byte-level BPE file with the usual split is needed")
        if pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: prefix spaces and normalizers are not supported")
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        self.split = regex.compile(SPLIT)
        self.special_split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._library = None

    # -- pre-tokens ---------------------------------------------------------------------------

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if not text.isascii() and _beyond.search(text) and _unassigned().search(text):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path).pre_tokenizer
            return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return self.split.findall(text)

    def stable_pieces(self, text: str, part: int = 1 << 16) -> Iterator[list[str] | tuple[int, int]]:
        """Pre-tokens of a text without special strings, part by part.

        The last two of a part wait for the text that follows. Where a part holds no more than these, the
        first of them is long: only its place (start, end) is given, so it is not gathered here.
        """
        at, end = 0, 0
        while at < len(text):
            end = min(len(text), max(end, at) + part)
            found = self.pieces(text[at:end])
            if end == len(text):
                yield found
                return
            if len(found) > 2:
                yield found[:-2]
                at = end = end - len(found[-2]) - len(found[-1])
            elif text.isascii() or not (_beyond.search(text) and _unassigned().search(text)):
                m = self.split.match(text, at)
                yield at, m.end()
                at = end = m.end()

    def pieces_by_part(self, text: str) -> Iterator[list[str]]:
        for found in self.stable_pieces(text):
            yield [text[found[0] : found[1]]] if isinstance(found, tuple) else found

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of ordinary text (id None) and special strings (their id), in order."""
        if self.special_split is None or not self.special_split.search(text):
            if text:
                yield text, None
            return
        at = 0
        for m in self.special_split.finditer(text):
            if m.start() > at:
                yield text[at : m.start()], None
            yield m[0], self.special[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:], None

    # -- merging ------------------------------------------------------------------------------

    def merge(self, data: bytes) -> list[bytes]:
        """The tokens of one pre-token, by applying the lowest-ranked leftmost merge again and again."""
        if len(data) > 40:
            return self._merge_long(data)
        rank, parts = self.rank, [data[i : i + 1] for i in range(len(data))]
        ranks = [rank.get(pair, 1 << 30) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == 1 << 30:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank.get((parts[k - 1], parts[k]), 1 << 30)
            if k < len(ranks):
                ranks[k] = rank.get((parts[k], parts[k + 1]), 1 << 30)
        return parts

    def _merge_long(self, data: bytes) -> list[bytes]:
        """The same by a heap over a linked list, in n log n steps."""
        rank, n = self.rank, len(data)
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or len(parts[i]) + len(parts[j]) != size or rank.get((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
        return [p for p in parts if p is not None]


@lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


class TwoAgeCache(dict):
    """A dict that makes missing values; when full, values not used for a while go."""

    def __init__(self, make, limit: int = 300_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


# -- prefix dynamic programming (operator 5) --------------------------------------------------

KEPT_PIECE = 256
last_entry = itemgetter(-1)


class PrefixCounter:
    """Exact token counts of all prefixes.

    For a pre-token the recurrence runs over its bytes. ``last[i]``, the last token of the encoding
    of the first i bytes, is the one token t ending at i for which the pair (last[i - len(t)], t) is
    left alone by the merges; then ``count[i] = count[i - len(t)] + 1``. A sequence of tokens is an
    encoding exactly if each adjacent pair is, so one table answers every prefix. Tables of usual
    pre-tokens are kept, so that a text's total and its prefixes are read from the same tables.
    """

    def __init__(self, table: MergeTable, cache: int = 600_000):
        self.table = table
        self.pairs: dict[int, bool] = {}
        # a token that its own bytes are not encoded as occurs in no encoding
        self.ids = {b: i for b, i in table.ids.items() if len(b) == 1 or table.merge(b) == [b]}
        self.longest_by_end = [1] * 256
        for b in self.ids:
            self.longest_by_end[b[-1]] = max(self.longest_by_end[b[-1]], len(b))
        self.kept = TwoAgeCache(lambda piece: self.byte_counts(piece.encode("utf-8", "replace")), cache)

    def _pair_holds(self, a: int, b: int) -> bool:
        x, y = self.table.bytes_of[a], self.table.bytes_of[b]
        held = x + y not in self.ids and self.table.merge(x + y) == [x, y]
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[a << 32 | b] = held
        return held

    def byte_counts(self, data: bytes) -> bytes | array:
        """count[i]: tokens of the first i bytes of one pre-token, for i from 0 to its length."""
        ids, longest, known = self.ids.get, self.longest_by_end, self.pairs.get
        count, last, begin = [0], [-1], 0
        if len(data) > 255:
            count, last = array("i", count), array("i", last)
        for i in range(1, len(data) + 1):
            # most often the last token grows by one byte
            for j in chain((begin,), range(i - 1, max(0, i - longest[data[i - 1]]) - 1, -1)):
                t = ids(data[j:i])
                if t is not None:
                    if j:
                        held = known(last[j] << 32 | t)
                        if held is None:
                            held = self._pair_holds(last[j], t)
                        if not held:
                            continue
                    count.append(count[j] + 1)
                    last.append(t)
                    begin = j
                    break
        return bytes(count) if isinstance(count, list) else count

    def piece(self, piece: str) -> bytes | array:
        """The table of one pre-token; those of usual length are kept."""
        return self.kept[piece] if len(piece) <= KEPT_PIECE else self.byte_counts(piece.encode("utf-8", "replace"))

    def total(self, text: str) -> int:
        """Tokens of a whole text: the last entries of its pre-tokens' tables."""
        n = 0
        for s, t in self.table.segments(text):
            if t is not None:
                n += 1
                continue
            for found in self.table.pieces_by_part(s):
                if max(map(len, found)) <= KEPT_PIECE:
                    n += sum(map(last_entry, map(self.kept.__getitem__, found)))
                else:
                    n += sum(self.piece(x)[-1] for x in found)
        return n

    def index(self, text: str) -> PrefixIndex:
        return PrefixIndex(self, text)


class PrefixIndex:
    """The prefix tables of one text: tokens before each pre-token, and each pre-token's own table."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.starts, self.tables, at = [], [], 0
        for s, t in counter.table.segments(text):
            if t is not None:
                self.starts.append(at)
                self.tables.append(None)  # a special string: one token as a whole
                at += len(s)
                continue
            for found in counter.table.pieces_by_part(s):
                for piece in found:
                    self.starts.append(at)
                    self.tables.append(counter.piece(piece))
                    at += len(piece)
        self.sums = [0, *accumulate(1 if t is None else t[-1] for t in self.tables)]
        self.ends = [*self.starts[1:], len(text)]

    def _piece_counts(self, k: int) -> np.ndarray:
        """Tokens of the text cut within pre-token k, after each of its characters but the first three.

        From the fourth on a cut leaves one pre-token, of which the table tells; before, a cut may join a
        space to the spaces before it or bare an apostrophe.
        """
        piece, table = self.text[self.starts[k] : self.ends[k]], self.tables[k]
        counts = np.frombuffer(table, np.uint8 if isinstance(table, bytes) else np.intc)
        if not piece.isascii():
            raw = np.frombuffer(piece.encode("utf-8", "replace"), np.uint8)
            counts = counts[np.r_[np.flatnonzero(raw & 0xC0 != 0x80), len(raw)]]
        return self.sums[k] + counts[4:].astype(np.int64)

    def count(self, n_chars: int) -> int:
        """Tokens of the first ``n_chars`` characters, as if they were encoded alone."""
        n_chars = max(0, min(n_chars, len(self.text)))
        if n_chars == len(self.text):
            return self.sums[-1]
        k = bisect_right(self.starts, n_chars) - 1
        at = self.starts[k] if self.starts else 0
        if n_chars - at > 3 and self.tables[k] is not None:
            return self.sums[k] + self.tables[k][len(self.text[at:n_chars].encode("utf-8", "replace"))]
        # the pre-tokens just before the cut are split anew
        k = max(0, k - 2)
        return self.sums[k] + self.counter.total(self.text[self.starts[k] if self.starts else 0 : n_chars])

    def counts(self) -> list[int]:
        return [self.count(i) for i in range(len(self.text) + 1)]

    def longest_prefix(self, budget: int) -> int:
        """The most characters whose encoding has at most ``budget`` tokens.

        Where cuts split anew, a prefix has at most three tokens less than the borders before it. So the
        search goes down from the first pre-token that is out of reach.
        """
        if self.sums[-1] <= budget:
            return len(self.text)
        k = bisect_right(self.sums, budget + 3)
        for k in range(min(k, len(self.ends) - 1), -1, -1):
            at, end = self.starts[k], self.ends[k]
            if self.count(end) <= budget:
                return end
            near = end - 1
            if self.tables[k] is not None and end - at > 4:
                fits = np.flatnonzero(self._piece_counts(k)[:-1] <= budget)
                if len(fits):
                    return at + 4 + int(fits[-1])
                near = at + 3
            for n in range(near, at, -1):
                if self.count(n) <= budget:
                    return n
        return 0


# -- streaming transducer (operator 10) -------------------------------------------------------


def sufficient_lookahead(table: MergeTable) -> int:
    """Bytes after a token's end that can still change it.

    Whether (u, v) merges depends on what follows only if a merge of higher priority takes the right
    end of v first, and that one only on merges of still higher priority. So, in order of priority,
    reach(x, w) = len(w) + the largest reach of an earlier rule whose left side stands at the right
    end of w; the largest reach of any rule bounds them all.
    """
    right = {a + b: b for a, b in table.rank}
    best: dict[bytes, int] = {}

    def at_end_of(token: bytes) -> int:
        most = 0
        while token:
            most = max(most, best.get(token, 0))
            token = right.get(token, b"")
        return most

    for (a, b), _ in sorted(table.rank.items(), key=lambda x: x[1]):
        best[a] = max(best.get(a, 0), len(b) + at_end_of(b))
    return max(best.values(), default=0)


class Encoder:
    """Tokens of a stream of text parts, in memory that does not grow with the text.

    Text is split as far as what follows cannot move a border. A pre-token of usual length is encoded
    at once (and kept in a cache); a long one is not gathered but goes through a byte window: it is merged,
    tokens that end at least ``lookahead`` bytes before the window's end are stable and go out, the rest stays.
    """

    def __init__(self, table: MergeTable, lookahead: int | None = None, window: int = 4096, cache: int = 400_000):
        self.table = table
        self.lookahead = sufficient_lookahead(table) if lookahead is None else lookahead
        self.window = max(window, 4 * (self.lookahead + table.longest))
        self.cache = TwoAgeCache(self._encode_short, cache)

    def _encode_short(self, piece: str) -> tuple[str, tuple[int, ...]]:
        ids = tuple(map(self.table.ids.__getitem__, self.table.merge(piece.encode("utf-8", "replace"))))
        return ",".join(map(str, ids)), ids

    def _encode_long(self, text: str, start: int, end: int) -> Iterator[list[int]]:
        """A long pre-token, text[start:end], through a window of bytes."""
        ids, pending, step, sent = self.table.ids, b"", self.window, TwoAgeCache(self._stable_tokens, 16)
        for at in range(start, end, step):
            pending += text[at : min(end, at + step)].encode("utf-8", "replace")
            if at + step >= end:
                break
            out, done = sent[pending]
            yield out
            pending = pending[done:]
        yield [ids[token] for token in self.table.merge(pending)]

    def _stable_tokens(self, pending: bytes) -> tuple[list[int], int]:
        """Tokens at the window's start that nothing behind it can change, and their bytes."""
        ids, done, sure, out = self.table.ids, 0, len(pending) - self.lookahead - self.table.longest, []
        for token in self.table.merge(pending):
            if done + len(token) > sure:
                break
            out.append(ids[token])
            done += len(token)
        return out, done

    def parts(self, text: str) -> Iterator[tuple[list[str], list[tuple[int, ...]]]]:
        """Runs of tokens as they become stable: decimal ids joined by commas, and ids, in short groups."""
        for s, t in self.table.segments(text):
            if t is not None:
                yield [str(t)], [(t,)]
                continue
            for found in self.table.stable_pieces(s):
                if isinstance(found, tuple):
                    for run in self._encode_long(s, *found):
                        yield [",".join(map(str, run))], [tuple(run)]
                elif max(map(len, found), default=0) <= self.window:
                    values = list(map(self.cache.__getitem__, found))
                    yield [v[0] for v in values], [v[1] for v in values]
                else:
                    for piece in found:
                        if len(piece) <= self.window:
                            name, ids = self.cache[piece]
                            yield [name], [ids]
                        else:
                            for run in self._encode_long(piece, 0, len(piece)):
                                yield [",".join(map(str, run))], [tuple(run)]

    def encode(self, text: str) -> list[int]:
        return [i for _, groups in self.parts(text) for ids in groups for i in ids]


class Utf8Machine:
    """Bytes in, text out: a state machine over the lead and continuation bytes of UTF-8.

    State: how many continuation bytes are due, the range allowed for the next one, and the bytes
    held. A byte that cannot continue turns the held bytes into one U+FFFD and is read again as a
    first byte, so each maximal broken sequence gives one U+FFFD, as the usual lossy decoding does.
    """

    def __init__(self):
        self.held, self.due, self.low, self.high = bytearray(), 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.due and data.isascii():
            return data.decode("ascii")
        out: list[str] = []
        run = 0  # start of a stretch of whole characters, decoded at once
        try:
            if not self.due:
                return data.decode("utf-8")
        except UnicodeDecodeError as e:
            out.append(data[: e.start].decode("utf-8"))
            run = e.start
        for b in data[run:]:
            self._step(b, out)
        return "".join(out)

    def _step(self, b: int, out: list[str]) -> None:
        if self.due:
            if self.low <= b <= self.high:
                self.held.append(b)
                self.due, self.low, self.high = self.due - 1, 0x80, 0xBF
                if not self.due:
                    out.append(self.held.decode("utf-8"))
                    self.held.clear()
                return
            out.append("�")
            self.held.clear()
            self.due = 0
        if b < 0x80:
            out.append(chr(b))
        elif 0xC2 <= b <= 0xF4:
            self.held.append(b)
            self.due = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
            self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
            self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
        else:
            out.append("�")

    def finish(self) -> str:
        broken, self.due = bool(self.due), 0
        self.held.clear()
        return "�" * broken


def decode(table: MergeTable, ids: Iterable[int], part: int = 4096) -> Iterator[str]:
    """Text of a stream of ids, part by part."""
    machine, waiting, of = Utf8Machine(), [], table.bytes_of
    for i in ids:
        waiting.append(of[i])
        if len(waiting) >= part:
            yield machine.feed(b"".join(waiting))
            waiting.clear()
    yield machine.feed(b"".join(waiting)) + machine.finish()
