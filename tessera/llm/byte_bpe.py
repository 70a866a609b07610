"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a byte string has exactly one encoding, so it has exactly one last token: of the tokens that end the prefix, the
one that may follow the last token of what is left of it. Two tokens may be neighbours if the encoding of their joint bytes is
these two. Storing the last token of each prefix therefore gives the whole encoding by walking back from the end, more bytes are
encoded by going on from where the table ends, and after an edit the table is right again as soon as the longest token's length
of new entries agrees with the old ones.

A pattern first cuts a text into matches, which are encoded separately; a match that is a token is that token. A changed text
takes over the ids before and behind the two nearest borders of matches around what differs.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, StructField, StructType

from tessera.llm.common import in_small_batches
from tessera.llm.words import BYTE_VALUE, GOLDEN, MASK, U, chunks, mix, powers, span_hashes

#: Encodings of matches that a process remembers; a full memory starts anew. Longer matches, in bytes, are encoded one by one.
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64
#: Bytes of text whose matches are encoded together.
CHUNK = 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file: base64 and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Ranks of tokens as training leaves them: every single byte is a token, and the bytes of any other are encoded, by the merges
    of lower rank alone, as two tokens. Only such ranks have merges in rank order everywhere, on which the borders below rest."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._neighbours: dict[tuple[int, int], bool] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens of whose merge the token comes; None for a byte."""
        if token not in self._halves:
            data = self.tokens[token]
            pairs = ((self.ranks.get(data[:cut], token), self.ranks.get(data[cut:], token)) for cut in range(1, len(data)))
            found = next((p for p in pairs if max(p) < token and self._joined(*p, token)), None)
            if found is None and len(data) > 1:
                raise ValueError(f"no two tokens of lower rank merge to {data!r}")
            self._halves[token] = found
        return self._halves[token]

    def checked(self) -> Vocabulary:
        """Itself, if every token is a byte or a merge of two."""
        for token in sorted(self.tokens):
            self.halves(token)
        return self

    def _joined(self, a: int, b: int, limit: int) -> bool:
        """Whether merges of rank below ``limit`` leave the bytes of ``a`` and ``b`` as just these two.

        Taking the later of the two apart, again and again, shows every pair of tokens that ever met at the border. Had a pair
        a merge of its own that came before the one that grew its first side or the side taken apart last, the border would
        have gone. At equal rank the leftmost merge comes first, which is the left token's own.
        """
        while True:
            across = self.ranks.get(self.tokens[a] + self.tokens[b])
            if across is not None and across < limit:
                return False
            left, right = self.halves(a), self.halves(b)
            if left is None and right is None:
                return True
            # The left token stands only because it was merged before the border could be: at its own rank it comes first.
            if right is None or (left is not None and a > b):
                a, limit = left[1], a
            else:
                b, limit = right[0], b + 1

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the encoding of the joint bytes of two tokens is these two."""
        known = self._neighbours.get((a, b))
        if known is None:
            if len(self._neighbours) >= REMEMBERED:
                self._neighbours.clear()
            known = self._neighbours[a, b] = self._joined(a, b, 1 << 62)
        return known


class Prefixes:
    """The last token of every prefix of some bytes, which may grow at the end and change anywhere."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _token(self, data: bytes, last: list[int], end: int) -> int:
        """The last token of ``data[:end]``, from those of all shorter prefixes."""
        ranks, neighbours = self.vocabulary.ranks, self.vocabulary.neighbours
        for size in range(min(end, self.vocabulary.longest), 0, -1):
            token = ranks.get(data[end - size : end])
            if token is not None and (size == end or neighbours(last[end - size - 1], token)):
                return token
        raise AssertionError("every prefix has an encoding")

    def append(self, more: bytes) -> None:
        before = len(self.data)
        self.data += more
        for end in range(before + 1, len(self.data) + 1):
            self.last.append(self._token(self.data, self.last, end))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """``data[start:stop]`` becomes ``new``; returns how many prefixes were worked out anew."""
        data = self.data[:start] + new + self.data[stop:]
        old, last, same = self.last, self.last[:start], 0
        shift = len(new) - (stop - start)
        for end in range(start + 1, len(data) + 1):
            last.append(self._token(data, last, end))
            behind = end - (start + len(new))
            same = same + 1 if behind > 0 and old[end - shift - 1] == last[-1] else 0
            if same >= self.vocabulary.longest:
                last += old[end - shift :]
                self.data, self.last = data, last
                return end - start
        self.data, self.last = data, last
        return len(data) - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class PrefixTables:
    """The same for many short byte strings at once: one row each, one column for each prefix, filled column by column.

    Substrings are looked up by a 64-bit hash. A chosen sequence is compared with the bytes at the end; where all tokens spell
    the bytes and all neighbours are allowed, it is the encoding, so a false match of hashes is found out.
    """

    SLOTS = 1 << 19

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        size, tokens = max(vocabulary.tokens) + 1, vocabulary.tokens
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.lengths, self.letters = np.zeros(size, np.int64), np.zeros((size, vocabulary.longest), np.uint8)
        pairs: dict[int, int] = {}
        for token, data in tokens.items():
            self.lengths[token], self.letters[token, : len(data)] = len(data), np.frombuffer(data, np.uint8)
            if halves := vocabulary.halves(token):
                self.left[token], self.right[token] = halves
            for cut in range(1, len(data)):
                a, b = vocabulary.ranks.get(data[:cut]), vocabulary.ranks.get(data[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = token
        ends = np.cumsum([len(x) for x in tokens.values()])
        hashes = span_hashes(np.frombuffer(b"".join(tokens.values()), np.uint8), np.append(0, ends[:-1]), ends)
        self.by_hash = self._table(hashes, np.fromiter(tokens, np.int64))
        self.by_pair = self._table(np.fromiter(pairs, np.uint64), np.fromiter(pairs.values(), np.int64))

    def _table(self, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, ...]:
        """(keys and values by slot, then keys and values, in order, whose slot another key has)."""
        slot = self._slot(keys)
        held, where = np.zeros(self.SLOTS, U), np.full(self.SLOTS, -1, np.int64)
        held[slot], where[slot] = keys, values
        rest = np.flatnonzero(held[slot] != keys)
        rest = rest[np.argsort(keys[rest])]
        return held, where, keys[rest], values[rest]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U(GOLDEN) >> U(64 - self.SLOTS.bit_length() + 1)).astype(np.int64)

    def _look_up(self, table: tuple[np.ndarray, ...], keys: np.ndarray) -> np.ndarray:
        """Values of the keys; -1 for keys that the table lacks."""
        held, where, other, values = table
        slot = self._slot(keys)
        found = where[slot]
        odd = np.flatnonzero((held[slot] != keys) & (found >= 0))
        if len(odd):
            found[odd] = -1
            at = np.minimum(np.searchsorted(other, keys[odd]), max(len(other) - 1, 0))
            if len(other):
                same = other[at] == keys[odd]
                found[odd[same]] = values[at[same]]
        return found

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``Vocabulary.neighbours`` of many pairs."""
        good, at, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), 1 << 62)
        while len(at):
            across = self._look_up(self.by_pair, a.astype(U) << U(32) | b.astype(U))
            bad = (across >= 0) & (across < limit)
            good[at[bad]] = False
            left, right = self.right[a], self.left[b]
            go = ~bad & ((left >= 0) | (right >= 0))
            at, a, b, left, right = at[go], a[go], b[go], left[go], right[go]
            apart = (right < 0) | ((left >= 0) & (a > b))
            limit = np.where(apart, a, b + 1)
            a, b = np.where(apart, left, a), np.where(apart, b, right)
        return good

    def encode(self, strings: list[bytes]) -> list[bytes]:
        """Little-endian ids of each string; none is empty."""
        order = sorted(range(len(strings)), key=lambda i: -len(strings[i]))
        sizes = np.array([len(strings[i]) for i in order])
        data = np.zeros((len(order), sizes[0]), np.uint8)
        data[np.arange(sizes[0]) < sizes[:, None]] = np.frombuffer(b"".join(strings[i] for i in order), np.uint8)
        up, down = powers(sizes[0] + 1)
        sums = np.zeros((sizes[0] + 1, len(order)), U)
        np.cumsum((BYTE_VALUE[data] * up[: sizes[0]]).T, axis=0, out=sums[1:])
        last = np.full((sizes[0] + 1, len(order)), -1, np.int64)
        for end in range(1, sizes[0] + 1):
            # Rows are in order of length, longest first.
            open_ = np.arange(np.searchsorted(-sizes, -end, "right"))
            for size in range(min(end, self.vocabulary.longest), 0, -1):
                hashes = mix((sums[end, open_] - sums[end - size, open_]) * down[end - size] + U(size * GOLDEN & MASK))
                token = self._look_up(self.by_hash, hashes)
                hit = np.flatnonzero(token >= 0)
                if size < end:
                    hit = hit[self.neighbours(last[end - size, open_[hit]], token[hit])]
                last[end, open_[hit]] = token[hit]
                open_ = np.delete(open_, hit)
                if not len(open_):
                    break
        return self._walked(strings, order, sizes, data, last)

    def _walked(self, strings: list[bytes], order: list[int], sizes: np.ndarray, data: np.ndarray, last: np.ndarray) -> list[bytes]:
        rows, end, steps, wrong = np.arange(len(order)), sizes.copy(), [], np.zeros(len(order), bool)
        while len(rows):
            token = last[end, rows]
            wrong[rows[token < 0]] = True
            rows, end, token = rows[token >= 0], end[token >= 0], token[token >= 0]
            end = end - self.lengths[token]
            for k in range(int(self.lengths[token].max(initial=0))):
                longer = np.flatnonzero(self.lengths[token] > k)
                wrong[rows[longer[data[rows[longer], end[longer] + k] != self.letters[token[longer], k]]]] = True
            steps.append((rows, token))
            rows, end = rows[end > 0], end[end > 0]
        counts = np.zeros(len(order), np.int64)
        for rows, _ in steps:
            counts[rows] += 1
        stops = np.cumsum(counts)
        ids = np.zeros(int(counts.sum()), "<u4")
        for k, (rows, token) in enumerate(steps):
            ids[stops[rows] - 1 - k] = token
        whole, out = ids.tobytes(), [b""] * len(order)
        for row, i in enumerate(order):
            out[i] = whole[4 * (stops[row] - counts[row]) : 4 * stops[row]]
        for row in np.flatnonzero(wrong):
            i = order[row]
            out[i] = np.array(Prefixes(self.vocabulary, strings[i]).tokens(), "<u4").tobytes()
        return out


class Coder:
    """Encodes texts and decodes ids; ids are little-endian 32-bit numbers, side by side in bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.tables = vocabulary, PrefixTables(vocabulary)
        self.memory: dict[str, bytes] = {}
        self.starts = np.cumsum(np.append(0, self.tables.lengths))
        self.letters = np.frombuffer(b"".join(vocabulary.tokens.get(i, b"") for i in range(len(self.tables.lengths))), np.uint8)

    def _learn(self, matches: set[str]) -> dict[str, bytes]:
        """Ids of all of these matches: those that are remembered, and the others encoded."""
        if len(self.memory) > REMEMBERED:
            self.memory = {}
        short, long = [], {}
        for match in matches.difference(self.memory):
            data = match.encode()
            whole = self.vocabulary.ranks.get(data)
            if whole is not None:
                self.memory[match] = whole.to_bytes(4, "little")
            elif len(data) <= LONGEST_REMEMBERED:
                short.append((match, data))
            else:
                long[match] = np.array(Prefixes(self.vocabulary, data).tokens(), "<u4").tobytes()
        if short:
            self.memory.update(zip([m for m, _ in short], self.tables.encode([d for _, d in short]), strict=True))
        return self.memory | long if long else self.memory

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = [self.vocabulary.pattern.findall(text) for text in texts]
        known = self._learn(set().union(*split))
        return [b"".join(map(known.__getitem__, matches)) for matches in split]

    def encode(self, text: str, start: int = 0, stop: int | None = None) -> bytes:
        return self.encode_all([text[start:stop]])[0]

    def decode(self, ids: bytes) -> bytes:
        tokens = np.frombuffer(ids, "<u4")
        sizes = self.tables.lengths[tokens]
        ends = np.cumsum(sizes)
        return self.letters[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[tokens] - (ends - sizes), sizes)].tobytes()

    def reencode(self, old: str, ids: bytes, new: str) -> bytes:
        """The ids of ``new``, from the ids of ``old``: only what lies between two borders around the difference is encoded.

        Where a letter stands before a space, every pattern of this kind ends a match, whatever comes before or after.
        """
        most, shift = min(len(old), len(new)), len(new) - len(old)
        left = _common(old, new, most)
        right = _common(old[::-1], new[::-1], most - left)
        start = old.rfind(" ", 0, left)
        while start > 0 and not old[start - 1].isalpha():
            start = old.rfind(" ", 0, start)
        stop = old.find(" ", len(old) - right + 1)
        while stop > 0 and not old[stop - 1].isalpha():
            stop = old.find(" ", stop + 1)
        start, stop = max(start, 0), len(old) if stop < 0 else stop
        ends = np.cumsum(self.tables.lengths[np.frombuffer(ids, "<u4")])
        used = 4 * int(np.searchsorted(ends, len(old[:start].encode()), "right"))
        rest = 4 * int(np.searchsorted(ends, len(old[:stop].encode()), "right"))
        return ids[:used] + self.encode(new, start, stop + shift) + ids[rest:]


def _common(a: str, b: str, most: int) -> int:
    """Length of the common beginning, at most ``most``: halved, then compared."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


#: Coders of this process, by vocabulary and pattern: what they remember serves later tasks, too.
_coders: dict[str, Coder] = {}


class Tokenizer:
    """A vocabulary for DataFrames: read once on the driver, sent to every executor (its size is that of the file)."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = Vocabulary(read_ranks(path), pattern).checked().ranks
        self.name = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
        self.known = spark.sparkContext.broadcast((ranks, pattern))

    def coder(self) -> Coder:
        if self.name not in _coders:
            _coders.clear()
            _coders[self.name] = Coder(Vocabulary(*self.known.value))
        return _coders[self.name]

    def encoded(self, rows: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """``rows`` with the encoding of their whole texts instead of the texts: ids as little-endian 32-bit numbers in a binary
        column, empty for null and empty texts. All other columns stay, under names that may be the same as any here."""
        return _mapped(rows, (text,), ids, lambda texts: self.coder().encode_all(texts))

    def decoded(self, rows: DataFrame, ids: str = "ids", data: str = "data") -> DataFrame:
        """``rows`` with the bytes that ``ids`` stand for instead of the ids; null ids are empty."""
        return _mapped(rows, (ids,), data, lambda ids: map(self.coder().decode, ids))

    def reencoded(self, rows: DataFrame, old: str = "text", ids: str = "ids", new: str = "new_text") -> DataFrame:
        """``rows`` with the ids of their text ``new``, made from the text ``old`` and its ``ids`` near what differs; in place of
        these three columns. Null texts and ids are empty."""
        return _mapped(rows, (old, ids, new), ids, lambda *columns: map(self.coder().reencode, *columns))


def _mapped(rows: DataFrame, columns: tuple[str, ...], result: str, function: Callable[..., Iterable[bytes]]) -> DataFrame:
    """``rows`` with binary column ``result``, last, instead of ``columns``."""
    kept = [f for f in rows.schema.fields if f.name not in columns]
    schema = StructType([*kept, StructField(result, BinaryType())])
    # Other columns may have any names, so all go by place.
    places = [rows.columns.index(c) for c in columns]
    others = [i for i in range(len(rows.columns)) if i not in places]
    empty = [b"" if isinstance(rows.schema[c].dataType, BinaryType) else "" for c in columns]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, places[-1], CHUNK):
                values = [[e if x is None else x for x in part.column(i).to_pylist()] for i, e in zip(places, empty, strict=True)]
                made = pa.array(function(*values), pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in others], made], names=[f.name for f in schema.fields])

    return in_small_batches(rows).mapInArrow(task, schema)
