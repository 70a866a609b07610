"""Language-model scores of whole documents by a weighted backoff automaton.

The model is an n-gram model with absolute discounting. Every training token is an arc of the root state; words and repeated
n-grams are states too, each with arcs for the repeated n-grams that extend it, a failure arc to its longest proper suffix, and
a backoff weight on that arc. Reading a text left to right, the automaton carries one state (the longest suffix that is a
state), follows failure arcs until the next token has an arc, and adds up log-probabilities.

Counts cover the whole training part of the corpus: every word is a state and every n-gram of ``least_count`` occurrences is an
arc, however large the corpus (``state_share`` and ``gram_share`` can raise these floors; by default they do not). The model
grows with the corpus and is never collected or broadcast. Texts are packed into chunks, and two rounds of questions give each
chunk the part of the automaton that its own texts can walk through:

1. Each chunk asks for the counts of its distinct words and n-grams; each n-gram is entrusted to one of the chunks that asked.
2. For each state, chunks hand in the probability that the arcs entrusted to them take, and what the shorter state gives to the
   same tokens; the sums are the state's backoff weight, which goes to each chunk that has the state.

Keys are dealt by ranges of their hash and a chunk asks for a key once, so no frequent word or n-gram gathers in one task. Each
chunk sends a row to at most ``FAN`` ranges. Where the corpus needs more ranges, questions pass through levels: ``FAN`` chunks at
a time are merged for each range, what is merged is split into narrower ranges, and so on, until all chunks meet in ranges of
about a chunk's size; replies go back the same way. So the rows grow with the number of chunks, not with its square.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, crc_mod, in_small_batches, shuffles_removed
from tessera.llm.words import PLACE, Texts, U, chunks, mix

#: Bytes of text in a chunk; a longer single text is a chunk by itself.
PACK_BYTES = 8 << 20
#: Ranges that a chunk deals its keys to, and chunks that are merged at a time.
FAN = 256
#: Hash of the end token; no word's hash is mixed this way.
END = U(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Backoff:
    order: int = 3
    discount: float = 0.75
    state_share: float = 0.0
    gram_share: float = 0.0
    least_count: int = 2


@dataclass(frozen=True)
class Route:
    """The levels that questions pass through: at each, ranges of keys are split further and more chunks are merged."""

    chunks: int
    fan: int

    @property
    def fans(self) -> list[int]:
        """Into how many ranges each level splits a range; in the end there is one range for two chunks."""
        ranges, out = max(1, self.chunks // 2), []
        while ranges > self.fan:
            out.append(self.fan)
            ranges = -(-ranges // self.fan)
        return [*out, ranges]

    def ranges(self, level: int) -> int:
        return int(np.prod(self.fans[:level], dtype=object))

    def team(self, seat: int, level: int) -> int:
        """Who is merged at a level; at the last all are."""
        return 0 if level == len(self.fans) else seat // self.fan**level

    def seat(self, chunk: int) -> int:
        return int(mix(np.array([chunk], U))[0] % U(max(1, self.chunks)))


@dataclass(frozen=True)
class Root:
    """What every chunk must know of the whole corpus: numbers of training tokens and of distinct ones."""

    options: Backoff
    route: Route
    tokens: int
    types: int = 0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """Probability of tokens in the root state, by their counts."""
        if not self.tokens:
            return np.ones(len(counts))
        return np.where(counts > 0, counts - self.options.discount, self.options.discount * self.types) / self.tokens


def sequence(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text followed by the end token, and where each text begins."""
    first = texts.first + np.arange(len(texts) + 1)
    tokens = np.full(first[-1], END)
    tokens[np.arange(len(texts.hashes)) + texts.owner] = texts.hashes
    return tokens, first


def _pack(batches: Iterator[pa.RecordBatch], pack_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, blob, tokens): about ``pack_bytes`` of text each, with the number of training tokens in it."""
    place, number = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []
    size = tokens = 0

    def row() -> pa.RecordBatch:
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=7))) as out:
            for x in held:
                out.write_batch(x)
        return pa.RecordBatch.from_arrays([pa.array([place << 32 | number], pa.int64()), pa.array([sink.getvalue()], pa.binary()), pa.array([tokens], pa.int64())], names=["chunk", "blob", "tokens"])

    for batch in batches:
        for part in chunks(batch, "text", pack_bytes // 4):
            texts = Texts(part.column("text"))
            train = part.column("train").to_numpy(zero_copy_only=False)
            held.append(part)
            size += len(texts.data)
            tokens += int((texts.counts + 1)[train].sum())
            if size >= pack_bytes:
                yield row()
                held, size, tokens, number = [], 0, 0, number + 1
    if held:
        yield row()


class Tokens:
    """Tokens of a chunk, text after text: their hashes, their places in their texts, and whether they are learned from."""

    def __init__(self, blob):
        self.pieces, tokens, places, train, size = [], [np.empty(0, U)], [np.empty(0, np.int64)], [np.empty(0, bool)], 0
        for part in pa.ipc.open_stream(pa.py_buffer(blob)):
            found, first = sequence(Texts(part.column("text"), lower=True))
            self.pieces.append((part.select(["doc_id", "train"]), first + size))
            tokens.append(found)
            places.append(np.arange(len(found)) - np.repeat(first[:-1], np.diff(first)))
            train.append(np.repeat(part.column("train").to_numpy(zero_copy_only=False), np.diff(first)))
            size += len(found)
        self.tokens, self.place, self.train = np.concatenate(tokens), np.concatenate(places), np.concatenate(train)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(where it ends, key) of every n-gram of k tokens inside one text; keys are even."""
        at = np.flatnonzero(self.place >= k - 1)
        total = np.full(len(at), U(k))
        for j in range(k):
            total += self.tokens[at - j] * PLACE[j]
        return at, mix(total) & ~U(1)

    def counted(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams of k tokens in order, and how often each is learned from."""
        at, keys = self.grams(k)
        both = np.sort(keys | self.train[at])
        keys = both & ~U(1)
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(both & U(1), first).astype(np.int64) if len(first) else np.empty(0, np.int64)


class Chunk(Tokens):
    """Tokens of a chunk and, for each order k, its distinct n-grams.

    ``ends[k]`` are the places where an n-gram of k tokens inside one text ends, ``keys[k]`` the distinct ones in order,
    ``of[k]`` the number of the one that ends at each place (−1 for none).
    """

    def __init__(self, blob, order: int):
        super().__init__(blob)
        self.keys, self.of, self.ends = {}, {}, {}
        for k in range(1, order + 1):
            at, keys = self.grams(k)
            self.keys[k], inverse = np.unique(keys, return_inverse=True)
            self.of[k] = np.full(len(self.tokens), -1, np.int32)
            self.of[k][at] = inverse
            self.ends[k] = at

    def some_end(self, k: int) -> np.ndarray:
        """A place where each distinct n-gram ends."""
        out = np.empty(len(self.keys[k]), np.int64)
        out[self.of[k][self.ends[k]]] = self.ends[k]
        return out


def _squeeze(values: np.ndarray) -> bytes:
    """Compressed values: all lowest bytes first, then all second ones, of which most are zero."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(data, count: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data.as_buffer(), count * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, count).T).view(kind).ravel()


def _dump(keys: np.ndarray) -> bytes:
    """Sorted keys: their number, the first, and the bytes of the differences, all lowest bytes first, then all second ones."""
    steps = np.diff(keys)
    width = (int(steps.max(initial=0)).bit_length() + 7) // 8
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return np.array([len(keys), width], "<i8").tobytes() + keys[:1].tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _load(data) -> np.ndarray:
    raw = data.as_buffer()
    (count, width), first = np.frombuffer(raw[:16], "<i8").tolist(), np.frombuffer(raw[16:24], U)
    steps = np.zeros((count - 1, 8), np.uint8)
    steps[:, :width] = np.frombuffer(pa.decompress(raw[24:], (count - 1) * width, codec="zstd"), np.uint8).reshape(width, count - 1).T
    return np.cumsum(np.concatenate((first, steps.view("<u8").ravel())), dtype=U)


def _edges(keys: np.ndarray, route: Route, level: int = 0, within: int = 0) -> list[int]:
    """Where each of the ranges begins that a level splits the range ``within`` of sorted keys into."""
    count, total = route.fans[level], route.ranges(level + 1)
    return np.searchsorted(keys, np.array([(k << 64) // total for k in range(within * count, (within + 1) * count)], U)).tolist() + [len(keys)]


QUESTIONS = "kind long, part long, team long, chunk long, keys binary, x binary, y binary"
ANSWERS = "chunk long, kind long, part long, reply binary, types long"


def _question(kind: int, chunk: int, keys: np.ndarray, x: np.ndarray, y: np.ndarray | None, route: Route, level: int = 0, within: int = 0, seat: int | None = None) -> pa.RecordBatch:
    """One row for each range in which the chunk, or those merged at a level, have keys."""
    edges = _edges(keys, route, level, within)
    rows = [(within * route.fans[level] + k, slice(a, b)) for k, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
    team = route.team(route.seat(chunk) if seat is None else seat, level + 1)
    column = lambda v: pa.array([None if v is None else _squeeze(v[at]) for _, at in rows], pa.binary())
    same = lambda v: pa.array([v] * len(rows), pa.int64())
    return pa.RecordBatch.from_arrays(
        [same(kind), pa.array([k for k, _ in rows], pa.int64()), same(team), same(chunk), pa.array([_dump(keys[at]) for _, at in rows], pa.binary()), column(x), column(y)],
        names=["kind", "part", "team", "chunk", "keys", "x", "y"],
    )


def _ask(batches: Iterator[pa.RecordBatch], order: int, route: Route) -> Iterator[pa.RecordBatch]:
    """The distinct words and n-grams of each chunk with their counts."""
    for batch in batches:
        for number, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
            tokens = Tokens(blob.as_buffer())
            for k in range(1, order + 1):
                yield _question(k, number, *tokens.counted(k), None, route)


def _gathered(asked: pa.Table) -> tuple[pa.Table, list[int], np.ndarray, np.ndarray, np.ndarray]:
    """(questions by chunk, where each begins, distinct keys' first places, number of each key, edges' count)."""
    asked = asked.sort_by("chunk")
    keys = [_load(x) for x in asked.column("keys")]
    edges = np.cumsum([0, *map(len, keys)]).tolist()
    values, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return asked, edges, first, inverse, values


def _summed(column, edges: list[int], inverse: np.ndarray, size: int, dtype: type) -> np.ndarray:
    """The sum of what is said of each key."""
    out = np.zeros(size, dtype)
    np.add.at(out, inverse, np.concatenate([_unsqueeze(x, b - a, dtype) for x, a, b in zip(column, edges, edges[1:])]))
    return out


def _reply(asked: pa.Table, edges: list[int], kind: int, reply: np.ndarray, types: int) -> pa.Table:
    rows = asked.num_rows
    return pa.table(
        {
            "chunk": asked.column("chunk").combine_chunks(),
            "kind": pa.array([kind] * rows, pa.int64()),
            "part": asked.column("part").combine_chunks(),
            "reply": pa.array([_squeeze(reply[a:b]) for a, b in zip(edges, edges[1:])], pa.binary()),
            "types": pa.array([types, *[0] * (rows - 1)], pa.int64()),
        }
    )


def _totals(asked: pa.Table, floor: float) -> pa.Table:
    """Twice the total of each key that was asked for, and one more for the chunk that the key is entrusted to."""
    asked, edges, first, inverse, values = _gathered(asked)
    kind = asked.column("kind")[0].as_py()
    totals = _summed(asked.column("x"), edges, inverse, len(values), np.int64)
    types = int((totals > 0).sum()) if kind == 1 else 0
    if kind > 1:
        totals[totals < floor] = 0
    reply = 2 * totals[inverse]
    reply[first] += 1
    return _reply(asked, edges, kind, reply, types)


def _weights(asked: pa.Table) -> pa.Table:
    """The backoff weight of each state that was asked for; its kind is −k for a state of k tokens."""
    asked, edges, _, inverse, values = _gathered(asked)
    kept, covered = (_summed(asked.column(c), edges, inverse, len(values), np.float64) for c in "xy")
    back = np.log10(np.maximum(1 - kept, 1e-12) / np.maximum(1 - covered, 1e-12))
    return _reply(asked, edges, asked.column("kind")[0].as_py(), back[inverse].astype(np.float32), 0)


def _merge(asked: pa.Table, route: Route, level: int) -> pa.Table:
    """The questions of a team about one range as one, in narrower ranges."""
    asked, edges, _, inverse, values = _gathered(asked)
    kind, part, team = (asked.column(c)[0].as_py() for c in ("kind", "part", "team"))
    x, y = (_summed(asked.column(c), edges, inverse, len(values), np.int64 if kind > 0 else np.float64) if asked.column(c)[0].is_valid else None for c in "xy")
    seat = team * route.fan**level
    return pa.Table.from_batches([_question(kind, part << 32 | team, values, x, y, route, level, part, seat)])


def _hand_down(asked: pa.Table, replies: pa.Table, route: Route, level: int) -> pa.Table:
    """What the merged question got, for each of those who asked; a key is entrusted to the first of them."""
    asked, edges, first, inverse, values = _gathered(asked)
    kind, part = (asked.column(c)[0].as_py() for c in ("kind", "part"))
    found = dict(zip(replies.column("part").to_pylist(), replies.column("reply")))
    cuts, begin = _edges(values, route, level, part), part * route.fans[level]
    dtype = np.int64 if kind > 0 else np.float32
    merged = np.concatenate([_unsqueeze(found[begin + k], b - a, dtype) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b])
    reply = merged[inverse]
    if kind > 0:
        others = np.ones(len(reply), bool)
        others[first] = False
        reply[others] &= ~1
    return _reply(asked, edges, kind, reply, 0)


def _merger(route: Route, level: int):
    return lambda asked: _merge(asked, route, level)


def _hander(route: Route, level: int):
    return lambda asked, replies: _hand_down(asked, replies, route, level)


def _exchange(asked: DataFrame, route: Route, answer) -> tuple[DataFrame, int]:
    """The replies to the chunks, and the number of types that those who answer have counted."""
    with shuffles_removed(asked.sparkSession):
        levels = [asked]
        for level in range(1, len(route.fans)):
            levels[-1] = checkpointed(levels[-1])
            levels.append(levels[-1].groupBy("kind", "part", "team").applyInArrow(_merger(route, level), QUESTIONS))
        replies = checkpointed(levels.pop().groupBy("kind", "part").applyInArrow(answer, ANSWERS))
        types = replies.agg(F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()["types"]
        for level in range(len(route.fans) - 1, 0, -1):
            node = replies.select("kind", F.shiftright("chunk", 32).alias("of_part"), F.col("chunk").bitwiseAND((1 << 32) - 1).alias("of_team"), "part", "reply")
            replies = checkpointed(levels.pop().groupBy("kind", "part", "team").cogroup(node.groupBy("kind", "of_part", "of_team")).applyInArrow(_hander(route, level), ANSWERS))
    return replies, types


class Walk:
    """A chunk with the counts of its n-grams: which are states, which are arcs, and the arcs' probabilities."""

    def __init__(self, blob, replies: pa.Table, root: Root):
        options = root.options
        self.chunk, self.root = Chunk(blob, options.order), root
        found = {(k, p): x for k, p, x in zip(replies.column("kind").to_pylist(), replies.column("part").to_pylist(), replies.column("reply"))}
        self.found = found
        self.total, self.mine, self.arc, self.state, self.prob, self.end, self.prefix = {}, {}, {}, {}, {}, {}, {}
        for k in range(1, options.order + 1):
            reply = self.answers(k, self.chunk.keys[k], np.int64)
            self.total[k], self.mine[k] = reply >> 1, (reply & 1).astype(bool)
            end = self.end[k] = self.chunk.some_end(k)
            last = self.chunk.tokens[end] == END
            if k == 1:
                self.prob[1] = root.probability(self.total[1])
                frequent = self.total[1] >= max(options.state_share * root.tokens, 1)
                self.arc[1], self.state[1] = frequent | last, frequent & ~last
            else:
                prefix, suffix = self.chunk.of[k - 1][end - 1], self.chunk.of[k - 1][end]
                self.prefix[k] = prefix
                self.arc[k] = (self.total[k] > 0) & self.state[k - 1][prefix] & self.arc[k - 1][suffix]
                self.state[k] = self.arc[k] & ~last
                self.prob[k] = np.where(self.arc[k], (self.total[k] - options.discount) / np.maximum(self.total[k - 1][prefix], 1), 0)

    def answers(self, kind: int, keys: np.ndarray, dtype: type) -> np.ndarray:
        edges = _edges(keys, self.root.route)
        parts = [_unsqueeze(self.found[kind, p], b - a, dtype) for p, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
        return np.concatenate(parts) if parts else np.empty(0, dtype)

    def steps(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, state, longer n-gram) of each token that is read in a state of k tokens."""
        at = self.chunk.ends[k + 1]
        state, gram = self.chunk.of[k][at - 1], self.chunk.of[k + 1][at]
        on = self.state[k][state]
        return at[on], state[on], gram[on]

    def given(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each n-gram of k tokens, what the arcs entrusted to this chunk take of it, and what the shorter state gives to their tokens."""
        arcs = np.flatnonzero(self.arc[k + 1] & self.mine[k + 1])
        into, lower = self.prefix[k + 1][arcs], self.chunk.of[k][self.end[k + 1][arcs]]
        size = len(self.chunk.keys[k])
        return np.bincount(into, self.prob[k + 1][arcs], size), np.bincount(into, self.prob[k][lower], size)

    def asked(self, k: int, kept: np.ndarray) -> np.ndarray:
        """The states whose backoff weight this chunk asks for: those that it has arcs of, and those that a text of it leaves by failure."""
        _, state, gram = self.steps(k)
        fails = np.zeros(len(kept), bool)
        fails[state[~self.arc[k + 1][gram]]] = True
        return self.state[k] & (fails | (kept > 0))

    def shares(self, number: int) -> Iterator[pa.RecordBatch]:
        """What this chunk has to say of the states that it asks for."""
        for k in range(1, self.root.options.order):
            kept, covered = self.given(k)
            on = self.asked(k, kept)
            yield _question(-k, number, self.chunk.keys[k][on], kept[on], covered[on], self.root.route)

    def log_probabilities(self) -> np.ndarray:
        """log10 probability of each token, read left to right."""
        total = np.log10(self.prob[1])[self.chunk.of[1]]
        for k in range(1, self.root.options.order):
            back = np.zeros(len(self.chunk.keys[k]))
            on = self.asked(k, self.given(k)[0])
            back[on] = self.answers(-k, self.chunk.keys[k][on], np.float32)
            at, state, gram = self.steps(k)
            hit = self.arc[k + 1][gram]
            total[at] = np.where(hit, np.log10(np.where(hit, self.prob[k + 1][gram], 1)), back[state] + total[at])
        return total


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(blob, replies: pa.Table, root: Root) -> Iterator[pa.RecordBatch]:
    walk = Walk(blob, replies, root)
    counts = walk.total[1][walk.chunk.of[1]]
    base, logs = np.log10((counts + 1) / (root.tokens + root.types + 1)), walk.log_probabilities()
    for part, first in walk.chunk.pieces:
        whole = slice(first[0], first[-1])
        begin = first[:-1] - first[0]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array(~part.column("train").to_numpy(zero_copy_only=False)),
                pa.array(np.diff(first), pa.int64()),
                pa.array(np.add.reduceat((counts[whole] > 0).astype(np.int64), begin)),
                pa.array(np.full(len(begin), root.tokens), pa.int64()),
                pa.array(np.add.reduceat(base[whole], begin)),
                pa.array(np.add.reduceat(logs[whole], begin)),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


def scores(documents: DataFrame, options: Backoff = Backoff(), modulus: int = 7, remainder: int = 2) -> DataFrame:
    """One row (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``documents``.

    Documents whose crc32(doc_id) mod ``modulus`` is ``remainder`` are held out; the model learns from all others (a null id
    is learned from). A-Z count as lower case. A null text is empty and scores its end token alone. Without training
    documents the model knows no token and gives the unknown token probability 1. Other columns are ignored; repeated rows
    are scored, and learned from, as often as they occur; an empty table gives no rows.
    """
    train_row = F.coalesce(crc_mod("doc_id", modulus) != remainder, F.lit(True)).alias("train")
    docs = in_small_batches(documents).select("doc_id", "text", train_row)
    packed = checkpointed(docs.mapInArrow(lambda b, n=PACK_BYTES: _pack(b, n), "chunk long, blob binary, tokens long"))
    about = packed.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    root = Root(options, Route(about["n"], FAN), about["tokens"])
    floor = max(options.least_count, options.gram_share * root.tokens)
    texts = packed.select("chunk", "blob")
    asked = texts.mapInArrow(lambda b: _ask(b, options.order, root.route), QUESTIONS)
    totals, types = _exchange(asked, root.route, lambda x: _totals(x, floor))
    known = Root(options, root.route, root.tokens, types)

    def share(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        found = [x for number, blob in zip(chunk.column("chunk").to_pylist(), chunk.column("blob")) for x in Walk(blob.as_buffer(), replies, known).shares(number)]
        return pa.Table.from_batches(found)

    def score(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        return pa.Table.from_batches([x for blob in chunk.column("blob") for x in _score(blob.as_buffer(), replies, known)])

    if options.order > 1:
        shares = texts.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(share, QUESTIONS)
        weights, _ = _exchange(shares, root.route, _weights)
        totals = totals.union(weights)
    return texts.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(score, SCORES)
