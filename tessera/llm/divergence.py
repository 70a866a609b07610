"""Audit of how the sources of a language differ in their terms, by counting behind a sketch.

A first pass adds up a count-min sketch of document frequencies: the cells of (language, term) hold, at the least, the number of
documents of the language that have the term, and never less. A task's sketch leaves it as blocks of cells; blocks of one place
are added up where they meet, and only a bit for each cell goes on: whether it reaches the least frequency. A second pass reads
the texts again and lets through only the terms all of whose cells do. What the sketch discards is therefore truly too rare, and
is neither shuffled nor kept; what it lets through is counted exactly and cut by its exact frequency.

The survivors' counts are sparse. A term that a source lacks has there the same share as any other such term, so pairs of sources
are only joined on terms that both have; all others enter through histograms of counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, in_small_batches
from tessera.llm.words import GOLDEN, LOWER, U, chunks, mix, span_hashes

#: Bytes of a term: ASCII letters and all that is not ASCII.
IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Cells of a block of the sketch, which is what tasks exchange.
BLOCK = 1 << 16
#: Bytes of text whose terms are counted together.
CHUNK = 8 << 20
#: Cells that a task gathers before it hands them on: 9 bytes each.
HELD = 4_000_000


@dataclass(frozen=True)
class Divergence:
    """``depth`` rows of cells; a row has ``cells_per_document`` for each document, at least one block and at most ``most_cells``.

    Too few cells let more rare terms through, which costs shuffle and nothing else. The bound keeps what is sent to every
    executor at ``depth * most_cells / 8`` bytes, 96 MB with these defaults; frequencies up to 255.
    """

    least_documents: int = 3
    depth: int = 3
    cells_per_document: int = 16
    most_cells: int = 1 << 28
    top_terms: int = 200
    unit: int = 1_000_000_000


class Terms:
    """The terms of one chunk: ``words`` are the distinct ones, ``code`` and ``owner`` the term and text of each occurrence."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        _, where, body = texts.buffers()
        offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = LOWER[np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]]] if body is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = IS_TERM[data]
        edge = inside[1:] != inside[:-1]
        # A text's end ends a term, too: there both a term's end and the next one's start may lie at one place.
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        starts = np.flatnonzero((edge | cut)[:-1] & inside[1:-1])
        ends = np.flatnonzero((edge | cut)[1:] & inside[1:-1]) + 1
        self.owner = np.searchsorted(offsets, starts, "right") - 1
        places = np.concatenate(([0], np.cumsum(ends - starts)))
        letters = pa.py_buffer(np.ascontiguousarray(data[inside[1:-1]]))
        terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), letters]).dictionary_encode()
        self.words, self.code = terms.dictionary, terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct term."""
        _, where, body = self.words.buffers()
        offsets = np.frombuffer(where, np.int64)[self.words.offset : self.words.offset + len(self.words) + 1]
        if not len(self.words):
            return np.empty(0, U)
        return span_hashes(np.frombuffer(body, np.uint8), offsets[:-1], offsets[1:])


def _coded(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    coded = column.cast(pa.large_string()).fill_null("").dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    data = [x.encode() for x in langs.to_pylist()]
    ends = np.cumsum([len(x) for x in data], dtype=np.int64)
    return span_hashes(np.frombuffer(b"".join(data), np.uint8), ends - [len(x) for x in data], ends) if data else np.empty(0, U)


def _tuples(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct tuples of codes, and which of them each row is."""
    sizes = [int(c.max(initial=0)) + 1 for c in columns]
    key = np.zeros(len(columns[0]), np.int64)
    for c, size in zip(columns, sizes, strict=True):
        key = key * size + c
    found, at = np.unique(key, return_inverse=True)
    out = []
    for size in reversed(sizes):
        out.append(found % size)
        found = found // size
    return out[::-1], at


def _cells(lang: np.ndarray, term: np.ndarray, depth: int, width: int) -> Iterator[np.ndarray]:
    """The cell in each row of (language, term), by their hashes; a power of two of cells."""
    key = mix(lang * U(GOLDEN) + term)
    step = mix(key) | U(1)
    for _ in range(depth):
        yield (key >> U(20) & U(width - 1)).astype(np.int64)
        key = mix(key + step)


def _added(cells: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, with their counts added up to ``least`` at most."""
    found, at = np.unique(cells, return_inverse=True)
    return found, np.minimum(np.bincount(at, counts, len(found)), least).astype(np.uint8)


def _blocks(cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """(block, places, counts): the ordered cells, by block; two bytes and one byte for each."""
    block, first = np.unique(cells // BLOCK, return_index=True)
    bounds = np.append(first, len(cells)).astype(np.int32)
    binary = lambda data, size: pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(bounds * np.int32(size)), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), binary((cells % BLOCK).astype("<u2"), 2), binary(counts, 1)], names=["block", "places", "counts"])


def _sketch_task(batches: Iterator[pa.RecordBatch], depth: int, width: int, least: int) -> Iterator[pa.RecordBatch]:
    """This task's part of the sketch: its cells that are not 0. A count stays at ``least`` once it is there."""
    cells, counts = np.empty(0, np.int64), np.empty(0, np.uint8)
    for batch in batches:
        for part in chunks(batch, "text", CHUNK):
            terms = Terms(part.column("text"))
            langs, lang = _coded(part.column("lang"))
            (owner, code), _ = _tuples(terms.owner, terms.code)
            (spoken, code), at = _tuples(lang[owner], code)
            documents = np.minimum(np.bincount(at, minlength=len(code)), least)
            rows = [cell + i * width for i, cell in enumerate(_cells(_lang_hashes(langs)[spoken], terms.hashes()[code], depth, width))]
            cells, counts = _added(np.concatenate((cells, *rows)), np.concatenate((counts, np.tile(documents, depth))), least)
            if len(cells) > HELD:
                yield _blocks(cells, counts)
                cells, counts = cells[:0], counts[:0]
    if len(cells):
        yield _blocks(cells, counts)


def _merge_task(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(block, bits): blocks added up, and of each cell only whether it reaches the least frequency."""
    merged: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, places, counts in zip(batch.column("block").to_pylist(), batch.column("places"), batch.column("counts"), strict=True):
            cells = merged.setdefault(i, np.zeros(BLOCK, np.uint8))
            at = np.frombuffer(places.as_buffer(), "<u2")
            cells[at] = np.minimum(cells[at].astype(np.int64) + np.frombuffer(counts.as_buffer(), np.uint8), least)
    for i, cells in merged.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(cells >= least, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])


class Sketch:
    """Which cells reach the least document frequency."""

    def __init__(self, depth: int, width: int, blocks: dict[int, bytes]):
        self.depth, self.width = depth, width
        self.bits = np.zeros(depth * width // 8, np.uint8)
        for i, bits in blocks.items():
            self.bits[i * BLOCK // 8 : (i + 1) * BLOCK // 8] = np.frombuffer(bits, np.uint8)

    def may_reach(self, lang: np.ndarray, term: np.ndarray) -> np.ndarray:
        """False only for terms that are in fewer documents of the language than the least."""
        out = np.ones(len(term), bool)
        for row, cell in enumerate(_cells(lang, term, self.depth, self.width)):
            cell = cell + row * self.width
            out &= (self.bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1) != 0
        return out


def document_sketch(documents: DataFrame, rules: Divergence, width: int) -> Sketch:
    """The merged sketch of all ``documents`` (text, lang)."""
    depth, least = rules.depth, rules.least_documents
    parts = documents.select("text", "lang").mapInArrow(lambda b: _sketch_task(b, depth, width, least), "block int, places binary, counts binary")
    merged = parts.repartition("block").mapInArrow(lambda b: _merge_task(b, least), "block int, bits binary")
    # At most depth * most_cells / 8 bytes.
    return Sketch(depth, width, {r.block: bytes(r.bits) for r in merged.collect()})


def _count_task(batches: Iterator[pa.RecordBatch], sketch: Sketch) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, documents) of the terms of a chunk that the sketch lets through."""
    for batch in batches:
        for part in chunks(batch, "text", CHUNK):
            terms = Terms(part.column("text"))
            langs, lang = _coded(part.column("lang"))
            sources, source = _coded(part.column("source"))
            (owner, code), at = _tuples(terms.owner, terms.code)
            n = np.bincount(at, minlength=len(code))
            kept = sketch.may_reach(_lang_hashes(langs)[lang[owner]], terms.hashes()[code])
            owner, code, n = owner[kept], code[kept], n[kept]
            (lang, source, code), at = _tuples(lang[owner], source[owner], code)
            size = len(code)
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(lang)), sources.take(pa.array(source)), terms.words.take(pa.array(code)), pa.array(np.bincount(at, n, size).astype(np.int64)), pa.array(np.bincount(at, minlength=size).astype(np.int64))],
                names=["lang", "source", "term", "n", "documents"],
            )


def kept_terms(documents: DataFrame, rules: Divergence = Divergence()) -> DataFrame:
    """(lang, source, term, n, in_lang, first): occurrences of each term that enough documents of its language have.

    ``n`` is the term's count in the source, ``in_lang`` that of all sources of the language; ``first`` is true for one of the
    term's rows in the language. Rows without n do not occur. Null text, lang and source are empty strings; rows repeat as
    documents of their own.
    """
    docs = in_small_batches(documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]))
    rows = documents.select(F.lit(1)).count()
    width = BLOCK
    while width < min(rules.cells_per_document * rows, rules.most_cells):
        width *= 2
    sketch = documents.sparkSession.sparkContext.broadcast(document_sketch(docs, rules, width))
    counted = docs.mapInArrow(lambda b: _count_task(b, sketch.value), "lang string, source string, term string, n long, documents long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    term = Window.partitionBy("lang", "term")
    told = counted.withColumns({"in_lang": F.sum("n").over(term), "everywhere": F.sum("documents").over(term), "least": F.min("source").over(term)})
    told = told.filter(F.col("everywhere") >= rules.least_documents)
    return told.select("lang", "source", "term", "n", "in_lang", (F.col("source") == F.col("least")).alias("first"))


def _share(unit: int, n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(unit * (n + 1) / (total + terms)); 38 digits hold the product."""
    wide = lambda x: (F.col(x) if isinstance(x, str) else x).cast("decimal(19,0)")
    top, bottom = (wide(n) + 1) * F.lit(unit).cast("decimal(12,0)"), wide(total) + wide(terms)
    return F.call_function("div", top, bottom) + 1


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares stay below 2^30 or so, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(documents: DataFrame, rules: Divergence = Divergence()) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others, and by which terms.

    A term's share in a group is ``p = 1 + floor(unit * (count + 1) / (N + V))``, of N occurrences of the V kept terms of the
    language; the gap of two shares is ``floor((p - q)^2 / q)``. Part ``pair`` has each other source of the language, its gaps
    summed over all V terms; part ``term`` the ``top_terms`` largest gaps to the language's own share, of terms that the group has
    and that it has more of. Ranks follow the value, largest first, then the item in UTF-8 order.

    Null text, lang and source are empty strings. A group without kept terms is there too: its pairs count, it has no terms. With
    one source in a language there are no pairs. Repeated rows are documents of their own. Other columns are not read. An empty
    table gives no rows.
    """
    scratch = Scratch(documents.sparkSession)
    kept = scratch.keep(kept_terms(documents, rules))
    lang_of, source_of = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))
    groups = documents.select(lang_of, source_of).distinct()
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("terms"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "lang_total", "terms"])
    none = F.when(F.col("terms") > 0, _share(rules.unit, F.lit(0), "total", "terms"))
    sizes = scratch.keep(sizes.withColumn("none", none))

    shares = kept.join(sizes, ["lang", "source"]).withColumn("p", _share(rules.unit, "n", "total", "terms"))
    wide = shares.withColumn("q", _share(rules.unit, "in_lang", "lang_total", "terms")).filter("p > q")
    wide = wide.select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    # First within shares of a group, so that no task gets more of a large group than ranks of so many shares.
    some = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(64))).orderBy(F.desc("value"), "item")
    wide = wide.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= rules.top_terms).drop("rank")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = wide.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= rules.top_terms)

    # Summed over all terms: as if neither had any; what changes where one has the term; and where both have it.
    left, right = sizes.alias("a"), sizes.alias("b")
    pair = (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source"))
    ours, theirs = F.col("a.none"), F.col("b.none")
    start = left.join(right, pair).select(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.coalesce(F.col("a.terms") * _gap(ours, theirs), F.lit(0)).alias("value"))
    counts = shares.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("terms"))
    p = F.col("a.p")
    sides = F.array(
        F.struct(F.col("a.source").alias("source"), F.col("b.source").alias("item"), (F.col("a.terms") * (_gap(p, theirs) - _gap(ours, theirs))).alias("value")),
        F.struct(F.col("b.source").alias("source"), F.col("a.source").alias("item"), (F.col("a.terms") * (_gap(theirs, p) - _gap(theirs, ours))).alias("value")),
    )
    one = counts.alias("a").join(right, pair).select(F.col("a.lang").alias("lang"), F.inline(sides))
    slim = shares.select("lang", "term", "source", "p", "none")
    q = F.col("b.p")
    change = lambda x, x0, y, y0: _gap(x, y) - _gap(x, y0) - _gap(x0, y) + _gap(x0, y0)
    both = slim.alias("a").join(slim.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    both = both.groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("x"), F.col("b.source").alias("y")).agg(
        F.sum(change(p, ours, q, theirs)).alias("xy"), F.sum(change(q, theirs, p, ours)).alias("yx")
    )
    directed = lambda source, item, value: F.struct(F.col(source).alias("source"), F.col(item).alias("item"), F.col(value).alias("value"))
    both = both.select("lang", F.inline(F.array(directed("x", "y", "xy"), directed("y", "x", "yx"))))
    pairs = start.union(one).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    named = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return named(pairs, "pair").union(named(terms, "term"))
