"""MinHash near-duplicates of whole documents by tensored banding.

Two small collections, left and right, hold ``m`` sub-keys each, and a sub-key joins ``r`` minhashes. A table key pairs one
left with one right sub-key, so 2·m·r minhashes serve m² tables of 2·r minhashes each; computing those tables outright
would take 2·r·m² minhashes. Two documents of similarity s meet in a table with probability (1 − (1 − s^r)^m)²: 0.9995 at
s = 0.75 for the default r = 2, m = 10.

Steps, all on Spark:

1. One pass over the texts gives each document its distinct-shingle count, a 128-bit fingerprint of its shingle set and its
   2·m sub-keys. Documents of one fingerprint collapse into a class, so exact copies take part once.
2. Sub-keys that only one class has are dropped; table keys are formed from what is left. A pair collides in table (i, j)
   exactly if it collides in left i and right j, so nothing is lost. Each bucket has a head: the class whose sub-keys are
   shared most, which in a group of copies is the one that most of them come from.
3. Every class is compared with the head that it meets most prominently, on the full sets, and linked classes form components.
   In buckets that still hold several components, every class is then compared with every head.
4. What is left are pairs (a, b) of one bucket with head p, at least one of them, say b, not similar to p. With added parts
   A, what each has and the head lacks, a and b share |a ∩ b ∩ p| + |Aa ∩ Ab| members. The first is at most |b ∩ p|, which is under t/(1 + t)·(|b| + |p|),
   and similarity t asks for t/(1 + t)·(|a| + |b|) in all; so Aa and Ab share more than t/(1 + t)·(|a| − |p|) members, and at
   least |Aa| − (1 − t)·|a|. A prefix filter on the added parts, rarest members first, therefore finds all pairs one of which is
   no smaller than the head, or has enough that the head lacks. What all of a group have from the head, or lack of it, as pages
   of one template do, is in no list.
5. The few that are smaller and nearly inside the head are left for one of two exact filters, whichever has the shorter lists in
   a group: on the whole differences δ from the head (|a Δ b| = |δa| + |δb| − 2·|δa ∩ δb| bounds what δa and δb must share), or on
   the added parts over the smallest of the group, with which all are compared, so that none is smaller than that head. So no
   link between different components is lost, and no pairs of a bucket are listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, in_small_batches, row_name
from tessera.llm.components import components
from tessera.llm.words import PLACE, Texts, U, chunks, constants, mix, signed, unique_per_text

#: Lists of up to this many classes (48 bytes each) are sent to every executor; longer ones are shuffled.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Banding:
    shingle_words: int = 5
    percent: int = 75
    collection: int = 10
    rows: int = 2


def shingles(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, text) pairs of n-word shingles; the whole sequence for a text of fewer words; none without words."""
    found, at = texts.grams(n)
    hashes, owners = [found], [texts.owner[at]]
    for k in range(1, n):
        short = np.flatnonzero(texts.counts == k)
        total = np.zeros(len(short), U)
        for j in range(k):
            total += texts.hashes[texts.first[short] + j] * PLACE[j]
        hashes.append(mix(total + U(k)))
        owners.append(short)
    return unique_per_text(np.concatenate(hashes), np.concatenate(owners))


def _fingerprints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sixteen bytes for each set, whatever the order of its members."""
    rest = mix(hashes + U(7))
    total = np.zeros((len(hashes) + 1, 2), U)
    np.cumsum(mix(hashes), out=total[1:, 0])
    np.cumsum(rest, out=total[1:, 1])
    return np.ascontiguousarray(total[first[1:]] - total[first[:-1]])


def _signatures(batches: Iterator[pa.RecordBatch], banding: Banding) -> Iterator[pa.RecordBatch]:
    factors = constants(2 * banding.collection * banding.rows, 11)
    for batch in batches:
        for part in chunks(batch, "text"):
            texts = Texts(part.column("text"), lower=True)
            hashes, owner = shingles(texts, banding.shingle_words)
            first = np.searchsorted(owner, np.arange(len(texts) + 1))
            sizes = np.diff(first)
            full = np.flatnonzero(sizes)
            keys = np.zeros((len(texts), 2 * banding.collection), U)
            for k in range(2 * banding.collection):
                key = np.full(len(full), U(k))
                for j in range(banding.rows):
                    least = np.minimum.reduceat(hashes * factors[k * banding.rows + j], first[full]) if len(full) else np.empty(0, U)
                    key = mix(key + least * PLACE[j])
                keys[full, k] = key
            prints = _fingerprints(hashes, first)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("row"),
                    pa.array(sizes, pa.int64()),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(texts), [None, pa.py_buffer(prints.tobytes())]).cast(pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * keys.shape[1], pa.int32()), pa.array(signed(keys.ravel()))),
                ],
                names=["doc_id", "row", "n_shingles", "node", "keys"],
            )


def _sets(batches: Iterator[pa.RecordBatch], banding: Banding) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            texts = Texts(part.column("text"), lower=True)
            hashes, owner = shingles(texts, banding.shingle_words)
            first = np.searchsorted(owner, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(signed(hashes)))], names=["node", "shingles"]
            )


def _alike(a: str, b: str, percent: int) -> Column:
    common = F.size(F.array_intersect(a, b))
    return 100 * common >= percent * (F.size(a) + F.size(b) - common)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the shingle sets of both."""
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    return pairs.join(first, "a").join(other, "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    return _with_sets(pairs, sets).filter(_alike("of_a", "of_b", percent)).select("a", "b")


def _could_link(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _labelled(rows: DataFrame, labels: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """The rows with the component of ``node``; a class without links is its own."""
    found = labels.select(F.col("node").alias(node), F.col("label").alias("_found"))
    return rows.join(found, node, "left").withColumn(label, F.coalesce("_found", node)).drop("_found")


def near_duplicates(documents: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, row) for every row of ``documents`` (doc_id, text; other columns are ignored).

    A-Z count as lower case. A null or blank text has an empty set and is linked with nothing. ``component_id`` is the
    smallest doc_id reached, ``kept`` whether it is the row's own. A null doc_id counts as larger than any other: it is a
    component's id only where all of its ids are null. Rows that repeat a doc_id are judged each by its own text. An empty
    table gives no rows. ``row`` is a 128-bit name of doc_id and text, which tells rows of one doc_id apart.
    """
    percent = banding.percent
    scratch = Scratch(documents.sparkSession)
    docs = in_small_batches(documents).select("doc_id", "text").withColumn("row", row_name("doc_id", "text"))
    signed_docs = scratch.keep(
        docs.mapInArrow(lambda b: _signatures(b, banding), "doc_id long, row string, n_shingles long, node binary, keys array<long>")
    )
    ids = scratch.keep(signed_docs.select("doc_id", "row", "n_shingles", "node"))
    classes = scratch.keep(
        signed_docs.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min("row").alias("row"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    )
    scratch.drop(signed_docs)

    # Step 2: sub-keys that two classes share, the tables formed from them, and the heads of their buckets.
    sub = classes.select("node", "n", F.posexplode("keys").alias("i", "key"))
    shared = sub.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    hits = sub.join(shared, "key").groupBy("node").agg(F.first("n").alias("n"), F.sum("members").alias("weight"), F.collect_list(F.struct("i", "key")).alias("hits"))
    side = lambda cond: F.filter("hits", lambda x: cond(x["i"]))
    tables = (
        hits.withColumn("right", side(lambda i: i >= banding.collection))
        .select("node", "n", "weight", F.explode(side(lambda i: i < banding.collection)).alias("x"), "right")
        .select("node", "n", "weight", F.col("x.key").alias("key"), F.explode("right").alias("y"))
        .select("node", "n", "weight", F.xxhash64("key", "y.key").alias("table"))
    )
    tables = scratch.keep(tables)
    first = F.max_by(F.struct("node", "n", "weight"), F.struct("weight", "node")).alias("first")
    heads = tables.groupBy("table").agg(first, F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    heads = heads.select("table", F.col("first.node").alias("head"), F.col("first.n").alias("head_n"), F.col("first.weight").alias("head_weight"))
    met = scratch.keep(tables.join(heads, "table").filter("node <> head").drop("weight"))
    scratch.drop(tables)

    # Shingle sets of one row for each class that met another.
    named = met.select("node").union(met.select("head")).distinct()
    wanted = scratch.keep(classes.join(named, "node", "left_semi").select("row", "node"))
    few = wanted.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(wanted) if few else wanted, "row").groupBy("node").agg(F.first("text").alias("text"))
    sets = scratch.keep(texts.mapInArrow(lambda b: _sets(b, banding), "node binary, shingles array<long>"))
    owners = scratch.keep(classes.select("node", "least_id"))
    scratch.drop(classes, wanted)

    # Step 3: each class with its most prominent head, then with all heads of the buckets that are not of one component.
    fits = met.filter(_could_link(F.col("n"), F.col("head_n"), percent))
    told = scratch.keep(fits.groupBy(F.col("node").alias("a")).agg(F.max_by("head", F.struct("head_weight", "head")).alias("b")))
    links = scratch.keep(_confirmed(told, sets, percent))
    labels = components(links)
    both = _labelled(_labelled(met.drop("head_weight"), labels), labels, "head", "head_label")
    met2 = scratch.keep(both)
    scratch.drop(met)
    spread = lambda low, high: met2.groupBy("table").agg(F.min(low).alias("low"), F.max(high).alias("high")).filter("low <> high").select("table")
    open_ = met2.join(spread(F.least("label", "head_label"), F.greatest("label", "head_label")), "table", "left_semi")
    fits = open_.filter((F.col("label") != F.col("head_label")) & _could_link(F.col("n"), F.col("head_n"), percent))
    rest = fits.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct().join(told, ["a", "b"], "left_anti")
    more = scratch.keep(_confirmed(rest, sets, percent))
    if not more.isEmpty():
        links = scratch.keep(links.union(more))
        labels = components(links)

    # Step 4: classes of different components in one bucket, by what they add to its head.
    met3 = _labelled(_labelled(met2.drop("label", "head_label", "head_n"), labels), labels, "head", "head_label")
    held = met3.groupBy("table").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("table")
    apart = scratch.keep(met3.join(held, "table", "left_semi").select(F.col("node").alias("a"), F.col("head").alias("b"), "label", "head_label", "n").distinct())
    differ = _with_sets(apart, sets).withColumns({"added": F.array_except("of_a", "of_b"), "lacks": F.array_except("of_b", "of_a"), "head_n": F.size("of_b")})
    differ = scratch.keep(differ.select("a", F.col("b").alias("head"), "label", F.col("label").eqNullSafe(F.col("head_label")).alias("inside"), "n", "head_n", "added", "lacks"))
    slack = F.size("added") - F.floor(F.col("n") * (100 - percent) / 100)
    # What it shares at least with one that is not similar to the head; with one that may be, only the slack holds.
    other = F.greatest(slack, F.floor(percent * (F.col("n") - F.col("head_n")) / (100 + percent)) + 1)
    found = _met(_prefixes(differ.withColumn("least", F.when(F.col("inside"), other).otherwise(slack)), "added"), _added_enough(percent), percent)

    # Step 5: pairs of which neither is bound to share a member there.
    loose = differ.groupBy("head").agg(F.max(F.col("inside") & (other <= 0)).alias("some"))
    rest = differ.withColumn("slack", slack).withColumn("other", other).join(loose, "head").filter((F.col("other") <= 0) | (F.col("some") & (F.col("slack") <= 0)))
    rest = scratch.keep(rest.select("a", "head", "label", "n", F.concat("added", "lacks").alias("delta")))
    least = F.min(F.struct("n", "a", "label"))
    low = scratch.keep(rest.groupBy("head").agg(least.alias("q"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("head", F.col("q.a").alias("b"), F.col("q.label").alias("b_label")))
    both = rest.select("a", "head", "label", "n").join(low, "head").filter("a <> b")
    told = _with_sets(both.select("a", "b").distinct(), sets).select("a", "b", _alike("of_a", "of_b", percent).alias("alike"), F.array_except("of_a", "of_b").alias("added"))
    told = scratch.keep(both.join(told, ["a", "b"]).select("a", "b", "head", F.when(F.col("alike"), F.col("b_label")).otherwise(F.col("label")).alias("label"), "n", "added", "alike", F.col("label").alias("own"), "b_label"))
    over_least = scratch.keep(_prefixes(told.withColumn("least", slack), "added"))
    deltas = scratch.keep(rest.join(low.select("head"), "head", "left_semi"))
    cheaper = _cost(_delta_prefixes(deltas, percent), "by_delta").join(_cost(over_least, "by_added"), "head", "full")
    cheaper = scratch.keep(cheaper.filter("coalesce(by_delta, 0) <= coalesce(by_added, 0)").select("head"))
    found = found.union(_delta_pairs(deltas.join(cheaper, "head", "left_semi"), percent))
    found = found.union(_met(over_least.join(cheaper, "head", "left_anti"), _added_enough(percent), percent))
    sure = told.filter("alike and own <> b_label").select("a", "b")
    last = scratch.keep(_confirmed(found.distinct(), sets, percent).union(sure).distinct())
    if not last.isEmpty():
        labels = components(links.union(last))

    grouped = _labelled(owners, labels)
    whole = grouped.groupBy("label").agg(F.min("least_id").alias("component_id"))
    found = scratch.keep(grouped.select("node", "label").join(whole, "label").select("node", "component_id"))
    scratch.drop(met2, sets, owners, apart, differ, rest, low, told, over_least, deltas, cheaper)
    linked = ids.filter("n_shingles > 0").join(found, "node")
    alone = ids.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    names = ["doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row"]
    return linked.select(*names).union(alone.select(*names))


def _prefixes(rows: DataFrame, members: str) -> DataFrame:
    """(head, shingle, of) for the members that each row (head, a, label, n, members, least) is looked up by.

    Members that only one label of the head has can't be shared; the others are in one total order (how many have it, then the
    shingle). Who must share ``least`` of them (1 at least) shares one of all but the last least − 1.
    """
    each = rows.select("head", "a", "label", "n", F.size(members).alias("size"), F.greatest(F.lit(1), F.col("least")).alias("least"), F.explode(members).alias("shingle"))
    common = each.groupBy("head", "shingle").agg(F.count("*").alias("members"), F.min("label").alias("low"), F.max("label").alias("high"))
    common = common.filter("low <> high").select("head", "shingle", "members")
    ranked = each.join(common, ["head", "shingle"]).groupBy("head", "a", "label", "n", "size", "least").agg(F.sort_array(F.collect_list(F.struct("members", "shingle"))).alias("rest"))
    ranked = ranked.withColumn("length", (F.size("rest") - F.col("least") + 1).cast("int")).filter("length > 0")
    prefix = ranked.select("head", "a", "label", "n", "size", F.posexplode(F.slice("rest", F.lit(1), F.col("length"))).alias("place", "x"), F.size("rest").alias("open"))
    return prefix.select("head", "x.shingle", F.struct("a", "label", "n", "size", (F.col("open") - F.col("place")).alias("left")).alias("of"))


def _met(prefixes: DataFrame, enough: Column, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels that are looked up by one member and can still share as many as they must."""
    one, two = prefixes.withColumnRenamed("of", "x"), prefixes.withColumnRenamed("of", "y")
    near = one.join(two, ["head", "shingle"]).filter((F.col("x.label") < F.col("y.label")) & _could_link(F.col("x.n"), F.col("y.n"), percent) & enough)
    return near.select(F.col("x.a").alias("a"), F.col("y.a").alias("b")).distinct()


def _cost(prefixes: DataFrame, name: str) -> DataFrame:
    """(head, name): how many rows the pairs of each head's lists are."""
    return prefixes.groupBy("head", "shingle").agg(F.count("*").alias("n")).groupBy("head").agg(F.sum(F.col("n") * F.col("n")).alias(name))


def _added_enough(percent: int) -> Column:
    """As the first member that both share, it and what is left behind it must make up for what they can share with the head."""
    with_head = F.least(F.col("x.n") - F.col("x.size"), F.col("y.n") - F.col("y.size"))
    return (100 + percent) * (F.least("x.left", "y.left") + with_head) >= percent * (F.col("x.n") + F.col("y.n"))


def _delta_prefixes(deltas: DataFrame, percent: int) -> DataFrame:
    # |a Δ b| is largest for the largest partner, n·100/percent; and δb is no smaller than δa less that.
    return _prefixes(deltas.withColumn("least", F.size("delta") - F.floor(F.col("n") * (100 - percent) / percent)), "delta")


def _delta_pairs(deltas: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels whose differences from one head share as many members as the similarity asks for."""
    # As the first member that both share, it and what is left behind it must hold all that the pair must share.
    enough = 2 * (100 + percent) * F.least("x.left", "y.left") >= (100 + percent) * (F.col("x.size") + F.col("y.size")) - (100 - percent) * (F.col("x.n") + F.col("y.n"))
    return _met(_delta_prefixes(deltas, percent), enough, percent)
