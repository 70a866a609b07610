"""Map relations: multipolygons from ways, and tile boxes that relations widen."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.polygons import normalised
from tessera.operators.vectors import _union, node_boxes, way_boxes


def without_repeats(ways: list) -> list:
    """The first copy of each way; the last member takes the place of a copy, as when a list is kept dense."""
    ways, seen, i = list(ways), set(), 0
    while i < len(ways):
        if ways[i][0] in seen:
            ways[i] = ways[-1]
            ways.pop()
        else:
            seen.add(ways[i][0])
            i += 1
    return ways


def linked(ways: list) -> list:
    """Ways (id, inner, first, last) without the open ones that hang loose.

    Outer ways first, then inner ones: while some open way of the role has an end node at which not exactly two ends of open
    ways of the role meet, the first such way goes, and the last member of the list takes its place.
    """
    place: list[int | None] = list(range(len(ways)))
    list_ = list(range(len(ways)))
    for role in (False, True):
        ends: dict = defaultdict(set)
        count: dict = defaultdict(int)
        for i in list_:
            _, inner, first, last = ways[i]
            if inner == role and first != last:
                for node in (first, last):
                    ends[node].add(i)
                    count[node] += 1
        loose = lambda i: ways[i][1] == role and ways[i][2] != ways[i][3] and (count[ways[i][2]] != 2 or count[ways[i][3]] != 2)
        waiting = [(place[i], i) for i in list_ if loose(i)]
        heapq.heapify(waiting)
        while waiting:
            at, i = heapq.heappop(waiting)
            if place[i] != at or not loose(i):
                continue
            moved = list_.pop()
            place[i] = None
            if moved != i:
                list_[at], place[moved] = moved, at
            for node in ways[i][2:]:
                count[node] -= 1
                ends[node].discard(i)
            # A node may have become loose, or, from three ends to two, sound: what is in the heap is tested when its turn comes.
            again = {moved} if moved != i else set()
            for node in ways[i][2:]:
                again |= ends[node]
            for j in again:
                if place[j] is not None and loose(j):
                    heapq.heappush(waiting, (place[j], j))
    return [ways[i] for i in list_]


def chained(ways: list) -> list:
    """(ring, inner, step, way id, reversed) of linked ways: each unused way begins a ring and runs forward, then always the first
    unused way of the role that begins or ends where the ring has come to, until it is closed. Rings that cannot close go."""
    at: dict = defaultdict(list)
    for i, (_, inner, first, last) in enumerate(ways):
        at[inner, first].append(i)
        if first != last:
            at[inner, last].append(i)
    out, used, ring = [], set(), 0
    for i, (way, inner, first, last) in enumerate(ways):
        if i in used:
            continue
        used.add(i)
        steps, come = [(way, False)], last
        while come != first:
            nxt = next((j for j in at[inner, come] if j not in used), None)
            if nxt is None:
                break
            used.add(nxt)
            back = ways[nxt][2] != come
            steps.append((ways[nxt][0], back))
            come = ways[nxt][2] if back else ways[nxt][3]
        if come == first:
            out += [(ring, inner, n, w, b) for n, (w, b) in enumerate(steps)]
            ring += 1
    return out


_STEPS = "rel_id long, ring int, inner boolean, step int, way_id long, backward boolean"


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All steps of the rings of relations whose members follow each other; what a batch leaves open is held for the next."""
    types = (pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.bool_())

    def told(relations: list) -> pa.RecordBatch:
        rows = [(rel, *step) for rel, ways in relations for step in chained(linked(without_repeats(ways)))]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in _STEPS.split(", ")])

    open_: list = []
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("rel_id", "way_id", "inner", "first", "last")), strict=True)
        for rel, members in groupby(rows, lambda r: r[0]):
            if not open_ or open_[-1][0] != rel:
                open_.append((rel, []))
            open_[-1][1].extend(r[1:] for r in members)
        if len(open_) > 1:
            yield told(open_[:-1])
            del open_[:-1]
    yield told(open_)


def ring_steps(members: DataFrame, refs: DataFrame) -> DataFrame:
    """(rel_id, ring, inner, step, way_id, backward): which ways, in which order and direction, make the rings of each relation.

    ``members`` are ways of multipolygons (rel_id, pos, way_id, role), ``refs`` the nodes of ways (way_id, pos, node_id). Only the
    end nodes of a relation's ways come together in one task, at most as many as a relation may have members (32,000).
    """
    at = F.struct("pos", "node_id")
    ends = refs.groupBy("way_id").agg(F.min(at).alias("a"), F.max(at).alias("b")).select("way_id", F.col("a.node_id").alias("first"), F.col("b.node_id").alias("last"))
    met = members.join(ends, "way_id").select("rel_id", "pos", "way_id", (F.coalesce("role", F.lit("")) == "inner").alias("inner"), "first", "last")
    # Many relations in one call: a call for each takes longer than its rings.
    ordered = met.repartition("rel_id").sortWithinPartitions("rel_id", F.asc_nulls_last("pos"), "way_id").drop("pos")
    return ordered.mapInArrow(_assembled, _STEPS)


def assemble_multipolygons(members: DataFrame, refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rel_id, ring, inner, points): the closed rings of each relation, outer ones clockwise, inner ones counter-clockwise.

    See ``ring_steps``; a relation of which no outer ring is left is broken and gives none. ``points`` is an array of (x, y), the
    first one not repeated at the end. Nodes without a place are left out, members that are no known way do nothing, an inner
    ring needs no outer ring around it.
    """
    refs = refs.join(nodes.select("node_id"), "node_id", "left_semi")
    steps = ring_steps(members, refs)
    sound = steps.filter("not inner").select("rel_id").distinct()
    placed = refs.join(nodes, "node_id").select("way_id", F.col("pos").alias("at"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    ends = placed.groupBy("way_id").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    walked = steps.join(sound, "rel_id", "left_semi").join(placed.join(ends, "way_id"), "way_id")
    # Each way's last point is the next one's first.
    walked = walked.filter(F.col("at") != F.when(F.col("backward"), F.col("low")).otherwise(F.col("high")))
    walked = walked.withColumn("place", F.when(F.col("backward"), -F.col("at")).otherwise(F.col("at")))
    rings = walked.groupBy("rel_id", "ring", "inner").agg(F.sort_array(F.collect_list(F.struct("step", "place", "x", "y"))).alias("p"))
    points = F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    plain = rings.select("rel_id", "ring", "inner", points.alias("points"))
    return plain.withColumn("points", F.when(F.col("inner"), normalised(F.col("points"), True)).otherwise(normalised(F.col("points"), False)))


def migrated_tags(relations: DataFrame, members: DataFrame, ways: DataFrame, steps: DataFrame) -> DataFrame:
    """(rel_id, tags): a multipolygon's own tags, or, if it has none but its type, those of its outer ways, the earlier ways first.

    ``relations`` (rel_id, tags) and ``ways`` (way_id, tags) have maps of strings; only outer ways that are in a ring count.
    """
    outer = steps.filter("not inner").select("rel_id", "way_id").distinct()
    lent = members.join(outer, ["rel_id", "way_id"]).join(ways, "way_id").filter(F.size("tags") > 0)
    lent = lent.groupBy("rel_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.map_entries("tags").alias("entries")))).alias("lent"))
    first = lambda known, more: F.map_concat(known, F.map_filter(F.map_from_entries(more), lambda k, v: ~F.map_contains_key(known, k)))
    empty = F.map_from_entries(F.slice(F.array(F.struct(F.lit("").alias("k"), F.lit("").alias("v"))), 1, 0))
    taken = F.aggregate(F.col("lent"), empty, lambda known, w: first(known, w["entries"]))
    own = F.map_filter("tags", lambda k, v: k != "type")
    both = relations.join(lent, "rel_id", "left")
    return both.select("rel_id", F.when((F.size(own) > 0) | F.col("lent").isNull(), own).otherwise(taken).alias("tags"))


def relation_boxes(relations: DataFrame, members: DataFrame, nodes: DataFrame, refs: DataFrame, grid: int = 1, types: tuple[str, ...] = ()) -> DataFrame:
    """(rel_id, box) over the boxes of a relation's nodes and ways; nested relations add nothing.

    Relations (rel_id, rel_type) of other than the allowed ``types``, if any are given, have no box; members (rel_id, kind, ref)
    that are missing add nothing, and a relation with none has no box.
    """
    wanted = relations.filter(F.col("rel_type").isin(*types)) if types else relations
    held = members.join(wanted.select("rel_id"), "rel_id", "left_semi")
    of = lambda kind, boxes, key: held.filter(F.col("kind") == kind).join(boxes.withColumnRenamed(key, "ref"), "ref").select("rel_id", "x0", "x1", "y0", "y1")
    return _union(of("node", node_boxes(nodes, grid), "node_id").union(of("way", way_boxes(nodes, refs, grid), "way_id")).groupBy("rel_id"))


def widened_by_relations(nodes: DataFrame, refs: DataFrame, members: DataFrame, boxes: DataFrame, grid: int = 1) -> tuple[DataFrame, DataFrame]:
    """Boxes of ways, widened by the relations they are in; and of nodes, widened by their relations and their widened ways."""
    through = members.join(boxes, "rel_id")
    of = lambda kind, key: through.filter(F.col("kind") == kind).select(F.col("ref").alias(key), "x0", "x1", "y0", "y1")
    own = way_boxes(nodes, refs, grid)
    ways = _union(own.union(of("way", "way_id").join(own, "way_id", "left_semi")).groupBy("way_id"))
    single = node_boxes(nodes, grid)
    by_way = refs.join(ways, "way_id").select("node_id", "x0", "x1", "y0", "y1")
    more = by_way.union(of("node", "node_id")).join(single.select("node_id"), "node_id", "left_semi")
    return ways, _union(single.union(more).groupBy("node_id"))
