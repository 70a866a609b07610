"""Line dedup over the whole corpus by a deletion-neighbourhood join, with DataFrame functions only.

A line is a sequence of words, and the edit distance counts words inserted, deleted or replaced. Every line emits hashed keys
of its variants within the bound of one edit: itself, and itself without each of its words. Equal variants meet in a grouped
aggregate, which keeps the earliest line of each group, so a group of any size costs one row for each member and no pairs:

* lines of one length that agree after deletion at the same place differ in that place alone;
* a line that equals a longer one without some word is one insertion away from it.

Keys are 128 bits wide, so that different variants don't meet at any size. What meets is confirmed on the words. Lines that occur more than once take part once, by their earliest place. Before the
variants are made, lines that cannot have a partner are left out: two lines within one edit agree in their first or in their
last half, so a line whose halves nobody shares has none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, row_key

#: The ASCII blanks that end words, but for the line feed.
BLANKS = " \t\x0b\x0c\r"
#: Up to this many lines, what is known of them (about 30 bytes each) is sent to every executor.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class LineDedup:
    #: The edit may change one word in so many of the shorter line: lines are near by the share that differs, up to one word.
    words_per_edit: int = 8


def _half_keys(words: Column, n: Column) -> Column:
    """Keys of the first and the last half; both roundings, so that lines whose lengths differ by one agree in one."""
    short, long_ = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    head = lambda k: F.xxhash64(F.lit(0), k, F.slice(words, F.lit(1), k))
    tail = lambda k: F.xxhash64(F.lit(1), k, F.slice(words, n - k + 1, k))
    return F.array_distinct(F.array(head(short), head(long_), tail(short), tail(long_)))


def _bodies(documents: DataFrame) -> DataFrame:
    """(doc, row, line, body) of each line that has a word; ``line`` counts from 0, blanks around the line are gone.

    ``doc`` is the doc_id, larger than any other if null.
    """
    cut = documents.select(_doc().alias("doc"), row_key("doc_id", "text").alias("row"), F.posexplode(F.split("text", "\n")).alias("line", "body"))
    return cut.withColumn("body", F.btrim("body", F.lit(BLANKS))).filter("body <> ''")


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def _words(body: Column) -> Column:
    """The words of a trimmed line; most lines have single spaces only, for which the plain split is faster."""
    odd = body.contains("  ")
    for blank in BLANKS.replace(" ", ""):
        odd = odd | body.contains(blank)
    return F.when(odd, F.split(body, r"[\x20\x09-\x0D]+")).otherwise(F.split(body, " "))


def _place() -> Column:
    """Orders lines by document (null ids last), row and line."""
    return F.struct("doc", "row", "line")


def _near(lines: DataFrame, documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, g): hashes of the lines that have an earlier line one edit away."""
    distinct = scratch.keep(lines.filter("halves is not null").groupBy("h", "g").agg(F.min(_place()).alias("place"), F.first("halves").alias("halves")))
    halves = distinct.select("h", F.explode("halves").alias("half"))
    # Written before they are joined, here and below, so that a key that very many have can be split.
    shared = scratch.keep(halves.groupBy("half").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("half"))
    hopeful = halves.join(shared, "half", "left_semi").select("h").distinct()
    first = scratch.keep(distinct.join(hopeful, "h", "left_semi").select("h", "g", "place.*"))
    scratch.drop(distinct, shared)
    few = first.count() <= BROADCAST_ROWS
    found = _bodies(documents).join(F.broadcast(first) if few else first, ["doc", "row", "line"])
    # One row for each line, also where a document is repeated; by the keys of the join, so that nothing is dealt out again.
    full = scratch.keep(found.groupBy("doc", "row", "line", "h", "g").agg(F.first(_words(F.col("body"))).alias("words")))

    # The two fingerprints of a word sequence are xors over its words and their places; a deletion moves the words behind it.
    # Dealt out as whole lines, so that what the windows need of a line is together before there is a row for each word.
    dealt = full.repartition("doc", "row", "line")
    word = dealt.select("doc", "row", "line", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    value = lambda seed, place: F.xxhash64(F.lit(seed), "word", place)
    order = Window.partitionBy("doc", "row", "line").orderBy("i")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("doc", "row", "line")
    values = [value(seed, F.col("i") - moved).alias(f"{name}{seed}") for seed in (1, 2) for moved, name in enumerate(("here", "moved"))]
    valued = word.select("doc", "row", "line", "n", "i", *values)
    xor = lambda name, window: F.coalesce(F.bit_xor(name).over(window), F.lit(0).cast("long"))
    without = [xor(f"here{k}", before).bitwiseXOR(xor(f"moved{k}", whole)).bitwiseXOR(xor(f"moved{k}", upto)).alias(f"print{k}") for k in (1, 2)]
    itself = valued.groupBy("doc", "row", "line", "n").agg(*[F.bit_xor(f"here{k}").alias(f"print{k}") for k in (1, 2)]).select("doc", "row", "line", "n", F.lit(-1).alias("i"), "print1", "print2")
    prints = scratch.keep(valued.select("doc", "row", "line", "n", "i", *without).union(itself))
    left = F.when(F.col("i") < 0, F.col("n")).otherwise(F.col("n") - 1).alias("left")
    key = ["print1", "print2"]
    common = prints.groupBy(*key, left).agg(F.count("*").alias("members")).filter("members > 1").select(*key, "left")
    variants = scratch.keep(prints.withColumn("left", left).join(common, [*key, "left"], "left_semi").select(*key, "left", "n", "i", _place().alias("place")))
    scratch.drop(prints, first)

    # A deletion variant meets those of the same place, and the line that it equals; a whole line meets its longer ones.
    deleted = F.col("i") >= 0
    least = lambda rows, *keys: scratch.keep(rows.groupBy(*key, *keys).agg(F.min("place").alias("partner")))
    replaced, longer, equal = least(variants.filter(deleted), "n", "i"), least(variants.filter(deleted), "left"), least(variants.filter(~deleted), "left")
    met = variants.filter(deleted).join(replaced, [*key, "n", "i"]).select("place", "partner")
    met = met.union(variants.filter(deleted).join(equal, [*key, "left"]).select("place", "partner"))
    met = met.union(variants.filter(~deleted).join(longer, [*key, "left"]).select("place", "partner"))
    pairs = met.filter("partner < place").groupBy("place").agg(F.min("partner").alias("partner"))
    mine = full.select(_place().alias("place"), "h", "g", F.col("words").alias("a"))
    theirs = full.select(_place().alias("partner"), F.col("words").alias("b"))
    return pairs.join(mine, "place").join(theirs, "partner").filter(within_one_edit(F.col("a"), F.col("b"))).select("h", "g")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one inserted, deleted or replaced word apart.

    Their common beginning and common end, which may not overlap, then cover all of the longer but one word.
    """
    n, m = F.size(a), F.size(b)
    short, long_ = F.least(n, m), F.greatest(n, m)
    differs = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
    same = lambda x, y: F.when(differs(x, y) == 0, short.cast("long")).otherwise(F.least(differs(x, y) - 1, short.cast("long")))
    head, tail = same(F.slice(a, F.lit(1), short), F.slice(b, F.lit(1), short)), same(F.reverse(F.slice(a, n - short + 1, short)), F.reverse(F.slice(b, m - short + 1, short)))
    return (long_ - short <= 1) & (head + tail >= long_ - 1)


def dedup_lines(documents: DataFrame, options: LineDedup = LineDedup()) -> DataFrame:
    """The rows of ``documents`` with the columns ``text`` (without its later near-equal lines), ``n_lines`` and ``n_dropped``.

    A line goes if the corpus has an earlier line (by doc_id, null last, then row and place) with equal words, or with at most
    one word inserted, deleted or replaced, where that is no more than one in ``words_per_edit`` words of the shorter line.
    That line may itself be one that goes. Lines without words are kept as they are and not counted. Rows that repeat both
    doc_id and text count as one document and keep the same lines; a null text stays null with 0 lines. All other columns are
    passed through, but own columns n_lines and n_dropped are replaced; an empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession)
    n = F.size("words")
    lines = _bodies(documents).select("doc", "row", "line", _words(F.col("body")).alias("words"))
    halves = F.when(n >= options.words_per_edit, _half_keys(F.col("words"), n))
    lines = scratch.keep(lines.select(F.xxhash64("words").alias("h"), F.xxhash64(F.lit(7), "words").alias("g"), "doc", "row", "line", halves.alias("halves")))
    near = scratch.keep(_near(lines, documents, scratch)).withColumn("near", F.lit(True))
    every = lines.select("h", "g", _place().alias("place"))
    # Written first, so that the join below deals both sides anew and can split a line that is everywhere.
    verdict = every.groupBy("h", "g").agg(F.min("place").alias("earliest"), F.count("*").alias("times")).join(near, ["h", "g"], "left")
    verdict = scratch.keep(verdict.filter("times > 1 or near is not null").select("h", "g", "earliest", F.col("near").isNotNull().alias("near")))
    few = verdict.count() <= BROADCAST_ROWS
    every = every.join(F.broadcast(verdict) if few else verdict, ["h", "g"]).filter(F.col("near") | (F.col("place") != F.col("earliest")))
    gone = scratch.keep(every.groupBy("place.doc", "place.row").agg(F.sort_array(F.collect_set("place.line")).alias("gone")))
    scratch.drop(lines, verdict)
    # Own columns have names with a blank, so that no column of the documents clashes.
    keys, marked = ["line doc", "line row"], gone.select(F.col("doc").alias("line doc"), F.col("row").alias("line row"), F.col("gone").alias("lines gone"))
    docs = documents.withColumns({"line doc": _doc(), "line row": row_key("doc_id", "text")})
    # One plan at every size; both sides are scans, so a document that is repeated very often can be split.
    out = docs.join(marked, keys, "left").withColumn("lines gone", F.coalesce("lines gone", F.array().cast("array<int>")))
    body = F.split("text", "\n")
    edges = F.concat(F.array(F.lit(-1)), F.col("lines gone"), F.array(F.size(body)))
    between = F.transform(F.sequence(F.lit(0), F.size("lines gone")), lambda k: F.slice(F.col("lines all"), F.get("line edges", k) + 2, F.get("line edges", k + 1) - F.get("line edges", k) - 1))
    out = out.withColumns({"lines all": body, "line edges": edges})
    left = F.when(F.size("lines gone") == 0, F.col("text")).otherwise(F.array_join(F.flatten(between), "\n")).alias("text")
    worded = F.size(F.filter("lines all", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    names = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    counts = [F.when(F.col("text").isNull(), 0).otherwise(worded).cast("long").alias("n_lines"), F.size("lines gone").cast("long").alias("n_dropped")]
    return out.select(*[left if c == "text" else F.col(f"`{c}`") for c in names], *counts)
