"""Near-duplicates and line dedup against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import near_dedup
from tessera.llm.components import components
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.near_dedup import _delta_pairs, near_duplicates
from tests.llm.cases import documents, nothing, words


def plain_components(rows):
    sets = []
    for _, text in rows:
        w = words(text, True)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                a, b = sets[i], sets[j]
                if a and b and 100 * len(a & b) >= 75 * len(a | b) and label[i] != label[j]:
                    low = min(label[i], label[j])
                    label[i] = label[j] = low
                    changed = True
    out = {}
    for k, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        out.setdefault((doc_id, len(sets[k])), set()).add(min(ids) if ids else None)
    return out


def varied(seed, n):
    """A family of texts whose copies differ more and more, so that similarities lie on both sides of the threshold."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(400)}" for _ in range(80)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(draw.randrange(7)):
            w[draw.randrange(len(w))] = f"x{draw.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    return rows


def test_near_duplicates_equal_brute_force(spark):
    extra = [(i, t, "en", "a", 1) for i, t in varied(3, 60)]
    docs = documents(spark, extra)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_components(rows)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert want[r.doc_id, r.n_shingles] == {r.component_id}
        assert r.kept == (r.doc_id == r.component_id)


def test_one_large_group_on_both_sides_of_the_threshold(spark):
    """Copies of one text with more and more changed words: many are linked with none, though all meet in every bucket."""
    draw = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(draw.randrange(9)):
            w[draw.randrange(len(w))] = f"x{draw.randrange(40)}"
        rows.append((i, " ".join(w)))
    want = plain_components(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(want[r.doc_id, r.n_shingles] == {r.component_id} for r in got)


def test_candidates_of_differences_hold_every_link_and_few_pairs(spark):
    """Sets around a head that none of them is linked with: of 300 such sets, only those that can be linked meet."""
    draw = random.Random(3)
    head, sets = set(range(140)), []
    for i in range(300):
        gone = set(draw.sample(range(140), 26))
        own = {10_000 + 100 * (i // 2) + k for k in range(22)} | {90_000 + 10 * i + k for k in range(4)}
        sets.append((head - gone if i % 2 == 0 else sets[-1] & head) | own)
    rows = [(bytes([i // 256, i % 256]), b"p", bytes([i // 256, i % 256]), len(s), sorted(head ^ s)) for i, s in enumerate(sets)]
    deltas = spark.createDataFrame(rows, "a binary, head binary, label binary, n int, delta array<long>")
    found = {tuple(sorted((int.from_bytes(r.a), int.from_bytes(r.b)))) for r in _delta_pairs(deltas, 75).collect()}
    linked = {(i, j) for j in range(300) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert linked and linked <= found and len(found) <= 600


def templated(n, content, template=375, seed=0):
    """Pages of one template, each with its own words behind it."""
    frame = [f"t{i}" for i in range(template + 4)]
    return [(i, " ".join([*frame, *(f"c{seed}_{i}_{k}" for k in range(content(i)))])) for i in range(n)]


def joined_rows(spark, monkeypatch, rows):
    """Near-duplicates of the texts, and how many rows the lists of step 4 and 5 have as pairs."""
    made = []
    met = near_dedup._met

    def counted(prefixes, enough, percent):
        lists = prefixes.groupBy("head", "shingle").count()
        made.append(lists.agg(F.coalesce(F.sum(F.col("count") * F.col("count")), F.lit(0))).first()[0])
        return met(prefixes, enough, percent)

    monkeypatch.setattr(near_dedup, "_met", counted)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return found, sum(made)


@pytest.mark.parametrize("content", [lambda i: 125, lambda i: 126 + i * 7 % 40], ids=["one size", "many sizes"])
def test_pages_of_one_template_meet_in_no_pairs(spark, monkeypatch, content):
    for n in (150, 300):
        rows = templated(n, content) + [(n + i, text + " tail") for i, (_, text) in enumerate(templated(5, content))]
        found, made = joined_rows(spark, monkeypatch, rows)
        assert {r.doc_id: r.component_id for r in found} == {**{i: i for i in range(n)}, **{n + i: i for i in range(5)}}
        assert made <= 20 * n


def test_templates_with_links_across_sizes(spark, monkeypatch):
    """Little content and much of it, so that some pages are linked through the template and some by their own words."""
    draw = random.Random(5)
    rows = templated(60, lambda i: 20 + i * 37 % 200, template=200)
    rows += [(100 + i, " ".join(w for w in t.split() if draw.random() > 0.01)) for i, t in rows[::3]]
    rows += [(200 + i, " ".join(t.split()[: draw.randrange(150, 260)])) for i, t in rows[:20]]
    found, _ = joined_rows(spark, monkeypatch, rows)
    want = plain_components(rows)
    assert all(want[r.doc_id, r.n_shingles] == {r.component_id} for r in found) and len({r.component_id for r in found}) > 10


@pytest.mark.parametrize("seed", range(4))
def test_random_families_equal_brute_force(spark, seed):
    draw = random.Random(seed)
    base = [[f"b{g}_{i}" for i in range(draw.randrange(30, 120))] for g in range(3)]
    rows = []
    for i in range(160):
        w = list(draw.choice(base))
        for _ in range(draw.randrange(6)):
            at, kind = draw.randrange(len(w)), draw.randrange(4)
            if kind == 0:
                w[at] = f"x{draw.randrange(30)}"
            elif kind == 1:
                w.insert(at, f"y{draw.randrange(30)}")
            elif kind == 2:
                del w[at : at + draw.randrange(12)]
            else:
                w[at:at] = draw.choice(base)[: draw.randrange(15)]
        rows.append((i, " ".join(w)))
    want = plain_components(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(want[r.doc_id, r.n_shingles] == {r.component_id} for r in got)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(nothing(spark)).count() == 0


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_hub_and_chain(spark):
    edges = [(0, i) for i in range(1, 50)] + [(100 + i, 101 + i) for i in range(30)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(50)) and all(found[100 + i] == 100 for i in range(31))


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long_ = sorted((a, b), key=len)
    return len(long_) - len(short) == 1 and any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def plain_lines(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    before, out = [], {}
    for doc_id, text in order:
        if (doc_id, text) in out:
            continue
        kept = []
        for line in (text or "").split("\n"):
            w = words(line)
            if w and any(w == v or (min(len(w), len(v)) >= 8 and one_edit(w, v)) for v in before):
                before.append(w)
                continue
            if w:
                before.append(w)
            kept.append(line)
        out[doc_id, text] = None if text is None else "\n".join(kept)
    return out


def test_line_dedup_equals_brute_force(spark):
    draw = random.Random(5)
    base = [[f"v{draw.randrange(50)}" for _ in range(draw.randrange(6, 14))] for _ in range(12)]
    extra = []
    for i in range(40):
        lines = []
        for _ in range(4):
            w = list(draw.choice(base))
            for _ in range(draw.randrange(3)):
                k = draw.randrange(len(w))
                w[k : k + draw.randrange(2)] = [f"n{draw.randrange(30)}"] * draw.randrange(2)
            lines.append(draw.choice(["", " "]) + draw.choice([" ", "  "]).join(w))
        extra.append((2000 + i, "\n".join(lines), "en", "a", 1))
    docs = documents(spark, extra)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_lines(rows)
    got = dedup_lines(docs)
    assert set(docs.columns) <= set(got.columns)
    got = got.collect()
    assert len(got) == len(rows)
    left = {}
    for r in got:
        left.setdefault(r.doc_id, set()).add(r.text)
    for (doc_id, _), text in want.items():
        assert text in left[doc_id]
    assert {r.doc_id: r.n_dropped for r in got}[8] == 1


def test_line_dedup_of_nothing(spark):
    assert dedup_lines(nothing(spark)).count() == 0


@pytest.mark.parametrize("copies", [300])
def test_many_near_lines_of_one_place(spark, copies):
    docs = spark.createDataFrame([(i, f"this is the line number {i} of a long list of them") for i in range(copies)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert got[0] and not any(got[i] for i in range(1, copies))
