"""Filter audit, byte-level BPE and source divergence, each against SQL or a plain version."""

import hashlib
import random
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.byte_bpe import Coder, Prefixes, Tokenizer, Vocabulary, read_ranks
from tessera.llm.divergence import Divergence, Terms, divergence, document_sketch, kept_terms
from tessera.llm.filter_audit import BitmapIndex, audit, filter_interactions
from tessera.llm.registry import ORACLES, QUERIES
from tests.llm.cases import documents, nothing

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def by_sql(name, **tables):
    """The oracle's rows over these pandas tables, by column name."""
    con = duckdb.connect()
    for table, frame in tables.items():
        con.register(table, frame)
    found = con.sql(ORACLES[name])
    return sorted(tuple(dict(zip(found.columns, r))[c] for c in sorted(found.columns)) for r in found.fetchall())


def plain(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def arrow(df):
    return df.toArrow()


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_source_divergence"])
def test_query_against_sql(spark, name):
    read = lambda t: arrow(spark.read.parquet(f"{SMALL}/{t}.parquet"))
    want = by_sql(name, documents=read("documents"), labels=read("labels"))
    assert want and plain(QUERIES[name](spark, SMALL)) == want


HOSTILE = [
    (20, "Word " * 60, "en", "a", 1),
    (21, "Word " * 60, "en", None, 1),
    (22, "Word " * 60, None, "", 1),
    (23, "# short", "en", "a", 1),
    (24, "ABC DEF", "en", "only one", 1),
    (25, " ".join(f"été{i % 9} Ünï x_y z-w" for i in range(90)), "fr", "a", 1),
    (26, " ".join(f"été{i % 7} ünï x_y z-w" for i in range(90)), "fr", "b", 1),
    (27, "ünï été1\x7f\x00x été1", "fr", "c", 1),
    (28, "12 34 --", "fr", "d", 1),
    (29, "12 34", "zz", "d", 1),
    (30, "", "zz", "e", 1),
    (21, "Word " * 60, "en", None, 1),
]


def labelled(spark):
    rows = [(1, 1, 0), (2, 0, 1), (20, 1, 1), (21, None, 1), (21, 1, None), (23, 1, 0), (None, 1, 1), (999, 1, 1), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_filter_audit_of_odd_rows(spark):
    docs, labels = documents(spark, HOSTILE), labelled(spark)
    want = by_sql("op11_filter_audit", documents=arrow(docs), labels=arrow(labels))
    assert plain(filter_interactions(docs, labels)) == want
    assert plain(filter_interactions(docs, labels.limit(0))) == by_sql("op11_filter_audit", documents=arrow(docs), labels=arrow(labels.limit(0)))
    assert filter_interactions(nothing(spark), labels).count() == 0


def test_bitmaps_count_like_a_loop():
    draw = random.Random(5)
    parts = [draw.choice(["a", "b", "", "only"][: 3 + (i > 700)]) for i in range(1000)]
    flags = np.array([draw.randrange(32) for _ in parts], np.int32)
    index = BitmapIndex(pa.array(parts), flags, 5)
    got = dict(zip(index.parts.to_pylist(), index.count(index.bitmaps[0] & ~index.bitmaps[3])))
    assert got == {p: sum(q == p and f & 1 and not f & 8 for q, f in zip(parts, flags.tolist())) for p in set(parts)}
    assert dict(zip(index.parts.to_pylist(), index.count(index.rows))) == {p: parts.count(p) for p in set(parts)}


def test_audit_of_three_filters_in_every_order(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["x", "y", None]), *(draw.random() < 0.4 for _ in range(3)), draw.choice([True, False, None])) for _ in range(400)]
    frame = spark.createDataFrame(rows, "part string, p boolean, q boolean, r boolean, good boolean").repartition(5)
    got = {(r.part, r.filter_order, r.step): r for r in audit(frame, {"P": "p", "Q": "q", "R": "r"}, {"good_lost": "good"}).collect()}
    assert len(got) == 3 * 6 * 3
    total = {}
    for part in ("x", "y", ""):
        for order in permutations("PQR"):
            left = [r for r in rows if (r[0] or "") == part]
            here = list(left)
            for step, name in enumerate(order, 1):
                k = "PQR".index(name) + 1
                out, gone = [r for r in left if r[k]], [r for r in here if r not in left]
                r = got[part, "".join(order), step]
                assert r.removed == len(out) and r.kept == len(left) - len(out) and r.good_lost == sum(bool(x[4]) for x in out)
                assert r.redundant == sum(x[k] for x in here) - len(out) == sum(x[k] for x in gone)
                assert r.unique_fails == sum(x[k] and sum(x[1:4]) == 1 for x in here)
                total[part, name] = total.get((part, name), 0) + len(out)
                left = [r for r in left if not r[k]]
    for (part, order, step), r in got.items():
        assert r.shapley == total[part, order[step - 1]]


@pytest.fixture(scope="module")
def coder():
    return Coder(Vocabulary(read_ranks(PATH), public_tokenizers.PATTERN))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def numbers(ids):
    return np.frombuffer(ids, "<u4").tolist()


PIECES = st.sampled_from(["the", " the", "'s", "'", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "漢字", "😀", "a", "b", "ing", "!!", "　", "\x00", "zzzzz", "straße", " \n "])
TEXT = st.lists(st.one_of(PIECES, st.text(max_size=5)), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encoding_is_the_library_s(coder, library, text):
    ids = coder.encode(text)
    assert numbers(ids) == library.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT, st.integers(0, 40), st.integers(0, 9))
def test_reencoding_near_edits_is_exact(coder, old, more, start, gone):
    new = old[:start] + more + old[start + gone :]
    for a, b in ((old, new), (new, old), (old, old + more), (old + more, old)):
        assert coder.reencode(a, coder.encode(a), b) == coder.encode(b)


@settings(max_examples=200, deadline=None)
@given(st.text("abcdest é", max_size=120), st.text("abcdest é", max_size=20), st.integers(0, 130), st.integers(0, 9))
def test_prefixes_grow_and_change(coder, old, more, start, gone):
    whole = lambda data: Prefixes(coder.vocabulary, data)
    data, new = old.encode(), more.encode()
    grown = whole(data)
    grown.append(new)
    assert grown.last == whole(data + new).last
    changed, start = whole(data), min(start, len(data))
    changed.replace(start, min(start + gone, len(data)), new)
    want = whole(data[:start] + new + data[start + gone :])
    assert changed.data == want.data and changed.last == want.last


def test_an_edit_in_a_long_run_is_local(coder, library):
    draw = random.Random(1)
    data = "".join(draw.choice("abcdefgh") for _ in range(20_000)).encode()
    table = Prefixes(coder.vocabulary, data)
    assert table.tokens() == library.encode_ordinary(data.decode())
    assert table.replace(9_000, 9_003, b"xyz") < 300
    assert table.tokens() == library.encode_ordinary(table.data.decode())


def merged(ranks, data):
    """Plain merging: the pair of lowest rank, leftmost first."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def test_small_vocabularies_against_merging():
    for seed in range(30):
        draw = random.Random(seed)
        some = lambda n: bytes(draw.choice(b"abc") for _ in range(draw.randrange(2, n)))
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 256 + 60:  # a pair that meets in an encoding, as in training
            parts = merged(ranks, some(30))
            if len(parts) > 1:
                i = draw.randrange(len(parts) - 1)
                ranks[parts[i] + parts[i + 1]] = len(ranks)
        vocabulary = Vocabulary(ranks, r"\S+").checked()
        for _ in range(20):
            data = some(60)
            assert Prefixes(vocabulary, data).tokens() == [ranks[p] for p in merged(ranks, data)], (seed, data)


def test_ranks_that_no_training_makes_are_refused():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abcd": 257}
    with pytest.raises(ValueError):
        Vocabulary(ranks, ".").checked()
    with pytest.raises(ValueError):
        Vocabulary({b"a": 0}, ".")


def test_tables_of_texts(spark, library):
    docs = documents(spark, HOSTILE)
    tokenizer = Tokenizer(spark, PATH, public_tokenizers.PATTERN)
    coded = tokenizer.encoded(docs)
    assert coded.columns == ["doc_id", "lang", "source", "n_chars", "score", "row", "size", "kept", "ids"]
    found = sorted((str(r.doc_id), numbers(r.ids)) for r in coded.collect())
    assert found == sorted((str(r.doc_id), library.encode_ordinary(r.text or "")) for r in docs.collect())
    back = tokenizer.decoded(coded, data="text")
    assert sorted((str(r.doc_id), bytes(r.text).decode()) for r in back.collect()) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    edits = docs.select("doc_id", "text").join(coded.select("doc_id", "ids"), "doc_id").selectExpr("doc_id", "text", "ids", "concat('new ', text, ' end') AS new_text")
    again = {r.doc_id: numbers(r.ids) for r in tokenizer.reencoded(edits).collect()}
    assert again == {r.doc_id: library.encode_ordinary(r.new_text or "") for r in edits.collect()}
    assert tokenizer.encoded(nothing(spark)).count() == 0


def test_digests_of_whole_texts(spark, library):
    got = {r.doc_id: r for r in QUERIES["op12_byte_bpe"](spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_terms_of_a_chunk():
    texts = ["Äb-cD x1y", "", None, "\x00a\x7fb", "ab", "cd", "é"]
    terms = Terms(pa.array(texts))
    found = [(o, terms.words[c].as_py()) for o, c in zip(terms.owner, terms.code)]
    assert found == [(0, "Äb"), (0, "cd"), (0, "x"), (0, "y"), (3, "a"), (3, "b"), (4, "ab"), (5, "cd"), (6, "é")]
    assert len(Terms(pa.array([], pa.string())).code) == len(Terms(pa.array([None, "1"])).hashes()) == 0


def test_divergence_of_odd_rows(spark):
    docs = documents(spark, [*HOSTILE, *HOSTILE])
    want = by_sql("op13_source_divergence", documents=arrow(docs))
    assert plain(divergence(docs)) == want
    assert divergence(nothing(spark)).count() == 0


def test_ranks_are_cut_per_group(spark):
    docs = spark.createDataFrame([(i, " ".join(f"t{'x' * (k % 40)}{chr(97 + k // 40)}" for k in range(900) if k % 2 == i % 2 or k % 5 == 0), "en", "ab"[i % 2]) for i in range(12)], "doc_id long, text string, lang string, source string")
    for top in (1, 7, 200):
        rows = [r for r in divergence(docs, Divergence(top_terms=top)).collect() if r.part == "term"]
        assert sorted(r.rank for r in rows if r.source == "a") == list(range(1, top + 1))


def test_the_sketch_only_ever_discards_rare_terms(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("coalesce(text, '') AS text", "coalesce(lang, '') AS lang", "coalesce(source, '') AS source")
    exact = plain(kept_terms(docs))
    narrow = Divergence(depth=1, most_cells=1 << 16)  # many terms share a cell: more get through, the result is the same
    assert plain(kept_terms(docs, narrow)) == exact
    sketch = document_sketch(docs.repartition(7), Divergence(), 1 << 16)
    terms = Terms(pa.array([t for _, _, _, _, _, t in exact]))
    from tessera.llm.divergence import _lang_hashes

    for (_, _, lang, _, _, term) in exact[:500]:
        one = Terms(pa.array([term]))
        assert sketch.may_reach(_lang_hashes(pa.array([lang])), one.hashes()).all()
    never = Terms(pa.array(["neverseenterm" + "q" * i for i in range(50)]))
    assert len(terms.words) and not sketch.may_reach(_lang_hashes(pa.array(["en"] * 50)), never.hashes()).all()
