"""Quality, language and language-model scores."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.language import Field, fit, languages, marginals
from tessera.llm import lm_score
from tessera.llm.lm_score import Backoff, scores
from tessera.llm.quality import QualityRules, _buckets, quality
from tessera.llm.words import Texts, U, mix
from tests.llm.cases import documents, nothing, words


def test_marginals_equal_plain_forward_backward():
    random = np.random.default_rng(1)
    first = np.array([0, 0, 5, 200, 329, 330])
    score, step = random.normal(size=(330, 3)), random.normal(size=(3, 3))
    got = marginals(score, first, step)
    for a, b in zip(first, first[1:]):
        if a == b:
            continue
        e, s = np.exp(score[a:b]), np.exp(step)
        ahead = [e[0] / e[0].sum()]
        for t in range(1, b - a):
            x = (ahead[-1] @ s) * e[t]
            ahead.append(x / x.sum())
        back = [np.ones(3)]
        for t in range(b - a - 2, -1, -1):
            x = s @ (e[t + 1] * back[0])
            back.insert(0, x / x.sum())
        want = np.array(ahead) * np.array(back)
        assert np.abs(want / want.sum(1, keepdims=True) - got[a:b]).max() < 1e-9


def test_language_of_odd_texts(spark):
    got = {r.doc_id: r for r in languages(documents(spark), Field(steps=10)).collect()}
    assert [got[i].lang_pred for i in (4, 5, 6, 9)] == ["und"] * 4
    assert got[1].lang_pred in ("en", "de") and 0 <= got[1].score <= 1
    assert got[1].held_out == (zlib.crc32(b"1") % 3 == 1) and not got[None].held_out
    assert languages(nothing(spark)).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = languages(docs, Field(steps=15)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_switched_text_is_labelled_word_by_word():
    model = fit([("aa", "ka ko ki ku ke " * 40), ("bb", "zan zen zin zon zun " * 40)], Field(steps=20))
    assert model.transitions[0, 0] > model.transitions[0, 1]


def test_quality_measures_equal_brute_force(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (7, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality(docs, labels, QualityRules(buckets=1 << 10)).collect()
    assert len(got) == docs.count()
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
    for r in docs.collect():
        w = words(r.text)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert want in found[r.doc_id]
    assert all(not r.kept for r in got if r.base_failed)


def test_quality_without_labels_or_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept != r.base_failed for r in quality(documents(spark), labels).collect())
    assert quality(nothing(spark), labels).count() == 0


@pytest.mark.parametrize("broadcast_ids", [1 << 20, 0])
def test_quality_fits_every_trusted_document(spark, broadcast_ids):
    n, size = 24_000, 1 << 10
    texts = [" ".join(f"{'good' if i % 3 else 'bad'}{(i * j) % 97}" for j in range(20 + i % 3)) for i in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    trusted = np.arange(n) % 12 != 0
    labels = spark.createDataFrame([(i, int(trusted[i]), 0) for i in range(n)], "doc_id long, quality int, toxic int")
    got = quality(docs, labels, QualityRules(buckets=size, quantile=0.0123, broadcast_ids=broadcast_ids)).orderBy("doc_id").toPandas()
    bucket, owner = _buckets(Texts(pa.array(texts)), size)
    out = mix(np.arange(n).view(U)) % U(4) == 0
    raw, target = np.bincount(bucket, minlength=size), np.bincount(bucket[(trusted & ~out)[owner]], minlength=size)
    weights = np.log((target + 1) / (target.sum() + size)) - np.log((raw + 1) / (raw.sum() + size))
    score = np.bincount(owner, weights[bucket]) / np.bincount(owner)
    assert np.abs(got.score - score).max() < 1e-9
    fine = ~got.base_failed.to_numpy()
    threshold = np.quantile(got.score[trusted & out & fine], 0.0123)
    assert trusted.sum() > 20_000 and (got.kept == fine & (got.score >= threshold)).all() and 0 < got.kept.sum() < fine.sum()


def plain_backoff(train, options):
    """The same model with dictionaries: log10 probability of a token list."""
    count = Counter(w for t in train for w in t)
    total, types = sum(count.values()), len(count)
    state = {w for w, c in count.items() if c >= options.state_share * total and w is not None}
    kept = {1: {(w,): c for w, c in count.items()}}
    floor = max(options.least_count, options.gram_share * total)
    for n in range(2, options.order + 1):
        found = Counter(tuple(t[i : i + n]) for t in train for i in range(len(t) - n + 1))
        ok = lambda g: (g[0] in state and (g[1] in state or g[1] is None)) if len(g) == 2 else (g[:-1] in kept[len(g) - 1] and g[1:] in kept[len(g) - 1])
        kept[n] = {g: c for g, c in found.items() if c >= floor and None not in g[:-1] and ok(g)}

    def p(g):
        if len(g) == 1:
            return max(kept[1].get(g, 0) - options.discount, 0) / total if g in kept[1] else options.discount * types / total
        if g in kept[len(g)]:
            return (kept[len(g)][g] - options.discount) / kept[len(g) - 1][g[:-1]]
        return back(g[:-1]) * p(g[1:])

    def is_state(h):
        return len(h) < options.order and (h[0] in state if len(h) == 1 else h in kept.get(len(h), {}))

    def back(h):
        if not is_state(h):
            return 1.0
        on = [g for g in kept[len(h) + 1] if g[:-1] == h]
        return (1 - sum(p(g) for g in on)) / (1 - sum(p(g[1:]) for g in on))

    def score(tokens):
        out = 0.0
        for i in range(len(tokens)):
            h = tuple(tokens[max(0, i - options.order + 1) : i])
            while h and not is_state(h):
                h = h[1:]
            out += math.log10(p((*h, tokens[i])))
        return out

    return score, count, total, types


def test_scores_equal_a_dictionary_model(spark):
    options = Backoff(order=3, state_share=1e-3, gram_share=1e-3)
    extra = [(50 + i, " ".join(f"t{(i * j * j) % 11}" for j in range(40)), "en", "a", 1) for i in range(30)]
    docs = documents(spark, extra)
    rows = [(r.doc_id, [*words(r.text, True), None]) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    score, count, total, types = plain_backoff([t for i, t in rows if not held(i)], options)
    got = scores(docs, options).collect()
    assert len(got) == len(rows)
    for r in got:
        w = [t for i, t in rows if i == r.doc_id and len(t) == r.n_tokens][0]
        assert r.held_out == held(r.doc_id) and r.train_tokens == total and r.n_known == sum(count[x] > 0 for x in w)
        assert abs(r.base_score - sum(math.log10((count[x] + 1) / (total + types + 1)) for x in w)) < 1e-6 * max(1, len(w))
        assert abs(r.score - score(w)) < 1e-6 * max(1, len(w))


@pytest.mark.parametrize("fan", [2, 3])
def test_scores_through_levels_equal_those_of_one_level(spark, monkeypatch, fan):
    """Tiny chunks and a tiny fan make several levels; the rows asked grow with the chunks, not with their square."""
    rows = [(i, " ".join(f"t{(i * j * j) % 23}" for j in range(60))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want = {r.doc_id: r.score for r in scores(docs).collect()}
    monkeypatch.setattr(lm_score, "PACK_BYTES", 400)
    monkeypatch.setattr(lm_score, "FAN", fan)
    counted = []
    plain = lm_score._exchange

    def exchange(asked, route, answer):
        counted.append((asked.count(), route))
        return plain(asked, route, answer)

    monkeypatch.setattr(lm_score, "_exchange", exchange)
    got = {r.doc_id: r.score for r in scores(docs).collect()}
    assert len(got) == 80 and all(abs(got[i] - want[i]) < 1e-4 for i in want)
    rows_asked, route = counted[0]
    assert route.chunks >= 20 and len(route.fans) >= 3 and rows_asked <= 3 * fan * route.chunks


def test_scores_of_nothing_and_without_training(spark):
    assert scores(nothing(spark)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = scores(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(True, 3, 0, 0, 0.0, 0.0)]


def test_repeated_grams_count_however_large_the_corpus(spark):
    """A rare word pair and triple in a long corpus, where a floor by share of the tokens would drop them."""
    filler = " ".join(f"f{i % 977} g{i % 13}" for i in range(60_000))
    rows = [(i, filler) for i in range(100, 112)] + [(i, f"rare{i % 3} pair{i % 3} here{i % 3}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: [*words(t, True), None] for i, t in rows}
    score, *_ = plain_backoff([tokens[i] for i, _ in rows if not held(i)], Backoff(state_share=0, gram_share=0))
    got = {r.doc_id: r.score for r in scores(docs).collect()}
    assert len(got) == len(rows)
    assert all(abs(got[i] - score(tokens[i])) < 1e-5 for i in range(40))


def test_rare_and_long_languages_are_learned_and_switching_is_kept(spark):
    from corpus_pipeline import language_id

    make = lambda parts, i, n: " ".join(parts[(i * 7 + j * j) % len(parts)] + parts[(i + j) % len(parts)] for j in range(n))
    kinds = {"aa": ["ka", "ko", "ki", "ku"], "bb": ["zan", "zen", "zin", "zon"], "cc": ["plu", "plo", "ple", "pli"], "dd": ["wey", "way", "wuy", "woy"]}
    rows = [(i, make(kinds["aa"], i, 30), "aa") for i in range(2000)]
    rows += [(3000 + i, make(kinds["bb"], i, 30), "bb") for i in range(6)]  # rare
    rows += [(4000 + i, make(kinds["cc"], i, 4000), "cc") for i in range(6)]  # long texts only
    rows += [(4500 + i, make(kinds["dd"], i, 30), "dd") for i in range(30)]
    switched = " ".join(make(kinds[k], 1, 20) for k in kinds)
    rows += [(5000, switched, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in languages(docs, Field(steps=15)).collect()}
    assert all(got[i] == lang for i, _, lang in rows if lang and i >= 2000)
    assert not language_id(spark, docs.filter("doc_id = 5000 or doc_id % 7 <> 0"), "").filter("doc_id = 5000").isEmpty()
