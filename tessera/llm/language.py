"""Language identification of code-switched text by a linear-chain conditional random field over words.

Every word has features of its bytes (affixes, n-grams inside the word) and of the lexicons that the training texts give for
each language; learned transitions tie the languages of neighbouring words. Forward-backward over a whole document gives each
word a distribution over languages, and their mean over the document's words decides.

The field is fitted on a bounded sample of labelled rows: about ``train_rows``, dealt to the languages by their share, but
``language_rows`` of each language or all that it has. Of a text longer than ``train_chars`` characters a stretch of that
length is taken, anywhere in it. The texts are cut into short runs of words, and runs of all languages are shuffled together,
so the field learns from switched text. Prediction is one map over the texts: emissions are computed once for each distinct word of a chunk,
and forward-backward runs over all documents of a chunk at once, in blocks of words whose transfer matrices join exactly, so
that a very long text does not cost one step for each of its words.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import checkpointed, crc_mod, in_small_batches
from tessera.llm.words import CHUNK_BYTES, PLACE, Texts, U, chunks, mix

#: Words in a block of the forward-backward pass, and sequences of the fit that are in memory at once.
BLOCK, SLICE = 64, 1024
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Field:
    buckets: int = 1 << 15
    affixes: tuple[int, ...] = (1, 2, 3, 4)
    grams: tuple[int, ...] = (2, 3)
    lexicon_count: int = 2
    train_rows: int = 600
    language_rows: int = 40
    train_chars: int = 20_000
    sure: float = 0.5
    run_words: int = 12
    sequence_words: int = 48
    steps: int = 40
    rate: float = 0.3
    seed: int = 5


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # bucket × label
    lexicon: np.ndarray  # sorted word hashes
    in_lexicon: np.ndarray  # word × language
    lexicon_weights: np.ndarray  # language × label
    transitions: np.ndarray  # label × label, as logarithms


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of each affix and n-gram of each word."""
    length = ends - starts
    every = np.arange(len(starts))
    buckets, words = [], []
    rows = data.astype(U)

    def add(at: np.ndarray, word: np.ndarray, n: int, kind: int) -> None:
        total = np.full(len(at), U(kind << 8 | n))
        for k in range(n):
            total += rows[at + k] * PLACE[k]
        buckets.append((mix(total) % U(field.buckets)).astype(np.int32))
        words.append(word.astype(np.int32))

    for n in field.affixes:
        long_ = every[length >= n]
        add(starts[long_], long_, n, 1)
        add(ends[long_] - n, long_, n, 2)
    for n in field.grams:
        count = np.maximum(length - n + 1, 0)
        word = np.repeat(every, count)
        begin = np.cumsum(count) - count
        add(starts[word] + np.arange(len(word)) - begin[word], word, n, 3)
    return np.concatenate(buckets), np.concatenate(words)


def _lexicon_places(lexicon: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each word in the lexicon, or −1."""
    if not len(lexicon):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return np.where(lexicon[at] == hashes, at, -1)


def emissions(model: Model, bucket: np.ndarray, word: np.ndarray, n: int, place: np.ndarray) -> np.ndarray:
    """Score of each label for each of n words."""
    out = np.stack([np.bincount(word, model.weights[bucket, k], n) for k in range(len(model.labels))], 1)
    known = place >= 0
    out[known] += model.in_lexicon[place[known]] @ model.lexicon_weights
    return out


def _unit(x: np.ndarray, *axes: int) -> np.ndarray:
    return x / np.maximum(x.sum(axis=axes, keepdims=True), 1e-300)


def marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward: the distribution over labels of each word; ``first[i]:first[i + 1]`` are the words of text i."""
    n, labels = scores.shape
    if not n:
        return scores
    emit = np.exp(scores - scores.max(1, keepdims=True))
    step = np.exp(transitions - transitions.max())
    sizes = np.diff(first)
    texts = np.flatnonzero(sizes)
    blocks_of = -(-sizes[texts] // BLOCK)
    head = np.cumsum(blocks_of) - blocks_of  # the first block of each text
    count = int(blocks_of.sum())
    text = np.repeat(np.arange(len(texts)), blocks_of)
    number = np.arange(count) - head[text]
    begin = first[texts][text] + number * BLOCK
    size = np.minimum(BLOCK, first[texts + 1][text] - begin)
    opens = number == 0

    def at(t: int) -> tuple[np.ndarray, np.ndarray]:
        live = np.flatnonzero(size > t)
        return live, emit[begin[live] + t]

    transfer = np.broadcast_to(np.eye(labels), (count, labels, labels)).copy()
    for t in range(BLOCK):
        live, e = at(t)
        moved = transfer[live] @ step
        if t == 0:
            moved[opens[live]] = transfer[live[opens[live]]]
        transfer[live] = _unit(moved * e[:, None, :], 1, 2)
    into = np.ones((count, labels))  # forward message into each block
    behind = np.ones((count, labels))  # backward message out of each block
    for k in range(1, int(blocks_of.max())):
        here = head[blocks_of > k] + k
        into[here] = _unit((into[here - 1][:, None, :] @ transfer[here - 1])[:, 0], 1)
        back = (head + blocks_of - 1 - k)[blocks_of > k]
        behind[back] = _unit((transfer[back + 1] @ behind[back + 1][:, :, None])[:, :, 0], 1)
    out = np.empty((n, labels))
    state = into
    for t in range(BLOCK):
        live, e = at(t)
        moved = state[live] @ step
        if t == 0:
            moved[opens[live]] = state[live[opens[live]]]
        state[live] = _unit(moved * e, 1)
        out[begin[live] + t] = state[live]
    state = behind
    for t in range(BLOCK - 1, -1, -1):
        live, e = at(t)
        out[begin[live] + t] *= state[live]
        state[live] = _unit((e * state[live]) @ step.T, 1)
    return _unit(out, 1)


def fit(rows: list[tuple[str, str]], field: Field) -> Model:
    """The field fitted to (language, text) rows by gradient steps on the conditional likelihood."""
    labels = sorted({lang for lang, _ in rows})
    size = len(labels)
    texts = Texts(pa.array([text for _, text in rows], pa.large_string()), lower=True)
    lettered = _lettered(texts)
    label = np.array([labels.index(lang) for lang, _ in rows], np.int64)[texts.owner][lettered] if rows else np.empty(0, np.int64)
    hashes = texts.hashes[lettered]
    lexicon, word = np.unique(hashes, return_inverse=True)
    counts = np.zeros((len(lexicon), size), np.int64)
    np.add.at(counts, (word, label), 1)
    kept = counts.max(1, initial=0) >= field.lexicon_count
    model = Model(labels, np.zeros((field.buckets, size)), lexicon[kept], (counts[kept] >= field.lexicon_count).astype(float), np.zeros((size, size)), np.zeros((size, size)))
    if size < 2:
        return model
    # Runs of one text, shuffled over all languages, in sequences of one length.
    owner = texts.owner[lettered]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    run = np.cumsum(np.concatenate(([0], (np.diff(owner) != 0) | (place[1:] % field.run_words == 0)))) if len(owner) else owner
    random = np.random.default_rng(field.seed)
    order = np.argsort(random.permutation(run[-1] + 1)[run], kind="stable")
    order = order[: len(order) // field.sequence_words * field.sequence_words]
    if not len(order):
        order = np.arange(len(owner))
    shape = (-1, field.sequence_words) if len(order) >= field.sequence_words else (1, len(order))
    truth = label[order].reshape(shape)
    # Features once for each distinct word.
    _, at, of = np.unique(hashes[order], return_index=True, return_inverse=True)
    of = of.reshape(truth.shape)
    spans = np.flatnonzero(lettered)[order][at]
    bucket, owner_word = features(texts.data, texts.starts[spans], texts.ends[spans], field)
    lex = _lexicon_places(model.lexicon, hashes[order][at])
    share = np.bincount(label, minlength=size).astype(float)
    weight = (share.sum() / (size * share))[truth][..., None]  # languages count alike
    moments = [np.full(x.shape, 1e-8) for x in (model.weights, model.lexicon_weights, model.transitions)]
    onehot = np.eye(size)
    for _ in range(field.steps):
        scores = emissions(model, bucket, owner_word, len(at), lex)
        by_word, pairs = np.zeros((len(at), size)), np.zeros((size, size))
        for k in range(0, len(truth), SLICE):
            part = slice(k, k + SLICE)
            posterior, met = _expectations(scores[of[part]], model.transitions, weight[part])
            lack = ((onehot[truth[part]] - posterior) * weight[part]).reshape(-1, size)
            by_word += np.stack([np.bincount(of[part].ravel(), lack[:, k], len(at)) for k in range(size)], 1)
            pairs += met
        known = lex >= 0
        seen = np.zeros((size, size))
        np.add.at(seen, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), weight[:, 1:, 0].ravel())
        slopes = (
            np.stack([np.bincount(bucket, by_word[owner_word, k], field.buckets) for k in range(size)], 1),
            model.in_lexicon[lex[known]].T @ by_word[known],
            seen - pairs,
        )
        for value, slope, moment in zip((model.weights, model.lexicon_weights, model.transitions), slopes, moments):
            slope = slope / truth.size - 1e-6 * value
            moment += slope**2
            value += field.rate * slope / np.sqrt(moment)
    return model


def _expectations(scores: np.ndarray, transitions: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label distributions of each word, and the weighted expected transitions, for sequences of one length."""
    emit, step = np.exp(scores - scores.max(-1, keepdims=True)), np.exp(transitions)
    ahead, back = np.empty_like(emit), np.ones_like(emit)
    ahead[:, 0] = _unit(emit[:, 0], 1)
    for t in range(1, emit.shape[1]):
        ahead[:, t] = _unit((ahead[:, t - 1] @ step) * emit[:, t], 1)
    for t in range(emit.shape[1] - 2, -1, -1):
        back[:, t] = _unit((emit[:, t + 1] * back[:, t + 1]) @ step.T, 1)
    pairs = np.zeros_like(step)
    for t in range(1, emit.shape[1]):
        joint = ahead[:, t - 1, :, None] * step * (emit[:, t] * back[:, t])[:, None, :]
        pairs += (_unit(joint, 1, 2) * weight[:, t, :, None]).sum(0)
    return _unit(ahead * back, 2), pairs


def _lettered(texts: Texts) -> np.ndarray:
    """Whether each word has a letter, by its bytes (any byte beyond ASCII counts)."""
    total = np.concatenate(([0], np.cumsum(LETTER[texts.data])))
    return total[texts.ends] > total[texts.starts]


PREDICTIONS = "doc_id long, held_out boolean, lang_pred string, score double"


def _predict(batches: Iterator[pa.RecordBatch], model: Model, field: Field, keep: tuple[str, ...] = ("doc_id", "held_out"), names: tuple[str, ...] = ("lang_pred", "score")) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text", CHUNK_BYTES):
            texts = Texts(part.column("text"), lower=True)
            lettered = np.flatnonzero(_lettered(texts))
            first = np.searchsorted(lettered, texts.first)
            size = np.diff(first)
            # A text of other signs beyond ASCII may still have no letter.
            plain = np.concatenate(([0], np.cumsum(LETTER[texts.data] & (texts.data < 128))))[texts.offsets]
            for i in np.flatnonzero((size > 0) & (np.diff(plain) == 0)):
                if not any(c.isalpha() for c in part.column("text")[int(i)].as_py()):
                    size[i] = 0
            mean = np.zeros((len(texts), max(1, len(model.labels))))
            sure = np.zeros(len(texts))
            if len(lettered) and model.labels:
                _, at, of = np.unique(texts.hashes[lettered], return_index=True, return_inverse=True)
                bucket, word = features(texts.data, texts.starts[lettered[at]], texts.ends[lettered[at]], field)
                each = emissions(model, bucket, word, len(at), _lexicon_places(model.lexicon, texts.hashes[lettered[at]]))
                found = marginals(each[of], first, model.transitions)
                some = np.flatnonzero(size)
                total = np.concatenate((np.zeros((1, found.shape[1])), np.cumsum(found, 0)))
                mean[some] = (total[first[some + 1]] - total[first[some]]) / size[some, None]
                clear = np.concatenate(([0], np.cumsum(found.max(1) >= field.sure)))
                sure[some] = (clear[first[some + 1]] - clear[first[some]]) / size[some]
            best = mean.argmax(1)
            known = (size > 0) & bool(model.labels)
            told = [pa.array([model.labels[b] if k else "und" for b, k in zip(best, known)], pa.string()), pa.array(np.where(known, np.clip(mean.max(1), 0, 1), 0.0)), pa.array(sure)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *told[: len(names)]], names=[*keep, *names])


def fitted(documents: DataFrame, field: Field = Field(), modulus: int = 3, remainder: int = 1) -> Model:
    """The field fitted to a sample of the labelled documents that are not held out."""
    labelled = documents.filter(F.coalesce(crc_mod("doc_id", modulus) != remainder, F.lit(True)) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sample = _sample(labelled.select("doc_id", "text", "lang"), field)
    # Fitted in a task, so that the driver holds no texts and none of the arrays; what comes back is the model.
    found = sample.select("lang", "text").mapInArrow(lambda b: _fit(b, field), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], field)


def _sample(usable: DataFrame, field: Field) -> DataFrame:
    """Rows of every language by the smallest hash, long texts cut to a stretch that the hash places."""
    counts = checkpointed(usable.groupBy("lang").agg(F.count("*").alias("rows")))
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    share = F.ceil(F.col("rows") * field.train_rows / F.lit(max(total, 1)))
    counts = counts.withColumn("quota", F.greatest(share, F.lit(field.language_rows)))
    order = F.xxhash64("doc_id", "text", "lang")
    # Only rows of small hash reach the window: a few times the quota of each language.
    near = usable.join(F.broadcast(counts), "lang").withColumn("order", order).filter(F.shiftrightunsigned("order", 32) < 4 * F.col("quota") / F.col("rows") * (1 << 32))
    places = Window.partitionBy("lang").orderBy("order", "doc_id", "text")
    spare = F.length("text") - field.train_chars
    stretch = F.substring("text", (F.pmod("order", spare + 1) + 1).cast("int"), F.lit(field.train_chars))
    # Words that the stretch cuts go, unless they are all of it.
    whole = F.regexp_replace(stretch, r"^[^\x20\x09-\x0D]*[\x20\x09-\x0D]|[\x20\x09-\x0D][^\x20\x09-\x0D]*$", "")
    near = near.withColumn("text", F.when(spare > 0, whole).otherwise(F.col("text")))
    taken = near.withColumn("place", F.row_number().over(places)).filter(F.col("place") <= F.col("quota"))
    # One order and one partition, so that a rerun fits alike.
    return taken.orderBy("order", "doc_id", "lang", "text").coalesce(1)


def _fit(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    rows = [(lang, text) for batch in batches for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist())]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows, field))], pa.binary())], names=["model"])


def languages(documents: DataFrame, field: Field = Field(), modulus: int = 3, remainder: int = 1, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``documents`` (doc_id, text, lang; other columns are ignored).

    Held out are documents whose crc32(doc_id) mod ``modulus`` is ``remainder``; they and rows without lang are not learned
    from, and no prediction looks at lang, source or doc_id. ``score`` is the mean probability of the predicted language over
    the words that have letters. Null, empty and letterless texts are ``und`` with score 0, as is every text if there is
    nothing to learn from. A null doc_id is not held out. Repeated rows are predicted alike; an empty table gives no rows.
    """
    model = fitted(documents, field, modulus, remainder) if model is None else model
    held = documents.sparkSession.sparkContext.broadcast(model)
    docs = in_small_batches(documents).select("doc_id", "text", F.coalesce(crc_mod("doc_id", modulus) == remainder, F.lit(False)).alias("held_out"))
    return docs.mapInArrow(lambda b: _predict(b, held.value, field), PREDICTIONS)


def with_language(documents: DataFrame, names: tuple[str, str, str], field: Field = Field(), model: Model | None = None) -> DataFrame:
    """The rows of ``documents`` with all their columns and, under ``names``, the predicted language, its score, and the share of
    words (with letters) that are of some one language with a probability of ``sure``."""
    model = fitted(documents, field) if model is None else model
    held = documents.sparkSession.sparkContext.broadcast(model)
    keep = tuple(documents.columns)
    schema = T.StructType([*documents.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.DoubleType())])
    return in_small_batches(documents).mapInArrow(lambda b: _predict(b, held.value, field, keep, names), schema)
