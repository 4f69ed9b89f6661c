"""Language of texts by a linear-chain conditional random field over their words.

A word's label scores are sums of learned weights of its prefixes, suffixes, character n-grams
and, if it is in the learned lexicon, of the word itself; labels of neighbouring words are joined by
learned transitions. Training chains are put together from stretches of different documents, so
switches between languages are in them. Posteriors of all words come from forward-backward.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from caseframe.llm import words as wd
from caseframe.llm.shared import giving_back, ship, slices

UNKNOWN = "und"
#: Bounds of the training sample: labelled rows of a language, their characters, languages in all,
#: and words of a language that training uses.
ROWS_PER_LANGUAGE, ROW_CHARS, SAMPLE_ROWS, WORDS_PER_LANGUAGE = 150, 20_000, 30_000, 16_000
BUCKETS = 1 << 16
AFFIXES = (2, 3, 4)
LEXICON_COUNT = 3
CHAIN, STRETCH = 64, (3, 25)
EPOCHS, BATCH, RATE, DECAY = 6, 128, 0.25, 1e-3
#: A long text is cut into parts of this many words, each read with the words around it.
PART, CONTEXT = 96, 16


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray      # buckets x languages
    lexicon: np.ndarray      # sorted hashes of words
    lexicon_weights: np.ndarray
    transitions: np.ndarray  # from x to, log scale


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ASCII_LETTER = _LETTER & (np.arange(256) < 128)


def _any(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the mask is set anywhere from start to end."""
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[ends] > total[starts]


def _cores(found: wd.Words) -> wd.Words:
    """The words from their first to their last letter; words without letters stay as they are."""
    letters = _LETTER[found.data]
    at = np.arange(len(letters))
    following = np.minimum.accumulate(np.where(letters, at, len(letters))[::-1])[::-1]
    preceding = np.maximum.accumulate(np.where(letters, at, -1))
    held = _any(letters, found.starts, found.ends)
    starts, ends = found.starts.copy(), found.ends.copy()
    starts[held] = following[found.starts[held]]
    ends[held] = preceding[found.ends[held] - 1] + 1
    return found._replace(starts=starts, ends=ends)


def _bucket(values: np.ndarray, kind: int) -> np.ndarray:
    spread = (values.astype(np.uint64) + np.uint64(kind << 40)) * np.uint64(0x9E3779B97F4A7C15)
    return (spread >> np.uint64(48)).astype(np.int64)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Buckets of the n-grams of all words, their number per word, and affix buckets per word."""
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths)])
    within = np.arange(at[-1]) - np.repeat(at[:-1], lengths)
    padded = np.concatenate([[0], np.cumsum(lengths + 2)])
    letters = np.zeros(padded[-1] + 2, np.uint32)
    place = np.repeat(padded[:-1], lengths) + within
    letters[place + 1] = data[np.repeat(starts, lengths) + within]
    grams = _bucket(letters[place] | letters[place + 1] << 8 | letters[place + 2] << 16, 1)
    affixes = []
    for size in AFFIXES:
        front, back = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        for k in range(size):
            inside = np.minimum(k, lengths - 1)
            held = (k < lengths).astype(np.uint64)
            front = front * np.uint64(257) + held * (data[starts + inside].astype(np.uint64) + np.uint64(1))
            back = back * np.uint64(257) + held * (data[ends - 1 - inside].astype(np.uint64) + np.uint64(1))
        affixes += [_bucket(front, 10 + size), _bucket(back, 20 + size)]
    return grams, lengths, np.stack(affixes, axis=1)


def _lexicon_index(model: Model, hashed: np.ndarray) -> np.ndarray:
    """Place of each word in the lexicon; the last row of the weights is for words outside."""
    if not len(model.lexicon):
        return np.zeros(len(hashed), np.int64)
    at = np.minimum(np.searchsorted(model.lexicon, hashed), len(model.lexicon) - 1)
    return np.where(model.lexicon[at] == hashed, at, len(model.lexicon))


def emissions(model: Model, data, starts, ends, hashed) -> np.ndarray:
    """Scores words x languages; words without a letter score the same everywhere."""
    if not len(starts):
        return np.zeros((0, len(model.languages)), np.float32)
    grams, lengths, affixes = features(data, starts, ends)
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    scores = np.add.reduceat(model.weights[grams], at, axis=0) / np.sqrt(lengths)[:, None]
    scores += model.weights[affixes].sum(axis=1)
    scores += model.lexicon_weights[_lexicon_index(model, hashed)]
    return scores * _any(_LETTER[data], starts, ends)[:, None]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray,
                     pairs: bool = False):
    """Posteriors of chains (chains x words x languages); with `pairs` expected label pairs too."""
    count, steps, width = scores.shape
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    inside = np.arange(steps)[None, :] < lengths[:, None]
    forward = np.empty_like(local)
    state = np.full((count, width), 1 / width)
    for t in range(steps):
        step = local[:, t] * (state @ move if t else state)
        step /= step.sum(axis=1, keepdims=True)
        state = np.where(inside[:, t, None], step, state)
        forward[:, t] = state
    out, later = np.empty_like(local), np.ones((count, width))
    expected = np.zeros((width, width))
    for t in range(steps - 1, -1, -1):
        both = forward[:, t] * later
        out[:, t] = both / both.sum(axis=1, keepdims=True)
        if t:
            ahead = local[:, t] * later
            if pairs:
                joint = forward[:, t - 1, :, None] * move * ahead[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                expected += (joint * inside[:, t, None, None]).sum(axis=0)
            earlier = ahead @ move.T
            earlier /= earlier.sum(axis=1, keepdims=True)
            later = np.where(inside[:, t, None], earlier, later)
    return (out, expected) if pairs else out


def sample(docs: DataFrame, allowed: Column, rows: int = ROWS_PER_LANGUAGE,
           most: int = SAMPLE_ROWS) -> DataFrame:
    """text and lang of a bounded sample of labelled rows, the same on every run.

    Each language has an equal number of rows, however many languages there are: `most` rows are
    shared out, one at least. Of long rows a stretch is learned from. Rows that repeat an id, a
    text and a language are one.
    """
    usable = docs.filter(allowed & F.col("lang").isNotNull() & (F.length("text") > 0)).select(
        "lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    each = F.greatest(F.lit(1), F.least(F.lit(rows), F.floor(most / F.greatest("languages", F.lit(1)))))
    names = usable.agg(F.count_distinct("lang").alias("languages")).select(each.alias("each")).scalar()
    order = Window.partitionBy("lang").orderBy("h")
    some = (usable.select("lang", "h").distinct().withColumn("_r", F.row_number().over(order))
            .filter(F.col("_r") <= rows).filter(F.col("_r") <= names).select("lang", "h"))
    return (usable.join(F.broadcast(some), ["lang", "h"], "left_semi")
            .groupBy("lang", "h").agg(F.max(F.substring("text", 1, ROW_CHARS)).alias("text")))


def train(docs: DataFrame, allowed: Column, seed: int = 1) -> Model:
    """A model from the sample; the sample is all that reaches the driver."""
    rows = sorted((r.lang, r.h, r.text) for r in sample(docs, allowed).collect())
    names = sorted({r[0] for r in rows})
    return fit([r[2] for r in rows], [names.index(r[0]) for r in rows], names, seed)


def fit(texts: list[str], labels: list[int], names: list[str], seed: int = 1) -> Model:
    random = np.random.default_rng(seed)
    width = max(len(names), 1)
    empty = Model(names, np.zeros((BUCKETS, width), np.float32), np.zeros(0, np.uint64),
                  np.zeros((1, width), np.float32), np.zeros((width, width)))
    if len(names) < 2:
        return empty
    found = _cores(wd.split(pa.array(texts, pa.string()), lower=True))
    hashed = wd.hashes(found)
    distinct, first, word = np.unique(hashed, return_index=True, return_inverse=True)
    lexicon = distinct[np.bincount(word, minlength=len(distinct)) >= LEXICON_COUNT]
    model = empty._replace(lexicon=lexicon,
                           lexicon_weights=np.zeros((len(lexicon) + 1, width), np.float32))
    grams, lengths, affixes = features(found.data, found.starts[first], found.ends[first])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    entry = _lexicon_index(model, distinct)
    real = _any(_LETTER[found.data], found.starts[first], found.ends[first]).astype(np.float32)
    chain, truth = _chains(found.first, np.array(labels), random)
    state = {k: np.full_like(v, 1e-6, dtype=np.float64) for k, v in
             (("weights", model.weights), ("lexicon_weights", model.lexicon_weights),
              ("transitions", model.transitions))}

    def descend(values, name, gradient):
        state[name] += gradient ** 2
        values += (RATE * gradient / np.sqrt(state[name])).astype(values.dtype)

    for _ in range(EPOCHS):
        for part in np.array_split(random.permutation(len(chain)), max(1, len(chain) // BATCH)):
            used, where = np.unique(word[chain[part]].ravel(), return_inverse=True)
            spans = lengths[used]
            at = np.concatenate([[0], np.cumsum(spans)])
            own = grams[np.repeat(offsets[used], spans) + np.arange(at[-1]) - np.repeat(at[:-1], spans)]
            scale = 1 / np.sqrt(spans)
            score = np.add.reduceat(model.weights[own], at[:-1], axis=0) * scale[:, None]
            score += model.weights[affixes[used]].sum(axis=1) + model.lexicon_weights[entry[used]]
            score *= real[used, None]
            shape = (len(part), CHAIN, width)
            posterior, expected = forward_backward(
                score[where].reshape(shape), np.full(len(part), CHAIN), model.transitions, True)
            right = np.eye(width)[truth[part]]
            error = (right - posterior).reshape(-1, width)
            seen = np.zeros((width, width))
            np.add.at(seen, (truth[part][:, :-1].ravel(), truth[part][:, 1:].ravel()), 1)
            each = np.stack([np.bincount(where.ravel(), error[:, k], len(used)) for k in range(width)], 1)
            each *= real[used, None]
            slope = np.stack([
                np.bincount(own, np.repeat(each[:, k] * scale, spans), BUCKETS)
                + np.bincount(affixes[used].ravel(), np.repeat(each[:, k], affixes.shape[1]), BUCKETS)
                for k in range(width)], 1)
            lexical = np.stack([np.bincount(entry[used], each[:, k], len(lexicon) + 1)
                                for k in range(width)], 1)
            size = len(part)
            descend(model.weights, "weights", slope / size - DECAY * model.weights)
            descend(model.lexicon_weights, "lexicon_weights",
                    lexical / size - DECAY * model.lexicon_weights)
            descend(model.transitions, "transitions",
                    (seen - expected) / size - DECAY * model.transitions)
    return model


def _chains(first: np.ndarray, labels: np.ndarray, random) -> tuple[np.ndarray, np.ndarray]:
    """Chains of word numbers and their labels, from shuffled stretches of all texts."""
    stretches = []
    for label in range(labels.max() + 1):
        mine, total = [], 0
        for k in random.permutation(np.flatnonzero(labels == label)):
            at = first[k]
            while at < first[k + 1]:
                end = min(first[k + 1], at + random.integers(*STRETCH))
                mine.append((label, at, end))
                at, total = end, total + end - at
            if total > WORDS_PER_LANGUAGE:
                break
        stretches += mine
    order = random.permutation(len(stretches))
    words = np.concatenate([np.arange(stretches[k][1], stretches[k][2]) for k in order])
    truth = np.concatenate([np.full(stretches[k][2] - stretches[k][1], stretches[k][0]) for k in order])
    count = -(-len(words) // CHAIN)
    return (np.resize(words, (count, CHAIN)), np.resize(truth, (count, CHAIN)))


def posteriors(model: Model, column: pa.Array):
    """The words of a slice of texts, and languages' posteriors for each word."""
    found = _cores(wd.split(column, lower=True))
    hashed = wd.hashes(found)
    distinct, first, word = np.unique(hashed, return_index=True, return_inverse=True)
    scores = emissions(model, found.data, found.starts[first], found.ends[first], distinct)[word]
    lengths = np.diff(found.first)
    parts = -(-lengths // PART)
    text = np.repeat(np.arange(len(lengths)), parts)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    core = found.first[:-1][text] + number * PART
    core_end = np.minimum(core + PART, found.first[1:][text])
    begin = np.maximum(core - CONTEXT, found.first[:-1][text])
    end = np.minimum(core_end + CONTEXT, found.first[1:][text])
    out = np.empty_like(scores, dtype=np.float32)
    order = np.argsort(end - begin, kind="stable")
    for some in np.array_split(order, max(1, len(order) // 1024)):
        if not len(some):
            continue
        steps = (end - begin)[some]
        at = np.minimum(begin[some, None] + np.arange(steps.max()), end[some, None] - 1)
        found_here = forward_backward(scores[at].astype(np.float64), steps, model.transitions)
        inner = ((begin[some, None] + np.arange(steps.max()) >= core[some, None])
                 & (begin[some, None] + np.arange(steps.max()) < core_end[some, None]))
        out[at[inner]] = found_here[inner]
    return found, out


def _spoken(model: Model, column: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of each text of a slice."""
    found, each = posteriors(model, column)
    lettered = _any(_LETTER[found.data], found.starts, found.ends)
    total = np.concatenate([np.zeros((1, each.shape[1])),
                            np.cumsum(each * lettered[:, None], axis=0, dtype=np.float64)])
    count = np.concatenate([[0], np.cumsum(lettered)])
    share = total[found.first[1:]] - total[found.first[:-1]]
    number = count[found.first[1:]] - count[found.first[:-1]]
    best = share.argmax(axis=1)
    plain = _any(_ASCII_LETTER[found.data], found.texts[:-1], found.texts[1:])
    names, scores = [], []
    for k, text in enumerate(column.to_pylist() if not plain.all() else [None] * len(best)):
        known = plain[k] or any(c.isalpha() for c in text or "")
        names.append(model.languages[best[k]] if known and model.languages else UNKNOWN)
        scores.append(float(np.clip(share[k, best[k]] / number[k], 0, 1)) if names[-1] != UNKNOWN else 0.0)
    return names, scores


def predict(docs: DataFrame, model: Model, into: tuple[str, str] = ("lang_pred", "score")
            ) -> DataFrame:
    """docs with lang_pred and score, or other names, from the texts alone.

    A null text or one without a letter is `und` with score 0, as is any text if no language
    was learned. The score is the mean posterior of the language over the words with letters.
    Columns of docs are passed through; those of these names are replaced. Rows that
    repeat, and texts that tie, are decided row by row; a tie goes to the language first by name.
    """
    ship(docs.sparkSession)
    docs = docs.drop(*into)

    def label(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                names, scores = _spoken(model, part.column("text"))
                part = part.append_column(into[0], pa.array(names, pa.string()))
                yield part.append_column(into[1], pa.array(scores, pa.float64()))

    schema = StructType([*docs.schema.fields, StructField(into[0], StringType()),
                         StructField(into[1], DoubleType())])
    return docs.mapInArrow(giving_back(label), schema)


def held_out(id_name: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_name).cast("string")) % 5 == 0, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs (doc_id, text, lang)."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    model = train(slim, ~held_out() & F.col("doc_id").isNotNull())
    return predict(slim.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")
