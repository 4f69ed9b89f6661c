"""Spelling variants among the frequent words of a corpus, through an index of grams of variable length.

Two words are near if one inserted, deleted or replaced code point turns one into the other. The
dictionary of grams is pruned by frequency: all grams of two code points are in it, and a longer one
is if the gram without its last code point is frequent. A word is cut into the longest gram of the
dictionary at each place, less those that lie within an earlier one. One edit can change only some
of these grams; the most that any edit can, the word's bound, follows from the word and the
dictionary (`affected`). So two near words share a gram among the bound + 1 rarest ones of each,
and only these lists are merged; all longer lists of a word are left out.

With a single edit everything before, or everything after, a shared gram is equal as well. So the
list of a gram is filed by the text up to its end and by the text from its start. Words of a short
list are compared with one another; a long list is split once more by the rest of the word without
one of its code points. Nothing is left out either way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.llm.shared import keep, ship

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every so many occurrences lose a code point.
ERRORS = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form occurs at least so many times as often as the word.
RATIO = 5
#: Lengths of grams: all of the shortest are kept, the longest is half of a word's length.
SHORTEST, LONGEST = 2, 6
#: A gram in this share of all places of words is frequent, if it is also in so many words.
FREQUENT_SHARE, FREQUENT_WORDS = 50_000, 64
#: Words of a list that are compared with one another, and words that a task cuts at once.
LIST = 64
TOGETHER = 1_000

POSTED = "band int, side string, context string, rest string, word string, n bigint"


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n: runs of letters of all texts, with one code point lost in some of them.

    The loss depends on the row's doc_id (a null one is empty text) and the run.
    """
    lower = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    hashed = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                              F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return (docs.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0)))
                        .alias("run"))
            .withColumn("h", hashed)
            .select(F.when(F.col("h") % ERRORS == 0, lost).otherwise(F.col("run")).alias("word"))
            .filter(F.length("word") >= least_length)
            .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count))


def _band(length: Column) -> Column:
    return F.least(F.floor(length / 2), F.lit(LONGEST)).cast("int")


def banded(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Words with the bands whose dictionaries they are cut by, a row each.

    Words of 2q and 2q + 1 code points go by grams of up to q; one of 2q also goes with words that
    are one shorter, if there are such. Of a pair, the shorter word's band counts.
    """
    shorter = F.greatest(F.length("word") - 1, F.lit(least_length))
    bands = F.array_distinct(F.array(_band(F.length("word")), _band(shorter)))
    return words.withColumn("band", F.explode(bands))


def frequent_grams(words: DataFrame, share: int = FREQUENT_SHARE,
                   least: int = FREQUENT_WORDS) -> dict[int, dict[str, int]]:
    """Per band the frequent grams of `words` (word, band) and how often they occur in them.

    As a gram must fill one of `share` equal parts of all places, there are at most `share` of them.
    """
    spans = (words.select("word", "band", F.explode(F.sequence(F.lit(SHORTEST), F.col("band"))).alias("q"))
             .select("band", "q", F.explode(F.transform(
                 F.sequence(F.lit(1), F.length("word") - F.col("q") + 1),
                 lambda p: F.substring("word", p, F.col("q")))).alias("gram")))
    counts = keep(spans.groupBy("band", "gram").agg(F.count("*").alias("places")), "grams")
    places = counts.agg(F.sum("places")).first()[0] or 0
    found: dict[int, dict[str, int]] = {q: {} for q in range(SHORTEST, LONGEST + 1)}
    for row in counts.filter(F.col("places") > max(least, places // share)).collect():
        found[row.band][row.gram] = row.places
    return found


def decompose(word: str, longest: int, frequent: Mapping[str, int]) -> list[tuple[int, int]]:
    """Start and end of the word's grams; both rise from gram to gram."""
    grams, reached = [], 0
    for start in range(len(word) - SHORTEST + 1):
        end = start + SHORTEST
        while end - start < longest and end < len(word) and word[start:end] in frequent:
            end += 1
        if end > reached:
            grams.append((start, end))
            reached = end
    return grams


def endings(longest: int, frequent: Mapping[str, int]) -> set[str]:
    """Proper endings of the frequent grams that longer ones begin with."""
    return {gram[k:] for gram in frequent if len(gram) < longest for k in range(1, len(gram))}


def affected(word: str, grams: list[tuple[int, int]], longest: int, frequent: Mapping[str, int],
             inner: set[str]) -> int:
    """The most grams that one edit can take from the word's cut, whatever it puts in.

    The edit leaves word[:a] and word[b:] as they are. A gram before it stays if no frequent gram
    begins at its start or earlier and ends at a: else a longer gram may begin there and cover it.
    A gram after it stays unless a longer gram from before b can reach its end, which needs
    word[b:end-1] within a frequent gram, after its start. All other grams count as taken.
    """
    most = 0
    for a, b in [(k, k + 1) for k in range(len(word))] + [(k, k) for k in range(len(word) + 1)]:
        first = min((p for p in range(max(0, a - longest + 1), a - SHORTEST + 1)
                     if word[p:a] in frequent), default=a)
        stay = sum(end <= a and start < first or start >= b and word[b:end - 1] not in inner
                   for start, end in grams)
        most = max(most, len(grams) - stay)
    return most


def _posted(frequent: dict[int, dict[str, int]]):
    """Rows of the index: of each word the lists of its bound + 1 rarest grams."""
    inner = {band: endings(band, grams) for band, grams in frequent.items()}

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(k, TOGETHER) for b in batches for k in range(0, b.num_rows, TOGETHER)):
            rows = []
            for word, n, band in zip(*(part[c].to_pylist() for c in ("word", "n", "band"))):
                known = frequent[band]
                cut = decompose(word, band, known)
                bound = affected(word, cut, band, known, inner[band])
                order = sorted((known.get(word[s:e], 0), word[s:e], s, e) for s, e in cut)
                last = order[min(bound, len(order) - 1)][:2]
                for *gram, start, end in order:
                    if tuple(gram) <= last:
                        rows.append((band, "before", word[:end], word[end:], word, n))
                        rows.append((band, "after", word[start:], word[:start], word, n))
            columns = zip(*rows) if rows else [[]] * 6
            kinds = (pa.int32(), *[pa.string()] * 4, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(columns, kinds)],
                names=["band", "side", "context", "rest", "word", "n"])
    return post


def _without_one(text: Column) -> Column:
    """The text, and the text without each of its code points."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(text)), lambda k: F.concat(
        F.substring(text, F.lit(1), k - 1), F.substring(text, k + 1, F.length(text))))
    return F.array_distinct(F.concat(F.array(text), F.when(
        F.length(text) > 0, shorter).otherwise(F.array().cast("array<string>"))))


def _met(rows: DataFrame, *keys: str) -> DataFrame:
    """Pairs of near words that share the keys, the smaller word first."""
    def of(side: str) -> DataFrame:
        return rows.select(*keys, F.col("word").alias(side), F.col("n").alias(f"n_{side}"),
                           F.col("rest").alias(f"rest_{side}"))

    shorter = F.least(F.length("u"), F.length("v"))
    return (of("u").join(of("v"), list(keys))
            .filter((F.col("u") < F.col("v"))
                    & (F.abs(F.length("u") - F.length("v")) <= 1)
                    & (F.col("band") == _band(shorter))
                    & (F.levenshtein("rest_u", "rest_v", 1) == 1))
            .select("u", "n_u", "v", "n_v"))


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, most: int = LIST,
               share: int = FREQUENT_SHARE, least: int = FREQUENT_WORDS) -> DataFrame:
    """All pairs of near words of `words` (word, n), a kept table: u, n_u, v, n_v with u < v."""
    ship(words.sparkSession)
    rows = banded(words.select("word", "n"), least_length)
    posted = keep(rows.mapInArrow(_posted(frequent_grams(rows, share, least)), POSTED), "postings")
    lists = ["band", "side", "context"]
    sizes = posted.groupBy(*lists).agg(F.count("*").alias("size")).filter("size > 1")
    sized = keep(posted.join(sizes, lists), "lists")
    split = (sized.filter(F.col("size") > most)
             .withColumn("variant", F.explode(_without_one(F.col("rest")))))
    return (_met(sized.filter(F.col("size") <= most), *lists)
            .union(_met(split, *lists, "variant")).distinct())


def _roots(words: DataFrame, forms: DataFrame) -> DataFrame:
    """word and root of the words that have a form, by doubling the steps.

    A form occurs RATIO times as often as its word, so chains are no longer than the logarithm
    of the largest count.
    """
    largest = words.agg(F.max("n")).first()[0] or 1
    links = keep(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(math.ceil(math.log2(2 + math.log(largest, RATIO)))):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = keep(links.join(further, "root", "left")
                     .select("word", F.coalesce("next", "root").alias("root")), "roots")
    return links


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
             ratio: int = RATIO) -> DataFrame:
    """Every frequent word of docs (doc_id, text) with its form and root.

    A null or empty text has no words. Rows that repeat an id or a text all count; a null doc_id
    counts as empty text in the choice of lost code points. Of forms that occur equally often the
    smallest by code points is taken. Other columns are ignored; without any word there are no
    rows. Texts and words may be of any length; words need four code points to be cut.
    """
    if least_length < 2 * SHORTEST:
        raise ValueError(f"words need at least {2 * SHORTEST} code points")
    if ratio < 2:
        raise ValueError("a form must occur at least twice as often as its word")
    words = keep(word_counts(docs, least_length, least_count), "words")
    pairs = keep(near_words(words, least_length), "near")
    both = pairs.select(F.col("u").alias("word"), F.col("n_u").alias("n"),
                        F.col("v").alias("near"), F.col("n_v").alias("near_n")).union(
        pairs.select("v", "n_v", "u", "n_u"))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    formed = keep(words.join(best, "word", "left")
                  .withColumn("is_form", F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False)))
                  .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                          F.when(F.col("is_form"), F.col("best.form")).alias("form"),
                          F.when(F.col("is_form"), -F.col("best.less")).alias("form_n")), "formed")
    roots = _roots(words, formed.filter(F.col("form").isNotNull()))
    return (formed.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
