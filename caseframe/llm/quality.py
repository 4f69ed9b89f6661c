"""Quality rules: plain counts of a text, and a likelihood ratio of hashed n-grams.

Words and marks, and pairs of neighbours, fall into a fixed number of buckets. Their shares in
trusted texts and in the raw corpus are two multinomials; a text's score is the mean log ratio of
its n-grams, and a text below the threshold is not kept. Only DataFrame functions run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseframe.llm.shared import WORD, keep, text_or_empty

WINDOW = 5
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Words and runs of marks.
TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+"
BUCKETS = 1 << 14
#: Trusted texts are a sample of at most this many rows, in the order of a hash of their ids.
TRUSTED_ROWS = 20_000
SMOOTHING = 1.0
THRESHOLD = -0.5
LEAST_WORDS, MOST_REPEATED = 10, 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces(text: Column) -> Column:
    """The text cut at each character of SPACES: words, and empty strings between spaces."""
    return F.split(text, SPACE)


def repeated_words(word: Column) -> Column:
    """Words that lie in a five-word window that the text has twice or more.

    Windows are told apart by 64-bit hashes of those of their words. If some are equal, they are sorted with their places;
    the places of equal ones, again in order, cover at most five words each.
    """
    def windows(single: Column) -> Column:
        return F.transform(F.slice(single, 1, F.size(single) - WINDOW + 1), lambda x, i: F.xxhash64(
            x, *(F.get(single, i + k) for k in range(1, WINDOW))))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(s: Column) -> Column:
            again = F.filter(s, lambda y, k: (y["x"] == F.get(s, k - 1)["x"])
                             | (y["x"] == F.get(s, k + 1)["x"]))
            return F.sort_array(F.transform(again, lambda y: y["i"]))

        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("total"))
        return F.aggregate(let(placed, places), start, lambda a, i: F.struct(
            i.alias("last"), (a["total"] + F.least(F.lit(WINDOW), i - a["last"])).alias("total")),
            lambda a: a["total"])

    hashes = let(F.transform(word, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(word) > WINDOW, let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(
        covered(h)))).otherwise(F.lit(0).cast("bigint"))


def counts(text: Column) -> Column:
    """The plain counts of a text, as one struct."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return let(pieces(text), lambda piece: let(F.array_remove(piece, ""), lambda word: F.struct(
        F.size(word).cast("bigint").alias("n_words"),
        (F.length(text) - F.size(piece) + 1).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(word).alias("n_repeat_words"))))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def bucket(*parts: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def after_first(token: Column) -> Column:
    return F.slice(token, 2, F.greatest(F.size(token) - 1, F.lit(0)))


def pairs(token: Column, buckets: int) -> Column:
    """Buckets of neighbouring pairs."""
    return F.transform(after_first(token), lambda t, i: bucket(F.get(token, i), t, buckets=buckets))


def grams(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the words and marks of a text, and of neighbouring pairs."""
    return let(tokens(text), lambda token: F.concat(
        F.transform(token, lambda t: bucket(t, buckets=buckets)), pairs(token, buckets)))


def mean_weight(text: Column, weight: Column, buckets: int) -> Column:
    """Mean weight of the `grams` of a text, added up in their order; 0 if it has none."""
    def mean(token: Column) -> Column:
        total = F.aggregate(token, F.lit(0.0), lambda a, t: a + F.get(weight, bucket(t, buckets=buckets)))
        total = F.aggregate(pairs(token, buckets), total, lambda a, x: a + F.get(weight, x))
        return total / (2 * F.size(token) - 1)

    return let(tokens(text), lambda token: F.when(F.size(token) > 0, mean(token)).otherwise(F.lit(0.0)))


def weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and log ratio of its share in the trusted texts to its share in all texts.

    Counted over all of docs; `trusted` is a set of at most TRUSTED_ROWS ids.
    """
    ids = trusted.select(F.col("doc_id").cast("bigint").alias("_id"), F.lit(1).alias("_good"))
    # Rows of tokens, unlike functions of arrays, are hashed in generated code.
    token = (docs.join(F.broadcast(ids), docs["doc_id"] == F.col("_id"), "left")
             .select("_good", tokens(text_or_empty()).alias("token"))
             .select("_good", F.inline(F.arrays_zip("token", after_first(F.col("token")).alias("next")))))
    pair = F.when(F.col("next").isNotNull(), bucket(F.col("token"), F.col("next"), buckets=buckets))
    every = (token.select("_good", F.explode(F.array(
        bucket(F.col("token"), buckets=buckets), pair)).alias("bucket"))
        .filter(F.col("bucket").isNotNull())
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_good").alias("good")))
    full = (docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
            .join(every, "bucket", "left").fillna(0, ["raw", "good"]))
    whole = Window.partitionBy(F.lit(0))  # over the buckets, whose number is fixed
    share = lambda n: ((F.col(n) + SMOOTHING) / (F.sum(n).over(whole) + SMOOTHING * buckets))
    ratio = F.when(F.sum("good").over(whole) > 0, F.log(share("good") / share("raw")))
    return full.select("bucket", F.coalesce(ratio, F.lit(0.0)).alias("weight"))


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of texts labelled good, at most that many."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def judged(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD,
           buckets: int = BUCKETS) -> DataFrame:
    """doc_id, the counts, base_failed, score and kept for every row of docs (doc_id, text).

    A null text is empty: no words, score 0, base_failed. A text is judged by itself, so repeated
    rows and ties give equal verdicts; without trusted texts all scores are 0. A null doc_id stays
    null and is never trusted. Other columns are ignored; an empty table gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    table = keep(weights(slim, trusted, buckets), "weights")
    values = [repr(r.weight) for r in table.orderBy("bucket").collect()]  # one number per bucket
    constant = F.split(F.lit(",".join(values)), ",").cast("array<double>")
    score = let(constant, lambda w: mean_weight(text_or_empty(), w, buckets))
    failed = ((F.col("n_words") < LEAST_WORDS)
              | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    return (slim.select("doc_id", counts(text_or_empty()).alias("c"), score.alias("score"))
            .select("doc_id", "c.*", "score").withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)))
