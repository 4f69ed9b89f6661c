"""Each operator on awkward rows and against a plain version over the smallest test tables."""

import hashlib
import base64
import io
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pathlib import Path
from pyspark.sql import functions as F

from caseframe.llm import (credentials, exact, languages, licenses, mixing, neardup, packing, private,
                           quality, shared, warc, words)
from caseframe.llm.components import components
from tests.llm import brute

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are missing")
LONG = " ".join(f"w{k % 997}x{k}" for k in range(30_000))
BASE = [f"b{k}" for k in range(120)]


def edited(*places):
    return " ".join("zz%d" % k if k in places else w for k, w in enumerate(BASE))


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  two"), (6, LONG), (7, LONG), (None, "one two"),
       (None, None), (9, "ünï çode 日本"), (10, "a\x00b \x1c c"), (4, "one two"), (-3, "one\x0btwo"), (11, "!!! ###")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def table(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


# near duplicates

def test_near_duplicates_of_awkward_rows(docs):
    got = sorted(table(neardup.near_duplicates(docs(ODD), 85), "doc_id", "n_shingles", "component_id", "kept"), key=str)
    assert (1, 0, 1, True) in got and (2, 0, 2, True) in got and (None, 1, None, True) in got
    assert got.count((4, 1, -3, False)) == 2 and (-3, 1, -3, True) in got and (5, 1, -3, False) in got
    assert (7, 29_996, 6, False) in got and len(got) == len(ODD)


def test_near_duplicates_of_a_crowd(docs):
    """More nodes in a bucket than are compared at once, chained and apart."""
    rows = [(k, edited(k % 110)) for k in range(200)] + [(500 + k, edited(k, k + 20, k + 40, k + 60)) for k in range(50)]
    rows += [(900, edited(3, 50)), (901, edited(3, 50, 80)), (902, " ".join(BASE[:60] + BASE[60:][::-1]))]
    got = table(neardup.near_duplicates(docs(rows), 85), "doc_id", "n_shingles", "component_id")
    assert {r[0]: r[1:] for r in got} == brute.near(rows, 85)


@pytest.mark.parametrize("bits", [64, shared.FILTER_BITS])
def test_rows_of_some_ids(spark, docs, monkeypatch, bits):
    """With few bits ids collide, which the join corrects; a row without an id is nobody's."""
    monkeypatch.setattr(shared, "FILTER_BITS", bits)
    rows = docs([(k, f"t{k}") for k in range(-300, 300)] + [(None, "none"), (7, "again")])
    ids = spark.createDataFrame([(k,) for k in (*range(-290, 300, 10), 7, 10**12)], "doc_id bigint")
    got = table(shared.only_ids(rows.select("doc_id", "text"), ids), "doc_id", "text")
    assert sorted(got) == sorted([(k, f"t{k}") for k in (*range(-290, 300, 10), 7)] + [(7, "again")])
    assert shared.only_ids(rows, ids.limit(0)).columns == rows.columns
    assert shared.only_ids(rows, ids.limit(0)).count() == 0


def test_bitmap_of_ids_follows_their_number(spark):
    """Few ids make a small broadcast; few other rows pass, and none of the ids is lost."""
    rows = spark.range(400_000).withColumnRenamed("id", "doc_id")
    for count, most in ((0, 0), (500, 32), (100_000, 98)):
        ids = shared.keep(rows.limit(count), "ids")
        bits, _ = shared.bitmap(ids, "doc_id")
        assert bits.count() <= most
        likely, others = shared.split_ids(rows, ids)
        assert others.join(ids, "doc_id").count() == 0
        assert likely.count() + others.count() == 400_000 and likely.count() <= count + 400_000 // 25
        assert shared.without_ids(rows, ids).count() == 400_000 - count
    assert shared.bitmap(spark.range(10**7).toDF("doc_id"), "doc_id")[0].count() == 4096


def test_no_documents_no_groups(docs):
    assert neardup.near_duplicates(docs([])).count() == 0


@here
def test_near_duplicates_equal_brute_force(documents):
    rows = table(documents, "doc_id", "text")
    got = table(neardup.near_duplicates(documents, 80), "doc_id", "n_shingles", "component_id")
    assert {r[0]: r[1:] for r in got} == brute.near(rows, 80)


def test_registers_merge_and_estimate():
    values = np.random.default_rng(1).integers(0, 2**63, 3000, dtype=np.uint64)
    left, right = values[:2000], values[500:]
    a, b = neardup.registers(left), neardup.registers(right)
    assert (neardup.merge(a, b) == neardup.registers(np.union1d(left, right))).all()
    found = neardup.estimate(*(x[None].astype("i4") for x in (a, b)), np.array([2000.]), np.array([2500.]))
    assert abs(found[0] - 0.5) < 0.12


def test_components_of_a_path_a_star_and_loops(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 130)] + [(7, 7), (3, 2)]
    got = dict(table(components(spark.createDataFrame(links, "u long, v long")), "node", "label"))
    assert got == {k: 0 for k in range(21)} | {k: 100 for k in range(100, 130)}


# packing

@pytest.fixture(scope="module")
def tokenizer():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(packing.VOCABULARY))


STRANGE = ["  a", "a  b ", "<|endoftext|> x", "a <|endoftext|>b", "a\n b", "a \nb", "'s don't I'LL 12 3x $$$ a.\n\nb",
           "日本 語", "x \x1cb", "  y", "é́ ı", "tail "]


def check_packing(frame, tokenizer, rows, length=1024):
    got = table(frame, "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    expected = []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % length or length
        cuts = [0, *range(first, len(ids), length), len(ids)]
        expected += [(key, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
                     for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r[:5] for r in got), key=str) == sorted(expected, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r[5], []).append((r[6], r[3]))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(sequences), sum(r[3] for r in got)


def test_packing_of_awkward_rows(docs, tokenizer):
    rows = ODD + [(20 + k, t) for k, t in enumerate(STRANGE)]
    check_packing(packing.packed_documents(docs(rows)), tokenizer, rows)
    assert packing.packed_documents(docs([])).count() == 0


@here
def test_packing_is_a_partition_into_few_sequences(documents, tokenizer):
    used, tokens = check_packing(packing.packed_documents(documents), tokenizer, table(documents, "doc_id", "text"))
    assert used <= 1.03 * -(-tokens // 1024) + 3


def test_best_fit_closes_the_fullest():
    sequence, offset = packing.best_fit(np.array([6, 5, 4, 3, 2, 10]), 10, 1)
    assert sequence.tolist() == [0, 1, 1, 2, 2, 3] or sequence.tolist()[:3] == [0, 1, 0]
    assert len(set(zip(sequence, offset))) == 6


# WARC

PAGES = [(1, "<p>é</p>"), (2, "<p>é</p>"), (3, None), (4, ""), (5, "x" * 700_000), (6, "<p>é</p>"), (None, "lonely"), (6, "<p>é</p>"),
         (6, "other"), (7, "other")]


def test_warc_round_trip_of_awkward_rows(spark):
    pages = spark.createDataFrame([(k, h, "http://a b/\n" if k else None) for k, h in PAGES],
                                  "page_id long, html string, url string")
    got = sorted(table(warc.round_trip(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), key=str)
    expected = []
    for key, html in PAGES:
        data = (html or "").encode()
        last = max((k for k, h in PAGES if (h or "") == (html or "") and k is not None), default=None)
        refers = last if key is not None and key < last else None
        expected.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                         "response" if refers is None else "revisit", refers))
    assert got == sorted(expected, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reader_takes_small_chunks_and_finds_damage():
    data = b"".join(warc.page_record(k, None, b"abc" * k, None, 0) for k in (0, 1, 50_000))
    assert [n for _, n, _ in warc.read_records(io.BytesIO(data), 7)] == [0, 3, 150_000]
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_records(io.BytesIO(data[:-9])))
    other = warc.record({"WARC-Record-ID": "x", "WARC-Block-Digest": "sha1:WRONG"}, b"abc")
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_records(io.BytesIO(other)))


# secrets

SECRETS = ["password=abc", "PassWord: 'abcdef1'", "api_key==x12345 token = \"" + "ab12" * 10 + "\"", "AKIA" + "Z" * 16 + "9",
           "AKIAAKIA1", "ſecret=abcdef1 Key", "x" * 50_000 + "AKIA" + "0" * 17, "password" + " " * 30_000 + "=abcdefg",
           "0" * 23 + " " + "0" * 24, "é🙂 secret=abcdef secret=ghijkl"]


def test_secrets_of_awkward_rows_and_base_spans(docs):
    rows = ODD + [(30 + k, t) for k, t in enumerate(SECRETS)]
    found = credentials.listed(credentials.find_secrets(docs(rows)), credentials.KINDS, credentials.STRONG)
    got = sorted(table(found, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), key=str)
    expected = []
    for key, text in rows:
        spans = brute.secret_spans(text or "")
        expected.append((key, *(sum(s[0] == k for s in spans) for k in credentials.STRONG),
                         brute.sha(brute.listed(spans, credentials.KINDS))))
    assert got == sorted(expected, key=str)
    assert credentials.find_secrets(docs([])).count() == 0


def test_weak_parts_count_only_together(docs):
    mixed = "Zx9" + "aB3" * 12
    gap = " word" * 200
    rows = [(1, f"user=bob {mixed}"), (2, "user=bob nothing"), (3, f"{mixed} alone"), (4, f"user=bob{gap} {mixed}"),
            (5, "https://db.example.com password=hunter22"), (6, "https://db.example.com")]
    got = {r.doc_id: {s.kind for s in r.added} for r in credentials.find_secrets(docs(rows)).collect()}
    assert got == {1: {"identifier", "secret"}, 2: set(), 3: set(), 4: set(), 5: {"endpoint"}, 6: set()}


@here
def test_secret_base_equals_brute_force(documents):
    found = credentials.listed(credentials.find_secrets(documents), credentials.KINDS, credentials.STRONG)
    got = dict(table(found, "doc_id", "base_sha256"))
    assert got == {k: brute.sha(brute.listed(brute.secret_spans(t or ""), credentials.KINDS))
                   for k, t in table(documents, "doc_id", "text")}


def test_weak_parts_of_any_length_case_and_place(docs):
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    long_key, name, url = "Zx9" + "aB3" * 200, "n" * 300, "https://db.example.com/" + "p" * 900
    rows = [(1, f"AWS_ACCOUNT=bob AWS_KEY={key}"), (2, f"user=bob {long_key} end"), (3, f"user={name} {key}"),
            (4, f"{url} {key}"), (5, f"DB_HOST=db.example.com {key}"), (6, f"client_id={key}"),
            (7, f"user=bob{' ' * 401}{key}"), (8, f"user=bob{' ' * 400}{key}")]
    got = {r.doc_id: {(s.kind, rows[r.doc_id - 1][1][s.start:s.end]) for s in r.added}
           for r in credentials.find_secrets(docs(rows)).collect()}
    bob = ("identifier", "user=bob")
    assert got == {1: {("identifier", "ACCOUNT=bob"), ("secret", key)}, 2: {bob, ("secret", long_key)},
                   3: {("identifier", f"user={name}"), ("secret", key)}, 4: {("endpoint", url)},
                   5: {("endpoint", "HOST=db.example.com")}, 6: set(), 7: set(), 8: {bob, ("secret", key)}}


# personal data

PRIVATE = ["a@b.c", "@b.c a@b", "a@b.c@d.e", "x.y+z%q@h-1.org.", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.255", "0000000001.1.1.1",
           "4111 1111-1111 1111 1", "4111111111111111", "79927398713 0000000000000000", "+1 (555) 123-4567 x", "+1 555 +44 20 7946 0958",
           "a" * 60_000, "1" * 60_000, "é🙂 +1 (269) 555-3296", "a@b.c" * 50, "..@..a@-.-", "+12.3.4.5.6.7.8.9.0.1"]


def test_private_base_spans_equal_patterns(documents):
    for text in [t or "" for _, t in ODD] + PRIVATE + [t or "" for _, t in table(documents, "doc_id", "text")]:
        if len(text) < 50_000:
            assert brute.listed(private.base(text), private.KINDS) == brute.listed(brute.private_spans(text), private.KINDS)
        else:
            private.base(text)


@here
def test_tagger_finds_what_patterns_find_and_leaves_clean_texts(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [t for _, t in table(documents, "doc_id", "text")]
    found = private.tagged(private.train(documents), texts)
    both = sum(len(set(a) & set(private.base(t))) for a, t in zip(found, texts))
    assert both >= 0.7 * sum(len(private.base(t)) for t in texts)
    assert not any(found[k] for k, t in enumerate(texts) if not re.search("[0-9@]", t))


@here
def test_tagger_adds_variants_that_patterns_miss(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = private.train(documents)
    forms = {"phone": ["555 {}-4567", "(555) {}-4567", "001 555 {} 4567", "1.555.{}.4567"],
             "card": ["4111.1111.1111.1{}", "4012  8888  8888  1{}", "5500/0000/0000/0{}"],
             "email": ["maria{} @ example.org", "jo.hn{} @mail.net", "anna{}@ post.example.com"],
             "ip": ["10 . 20 . 3 . {}", "192-168-1-{}"]}
    clean = [t for (t,) in table(documents, "text") if t and not re.search("[0-9@]", t) and len(t) > 300][:25]
    texts, planted = [], []
    for k, text in enumerate(clean):
        for kind, some in forms.items():
            span, at = some[k % len(some)].format(101 + 5 * k), text.index(" ", 100) + 1
            texts.append(f"{text[:at]}{span} {text[at:]}")
            planted.append((kind, at, at + len(span)))
    assert not any(set(private.base(t)) & {p} for t, p in zip(texts, planted))
    found = private.tagged(model, texts)
    hits = {kind: sum(p in f for f, p in zip(found, planted) if p[0] == kind) / len(clean) for kind in forms}
    assert min(hits.values()) >= 0.25 and sum(hits.values()) >= 0.6 * len(hits), hits
    assert not any(private.tagged(model, clean))


def test_windows_without_digits_have_one_tagging():
    """Every position with a digit or an @ lies in a window that is run."""
    random = np.random.default_rng(5)
    for length in (1, 95, 128, 129, 500, 3000):
        chars = np.full(length, 97)
        marks = random.integers(0, length, 3)
        chars[marks] = 48
        inside = np.zeros(length, bool)
        for a, b in private._stretches(chars):
            inside[a * private.STRIDE:(b - 1) * private.STRIDE + private.WINDOW] = True
        assert inside[marks].all()


def test_marks_have_a_window_of_context_on_both_sides():
    chars = np.full(3000, 97)
    for mark in (0, 128, 700, 1441, 2999):
        chars[:] = 97
        chars[mark] = 64
        (a, b), = private._stretches(chars)
        assert a * private.STRIDE <= max(0, mark - private.STRIDE)
        assert (b - 1) * private.STRIDE + private.WINDOW >= min(3000, mark + private.STRIDE)


def test_private_of_awkward_rows(docs):
    rows = ODD + [(30 + k, t) for k, t in enumerate(PRIVATE)]
    found = credentials.listed(private.find_private(docs(rows)), private.KINDS, private.KINDS)
    got = sorted(table(found, "doc_id", "base_sha256"), key=str)
    assert got == sorted(((k, brute.sha(brute.listed(private.base(t or ""), private.KINDS))) for k, t in rows), key=str)
    assert private.find_private(docs([])).count() == 0


# exact duplicates

def test_exact_duplicates_of_awkward_rows(docs):
    got = table(exact.exact_duplicates(docs(ODD), F.col("doc_id") % 2 == 0), "doc_id", "keep_id", "group_size", "kept")
    normal = [(k, brute.SPACES.sub(" ", t or "")) for k, t in ODD]
    expected = []
    for key, text in normal:
        group = [k for k, t in normal if t == text]
        keep = min((k for k in group if k is not None), default=None)
        expected.append((key, keep, len(group), key == keep))
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert exact.exact_duplicates(docs([]), F.lit(True)).count() == 0


@pytest.mark.parametrize("history", [True, False, None])
def test_history_changes_no_result(docs, history):
    rows = [(k, f"text {k % 37}") for k in range(200)]
    got = {r[0]: r[1:] for r in table(exact.exact_duplicates(docs(rows), F.lit(history).cast("boolean")), "doc_id", "keep_id", "group_size")}
    assert got == {k: (k % 37, sum(j % 37 == k % 37 for j in range(200))) for k in range(200)}


def test_hash_is_minimal_and_perfect():
    words = np.random.default_rng(2).integers(0, 2**63, (5000, 4), dtype=np.uint64)
    levels, slots = exact.build(words)
    assert sorted(slots) == list(range(5000)) and (exact.find(levels, words) == slots).all()
    with pytest.raises(ValueError):
        exact.build(np.ones((2, 4), np.uint64))


# mixing

def test_mix_of_awkward_rows(docs):
    rows = [(k, "w " * (k % 5), None if k % 7 == 0 else "abc"[k % 3]) for k in range(300)] + [(None, None, "z"), (5, "x y", "a"), (5, "x y", "a")]
    got = mixing.mixed(docs(rows)).collect()
    assert len(got) == len(rows)
    sources = {r.source: r for r in got}
    total = sum(r.size for r in got)
    assert abs(sum(r.target for r in sources.values()) - total) < 1e-6
    for name, one in sources.items():
        assert one.target <= 3 * one.source_size + 1e-9
        taken = sum(r.taken for r in got if r.source == name)
        assert abs(taken - one.target) <= 2 * max(r.size for r in got if r.source == name)
        assert all(0 <= r.copies <= 3 and r.taken == r.size * r.copies for r in got if r.source == name)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs(rows)).collect()))
    assert mixing.mixed(docs([])).count() == 0
    assert {r.target for r in mixing.mixed(docs([(1, None), (2, "")])).collect()} == {0.0}


def test_clamped_sources_give_their_excess_by_weight(docs):
    rows = [(1, "w " * 10, "a"), (2, "w " * 50, "b"), (3, "w " * 100, "c")]
    got = {r.source: r.target for r in mixing.mixed(docs(rows)).collect()}
    assert got == {"a": 30.0, "b": 2 * 130 / 3, "c": 130 / 3}


# quality

@here
def test_quality_counts_equal_brute_force(spark, documents, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    repeats = [(40, "a b c d e f " * 3), (41, "a " * 50), (42, "x a b c d e y a b c d e z"), (43, "l\nl\n\n \nl m\nl"), (44, "a b c d e")]
    for frame, rows in ((documents, table(documents, "doc_id", "text")), (docs(ODD + repeats), ODD + repeats)):
        found = quality.judged(frame, quality.trusted_ids(labels)).cache()
        assert sorted(table(found, *columns), key=str) == sorted(((k, *brute.quality(t)) for k, t in rows), key=str)
        for r in found.collect():
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_quality_grams_are_counted_in_generated_code(spark, docs):
    some = docs([(1, "One two, one"), (2, "!"), (3, ""), (None, None)])
    found = quality.weights(some, spark.createDataFrame([(1,)], "doc_id bigint"))
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    raw, good = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for r in some.select("doc_id", quality.grams(F.col("text")).alias("g")).collect():
        np.add.at(raw, r.g or [], 1)
        np.add.at(good, (r.g or []) if r.doc_id == 1 else [], 1)
    expected = np.log(good / good.sum() / (raw / raw.sum()))
    assert np.allclose([r.weight for r in found.orderBy("bucket").collect()], expected, rtol=0, atol=1e-12)


@here
def test_quality_score_is_the_mean_log_ratio(spark, documents):
    trusted = quality.trusted_ids(spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in trusted.collect()}
    grams = {r.doc_id: r.g for r in documents.select("doc_id", quality.grams(F.col("text")).alias("g")).collect()}
    raw, sure = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for key, own in grams.items():
        np.add.at(raw, own, 1)
        if key in good:
            np.add.at(sure, own, 1)
    ratio = np.log((sure + 1) / (sure.sum() + quality.BUCKETS) / ((raw + 1) / (raw.sum() + quality.BUCKETS)))
    for r in quality.judged(documents, trusted).collect():
        assert abs(r.score - (ratio[grams[r.doc_id]].mean() if grams[r.doc_id] else 0)) < 1e-9
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [r.kept for r in quality.judged(documents, trusted).collect() if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert np.mean(kept) >= 0.99


# language

@pytest.fixture(scope="module")
def spoken(documents):
    return languages.train(documents, ~languages.held_out())


@here
def test_language_of_held_out_documents(spark, spoken):
    other = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(languages.held_out())
    rows = table(languages.predict(other, spoken), "lang", "lang_pred", "score")
    assert np.mean([a == b for a, b, _ in rows]) >= 0.95 and all(0 <= s <= 1 for *_, s in rows)


@here
def test_words_of_mixed_texts_have_their_own_language(documents, spoken):
    by = {r.lang: r.text.split()[:30] for r in documents.filter("length(text) > 1500").collect()}
    parts = [by[k] for k in sorted(by)]
    _, each = languages.posteriors(spoken, pa.array([" ".join(sum(parts, []))]))
    truth = sum(([k] * len(by[k]) for k in sorted(by)), [])
    assert np.mean([spoken.languages[k] == t for k, t in zip(each.argmax(axis=1), truth)]) >= 0.85


@here
def test_long_texts_are_read_in_parts_like_whole_ones(documents, spoken):
    text = " ".join(r.text for r in documents.limit(20).collect())
    found, each = languages.posteriors(spoken, pa.array([text]))
    hashed = languages.wd.hashes(found)
    scores = languages.emissions(spoken, found.data, found.starts, found.ends, hashed)
    whole = languages.forward_backward(scores[None].astype(float), np.array([len(scores)]), spoken.transitions)
    assert np.abs(whole[0] - each).max() < 0.02


@here
def test_language_of_awkward_rows(docs, spoken):
    got = {r.doc_id: (r.lang_pred, r.score) for r in languages.predict(docs(ODD), spoken).collect() if r.doc_id}
    assert got[1] == got[2] == got[3] == got[11] == ("und", 0.0) and got[9][0] != "und" and got[6][0] != "und"
    assert languages.identified(docs([])).count() == 0
    assert {r.lang_pred for r in languages.identified(docs([(1, "no labels here")])).collect()} == {"und"}


# licences

FILES = [("a/LICENSE", "Released under the MIT License."), ("a/x.py", "nothing here"), ("a/b/y.py", None), ("a/b/c/z.py", ""),
         ("a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."), ("other/q.py", "plain words"),
         ("a/b/h.py", "Licensed under the Apache License, Version 2.0.\n" + "many other words follow in this file " * 30),
         (None, "Released under the MIT License."), ("top.py", "the of and"), ("a/x.py", "nothing here")]


def test_licences_come_from_headers_files_and_directories(spark):
    files = spark.createDataFrame([(p, t, "x") for p, t in FILES], "path string, text string, licence string")
    got = [(r.path, r.licence, r.origin, r.holder) for r in licenses.licences(files).collect()]
    assert sorted(got, key=str) == sorted([
        ("a/LICENSE", "MIT", "file", None), ("a/x.py", "MIT", "inherited", "a/LICENSE"), ("a/x.py", "MIT", "inherited", "a/LICENSE"),
        ("a/b/y.py", "GPL-3.0", "inherited", "a/b/LICENSE"), ("a/b/c/z.py", "GPL-3.0", "inherited", "a/b/LICENSE"),
        ("a/b/LICENSE", "GPL-3.0", "file", None), ("other/q.py", None, None, None), ("a/b/h.py", "Apache-2.0", "header", None),
        (None, "MIT", "file", None), ("top.py", None, None, None)], key=str)
    assert licenses.licences(files.limit(0)).count() == 0


@here
def test_licence_lines_of_documents_are_found(documents):
    files = licenses.document_paths(documents)
    got = {r.path.rsplit("/", 1)[1]: (r.licence, r.origin) for r in licenses.licences(files).collect()}
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for key, text in table(documents, "doc_id", "text"):
        stated = {lines[x] for x in (text or "").split("\n") if x in lines}
        if stated:
            assert got[str(key)][0] in stated
        else:
            assert got[str(key)][1] in (None, "inherited")


WRAPPED = {
    "MIT": """# Permission is hereby granted, free of charge, to any person
# obtaining a copy of this software and associated documentation
# files (the "Software"), to deal in the Software without
# restriction, including without limitation the rights to use, copy,
# modify, merge, publish, distribute, sublicense, and/or sell copies
# of the Software, and to permit persons to whom the Software is
# furnished to do so, subject to the following conditions:""",
    "BSD-3-Clause": """ * Redistribution and use in source and binary forms, with
 * or without modification, are permitted provided that the
 *
 * following conditions are met:""",
    "MPL-2.0": "dnl This Source Code Form is subject to the\ndnl terms of the Mozilla\ndnl Public License, v. 2.0."}
CODE = "\n".join(f"value{k} = compute{k % 7}(other{k}, item{k % 11}) + rest{k}" for k in range(60))


def test_wrapped_notices_and_full_licence_texts_are_found(spark):
    folder = Path(licenses.__file__).parent / "texts"
    rows, expected = [], {}
    for name, notice in WRAPPED.items():
        rows.append((f"code/{name}", f"{CODE}\n{notice}\n{CODE}"))
        expected[f"code/{name}"] = (name, "header", None)
    for name in licenses.TEXTS:
        text = (folder / f"{name}.txt").read_text()
        joined = "Copyright 2021 Someone\n" + re.sub(r"\s+", " ", text).replace(". ", ".\n")
        rows += [(f"{name}/LICENSE", joined), (f"{name}/a/b.c", "int f;"), (f"{name}/top", None)]
        expected |= {f"{name}/LICENSE": (name, "file", None), f"{name}/a/b.c": (name, "inherited", f"{name}/LICENSE"),
                     f"{name}/top": (name, "inherited", f"{name}/LICENSE")}
    prose = "The people of the town and of the country are to be with it as they were in the year before that. " * 40
    rows += [(f"plain/{k}", f"{prose}{k} {CODE}") for k in range(20)]
    expected |= {f"plain/{k}": (None, None, None) for k in range(20)}
    files = spark.createDataFrame(rows, "path string, text string")
    assert {r.path: (r.licence, r.origin, r.holder) for r in licenses.licences(files).collect()} == expected


def test_common_words_outside_the_templates_weigh_little(spark):
    """Weights of words come from all texts, also of words in no template."""
    rows = [(f"d{k}/x", f"alle koda van ons voor elke mens word{k}") for k in range(400)]
    rows += [("n/x", f"{CODE}\nAlle koda van ons released under the MIT License voor elke mens.\n{CODE}"),
             ("m/x", "Qaza wexo released zurbo under vekti the MIT trolu License bnimo gripa hosto klemu.")]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.licence, r.origin) for r in licenses.licences(files).collect()}
    assert got.pop("n/x") == ("MIT", "header") and set(got.values()) == {(None, None)}


def test_words_of_a_kind_do_not_collide(docs):
    """Unequal words that a polynomial hash modulo 2**64 can not tell apart, whatever its base."""
    odious = "a"
    for _ in range(10):
        odious += odious.translate(str.maketrans("ab", "ba"))
    evil = odious.translate(str.maketrans("ab", "ba"))
    rows = [(1, odious), (2, evil), (3, f"one two three four five {odious}"), (4, f"one two three four five {evil}"),
            (5, odious), (6, "x" * 5_000), (7, "x" * 5_001), (8, "y " + "x" * 5_000)]
    got = {r[0]: r[1:] for r in table(neardup.near_duplicates(docs(rows), 80), "doc_id", "n_shingles", "component_id")}
    assert got == brute.near(rows, 80)
    found = words.split(pa.array([odious, evil, odious, None, "ab" * 300, "ab" * 300 + " a"]))
    hashed = words.hashes(found).tolist()
    assert hashed[0] == hashed[2] and hashed[3] == hashed[4] and len(set(hashed)) == 4


@here
def test_ordinary_numbers_are_left_alone(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = private.train(documents)
    clean = [t for (t,) in table(documents, "text") if t and not re.search("[0-9@]", t) and len(t) > 300][:20]
    numbers = ["1,234,567.89", "978-3-16-148410-0", "10.4.2-17", "802.11.4.5", "555 100 2000", "1234567890123456",
               "2024-03-05", "12:30:45", "3.14159", "1990-1995", "12 000 000"]
    texts = [f"{t[:t.index(' ', 100)]} {n} {t[t.index(' ', 100) + 1:]}" for t in clean for n in numbers]
    found = private.tagged(model, texts)
    wrong = {n: sum(bool(f) for f in found[k::len(numbers)]) for k, n in enumerate(numbers)}
    assert sum(wrong.values()) <= 0.1 * len(texts), wrong


def test_samples_are_bounded_by_rows(spark, docs, monkeypatch):
    """A third of all rows have one id; languages are many, and one has long rows only."""
    rows = [(1 if k % 3 == 0 else k, f"call {k} now @ home", "s", f"l{k % 90}") for k in range(900)]
    rows += [(5_000, "long " * 9_000, "s", "verbose"), (1, rows[0][1], "s", rows[0][3])]
    frame = docs(rows)
    got = languages.sample(frame, F.lit(True), rows=10, most=182).collect()
    assert len(got) == 90 * 2 + 1 and {r.lang for r in got} == {r[3] for r in rows}
    assert max(len(r.text) for r in got) == languages.ROW_CHARS
    seen = []
    monkeypatch.setattr(private, "SAMPLE_ROWS", 50)
    monkeypatch.setattr(private, "training_windows", lambda texts, random: seen.extend(texts) or (
        np.zeros((0, private.TRAIN_WINDOW), np.int64), np.zeros((0, private.TRAIN_WINDOW), np.int64)))
    private.train(frame)
    assert len(seen) == 50


def test_pieces_without_an_id_are_spread(spark, docs):
    """A third of the rows have no id: they go to all shards, and sequences are few."""
    numbers = np.random.default_rng(8)
    rows = [(None if k % 3 == 0 else k, "word " * int(numbers.integers(1, 400))) for k in range(1500)]
    pieces = shared.keep(packing.tokenized(docs(rows)), "pieces")
    packed = packing.pack(pieces, shard_pieces=100).withColumn("shard", F.col("sequence_id") % 16)
    by_shard = [r["count"] for r in packed.filter("doc_id is null").groupBy("shard").count().collect()]
    assert len(by_shard) == 16 and max(by_shard) < 60
    used, tokens = packing.pack(pieces).selectExpr("count(distinct sequence_id)", "sum(length)").first()
    assert used <= 1.01 * -(-tokens // 1024) + 1


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_archives_are_written_under_any_name_of_the_folder(spark, tmp_path, scheme):
    pages = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "page_id long, html string")
    got = warc.round_trip(pages, f"{scheme}{tmp_path}/warc").orderBy("page_id").collect()
    assert [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got] == [
        (1, "revisit", 2, 1), (2, "response", None, 1), (3, "response", None, 0)]
    with pytest.raises(Exception):
        warc.qualified(spark, "nosuchscheme://host/warc")


def test_revisits_need_the_response_that_they_name(spark, tmp_path):
    def records(*rows):
        return shared.keep(spark.createDataFrame(rows, warc.RECORDS), "records")

    response, copy = ("u1", 1, 3, "AB", "response", None, "x"), ("u2", 2, None, "AB", "revisit", "u1", "x")
    assert {(r.page_id, r.payload_bytes, r.refers_to) for r in warc.linked(records(response, copy)).collect()} == {
        (1, 3, None), (2, 3, 1)}
    for wrong in (("u2", 2, None, "ZZ", "revisit", "u1", "x"), ("u2", 2, None, "AB", "revisit", "u9", "x")):
        with pytest.raises(Exception, match="no response"):
            warc.linked(records(response, wrong)).collect()


@here
def test_only_pages_that_may_be_revisits_are_shuffled(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    again = warc.roles(pages).filter("refers_to is not null").select(F.xxhash64("_id", "_mark").alias("row"))
    rows = pages.withColumn("row", F.xxhash64("page_id", F.xxhash64(F.encode("html", "UTF-8"))))
    likely, others = shared.split_ids(rows, shared.keep(again, "again"), "row")
    assert likely.count() == again.count() < rows.count() and likely.count() + others.count() == rows.count()


def test_workers_keep_no_encoder_after_packing(spark, docs):
    from caseframe.llm import packing

    packing.tokenized(docs([(k, f"alpha beta{k}") for k in range(40)])).collect()

    def held(batches):
        import gc

        import pyarrow as pa
        from caseframe.llm import packing

        for _ in batches:
            found = sum(isinstance(x, packing.Encoder) for x in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([found])], names=["held"])

    rows = spark.range(0, 800, 1, 8).mapInArrow(held, "held bigint").collect()
    assert len(rows) == 8 and not any(r.held for r in rows)


def test_sets_of_texts_are_passed_on_by_slices():
    import pyarrow as pa
    from caseframe.llm import neardup

    texts = ["one two three four five six " * 20_000, "a b", None, "seven " * 200_000, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(neardup._slices([batch, batch.slice(0, 0), batch]))
    assert len(parts) >= 4
    assert [k for p in parts for k in p["doc_id"].to_pylist()] == [*range(5)] * 2
    assert [len(v) for p in parts for _, _, v in neardup._texts(p)] == [6, 1, 0, 1, 0] * 2


def test_documents_are_packed_in_small_batches(spark, monkeypatch):
    """Tasks that read texts get few bytes at once, and the session's limit stays as it was."""
    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            n, most = batch.num_rows, batch.get_total_buffer_size()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int64()),
                 pa.array([1] * n, pa.int64()), pa.array([most] * n, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    texts = spark.range(0, 6000, 1, 1).selectExpr("id doc_id", "repeat(concat(id, ' words '), 200) text")
    monkeypatch.setattr(packing, "tokenized", lambda docs, path, length: docs.mapInArrow(sizes, packing.PIECES))
    got = packing.packed_documents(texts).agg(F.max("ids_crc32"), F.count("*")).first()
    assert got[0] < 4_000_000 and got[1] == 6000
    monkeypatch.setattr(neardup, "sketches", lambda docs: docs.mapInArrow(
        sizes, packing.PIECES).selectExpr("doc_id", "cast(string(doc_id) as binary) node", "ids_crc32 n_shingles",
                                          "cast(null as binary) registers"))
    monkeypatch.setattr(neardup, "links_of", lambda docs, nodes, percent: nodes.selectExpr("node", "node label"))
    got = neardup.near_duplicates(texts).agg(F.max("n_shingles"), F.count("*")).first()
    assert got[0] < 4_000_000 and got[1] == 6000
    assert spark.conf.get(key) == before
    with pytest.raises(ZeroDivisionError), shared.small_batches(spark):
        assert spark.conf.get(key) == str(shared.BATCH_BYTES)
        raise ZeroDivisionError
    assert spark.conf.get(key) == before


def test_an_encoder_remembers_a_bounded_number_of_chunks(tokenizer):
    from public_tokenizers import path

    ids_of = packing.Encoder(path(packing.VOCABULARY))
    for k in range(50):
        text = " ".join(f"w{n}" for n in range(10_000 * k, 10_000 * k + 10_000))
        found = ids_of(text)
        assert len(ids_of.spaced) <= 210_000
    assert found == np.array(tokenizer.encode(text).ids, "<u4").tobytes()
    assert "tokenizer" not in vars(ids_of)  # for texts that can not be cut alone
    for text in STRANGE:
        assert ids_of(text) == np.array(tokenizer.encode(text).ids, "<u4").tobytes()


def test_tasks_that_read_texts_give_memory_back(spark, monkeypatch):
    import pyarrow as pa
    from public_tokenizers import path

    class Docs:
        """Documents whose tasks run here."""

        columns, sparkSession = ["doc_id", "text"], spark
        schema = spark.range(0).selectExpr("id doc_id", "string(id) text").schema

        def select(self, *columns):
            return self

        drop = select

        def mapInArrow(self, task, schema):
            return list(task(iter([batch, batch.slice(0, 1)])))

    class Pool:
        def release_unused(self):
            calls.append(1)

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c", None])], names=["doc_id", "text"])
    model = languages.fit(["ein und der", "the of and"] * 20, [0, 1] * 20, ["de", "en"])
    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    for task in (lambda: neardup.sketches(Docs()), lambda: packing.tokenized(Docs(), path(packing.VOCABULARY)),
                 lambda: languages.predict(Docs(), model)):
        calls = []
        assert sum(found.num_rows for found in task()) == 3 and calls == [1]
