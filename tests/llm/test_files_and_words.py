"""Token files, whitening and spelling variants: awkward rows, and plain versions over whole tables."""

import glob
import random
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseframe.llm import queries, spelling, tokenfiles, whitening
from caseframe.llm.shared import keep
from caseframe.sources.workdir import new_folder
from tests.llm import brute

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are missing")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "İstanbul ǅ ﬁ ñ ́a"), (7, "x" * 30_000),
       (None, "one two"), (None, None), (9, "ünï çode 日本 ÀÉß×÷"), (10, "a\x00b \x1c c\x85d e f"), (4, "one two"),
       (4, "three"), (-3, "I'LL don't <|endoftext|> x<|startoftext|>y <|end"), (11, "!!!'s ###1234 a'"), (12, "w " * 20_000)]


@pytest.fixture(scope="module")
def vocabulary():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    file = path(tokenfiles.VOCABULARY)
    return tokenfiles.Encoder(file), Tokenizer.from_file(file)


# token files

@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZé'sÀßtİ 1\n\t.,!<|>endoftx́ 日Σς−ﬃ"), max_size=30), max_size=4))
def test_chunks_are_encoded_as_whole_texts_are(vocabulary, texts):
    encoder, tokenizer = vocabulary
    got = encoder(texts)
    assert [np.frombuffer(x, encoder.kind).tolist() for x in got] == [
        tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_all_characters_are_encoded_alike(vocabulary):
    encoder, tokenizer = vocabulary
    texts = [f"a{chr(c)}B{chr(c)} {chr(c)}1" for c in range(0x2100) if not 0xD800 <= c < 0xE000]
    got = encoder(texts)
    assert [np.frombuffer(x, encoder.kind).tolist() for x in got] == [
        tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_equal_chunks_of_texts_are_looked_at_once(vocabulary, monkeypatch):
    encoder, tokenizer = vocabulary
    looked = []
    plain = encoder._plain
    monkeypatch.setattr(encoder, "_plain", lambda text: looked.append(text) or plain(text))
    texts = ["alpha, Beta\tgamma9\n", "", "Beta  alpha, beta don't", " alpha,\r\nBeta 日本 a", "Beta alpha,"] * 40
    got = encoder(texts)
    assert [np.frombuffer(x, encoder.kind).tolist() for x in got] == [
        tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(c == "alpha," for c in looked) <= 2 and len(looked) < 20


def test_words_are_encoded_without_a_pattern(vocabulary, monkeypatch):
    encoder, tokenizer = vocabulary
    monkeypatch.setattr(tokenfiles, "_PRE_TOKENS", None)
    texts = ["Qword, ANDMORE. Ünït;\nßa? xyzzy!", "É: Zz"]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder(texts)] == [
        tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_distinct_chunks_are_read_without_a_scalar_each():
    for chunks in ([], [""], ["a", "", "bé"], ["", "x"]):
        assert tokenfiles._strings(pa.array(chunks, pa.large_string())) == chunks


def test_token_files_of_awkward_rows(docs, vocabulary):
    got = [tuple(r) for r in tokenfiles.round_trip(docs(ODD)).collect()]
    expected = brute.token_rows(ODD, lambda t: vocabulary[1].encode(t, add_special_tokens=False).ids)
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert tokenfiles.round_trip(docs([])).collect() == []


@here
def test_token_files_of_the_documents(spark, vocabulary):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_token_files(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in got.collect()) == brute.token_rows(
        rows, lambda t: vocabulary[1].encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_parts_of_token_files(spark, docs, vocabulary, encoding):
    words = random.Random(5)
    rows = [(k, " ".join(words.choice(["alpha", "Beta", "gamma9"]) for _ in range(words.randrange(60))))
            for k in range(3_000)]
    folder = new_folder(spark, "parts")
    tokenfiles.write_tokens(keep(tokenfiles.encoded(docs(rows)), "ids"), folder, encoding=encoding,
                            row_group=30_000, page=2_000, page_rows=50, files=3)
    files = sorted(glob.glob(f"{folder}/tokens/*.parquet"))
    columns = [pq.ParquetFile(f).metadata.row_group(0) for f in files]
    assert len(files) == 3 and pq.ParquetFile(files[0]).metadata.num_row_groups > 1
    for group in columns:
        held = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert all(c.has_column_index and c.has_offset_index for c in held.values())
        assert "DELTA_BINARY_PACKED" in held["offset"].encodings and "DELTA_BINARY_PACKED" in held["doc_id"].encodings
        assert ("RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in held[
            "tokens.list.element"].encodings
    whole = [i for _, text in rows for i in [*vocabulary[1].encode(text, add_special_tokens=False).ids, 2]]
    for first, last in [(0, 10), (777, 778), (5_000, 61_003), (len(whole) - 3, len(whole) + 9), (0, len(whole))]:
        part = tokenfiles.read_range(spark, folder, first, last).orderBy("start").collect()
        assert [i for r in part for i in r.tokens] == whole[first:last]
        assert part[0].start == first and all(r.n_tokens == len(r.tokens) for r in part)
    assert tokenfiles.read_range(spark, folder, len(whole), len(whole) + 5).collect() == []
    some = tokenfiles.read_documents(spark, folder, 40, 42).orderBy("doc_id").collect()
    assert [r.doc_id for r in some] == [40, 41, 42] and some[1].tokens == whole[some[1].start:some[2].start]
    plan = tokenfiles.read_metadata(spark, folder, F.col("doc_id") > 2_990)._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("ReadSchema")[1].split("\n")[0] and "GreaterThan(doc_id,2990)" in plan
    spark.conf.set("spark.sql.maxMetadataStringLength", 1_000)
    ranged = tokenfiles.read_range(spark, folder, 5_000, 6_000)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThan(offset" in ranged and "GreaterThan(stop" in ranged


def test_damaged_ids_are_an_error(spark, docs):
    folder = new_folder(spark, "damaged")
    ids = tokenfiles.encoded(docs([(1, "one two"), (2, "three")]))
    tokenfiles.write_tokens(keep(ids.withColumn("ids", F.encode(F.reverse(F.decode("ids", "iso-8859-1")), "iso-8859-1")), "ids"), folder)
    with pytest.raises(Exception, match="damaged ids"):
        tokenfiles.read_checked(spark, folder).collect()
    with pytest.raises(ValueError):
        tokenfiles.write_tokens(ids, folder, encoding="plain")


# whitening

VECTORS = "vec_id long, embedding array<float>, label int, whitened string, vector int, dimension double"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 1, "x", 2, 0.5) for k, v in rows], VECTORS)


def plain_whitening(rows):
    """Whole numbers, exact deviations, eigenvalues and vectors, from Python's integers."""
    x = [[int(np.floor(64 * np.float64(np.float32(c)))) + 10**6 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    y = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in y) / n**3 for j in range(d)] for i in range(d)])
    values, units = np.linalg.eigh(cov)
    scores = np.array(y, float) / n @ units[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300))
    return [sum(c * c for c in r) for r in y], values[::-1] / cov.trace(), scores


def check_whitening(found, rows, components):
    deviation, shares, scores = plain_whitening(rows)
    got = {(r.vec_id, r.component): r for r in found}
    assert len(found) == len(got) == len(rows) * components
    for c in range(components):
        own = np.array([got[k, c + 1].whitened for k, _ in rows])
        assert min(abs(own - scores[:, c]).max(), abs(own + scores[:, c]).max()) < 1e-7
        assert all(abs(got[k, c + 1].explained - shares[c]) <= 1e-9 for k, _ in rows)
    assert all(int(got[k, 1].deviation) == e and got[k, 1].n == len(rows) for (k, _), e in zip(rows, deviation))
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-8


@pytest.mark.parametrize("scale", [1.0, 3e12])
def test_whitening_of_few_vectors(spark, scale):
    """Small entries, and such whose squares do not fit 64 bits."""
    numbers = np.random.default_rng(3)
    shear = np.eye(5) + np.triu(np.ones((5, 5)), 1)
    rows = [(k, (numbers.normal(size=5) @ shear * scale + 7 * scale).tolist()) for k in range(40)]
    check_whitening(whitening.whitening(vectors(spark, rows).repartition(3)).collect(), rows, 5)


def test_whitening_of_awkward_vectors(spark):
    rows = [(1, [1.0, 2.0, 5.0]), (2, [3.0, -1.0, 5.0]), (2, [0.5, 0.25, 5.0]), (None, [2.0, 2.5, 5.0])]
    bad = [(3, None), (4, []), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 2.0]), (7, [float("inf"), 1.0, 2.0]),
           (8, [-float("inf"), 1.0, 2.0]), (9, [3e38, 1.0, 2.0])]
    found = whitening.whitening(vectors(spark, rows + bad)).collect()
    assert sorted((str(r.vec_id), r.component) for r in found) == sorted(
        (str(k), c) for k, _ in rows for c in (1, 2))  # the third dimension never varies
    assert {r.n for r in found} == {4} and found[0].identity_error < 1e-12
    assert whitening.whitening(vectors(spark, [])).collect() == []
    assert whitening.whitening(vectors(spark, bad)).collect() == []
    assert whitening.whitening(vectors(spark, rows[:1] * 3)).collect() == []
    with pytest.raises(Exception, match="dimensions"):
        whitening.whitening(vectors(spark, [*rows, (11, [1.0, 2.0])]).coalesce(1))
    with pytest.raises(Exception, match="lengths"):
        whitening.fit(vectors(spark, rows).unionByName(vectors(spark, [(11, [1.0, 2.0])])))


@here
def test_whitening_of_the_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = queries.op12_embedding_whitening(spark, SF)
    assert dict(found.dtypes)["deviation"] == "bigint" and dict(found.dtypes)["component"] == "int"
    check_whitening(found.collect(), rows, 32)


def test_polarisation_gives_every_covariance(spark):
    rows = [(k, np.random.default_rng(k).normal(size=4).tolist()) for k in range(30)]
    x = np.array([[np.floor(64 * np.float64(np.float32(c))) for c in v] for _, v in rows])
    model = whitening.fit(vectors(spark, rows))
    back = model.vectors @ np.diag(model.values) @ model.vectors.T
    assert np.allclose(back, np.cov(x.T, bias=True), rtol=1e-12, atol=1e-9)


# spelling variants

def near_pairs(words):
    """Pairs by deletions, checked one by one."""
    held = {}
    for w in words:
        for v in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))}:
            held.setdefault(v, []).append(w)
    return {(a, b) for g in held.values() for a in g for b in g if a < b and brute.one_edit(a, b)}


@settings(max_examples=400, deadline=None)
@given(st.text("abß", min_size=6, max_size=14), st.integers(0, 14), st.sampled_from("abßé"), st.integers(0, 2),
       st.sets(st.text("abß", min_size=2, max_size=5), max_size=25))
def test_bounds_hold_for_every_edit(word, place, put, kind, grams):
    """Grams that an edit leaves stay in both cuts, and a rare one is among those that are merged."""
    place = min(place, len(word) - 1)
    other = word[:place] + (put if kind < 2 else "") + word[place + (kind > 0):]
    if other == word or len(other) < 6:
        return
    longest = min(min(len(word), len(other)) // 2, spelling.LONGEST)
    frequent = {g[:k]: len(g) for g in grams for k in range(2, len(g) + 1)}
    inner = spelling.endings(longest, frequent)
    first = []
    for w in (word, other):
        cut = spelling.decompose(w, longest, frequent)
        bound = spelling.affected(w, cut, longest, frequent, inner)
        assert bound < len(cut)
        order = sorted((frequent.get(w[s:e], 0), w[s:e], s, e) for s, e in cut)
        last = order[bound][:2]
        first.append({x for c, g, s, e in order if (c, g) <= last
                      for x in (("before", w[:e]), ("after", w[s:]))})
    assert first[0] & first[1]


@pytest.mark.parametrize(("least", "most"), [(1, 2), (6, 3), (64, 64)])
def test_near_words_of_a_crowd(spark, least, most):
    """Words with the same beginning and end, in lists of all lengths."""
    numbers = random.Random(11)
    words = {"".join(numbers.choice("abc") for _ in range(numbers.randrange(6, 9))) for _ in range(900)}
    words |= {"contra" + "".join(numbers.choice("abé") for _ in range(numbers.randrange(0, 8))) for _ in range(500)}
    frame = keep(spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n long"), "words")
    got = [(r.u, r.v) for r in spelling.near_words(frame, 6, most, 10**9, least).collect()]
    assert len(got) == len(set(got)) and set(got) == near_pairs(words)


def test_spelling_of_awkward_rows(docs):
    text = "Straße straße STRASSE naïveté naivete ×÷×÷×÷ x" + " colour" * 30 + " color colour's colours" * 6
    rows = [*ODD, (20, text), (20, text), (None, text), (21, "colors " * 5 + "coloured " * 9), (22, "q" * 5_000),
            (23, " ".join(["aaaaaaa"] * 40 + ["aaaaaa"] * 6 + ["aaaaaaaa"] * 40 + ["abaaaaa"] * 300))]
    got = [tuple(r) for r in spelling.variants(docs(rows)).collect()]
    assert sorted(got, key=str) == sorted(brute.spellings(rows), key=str)
    assert ("aaaaaa", "abaaaaa") in {r[:2] for r in got}
    assert spelling.variants(docs([])).collect() == [] == spelling.variants(docs([(1, "too few words")])).collect()
    with pytest.raises(ValueError):
        spelling.variants(docs([]), least_length=3)


def test_roots_follow_long_chains(docs):
    """Each word occurs five times as often as the one before it."""
    rows = [(k, " ".join(["abcdef" + "g" * k] * 5**(k + 1))) for k in range(6)]
    got = {tuple(r) for r in spelling.variants(docs(rows)).collect()}
    assert got == brute.spellings(rows) and len({r[2] for r in got}) < len(got)


@here
def test_spelling_equals_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    answer = connection.execute(queries.ORACLES["op13_spelling_variants"])
    columns = [c[0] for c in answer.description]
    got = queries.op13_spelling_variants(spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert {tuple(r) for r in got.select(*columns).collect()} == set(answer.fetchall())
