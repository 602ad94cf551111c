"""Token files, whitening and alignment: registered queries against plain versions, odd tables, round trips."""

import collections
import hashlib
import math
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import brute
from fleetpulse.llm import alignment, tokenfiles, whitening
from fleetpulse.llm.plans import QUERIES

SF = "/root/testdata/sf0.001"
WORDS, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", None, " ", "\n\n", "a", "  two  spaces ", "tab\tand space", "<|endoftext|> inside <|startoftext|>", "Ünïcode ÉTÉ ﬁ ①", "日本語のテキスト", "🙂🙂 x🙂", "we'll 's 12345",
       "▁ under", "é combining", "\u0000nul", "x" * 3000, "İstanbul ΣΑΣ", "a" * 40 + " " + "b" * 70, "don't<|endoftext|>stop"]


def library_ids(path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def in_files(rows, end):
    """(start, n, crc) of (key, text) rows in key order."""
    ids_of, at, out = library_ids(WORDS), 0, []
    for key, text in rows:
        ids = [*ids_of(text), end]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
def test_op11(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(tuple(r) for r in QUERIES["op11_token_files"](spark, SF).collect()) == in_files(docs, 2)


def test_odd_texts_in_files(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").repartition(5)
    folder = tokenfiles.write_tokens(docs, WORDS, 2)
    got = tokenfiles.read_documents(spark, folder, with_ids=True).orderBy("key").collect()
    assert [tuple(r)[:4] for r in got] == in_files(enumerate(ODD), 2)
    every = [[*library_ids(WORDS)(t), 2] for t in ODD]
    assert [r.ids for r in got] == every
    stream = tokenfiles.TokenStream(spark, folder)
    flat = sum(every, [])
    assert len(stream) == len(flat) and stream.ids(0, 10**9).tolist() == flat and stream.ids(17, 200).tolist() == flat[17:217]
    assert [stream.document(k).tolist() for k in range(len(ODD))] == every
    assert tokenfiles.manifest(spark, folder).agg(F.max("id_bytes")).first()[0] == 2


def test_repeated_and_null_keys_in_files(spark, odd_docs, no_docs):
    folder = tokenfiles.write_tokens(odd_docs, WORDS, 2)
    got = sorted(tokenfiles.read_documents(spark, folder).collect(), key=lambda r: r.start)
    rows = odd_docs.select("doc_id", "text").collect()
    want = collections.Counter((i, n, c) for i, _, n, c in in_files([tuple(r) for r in rows], 2))
    assert collections.Counter((r.key, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.key for r in got] == [None, *sorted(r.doc_id for r in rows if r.doc_id is not None)]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    folder = tokenfiles.write_tokens(no_docs, WORDS, 2)
    assert tokenfiles.read_documents(spark, folder).count() == 0 and len(tokenfiles.TokenStream(spark, folder)) == 0


def test_wide_ids_and_other_tokenizers(spark):
    docs = spark.createDataFrame([(2, "two  words\n"), (1, "<|endoftext|>")], "doc_id long, text string")
    folder = tokenfiles.write_tokens(docs, BYTES, 70_000)
    got = tokenfiles.read_documents(spark, folder, with_ids=True).orderBy("key").collect()
    ids_of = library_ids(BYTES)
    assert [r.ids for r in got] == [[*ids_of("<|endoftext|>"), 70_000], [*ids_of("two  words\n"), 70_000]]
    assert tokenfiles.word_rule(WORDS)[1] and tokenfiles.word_rule(BYTES) is None


def test_bases_over_many_partitions(spark):
    n = 3 * tokenfiles.SUMMED + 7
    parts = spark.range(n).selectExpr("CAST(id AS int) AS part", "'p' AS name", "id % 5 + 1 AS n_docs", "0L AS n_null", "id * 3 AS n_ids")
    rows = tokenfiles.with_bases(parts).orderBy("part").collect()
    docs = ids = 0
    for r in rows:
        assert (r.first_doc, r.first_id) == (docs, ids)
        docs, ids = docs + r.n_docs, ids + r.n_ids
    assert len(rows) == n


def whitened_plainly(vectors):
    """n, exact deviations, whitened columns (either sign), shares."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    deviations = [sum((n * r[k] - s[k]) ** 2 for k in range(d)) for r in x]
    centred = np.array([[(n * r[k] - s[k]) / n for k in range(d)] for r in x])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    return n, deviations, centred @ axes / np.sqrt(values), values / np.trace(cov)


def assert_whitened(got, ids, vectors):
    n, deviations, white, shares = whitened_plainly(vectors)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(ids) * white.shape[1] == len(by)
    for k in range(white.shape[1]):
        own = np.array([by[i, k + 1].whitened for i in ids])
        assert min(np.abs(own - white[:, k]).max(), np.abs(own + white[:, k]).max()) < 1e-7
        assert all(abs(by[i, k + 1].explained / shares[k] - 1) < 1e-6 for i in ids)
    assert all(by[i, 1].deviation == d and by[i, 1].n == n and by[i, 1].identity_error <= 1e-8 for i, d in zip(ids, deviations))


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
def test_op12(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    assert_whitened(QUERIES["op12_multiplicity_whitening"](spark, SF).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_odd_vectors(spark):
    rng = random.Random(5)
    common = [1.5, -2.0, 0.25]
    rows = [(i, common if i % 3 else [rng.gauss(0, s) for s in (3, 2, 1)], "x") for i in range(3000)]  # two thirds of the rows are one vector
    bad = [(-1, None, "x"), (-2, [], "x"), (-3, [1.0, None, 2.0], "x"), (-4, [1.0, float("nan"), 2.0], "x"), (-5, [float("inf"), 0.0, 0.0], "x"), (-6, [0.0, float("-inf"), 0.0], None)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, component string").repartition(7)
    got = whitening.whiten(table)
    assert got.columns.count("component") == 1
    assert_whitened(got.collect(), [r[0] for r in rows], [[float(np.float32(c)) for c in r[1]] for r in rows])


def test_vectors_without_variance(spark):
    ddl = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], ddl)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], ddl)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [2.0, 4.0]), (None, [3.0, 6.0])], ddl)).collect()
    assert sorted(round(r.whitened, 9) for r in line) == [-1.224744871, 0.0, 1.224744871] and {r.component for r in line} == {1}
    with pytest.raises(ValueError, match=r"\[1, 2\]"):
        whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], ddl))


def test_exact_deviations_beyond_longs():
    x = np.array([[10**15, 3], [5, 10**14]], np.int64)
    sums, n = x.sum(axis=0), 2
    assert whitening._deviations(x, n, sums) == [sum((n * int(v) - int(s)) ** 2 for v, s in zip(r, sums)) for r in x]


def plain_alignment(rows):
    """The contract's columns of (key, text) rows, from all pairs of tokens."""
    a, b = ((t.encode, t.bytes_of) for t in (alignment.Tokens(BYTES), alignment.Tokens(PIECES)))
    found = [(key, *brute.aligned(text, a, b)) for key, text in rows]
    count = collections.Counter(x for f in found for x in f[4])
    best = collections.Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return collections.Counter((key, len(i), len(j), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                                hashlib.sha256(";".join(groups).encode()).hexdigest() if i else "") for key, i, j, groups, links in found)


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
def test_op13(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 6000]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    blocks = alignment.blocks_of(table, BYTES, PIECES, block_bytes=20_000)
    got = alignment.score_documents(blocks, alignment.link_counts(blocks)).collect()
    assert collections.Counter(map(tuple, got)) == plain_alignment(docs)
    whole = QUERIES["op13_space_anchors"](spark, SF)
    assert whole.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert whole.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_odd_alignments(spark, no_docs):
    rows = [*enumerate(ODD), (None, "a b c"), (4, "a"), (4, "a"), (7, "<|endoftext|> <s> </s>")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("groups", F.lit("mine"))
    blocks = alignment.blocks_of(table, BYTES, PIECES, block_bytes=50)
    got = alignment.score_documents(blocks, alignment.link_counts(blocks)).collect()
    want = plain_alignment(rows)
    assert collections.Counter(map(tuple, got)) == want
    assert sum(n for r, n in want.items() if r[1] == 0) == 3  # null, empty, U+2581
    texts = {r.groups for r in alignment.aligned_texts(table, BYTES, PIECES).where("key = 4").collect()}
    assert len(texts) == 1 and hashlib.sha256(texts.pop().encode()).hexdigest() in {r[7] for r in want}
    blocks = alignment.blocks_of(no_docs, BYTES, PIECES)
    assert alignment.score_documents(blocks, alignment.link_counts(blocks)).count() == 0


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(150_000))  # 1.5 MB
    table = spark.createDataFrame([(1, long), (2, "x" * 200_000), (3, "short one")], "doc_id long, text string")
    got = {r.key: r for r in tokenfiles.read_documents(spark, tokenfiles.write_tokens(table, WORDS, 2)).collect()}
    assert got[1].n_tokens == len(library_ids(WORDS)(long)) + 1 and got[3].n_tokens == 3
    blocks = alignment.blocks_of(table, BYTES, PIECES)
    rows = {r.key: r for r in alignment.score_documents(blocks, alignment.link_counts(blocks)).collect()}
    assert rows[1].n_groups >= 150_000 and rows[2].n_links >= rows[2].n_a > 0 and rows[3].n_groups == 2
