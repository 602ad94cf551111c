"""Passages: runs of words that other documents have too, below the 400 bytes of a removed repeat as well."""

import collections
import random

import pytest
from brute import WORD
from fleetpulse.llm import plans, repeats


def passages(texts, words):
    """(words in passages, byte runs) of each text, from all windows."""
    found = [[(m.group(), len(t[:m.start()].encode()), len(t[:m.end()].encode())) for m in WORD.finditer(t)] for t in (t or "" for t in texts)]
    windows = [[tuple(w for w, _, _ in f[i:i + words]) for i in range(len(f) - words + 1)] for f in found]
    holders = collections.Counter(w for own in windows for w in set(own))
    out = []
    for f, own in zip(found, windows):
        on = [False] * (len(f) + 1)
        for i, w in enumerate(own):
            if holders[w] > 1:
                on[i:i + words] = [True] * words
        runs, first = [], None
        for k, x in enumerate(on):
            if x and first is None:
                first = k
            if not x and first is not None:
                runs.append((f[first][1], f[k - 1][2]))
                first = None
        out.append((sum(on), runs))
    return out


def found(docs, **options):
    return {r.doc_id: (r.passage_words, [(s["first"], s["end"]) for s in r.passages]) for r in repeats.find_repeats(docs, **options).collect()}


def prose(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def test_passages_below_400_bytes(spark, tmp_path):
    """55 words in 274 bytes between other words: nothing is removed, and the passage is told."""
    shared, own, copy = prose("p", 55).replace("1", "é"), prose("r", 60), prose("c", 51)
    rows = [(1, prose("a", 70) + " " + shared + "\n" + prose("b", 9)), (2, shared.replace(" ", "\t \u000b") + " " + prose("d", 80)),
            (3, prose("e", 90)), (4, own + " x " + own), (5, copy), (6, copy), (7, prose("f", 20) + " " + prose("p", 50)), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in plans.QUERIES["op7_difference_cover"](spark, str(tmp_path)).collect()}
    assert [(i, r.n_passages, r.n_passage_words) for i, r in sorted(got.items())] == [
        (1, 1, 55), (2, 1, 55), (3, 0, 0), (4, 0, 0), (5, 1, 51), (6, 1, 51), (7, 0, 0), (8, 0, 0), (9, 0, 0)]
    assert all(r.n_removed == 0 for r in got.values())


@pytest.mark.parametrize("words", [1, 3, 20, 51])
def test_passages_against_all_windows(spark, words):
    rng = random.Random(words)
    texts = [" ".join(rng.choice("a b é ab".split()) + (str(rng.randrange(4)) if words < 20 else "") for _ in range(rng.randrange(words * 4))) for _ in range(30)]
    for _ in range(50):
        a, b = rng.choice(texts).split(" "), rng.randrange(30)
        cut, at, old = rng.randrange(len(a) + 1), rng.random(), texts[b].split(" ")
        at = int(at * len(old))
        texts[b] = rng.choice([" ", "\n"]).join([*old[:at], *a[cut:cut + words + 3], *old[at:]][:2000])
    texts += [texts[0], texts[0], None, "", " \n", texts[1] + " ", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = found(docs, words=words, bucket_bytes=500)
    assert [got[i] for i in range(len(texts))] == passages(texts, words)


def test_passages_of_odd_rows(spark, odd_docs, no_docs):
    assert found(no_docs) == {}
    rows = odd_docs.select("doc_id", "text").collect()
    want = passages([r.text for r in rows], 51)
    got = repeats.find_repeats(odd_docs).collect()
    assert sorted((str(r.doc_id), r.passage_words, len(r.passages)) for r in got) == sorted((str(r.doc_id), n, len(x)) for r, (n, x) in zip(rows, want))
