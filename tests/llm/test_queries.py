"""Registered queries against plain versions, at the smallest scale."""

import collections
import hashlib
import json
import zlib
from pathlib import Path

import pytest

import brute
from fleetpulse.llm.plans import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name):
    return {r[0]: r for r in QUERIES[name](spark, SF).collect()}


def test_op1(spark, docs):
    got = result(spark, "op1_language_crf")
    assert got.keys() == docs.keys() and all(r.held_out == brute.held_out(i) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i in docs if got[i].held_out]
    assert sum(got[i].lang_pred == docs[i].lang for i in held) >= 0.9 * len(held)


def test_op2(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    for i, r in result(spark, "op2_token_counts").items():
        n = len(tokenizer.encode(docs[i].text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[i].text.encode()), n, n > 512)


def test_op3(spark, docs):
    bench = [(r.item_id, brute.folded(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, r in result(spark, "op3_qgram_decontamination").items():
        text = brute.folded(docs[i].text)
        assert set(r["items"]) >= {k for k, t in bench if t in text}
        assert r.contaminated == bool(r["items"])


def test_op4(spark, docs):
    want = brute.near_duplicates([(i, r.text) for i, r in docs.items()])
    got = result(spark, "op4_bbit_minhash")
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_op5(spark, docs):
    got = result(spark, "op5_external_shuffle")
    slots = collections.defaultdict(list)
    for i, r in got.items():
        raw = docs[i].text.encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
        slots[r.shard].append(r.slot)
    assert got.keys() == docs.keys() and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert got == result(spark, "op5_external_shuffle")


def test_op6(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows):
        want[c].append((role, text or ""))
    got = result(spark, "op6_chat_events")
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_op7(spark, docs):
    ids = sorted(docs)
    got = result(spark, "op7_difference_cover")
    assert [(got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in ids] == brute.repeats([docs[i].text for i in ids], 400)


def test_op8(spark, docs):
    for i, r in result(spark, "op8_skip_chain_pii").items():
        base = brute.personal_data(docs[i].text)
        n = collections.Counter(k for k, _, _ in base)
        lines = [f"{k}:{a}:{b}" for k, a, b in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        assert r.base_sha256 == hashlib.sha256(",".join(lines).encode()).hexdigest() and set(lines) <= set(r.spans.split(",")) | {""}


def test_op9(spark, docs):
    got = result(spark, "op9_source_mix")
    assert got.keys() == docs.keys()
    size = {i: len(brute.WORD.findall(docs[i].text)) for i in docs}
    by, taken, target = collections.Counter(), collections.Counter(), {}
    for i, r in got.items():
        assert r.size == size[i] and 0 <= r.taken <= 2 * r.size
        by[docs[i].source] += size[i]
        taken[docs[i].source] += r.taken
        target[docs[i].source] = r.target
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by))}
    left, want = 1.5 * sum(by.values()), {}
    while True:
        free = [s for s in by if s not in want]
        level = left / sum(weights[s] for s in free)
        over = [s for s in free if level * weights[s] > 2 * by[s]]
        if not over:
            want.update({s: level * weights[s] for s in free})
            break
        for s in over:
            want[s] = 2.0 * by[s]
            left -= want[s]
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= 200 for s in want)
    assert got == result(spark, "op9_source_mix")


def test_op10(spark, docs):
    for i, r in result(spark, "op10_quality_mcd").items():
        want = brute.quality(docs[i].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.kept and r.base_failed)


def test_pipeline(spark, docs):
    import corpus_pipeline

    frame, kept = spark.read.parquet(f"{SF}/documents.parquet"), None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        frame = stage(spark, frame, SF).cache()
        rows = frame.collect()
        if k == 0:
            assert {r.doc_id for r in rows} <= {i for i, r in docs.items() if (q := brute.quality(r.text))[0] >= 20 and 100 * q[4] <= 30 * q[0]}
            kept = brute.near_duplicates([(r.doc_id, r.text) for r in rows])
        if k == 1:
            assert {r.doc_id for r in rows} == {i for i, (_, c) in kept.items() if i == c}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} <= {r.doc_id for r in rows} and all(r.text in docs[r.doc_id].text and r.n_chars == len(r.text) for r in out)
    assert json.dumps(sorted(map(list, out), key=repr)) == json.dumps(sorted(map(list, corpus_pipeline.run(spark, SF).collect()), key=repr))
