"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; small lengths and planted cases."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from fleetpulse.llm import chat, counts, decontaminate, graph, langid, minhash, mixing, pii, quality, repeats, sharding

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BENCH = "item_id long, text string"


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and then sleeps for a whole day in the sun"), (2, None), (None, "x" * 90), (3, "short")], BENCH)


def all_operators(docs, bench):
    yield langid.label_languages(docs, ["doc_id"])
    yield counts.count_tokens(docs, TOKENIZER)
    yield decontaminate.find_passages(docs, bench)
    yield minhash.near_duplicates(docs)
    yield minhash.keep_first(docs)
    yield sharding.slots(*sharding.external_shuffle(docs, 3))
    yield repeats.find_repeats(docs)
    yield pii.find_personal_data(docs, ["doc_id"])
    yield mixing.taken_words(*mixing.mix(docs))
    yield mixing.mixed_texts(docs, *mixing.mix(docs))
    yield quality.quality_rules(docs)


def test_no_rows(no_docs, bench):
    assert [df.count() for df in all_operators(no_docs, bench)] == [0] * 11


def test_every_row_comes_out(odd_docs, bench):
    n = odd_docs.count()
    out = [df.count() for df in all_operators(odd_docs, bench)]
    assert [x for k, x in enumerate(out) if k not in (4, 9)] == [n] * 9 and out[4] < n


def test_odd_near_duplicates(odd_docs):
    got = collections.defaultdict(list)
    for r in minhash.near_duplicates(odd_docs).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == got[1] and [got[i][0][1] for i in (1, 2, 3)] == [1, 2, 3] and got[1][0][0] == 0
    assert got[5] == [(156, 4, False)] * 2 and got[7][0][1] == 6 and got[9] == [(1, 8, False)] and got[None] == [(157, None, True)]


def test_odd_repeats(odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want = sorted(zip([str(r.doc_id) for r in rows], [x[0] for x in brute.repeats([r.text for r in rows], 400)]))
    assert sorted((str(r.doc_id), r.n_removed) for r in repeats.find_repeats(odd_docs).collect()) == want


@pytest.mark.parametrize("length", [3, 24, 60, 300])
def test_repeats_of_other_lengths(spark, length):
    rng = random.Random(length)
    texts = ["".join(rng.choice("abé") for _ in range(rng.randrange(length * 3))) for _ in range(30)]
    for _ in range(40):
        a, b = rng.choice(texts), rng.randrange(30)
        cut = rng.randrange(len(a) + 1)
        texts[b] = (texts[b][:rng.randrange(len(texts[b]) + 1)] + a[cut:cut + length + 20])[-4000:]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, len(r.spans), r.kept_sha256) for r in repeats.find_repeats(docs, length, bucket_bytes=500).collect()}
    assert [got[i] for i in range(30)] == brute.repeats(texts, length)


@pytest.mark.parametrize("v", [2, 3, 7, 20, 133])
def test_difference_covers(v):
    cover = np.array(repeats.PERFECT_133) if v == 133 else repeats.difference_cover(v)
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_links_that_no_star_shows(spark):
    """A chain of near copies: neighbours are linked, the ends are not."""
    words, rows = [f"w{i}" for i in range(200)], []
    for k in range(12):
        rows.append((20 - k if k % 2 else 40 + k, " ".join(words)))
        words = words[:k * 15] + [f"x{k}_{i}" for i in range(12)] + words[k * 15 + 12:]
    rng = random.Random(3)
    for i in range(100, 160):
        rows.append((i, " ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(rng.randrange(1, 14)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()} == brute.near_duplicates(rows)


def test_estimate_is_near_the_similarity(spark):
    rng = np.random.default_rng(0)
    rows = []
    for share in (300, 600, 900):
        x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        y = np.concatenate([x[:share], rng.integers(0, 2**63, 1000 - share, dtype=np.uint64)])
        rows.append((share / (2000 - share), minhash.pack(minhash.minima(x)).tolist(), minhash.pack(minhash.minima(y)).tolist()))
    df = spark.createDataFrame(rows, "s double, x array<long>, y array<long>")
    assert all(abs(r[0] - r[1]) < 0.12 for r in df.select("s", minhash.estimate(F.col("x"), F.col("y"))).collect())


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r.id: r.component for r in graph.components(links).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_passages_with_edits(spark, bench):
    item = bench.first().text
    edited = item.replace("brown", "brwn").replace("lazy", "lazzy").upper()
    cut = item[:70]
    docs = spark.createDataFrame([(1, "before " + item + " after"), (2, "x " * 3000 + edited.replace(" ", " \n ") + " y" * 50), (3, "no passage here " * 40), (4, cut), (5, None)], "doc_id long, text string")
    for block in (4 << 20, 20):
        got = {r.doc_id: r["items"] for r in decontaminate.find_passages(docs, bench, block).collect()}
        assert got == {1: [1], 2: [1], 3: [], 4: [], 5: []}


def test_aligned_against_full_alignment(spark):
    rng = random.Random(5)
    item = "".join(rng.choice("abcd ") for _ in range(80)).replace("  ", "aa").strip().ljust(80, "b")
    index = decontaminate.Windows([(1, item)])
    for trial in range(60):
        text = list(item)
        for _ in range(rng.randrange(7)):
            at = rng.randrange(len(text))
            text[at:at + rng.randrange(2)] = rng.choice(["", "z", "zz"])
        raw = ("".join(rng.choice("abcd") for _ in range(50)) + "".join(text) + "c" * 30).encode()
        data, bounds = decontaminate.normalise(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert bool(len(index.places(data, bounds)[0])) == (brute.edit_place(brute.folded(item), data.tobytes()) <= 4)


def test_token_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    texts = ["one two", "one two", "", None, "<|endoftext|> ok", "漢字 \u2028 x\u00a0y", "a\x1cb\x85c", "  lead\n\n\ttabs  ", "it's we'll 's", "€ – ‘q’ ²³ ªº"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in counts.count_tokens(docs, TOKENIZER, cache).collect()} == want
    assert spark.read.parquet(cache).count() == 8  # one row per distinct text
    more = docs.unionByName(spark.createDataFrame([(99, "new text")], docs.schema))
    assert {r.doc_id: r.n_tokens for r in counts.count_tokens(more, TOKENIZER, cache).collect() if r.doc_id < 99} == want
    assert spark.read.parquet(cache).count() == 9


def test_shards_grow_into_the_new_one(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), (F.col("id") % 40).cast("int")).alias("text"))
    a = {r.doc_id: (r.shard, r.slot) for r in sharding.slots(*sharding.external_shuffle(docs, 4, bucket_bytes=20_000)).collect()}
    b = {r.doc_id: r.shard for r in sharding.slots(*sharding.external_shuffle(docs, 5)).collect()}
    assert len(set(a.values())) == 5000 and all(b[i] in (a[i][0], 4) for i in a)
    sizes = collections.Counter(s for s, _ in a.values())
    assert all(abs(n - 1250) < 200 for n in sizes.values())
    order = [i for i, _ in sorted(a.items(), key=lambda x: x[1])]
    assert abs(np.corrcoef(order[:1000], range(1000))[0, 1]) < 0.2


def test_texts_are_shuffled_once(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), F.col("id").cast("int")).alias("text"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = sharding.slots(*sharding.external_shuffle(docs, 4, bucket_bytes=500))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert out.groupBy("shard").agg((F.max("slot") + 1 - F.count("*")).alias("gap")).where("gap != 0").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_chat_events(spark):
    log = [(1, 0, 0, 0, "open", "user", 0, 0), (1, 0, 0, 1, "delta", "hexlo", 0, 0), (1, 0, 0, 2, "edit", "l", 2, 1), (1, 1, 0, 0, "open", "assistant", 0, 0),
           (1, 1, 0, 1, "delta", "bad", 0, 0), (1, 1, 0, 2, "regenerate", "", 0, 0), (1, 1, 0, 3, "delta", "good \\ </s>", 0, 0), (1, 1, 0, 4, "delta", "<s> é", 0, 0)]
    events = spark.createDataFrame(log, "conv_id long, turn long, tie int, seq int, kind string, body string, at int, n int")
    out = chat.format_chats(events.orderBy(F.rand(1)))
    r = out.select(chat.read_back(F.col("formatted")).alias("t"), chat.under_loss(F.col("formatted"), F.col("loss_spans")).alias("l"), "formatted").first()
    assert [tuple(x) for x in r.t] == [("user", "hello"), ("assistant", "good \\ </s><s> é")] and r.l == "good \\ </s><s> é"
    assert r.formatted.count("</s>") == 2 and r.formatted.count("<s>") == 1


def test_odd_conversations(spark):
    texts = ["\\", "\\\\", "</s>", "<<s>", "[INST]x[/INST]", "\\</s>\\", "", None, "[/INST]\\[INST]", "a\nb", "x" * 70_000, "é" * 500]
    rows = [(i, t, role, x) for i, x in enumerate(texts) for t, role in enumerate(["user", "assistant", "to[INST]ol", None])] + [(50, 0, "user", "same"), (50, 0, "user", "same"), (None, None, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r[0]: [tuple(x) for x in r[1]] for r in chat.format_chats(chat.events_of(df)).select("conv_id", chat.read_back(F.col("formatted"))).collect()}
    for i, x in enumerate(texts):
        assert got[i] == [(role or "", x or "") for role in ("user", "assistant", "to[INST]ol", None)]
    assert got[50] == [("user", "same")] * 2 and got[None] == [("user", "lost")]
    assert chat.format_chats(chat.events_of(df.limit(0))).count() == 0


def test_personal_data_patterns():
    rng = random.Random(2)
    parts = ["a@b.co", "x_y@z", "@@", "a@b.c@d.e", "u@v-w.org_x@y.zz", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+12", "++1 2 3",
             "é", " ", "\n", ".", "-", "007.08.09.0255", "+49 30 1234567", "12345678901234567890", "٣٤٥", "%"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute.personal_data(text), text


def test_linked_mentions_get_one_label(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        card = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
        card += next(str(d) for d in range(10) if brute.luhn(card + str(d)))
        rows.append((i, f"pay with {card} today , later id{rng.randrange(99)} and code x{rng.randrange(10**6)} end"))
    docs = spark.createDataFrame(rows + [(999, "again 4111111111111111 and later 4111111111111111x too")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(docs, ["doc_id"]).collect()}
    assert all(len(got[i].spans) == len(got[i].base_spans) == 1 for i in range(300))
    assert {(s["kind"], s["start"], s["end"]) for s in got[999].base_spans} <= {(s["kind"], s["start"], s["end"]) for s in got[999].spans}


def test_permutation_of_any_size(spark):
    for n in (1, 2, 7, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(n))


def test_robust_shape_ignores_outliers(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(120)]
        rows.append((i, " ".join(w + ("#$%&#$%&" if i < 60 else "") for w in words), "en", "s"))
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i] for i in range(60)) and all(got[i] for i in range(60, 600))


def test_code_switched_words():
    rng = random.Random(6)
    sides = [["sch", "ung", "lich", "keit"], ["tion", "ough", "the", "wh"]]
    make = lambda k, n: " ".join("".join(rng.choice(sides[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    weights, transitions = langid.fit([make(k, 60) for _ in range(40) for k in (0, 1)], [0, 1] * 40, 2)
    text = f"{make(0, 20)} {make(1, 20)}".encode()
    words = langid.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    marginals, _ = langid.forward_backward(words.emissions(weights), words, transitions)
    assert (marginals.argmax(1) == [0] * 20 + [1] * 20).mean() > 0.95
