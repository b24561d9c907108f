"""Language ID, language model, packing, media, near-duplicates, SentencePiece, search, pipeline."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import table_dir
from pyspark.sql import functions as F

from wideframe.llm import attention_lm, hamming_search, lang_id, mpeg, near_dedup, packing, sentencepiece_codec

SF = "/root/testdata/sf0.001"


def clean_odd(odd):
    return odd.where("doc_id IS NULL OR doc_id <> 7")


# --- language ID ---------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    got = lang_id.op3_lang_id(spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index]
    assert got["held_out"].tolist() == held and got["score"].between(0, 1).all()
    own = got[got["held_out"]]
    assert (own["lang_pred"] == docs.loc[own.index, "lang"]).mean() > 0.97


def test_language_matches_plain_bayes(spark):
    """Scores of the batched numpy form against sums over a text's grams one by one."""
    docs = spark.createDataFrame([("ab ba", "x"), ("abab", "x"), ("cdcd é", "y"), (None, "y"), ("z", None)], "text string, lang string")
    m = lang_id.train(docs)
    assert m.languages == ["x", "y"]
    texts = ["ab", "dc é", "q" * 7, "", None, "12 !", "ab" * 300_000]
    langs, p = m.score(texts)
    assert langs[:3] == ["x", "y", langs[2]] and langs[3:6] == ["und"] * 3 and p[3:6] == [0.0] * 3 and langs[6] == "x"
    t = texts[1]
    codes = np.frombuffer((t + "  ").encode("utf-32-le"), np.uint32)
    total = m.prior.copy()
    for n in (1, 2, 3):
        for k in range(len(t)):
            if n == 1 or k + n <= len(t) + (n - 1):
                g = lang_id._grams(codes, np.array([len(codes)]))[n - 1, k]
                total = total + m.log_p[g]
    want = math.exp(total.max()) / np.exp(total).sum()
    assert p[1] == pytest.approx(want)
    assert lang_id.Model([], np.zeros((1, 0)), np.zeros(0)).score(["a"]) == (["und"], [0.0])


def test_numbers_are_no_letters(spark):
    texts = ["½ ² Ⅷ 12", "½ ²x", "٣", "ª", "漢"]
    assert [lang_id.has_letter(t) for t in texts] == [any(c.isalpha() for c in t) for t in texts] == [False, True, False, True, True]
    m = lang_id.train(spark.createDataFrame([("ab", "x")], "text string, lang string"))
    assert m.score(texts)[0] == ["und", "x", "und", "x", "x"]


def test_language_edges(spark, odd, clashing, empty):
    m = lang_id.train(odd)
    assert lang_id.predict(odd, m).count() == odd.count()
    out = lang_id.predict(clashing, m)
    assert out.count() == clashing.count() and out.where("lang_pred = 'own'").count() == 0 and "class_id" in out.columns
    assert lang_id.predict(empty, m).count() == 0 and lang_id.train(empty).languages == []
    kept = lang_id.keep_known(spark, odd, "")
    assert kept.columns == odd.columns and kept.where("text IS NULL OR text = '' OR doc_id IN (9, 10)").count() == 0
    assert lang_id.keep_known(spark, empty, "").count() == 0
    assert kept.where("doc_id = 2 OR doc_id IS NULL").count() == 2


# --- language model ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("words", [40, 200_000])
def test_base_score(spark, tmp_path, odd, monkeypatch, words):
    monkeypatch.setattr(attention_lm, "BLOCK_WORDS", words)  # of the driver's module: the next line takes it along
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(clean_odd(odd).select("doc_id", "text").where("doc_id IS NOT NULL").selectExpr("doc_id + 100000 AS doc_id", "text"))
    got = attention_lm.op4_lm_score(spark, table_dir(tmp_path, documents=docs)).toPandas()
    rows = [tuple(r) for r in docs.collect()]
    counts = collections.Counter()
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    for i, t in rows:
        if not held(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6))
        for i, t in rows
        for w in [tokens(t)]
    )
    mine = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.itertuples())
    assert len(mine) == len(want)
    for a, b in zip(mine, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
    assert (got["score"] < 0).all()


def test_held_out_score_beats_word_counts(spark):
    """The model's log10 probability of the words of documents that it did not learn from, above the word base."""
    got = attention_lm.op4_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    score, base = got[0] / got[2], got[1] / got[2]
    print(f"held out, log10 of a word: {score:.3f}, word base {base:.3f}")
    assert score > base + 0.05


def test_lm_edges(spark, odd, empty, clashing):
    assert attention_lm.score_documents(empty).count() == 0
    short = clashing.where("doc_id IS NULL OR doc_id < 7").withColumn("block", F.lit("own")).withColumn("learn", F.lit("own"))
    got = attention_lm.score_documents(short, F.col("lang") == "en").collect()  # null languages teach nothing
    assert len(got) == short.count() and {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    train = short.where("lang = 'en'").collect()
    assert {r.train_tokens for r in got} == {sum(len((r.text or "").split()) + 1 for r in train)}
    none = attention_lm.score_documents(short, F.lit(False)).collect()
    assert {(r.base_score, r.n_known, r.train_tokens) for r in none} == {(0.0, 0, 0)} and all(r.score < 0 for r in none)


def _small_model():
    rng = np.random.default_rng(0)
    size = attention_lm.CLASSES + 60
    counts = rng.integers(1, 90, size)
    input_of, class_of = attention_lm.grouped(counts, np.zeros((size, 8), np.float32))
    ids = [rng.integers(0, size, n).astype(np.uint16) for n in (1, 15, 16, 17, 70)]
    near, far = (np.zeros(attention_lm.INPUTS * attention_lm.CLASSES, np.int64) for _ in range(2))
    attention_lm.pair_counts(ids, input_of, class_of, near, far)
    shape = attention_lm.INPUTS, attention_lm.CLASSES
    return attention_lm.build(counts, input_of, class_of, near.reshape(shape), far.reshape(shape)), ids


def test_attention_is_causal_and_normalised():
    m, ids = _small_model()
    end = len(m.class_of) - 1
    c, s = attention_lm.CONTEXT, attention_lm.SCORED
    assert c >= 32
    got = np.split(attention_lm.log_ids(m, ids), np.cumsum([len(i) for i in ids])[:-1])
    assert s >= 1
    for k, i in enumerate(ids):  # one id at a time, from what stands before it
        for at in range(len(i)):
            before = [end if j <= 0 else int(i[j - 1]) for j in range(at - c, at + 1)]
            q = m.weights.query[m.input_of[before[-1]]]
            score = [q @ m.weights.key[m.input_of[b]] + m.weights.offset[len(before) - 1 - j] for j, b in enumerate(before)]
            a = np.exp(np.array([*score, m.weights.offset[-1]], float))
            a /= a.sum()
            values = [m.far[m.input_of[b]] for b in before[:-1]] + [m.near[m.input_of[before[-1]]], m.plain]
            p = sum(x * d for x, d in zip(a, values, strict=True))
            assert p.sum() == pytest.approx(1, abs=1e-4)
            assert got[k][at] == pytest.approx(math.log(p[m.class_of[i[at]]]) + m.log_share[i[at]], rel=1e-4)
    shares = np.bincount(m.class_of, np.exp(m.log_share))
    assert shares[shares > 0] == pytest.approx(1, abs=1e-3)


def test_word_mixture():
    m, ids = _small_model()
    sizes, share = np.array([1, 1, 3, 2]), np.log([0.1, 0.2, 0.3, 0.4])
    words = [np.array([0]), np.array([2, 3] * 3), np.array([1] * 16), np.array([1] * 17), np.array([2] * 23 + [1])]
    log = np.split(attention_lm.log_ids(m, ids), np.cumsum([len(i) for i in ids])[:-1])
    got = attention_lm.score_texts(m, ids, words, sizes, share)
    for k, w in enumerate(words):
        total, at = 0.0, 0
        for x in w:
            own = log[k][at : at + sizes[x]].sum()
            total += math.log(attention_lm.OF_IDS * math.exp(own) + (1 - attention_lm.OF_IDS) * math.exp(share[x]))
            at += sizes[x]
        assert at == len(ids[k]) and got[k] == pytest.approx(total)


def test_attention_learns():
    m, ids = _small_model()
    before = attention_lm.log_ids(m, ids).sum()
    seen, target, use, _ = attention_lm.windows(ids, len(m.class_of) - 1)
    sums = attention_lm.no_sums(m.weights)
    for _ in range(5):
        attention_lm.descend(m, sums, m.input_of[seen].T, m.class_of[target].T, use.T)
    assert attention_lm.log_ids(m, ids).sum() > before


def test_slopes():
    """The gradient against differences of the loss, with windows of several batches."""
    m, ids = _small_model()
    seen, target, use, _ = attention_lm.windows(ids * 60, len(m.class_of) - 1)
    x, y = m.input_of[seen], m.class_of[target]
    assert x.shape[1] > attention_lm.BATCH
    w, n = m.weights, use.sum()
    loss = lambda: -(attention_lm.log_class(m, attention_lm.pulls(w), x, y) * use).sum(dtype=np.float64) / n
    got = attention_lm.slopes(m, x, y, use)
    for p, g in zip((w.query, w.key, w.offset), got, strict=True):
        assert p.shape == g.shape
        way = g / np.sqrt((g**2).sum())  # the steepest way: the loss grows by the gradient's length
        old = p.copy()
        p += 0.02 * way
        up = loss()
        p[...] = old - 0.02 * way
        down = loss()
        p[...] = old
        assert (up - down) / 0.04 == pytest.approx(np.sqrt((g**2).sum()), rel=0.02)


def test_met_by_targets():
    """All that a target sees is a row of its own, whatever batch it falls in: what it weighs and the values it has."""
    m, ids = _small_model()
    seen, target, _, _ = attention_lm.windows(ids * 60, len(m.class_of) - 1)
    x, y = m.input_of[seen], m.class_of[target]
    by_inputs, _ = attention_lm.pulls(m.weights)
    c, sizes = attention_lm.CONTEXT, []
    for part, places, pull, value in attention_lm.met(m, by_inputs, x, y):
        before = np.stack([x[k : k + c + 1, part] for k in range(attention_lm.SCORED)])  # (target, what it sees, window)
        own, of = before[:, -1:], y[:, None, part]
        by_target = lambda a: a.transpose(2, 0, 1).reshape(-1, c + 1)
        assert (places == by_target(own * attention_lm.INPUTS + before)).all()
        assert (pull == by_target(by_inputs[own, before])).all()
        assert (value[:, :-1] == by_target(m.far[before, of])[:, :-1]).all()
        assert (value[:, -1] == by_target(m.near[before, of])[:, -1]).all()
        sizes.append(len(places) // attention_lm.SCORED)
    assert sum(sizes) == x.shape[1] and len(sizes) == 2


def test_attention_is_fitted_on_all_windows(spark, monkeypatch):
    texts = [f"text {k} of many has its own words w{k} and v{k * k} " * 60 for k in range(400)]
    own, blocks = learned(spark, texts)
    fitted_on, keep = [], attention_lm.summed

    def here(rows, function, kind):  # the fit runs in this process, the counts as ever
        return dict(function(iter(rows.toArrow().to_batches()))) if kind is np.float64 else keep(rows, function, kind)

    monkeypatch.setattr(attention_lm, "summed", here)
    monkeypatch.setattr(attention_lm, "descend", lambda m, sums, x, y, use, *more: fitted_on.append(int(use.sum())))
    attention_lm.train(blocks, attention_lm.default_tokenizer())
    assert sum(fitted_on) == sum(len(bytes(r.ids)) // 2 for r in own.collect()) > 300_000


def learned(spark, texts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    attention_lm.ship(spark)
    blocks = attention_lm.encoded(docs, F.lit(True), attention_lm.default_tokenizer())
    return blocks.where("ids IS NOT NULL").select("ids"), blocks


def test_tables_count_all_documents(spark):
    texts = [f"text {k} of many has its own words w{k} and v{k * k} " * (1 + k % 5) for k in range(60)] + ["one copy " * 900] * 30
    own, blocks = learned(spark, texts)
    counts = attention_lm.id_counts(own, attention_lm.subwords(attention_lm.default_tokenizer())[1])
    around = attention_lm._around(own, counts)
    input_of, class_of = attention_lm.grouped(counts, around)
    near, far = attention_lm._pair_tables(own, input_of, class_of)
    assert counts.sum() == sum(len(bytes(r.ids)) // 2 for r in own.collect())
    assert near.sum() == counts.sum() and far.sum() == counts.sum() * len(attention_lm.FAR)
    assert (np.bincount(class_of, counts, attention_lm.CLASSES) == near.sum(0)).all()
    words = collections.Counter(w for t in texts for w in t.encode().split())
    found = attention_lm.counted(blocks).where("first").select("total").collect()
    assert sorted(r.total for r in found) == sorted([*words.values(), len(texts)])


def test_words_merge_as_the_library_does():
    import tiktoken

    path = attention_lm.default_tokenizer()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode, _ = attention_lm.subwords(path)
    run = tiktoken.Encoding("own", pat_str=".+", mergeable_ranks=ranks, special_tokens={})  # the whole word is one piece
    rng = random.Random(6)
    for _ in range(400):
        w = "".join(rng.choice(["the", "a", "ing", "x", "'", "é", "漢", "12", ".", "Q"]) for _ in range(rng.randint(1, 12)))
        ids = np.frombuffer(encode(w.encode()), np.uint16).tolist()
        assert ids == attention_lm.merged(ranks, b" " + w.encode()) == run.encode_ordinary(" " + w)


def test_words_are_encoded_together():
    """A batch's new words take one call, and have the ids that each has alone."""
    path = attention_lm.default_tokenizer()
    one, size = attention_lm.subwords(path)
    rng = random.Random(8)
    parts = ["the", "ing", "x", "'", "é", "漢", "12", "\u3000", "\x1c", "\x85", "\0", "<|endoftext|>", "a" * 3000]
    texts = [attention_lm.words_of(" ".join("".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(80))) for _ in range(3)]
    for more in ([], [attention_lm.words_of("a \ud800 b")]):  # a lone surrogate is no text for the library
        calls, many = [], attention_lm.many_subwords(path)
        known = attention_lm._Words(lambda words: calls.append(words) or many(words), size - 1)
        for _ in range(2):
            nos, ids = known.look_up(texts + more, np.ones(3 + len(more), bool))
        assert len(calls) == 1 and sorted(calls[0]) == sorted({w for t in texts + more for w in t})
        for t, n, i in zip(texts + more, nos, ids, strict=True):
            assert n.tolist() == [known[w] for w in t] + [0]
            assert i.tobytes() == b"".join(map(one, t)) + np.uint16(size - 1).tobytes()


def test_pairs_are_counted_in_several_tables(spark, monkeypatch):
    """A task that has more ids than a table may count hands on its counts and goes on."""
    texts = [f"text {k} of many has its own words w{k} " * 20 for k in range(40)]
    own, _ = learned(spark, texts)
    counts = attention_lm.id_counts(own, attention_lm.subwords(attention_lm.default_tokenizer())[1])
    input_of, class_of = attention_lm.grouped(counts, attention_lm._around(own, counts))
    whole, given, keep = attention_lm._pair_tables(own, input_of, class_of), [], attention_lm.summed

    def here(rows, function, kind):  # the counts of documents one by one, in this process
        found = {}
        for k, a in function(iter(rows.toArrow().to_batches(max_chunksize=1))):
            given.append(k)
            found[k] = found.get(k, 0) + a.astype(float)
        return found

    monkeypatch.setattr(attention_lm, "summed", here)
    monkeypatch.setattr(attention_lm, "COUNTED", 300)
    monkeypatch.setattr(attention_lm, "MOST_COUNTED", 2000)
    parts = attention_lm._pair_tables(own, input_of, class_of)
    assert len(given) > len(set(given)) and all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_words_are_found_by_columns():
    """Texts of a batch are cut without a Python text each, to the same words; a batch asks for each different word once."""
    texts = [None, "", " \t\n", "  The cat\x0b the\x0cCAT\r", "É\u00a0É İ \x1c a\u3000B", "\x85\0 x", "the " * 40]
    for own in (texts, texts[:3], texts[3:4]):
        words, lengths = attention_lm.words_in(pa.array([*texts[:2], *own], pa.string())[2:])
        assert lengths.tolist() == [len(attention_lm.words_of(t)) for t in own]
        assert words.cast(pa.binary()).to_pylist() == [w for t in own for w in attention_lm.words_of(t)]

    many = attention_lm.many_subwords(attention_lm.default_tokenizer())
    asked = []

    class Asked(attention_lm._Words):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    known = Asked(many, attention_lm.subwords(attention_lm.default_tokenizer())[1] - 1)
    asked.clear()
    words, lengths = attention_lm.words_in(pa.array(texts, pa.string()))
    nos, _ = known.look_up_all(words, lengths, np.array([True] * 6 + [False]))
    assert len(asked) == len(set(asked)) < len(words)
    assert [n.tolist() for n in nos] == [[*(known[w] for w in attention_lm.words_of(t)), 0] for t in texts]
    assert known.counts[known[b"the"]] == 2 and known.counts[0] == 6


def test_slopes_of_a_small_step():
    """A step makes the rows of inputs that ask in it, and no others; what earlier steps left in the kept tables is not met."""
    m, ids = _small_model()
    seen, target, use, _ = attention_lm.windows(ids * 60, len(m.class_of) - 1)
    x, y = m.input_of[seen], m.class_of[target]
    n, made, keep = 3, [], attention_lm._by_inputs
    small = x[:, :n], y[:, :n], use[:, :n]
    first = attention_lm.slopes(m, *small)
    attention_lm.slopes(m, x, y, use)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(attention_lm, "_by_inputs", lambda q, k: made.append(len(q)) or keep(q, k))
        again = attention_lm.slopes(m, *small)
    assert made == [len(np.unique(x[attention_lm.CONTEXT :, :n]))] and made[0] < attention_lm.INPUTS
    for a, b in zip(first, again, strict=True):
        assert (a == b).all() and a.any()
    others = np.setdiff1d(np.arange(attention_lm.INPUTS), x[attention_lm.CONTEXT :, :n])
    assert not again[0][others].any()


def test_packed_numbers():
    for n in ([], [0], [1, 70_000, 1 << 27], list(range(3000))):
        assert attention_lm.unpacked(attention_lm.packed(np.array(n, np.uint32))).tolist() == n


def test_around_counts():
    ids = [np.array([3, 4, 3, 9], np.uint16), np.array([9], np.uint16), np.array([4, 9], np.uint16)]
    number = np.full(10, 2)
    number[[3, 4]] = 0, 1
    needed = np.ones(10, bool)
    needed[4] = False
    around = np.zeros(60)
    attention_lm.around_counts(ids, number, needed, around)
    want = np.zeros((10, 6))
    for i in ids:
        for a, b in itertools.pairwise(i):
            want[b, number[a]] += needed[b]
            want[a, 3 + number[b]] += needed[a]
    assert (around.reshape(10, 6) == want).all()


def test_fit_takes_windows_from_all_places():
    rng = np.random.default_rng(4)
    ids = [np.arange(k, k + 4000, dtype=np.uint16) for k in rng.integers(0, 40_000, 40)]
    seen, target, _ = attention_lm.chosen_windows(ids, 50_000, 0.05)
    starts = np.array([t[0] for t in target])
    assert 300 < len(seen) < 700 and len(np.unique(starts // 16)) > 250
    assert len(attention_lm.chosen_windows(ids, 50_000, 1.0)[0]) == 40 * 250


def test_windows_fit_averages_tasks(spark):
    own, _ = learned(spark, [f"here is text {k} and it goes on and on " * 20 for k in range(40)])
    counts = attention_lm.id_counts(own, attention_lm.subwords(attention_lm.default_tokenizer())[1])
    input_of, class_of = attention_lm.grouped(counts, attention_lm._around(own, counts))
    m = attention_lm.build(counts, input_of, class_of, *attention_lm._pair_tables(own, input_of, class_of))
    ids = [np.frombuffer(bytes(r.ids), np.uint16) for r in own.collect()]
    before = attention_lm.log_ids(m, ids).sum()
    m.weights = attention_lm.fitted(m, own, float(counts.sum()))
    assert attention_lm.log_ids(m, ids).sum() > before


# --- packing -------------------------------------------------------------------------------------------------------


def test_tokenizer_is_the_file_s():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(packing.default_tokenizer()), packing.load_tokenizer(packing.default_tokenizer())
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\x85", "\xa0", "é", "中", "1", "'s", "!", "<|endoftext|>", "　", "\t", "́", "_", "ſ", "🤦"]
    for _ in range(800):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert slow.encode(t, add_special_tokens=False).ids == list(fast(t)), t


def test_cut():
    assert packing.cut(1) == [(0, 1)] and packing.cut(1024) == [(0, 1024)]
    assert packing.cut(1025) == [(0, 1), (1, 1024)] and packing.cut(2500) == [(0, 452), (452, 1024), (1476, 1024)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_all(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, rng.integers(1, 3000)) if seed else np.array([40] * 7)
    h = collections.Counter(lengths.tolist())
    runs = packing.plan(h, 64)
    used = collections.Counter()
    for p, n in runs:
        assert sum(p) <= 64 and n > 0
        for x in p:
            used[x] += n
    assert used == h
    bound = max(-(-sum(lengths) // 64), sum(x > 32 for x in lengths))
    assert sum(n for _, n in runs) <= bound * 1.02 + 2
    assert packing.plan({}) == []


@pytest.mark.parametrize("ranked", [3, 250_000])
def test_packing(spark, odd, clashing, empty, ranked):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.default_tokenizer())
    docs = odd.where("doc_id IS NULL OR doc_id <> 8").unionByName(spark.read.parquet(f"{SF}/documents.parquet"))
    cut = packing.pieces(docs)
    got = packing.pack(cut, ranked_rows=ranked).toPandas()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 1024
    want = collections.Counter()
    for r in docs.collect():
        ids = slow.encode(r.text or "", add_special_tokens=False).ids + [2]
        for k, (a, n) in enumerate(packing.cut(len(ids))):
            want[r.doc_id, k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())] += 1
    none = lambda v: None if v != v else int(v)
    assert want == collections.Counter((none(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert packing.pack(packing.pieces(empty)).count() == 0
    assert packing.pieces(clashing.where("doc_id <> 7")).columns == cut.columns


BIG = (1 << 60) + 1


@pytest.fixture
def big_ids(spark):
    """Ids that a double cannot hold, beside a null one."""
    return spark.createDataFrame([(BIG, "one"), (None, "none"), (BIG + 1, "two")], "doc_id long, text string").coalesce(1)


def test_ids_stay_exact(spark, big_ids):
    want = [None, BIG, BIG + 1]
    for df in (packing.pieces(big_ids), mpeg.store(big_ids), mpeg.read(mpeg.store(big_ids)), attention_lm.score_documents(big_ids)):
        assert sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda i: i or 0) == want


def test_many_common_lengths(spark):
    """Each of 1024 lengths is ranked in two parts."""
    cols = ["id AS doc_id", "0 AS piece", "0L AS start", "id % 1024 + 1 AS length", "id AS ids_crc32", "'own' AS part", "'own' AS nth", "'own' AS offset"]
    got = packing.pack(spark.range(1024 * 4).selectExpr(*cols), ranked_rows=3).toPandas()
    assert len(got) == 4096 and (got["part"] == "own").all() and (got["nth"] == "own").all()
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert by["length"].sum().max() <= 1024 and (by["offset"].first() == 0).all()
    assert (got["length"].sum() / 1024) * 1.01 + 1 > len(by)


# --- media ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "a", "x" * 192, "é🤦" * 500, "\xff" * 700])
def test_media_round_trip(text):
    payload = text.encode()
    data = mpeg.carry(payload)
    s = mpeg.probe(data)
    whole, n = mpeg.carried(data, s)
    assert whole[:n] == payload and set(whole[n:]) <= {32} and len(whole) % 192 == 0 and whole
    assert (s.bad_crc, s.skipped, s.frames) == (0, 0, len(whole) // 192)
    assert s.table == ("Info", s.frames, (s.frames + 1) * 240) and s.samples == s.frames * 1152
    assert float(s.duration) == s.frames * 0.024


def test_media_damage():
    data = mpeg.carry(b"abc" * 3000)
    s = mpeg.probe(data)
    at = s.seek[0] + 3 * 240
    broken = data[:at] + b"\x00" * 37 + data[at:]
    t = mpeg.probe(broken)
    assert (t.frames, t.skipped) == (s.frames, 37) and mpeg.carried(broken, t) == mpeg.carried(data, s)
    flipped = bytearray(data)
    flipped[at + 10] ^= 1  # in the side information of one frame
    assert mpeg.probe(bytes(flipped)).bad_crc == 1
    assert mpeg.probe(data + b"TAG" + bytes(125)).frames == s.frames
    assert mpeg.probe(b"").frames == 0 and mpeg.probe(b"no audio").first is None
    other = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)  # 128 kbit/s, 44.1 kHz, stereo, no checksum
    u = mpeg.probe(other * 5)
    assert (u.frames, u.duration, u.first.rate) == (5, mpeg.Fraction(5 * 1152, 44100), 44100)
    assert mpeg.crc16(np.frombuffer(b"123456789", np.uint8)[None])[0] == 0xAEE7  # the published check value


def bitwise_crc(bits):
    c = 0xFFFF
    for bit in bits:
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ bit else 0)
    return c


@pytest.mark.parametrize("mode,bands", [(0, 27), (1, 27), (3, 27)])
def test_layer_2_checksums(mode, bands):
    """Stereo, joint stereo from subband 8 on, mono; 128 kbit/s at 48 kHz (64 of a channel), so table a."""
    bitrate = 8 if mode != 3 else 4  # 128, or 64 for one channel
    head = bytes([0xFF, 0xFC, bitrate << 4 | 1 << 2, mode << 6 | 1 << 4])
    h = mpeg.Header.parse(head)
    assert len(mpeg.allocation_bits(h)) == bands and sum(mpeg.allocation_bits(h)) == 11 * 4 + 12 * 3 + 4 * 2
    rng = random.Random(mode)
    frames = b""
    for k in range(5):
        bits, choices = [], 0
        for band, n in enumerate(mpeg.allocation_bits(h)):
            own = 1 if mode == 3 or (mode == 1 and band >= 8) else 2
            for _ in range(own):
                v = rng.choice([0, 0, rng.randrange(1 << n)])
                bits += [v >> s & 1 for s in reversed(range(n))]
                if v:
                    choices += 1 if mode == 3 or own == 2 else 2
        bits += [rng.randrange(2) for _ in range(2 * choices)]
        header = [b >> s & 1 for b in head[2:4] for s in reversed(range(8))]
        crc = bitwise_crc(header + bits) ^ (k == 3)
        body = int("".join(map(str, bits + [0] * (-len(bits) % 8))), 2).to_bytes(-(-len(bits) // 8), "big")
        frame = head + crc.to_bytes(2, "big") + body
        frames += frame + bytes(h.length - len(frame))
    s = mpeg.probe(frames)
    assert (s.first.layer, s.frames, s.bad_crc, s.unverified) == (2, 5, 1, 0)


def test_unverified_checksums_are_counted():
    short = bytes([0xFF, 0xFE, 0x10 | 1 << 2, 0x00])  # Layer I, 32 kbit/s, 48 kHz, stereo: 32 bytes, of which 38 are covered
    h = mpeg.Header.parse(short)
    s = mpeg.probe((short + bytes(h.length - 4)) * 4)
    assert (s.first.layer, s.frames, s.bad_crc, s.unverified) == (1, 4, 0, 4)
    assert mpeg.probe(mpeg.carry(b"abc" * 300)).unverified == 0


def test_changing_headers_take_linear_time():
    a, b = bytes([0xFF, 0xFA, 0x90, 0x00]) + bytes(413), bytes([0xFF, 0xFA, 0x92, 0x00]) + bytes(414)
    began = time.process_time()
    s = mpeg.probe((a + b) * 50_000)
    assert time.process_time() - began < 2 and (s.frames, s.bad_crc, len(s.seek)) == (100_000, 100_000, 3125)
    assert s.duration == mpeg.Fraction(100_000 * 1152, 44100)
    good = bytearray(a)
    good[4:6] = int(mpeg.crc16(np.frombuffer(a[2:4] + a[6:38], np.uint8)[None])[0]).to_bytes(2, "big")
    assert mpeg.probe(bytes(good) * 3 + b * 2 + bytes(good)).bad_crc == 2
    runs = [n for _, n, _ in mpeg.probe(a * 7 + b + a * 33).runs]
    assert runs == [7, 1, 33]


def id3(version, frames, flags=0):
    size = bytes(len(frames) >> s & 0x7F for s in (21, 14, 7, 0))
    return b"ID3" + bytes([version, 0, flags]) + size + frames


def test_tags():
    audio = (bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)) * 3
    two = id3(2, b"TT2\0\0\x05\0Name")
    three = id3(3, b"TIT2" + (7).to_bytes(4, "big") + b"\0\0\x01\xff\0\xfeN\0a\0", 0x80)  # unsynchronised
    extended = id3(3, (6).to_bytes(4, "big") + bytes(6) + b"TIT2" + (5).to_bytes(4, "big") + b"\0\0\0Name", 0x40)
    four = id3(4, b"TIT2\0\0\0\x05\0\0\x03Name", 0x10) + b"3DI" + bytes(7)
    for data, want in ((two, {"TT2": "Name"}), (three, {"TIT2": "Na"}), (extended, {"TIT2": "Name"}), (four, {"TIT2": "Name"})):
        s = mpeg.probe(data + audio)
        assert (s.tags, s.frames, s.skipped) == (want, 3, 0)
    old = b"TAG" + b"Song".ljust(30, b"\0") + b"Band".ljust(30) + bytes(30) + b"1999" + bytes(28) + bytes([0, 7, 12])
    assert mpeg.probe(audio + old).tags == {"id3v1:title": "Song", "id3v1:artist": "Band", "id3v1:year": "1999", "id3v1:track": "7"}


def test_foreign_streams(spark):
    audio = (bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)) * 3
    odd = [None, b"", b"no audio", audio, id3(3, b"TXXX" + (9).to_bytes(4, "big") + b"\0\0\0BYTES\x0099") + audio, mpeg.carry(b"x")[:-100], b"\xff" * 500, b"ID3\x03\0\x40"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, media binary").withColumn("tags", F.lit(1))
    got = {r.doc_id: r for r in mpeg.read(df).collect()}
    assert len(got) == len(odd) and got[0].feature is None and got[0].media_bytes is None
    for k, data in enumerate(odd[1:], 1):
        assert got[k].media_bytes == len(data) and got[k].media_sha256 == hashlib.sha256(data).hexdigest() and got[k].n_bytes is None
    assert got[3].feature.startswith("mpeg1-layer3;44100Hz;stereo;frames=3;") and got[2].feature.startswith("none;frames=0")


def test_media_column(spark, odd, empty, clashing):
    got = mpeg.read(mpeg.store(odd)).toPandas()
    want = []
    for r in odd.collect():
        p = mpeg.padded((r.text or "").encode())
        want.append((len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted(want) == sorted(zip(got.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32, strict=True))
    assert mpeg.read(mpeg.store(empty)).count() == 0 and mpeg.store(clashing).columns == ["doc_id", "media"]


# --- near-duplicates -----------------------------------------------------------------------------------------------


def multiset(text):
    w = text.lower().split()
    return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] * bool(w))


def brute_classes(rows, similarity=0.8):
    root = {k: k for k in range(len(rows))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [None if t is None else multiset(t) for _, t in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] is None or sets[b] is None:
            continue
        both, either = (sets[a] & sets[b]).total(), (sets[a] | sets[b]).total()
        if rows[a][1] == rows[b][1] or (either and both / either >= similarity):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        f = find(k)
        least[f] = min(x for x in (least.get(f), i) if x is not None) if (least.get(f), i) != (None, None) else None
    return sorted(((i, least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def brute_roots(rows, similarity=0.8):
    """A number for each row: that of the first row of its class."""
    sets, root = [multiset(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if rows[a][1] != rows[b][1]:
            x, y = sets[a].total(), sets[b].total()
            if min(x, y) < similarity * max(x, y) or not x:
                continue
            both = (sets[a] & sets[b]).total()
            if both / (x + y - both) < similarity:
                continue
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(rows))]


def mutated(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.random()}"
    return " ".join(w)


def test_near_duplicates(spark, odd):
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for g in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([6, 40, 300]))]
        for _ in range(rng.randrange(1, 9)):
            rows.append((1000 + len(rows), mutated(rng, words, rng.randrange(0, 1 + len(words) // 60))))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(5000 + k, passage + " " + " ".join(f"q{rng.random()}" for _ in range(60))) for k in range(40)]
    rows += [(6000, "again and again " * 20), (6001, "again and again " * 21), (6002, "again and again " * 60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df.withColumn("key", F.lit(1)).withColumn("bands", F.lit(1)))
    assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=str) == brute_classes(rows)


@pytest.mark.parametrize("n,chunk", [(400, 50), (5000, None)])
def test_star_of_near_duplicates(spark, monkeypatch, n, chunk):
    """Variants that are each close to the original, not to each other, are one class at any size of the group."""
    if chunk:
        monkeypatch.setattr(near_dedup, "CHUNK_TEXTS", chunk)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(250)]
    rows = [(0, " ".join(words))]
    for k in range(1, n + 1):
        w = list(words)
        for at in rng.sample(range(4, 246, 6), 5):  # 25 of 246 shingles go: 0.815 of the original, 0.66 of each other
            w[at] = f"n{k}-{at}"
        rows.append((k, " ".join(w)))
    rng.shuffle(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == n + 1 and {r.class_id for r in got} == {0}


def test_common_counts():
    rng = np.random.default_rng(2)
    x, y = ([rng.choice(400, k, replace=False).astype(np.uint64) for k in rng.integers(0, 300, 30)] for _ in range(2))
    y = [v + np.uint64(300) for v in y]
    want = [[len(np.intersect1d(a, b)) for b in y] for a in x]
    assert (near_dedup.common_counts(x, y) == np.array(want)).all()


def test_near_duplicates_edges(spark, odd, clashing, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.near_duplicates(clashing).count() == clashing.count()
    kept = near_dedup.keep_one(spark, odd, "")
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert kept.columns == odd.columns and ids == sorted([1, 3, 4, None, None, 6, 7, 8, 9, 10], key=str)


def test_one_row_of_each_class_stays(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    near = a.replace("a39", "other")
    rows = [(3, a), (5, a), (5, b), (None, a), (3, a), (7, near), (None, c), (None, c), (8, None), (8, None), (3, near + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("own")).withColumn("dedup_head", F.lit("own"))
    kept = near_dedup.keep_one(spark, df, "")
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert len([x for x in got if x[0] == 3]) == 1 and dict(got)[3] in (a, near + " more")
    assert [x for x in got if x[0] != 3] == sorted([(5, b), (None, c), (8, None), (8, None)], key=str)
    assert near_dedup.keep_one(spark, df.limit(0), "").count() == 0


def test_points_split_consistently():
    """A lighter weight has just the heavier one's points below it, whatever else the blocks are split into."""
    h = np.array([12345], np.uint64)

    full = {}
    for w in (1, 2, 3, 5, 8, 13, 64):
        sig = near_dedup.signatures(np.zeros(w, np.int64), np.repeat(h, w), 1, 16)
        full[w] = sig[0]
    assert (full[1] != full[64]).any()
    # More weight can only bring points that are earlier, so registers that agree at 1 and 64 agree in between.
    same = full[1] == full[64]
    assert all((full[w][same] == full[1][same]).all() for w in full)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(40):
        base = rng.integers(0, 1 << 60, rng.integers(3, 80)).astype(np.uint64)
        a, b = rng.integers(0, 9, len(base)), rng.integers(0, 9, len(base))
        b = np.where(rng.random(len(base)) < 0.7, a, b)
        if not a.sum() or not b.sum():
            continue
        doc = np.repeat([0, 1], [a.sum(), b.sum()])
        sig = near_dedup.signatures(doc, np.concatenate([np.repeat(base, a), np.repeat(base, b)]), 2, 1024)
        off.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.006 and np.std(off) < 0.025


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, few):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(300 + rng.randrange(40), 300 + rng.randrange(40)) for _ in range(25)]
    got = {r.v: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
    root = {v: v for e in edges for v in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {v: r for v, r in root.items() if v != r}


# --- SentencePiece -------------------------------------------------------------------------------------------------


def test_sentencepiece_is_the_library_s():
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    c = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    rng = random.Random(3)
    parts = ["a", "th", "the", " ", "  ", "   ", "\n", "é", "中", "가", "1", "23", "ing", "🤦", "<s>", "<0x0A>", "▁", "Z", "'s", ".", "tion", "\t", "́", " " * 11]
    for _ in range(600):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        ids = c.encode(t).tolist()
        assert ids == sp.encode(t), t
        assert c.decode(ids) == sp.decode(ids)
        stream, s, out = sentencepiece_codec.Stream(c.m), c.m.normalise(t), []
        for k in range(0, len(s), 3):
            out += stream.feed(s[k : k + 3])
        assert out + stream.finish() == ids
    assert c.decode([3 + 255, 5]) is not None  # bytes that are no UTF-8


def test_ordinary_text_goes_through_the_stream():
    """What op9 runs commits at each word's end, and holds no more than a window and a word."""
    c = sentencepiece_codec.codec(sentencepiece_codec.default_model())
    before, text = c.stream.commits, "the streaming lattice commits word by word, 3 times in 2026 " * 50
    c.encode(text)
    assert c.stream.commits - before >= len(text.split()) - 1 and (c.stream.held, c.stream.text) == ("", "")
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    rng = random.Random(8)
    for _ in range(40):  # long words and short ones, in portions
        t = "".join(rng.choice(["ab", "c", " ", "d" * rng.randrange(900), "é中" * rng.randrange(300), "1"]) for _ in range(30))
        s, out, most, at = c.m.normalise(t), [], 0, 0
        while at < len(s):
            n = rng.randrange(1, 60)
            out += c.stream.feed(s[at : at + n])
            most, at = max(most, len(c.stream.held) + len(c.stream.text)), at + n
        assert out + c.stream.finish() == sp.encode(t) == c.encode(t).tolist()
        assert most <= (sentencepiece_codec.WAITED + 8) * c.m.longest + 60


def test_stream_window_is_bounded():
    m = sentencepiece_codec.Model(sentencepiece_codec.default_model())
    rng, stream, most, out = random.Random(5), sentencepiece_codec.Stream(m), 0, []
    text = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    for ch in text:
        out += stream.feed(ch)
        most = max(most, len(stream.text) + len(stream.held))
    assert most <= (sentencepiece_codec.WAITED + 1) * m.longest and len(out + stream.finish()) > 1000


def test_unigram_viterbi():
    m = sentencepiece_codec.Model(sentencepiece_codec.default_model())
    m.type = sentencepiece_codec.UNIGRAM
    rng = random.Random(6)
    m.scores = [-rng.random() * 5 - 1 for _ in m.pieces]
    m.least = min(m.scores) - 10
    for _ in range(60):
        t = "".join(rng.choice("thein ") for _ in range(rng.randint(1, 60))).replace(" ", "▁")
        best = [0.0] + [-1e18] * len(t)
        for e in range(1, len(t) + 1):
            for a in range(max(0, e - m.longest), e):
                i = m.ids.get(t[a:e])
                if i is not None:
                    best[e] = max(best[e], best[a] + m.scores[i])
        stream = sentencepiece_codec.Stream(m)
        ids = stream.feed(t) + stream.finish()
        assert "".join(m.pieces[i] for i in ids) == t and sum(m.scores[i] for i in ids) == pytest.approx(best[-1])


def test_sentencepiece_column(spark, odd, clashing, empty):
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(clashing))
    assert {r.doc_id: r.decoded for r in back.collect()} == {r.doc_id: r.text or "" for r in clashing.collect()}
    assert sentencepiece_codec.encode(empty).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [5, 6])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded is None for r in sentencepiece_codec.decode(nulls).collect()} == {1: True, 2: False}


def test_op9_holds_one_python_process_a_task(spark, odd):
    """Ids and the text of the ids are made in one pass, and are those of encode and decode in a row."""
    plan = sentencepiece_codec.op9_sentencepiece(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    key = ["doc_id", "text", "ids", "decoded"]
    once = sentencepiece_codec.encode(odd.withColumn("decoded", F.lit(1)), back="decoded").select(key)
    twice = sentencepiece_codec.decode(sentencepiece_codec.encode(odd)).select(key)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.collect()))
    empty = odd.where("doc_id > 99")
    assert sentencepiece_codec.encode(empty, back="decoded").count() == 0


def test_sentencepiece_remembers_a_bounded_number(monkeypatch):
    """Words, units and pairs of pieces that were met long ago are forgotten, and the ids stay the library's."""
    monkeypatch.setattr(sentencepiece_codec, "CACHED", 50)
    monkeypatch.setattr(sentencepiece_codec, "DECODED", 7, raising=False)
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    c = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    rng, texts = random.Random(12), []
    for _ in range(200):
        words = ["".join(rng.choice(["the", "in", "a", "st", "é", "中", "q", "1", ","]) for _ in range(rng.randint(1, 9))) for _ in range(20)]
        texts.append("  ".join(words) + " " + " ".join(words))
        ids = c.encode(texts[-1]).tolist()
        assert ids == sp.encode(texts[-1]) and c.decode(ids) == texts[-1]
        assert max(map(len, (c.stream.words, c.stream.units, c.m.apart))) <= 100
    ids = [c.encode(t) for t in texts]
    assert c.decode_flat(np.concatenate(ids), np.cumsum([len(i) for i in ids])) == texts


def test_similarity_runs_once(spark, monkeypatch):
    """One Python process a task: the filter on a pair's similarity takes the value that the row has."""
    plans = []
    monkeypatch.setattr(near_dedup, "written", lambda df, name: plans.append(df) or df)
    monkeypatch.setattr(near_dedup, "multisets_of", lambda *_: spark.createDataFrame([], "id long, blob binary"))
    signed = spark.createDataFrame([], "key binary, sig binary, bands array<long>, id long")
    pairs = near_dedup.candidate_pairs(signed)
    few = spark.createDataFrame([], "x long, y long")
    near_dedup.verified(few, None, None, 0.8, "dedup-first")
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("agreement(") == 1
    assert plans[0]._jdf.queryExecution().optimizedPlan().toString().count("overlap(") == 1


# --- search --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("dim,k,small,probes", [(20, 3, True, 40_000), (64, 10, False, 40_000), (130, 5, True, 40_000), (64, 4, True, 70)])
def test_search(spark, monkeypatch, dim, k, small, probes):
    monkeypatch.setattr(hamming_search, "MAX_PROBES", probes)
    if probes < 40_000:  # wide segments first, each width only as far as its probes are few
        monkeypatch.setattr(hamming_search, "WIDTHS", ((8, 0), (16, 0), (32, 1 << 62)))
    if not small:
        monkeypatch.setattr(hamming_search, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(dim)
    vectors = rng.normal(size=(120, dim))
    vectors[60:100] = vectors[0]
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)] + [(500, None), (None, [1.0]), (501, [None, 1.0]), (3, [0.5] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("ids", F.lit(1))
    got = hamming_search.top_k(df, df.where("vec_id % 20 = 0"), k)
    bits = {}
    words = 64 * -(-dim // 64)
    clean = [(i, [int(x is not None and x > 0) for x in v] + [0] * (words - len(v))) for i, v in rows if i is not None and v is not None]
    want = []
    for q, b in clean:
        if q % 20 == 0:
            near = sorted((sum(x != y for x, y in zip(b, c, strict=True)), i) for i, c in clean if i != q)[:k]
            want += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    assert not bits and sorted(map(tuple, got.collect())) == sorted(want)


def test_search_broadcasts_what_it_counted(spark, monkeypatch):
    """Listed probes are many more than Spark takes them for: where neither side is small, the index comes in pieces."""
    plans, keep = [], hamming_search.written

    def spied(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString() if name == "search-best" else "")
        return keep(df, name)

    monkeypatch.setattr(hamming_search, "written", spied)
    monkeypatch.setattr(hamming_search, "WIDTHS", ((16, 1 << 62),))
    monkeypatch.setattr(hamming_search, "BROADCAST_ROWS", 25)
    vectors = np.random.default_rng(11).normal(size=(60, 64))
    vectors[20:] = vectors[[k % 20 for k in range(40)]] + np.random.default_rng(12).normal(size=(40, 64)) / 9
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = hamming_search.top_k(df, df.where("vec_id % 6 = 0"), 2).collect()
    codes = vectors > 0
    want = []
    for q in range(0, 60, 6):
        near = sorted((int((codes[q] != codes[k]).sum()), k) for k in range(60) if k != q)[:2]
        want += [(q, r + 1, k, d) for r, (d, k) in enumerate(near)]
    joins = [x for p in plans for x in p.splitlines() if "Join" in x]
    assert sorted(map(tuple, got)) == sorted(want)
    assert len(joins) > 2 and all("BroadcastHashJoin" in x and "BuildRight" in x for x in joins)


def test_search_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hamming_search.top_k(none, none).count() == 0
    one = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")
    assert hamming_search.top_k(one, one).count() == 0 and hamming_search.top_k(one, one, with_self=True).count() == 1


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_low_scores_go(spark):
    """Language ID rejects a text that no language has LEAST_SCORE of: here three languages share all its letters."""
    rows = [(k, f"ab ba {x}{x}{x} ab ba", x) for x in "xyz" for k in range(20)]
    docs = spark.createDataFrame([*rows, (1000, "ab ba ab ba", None)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in lang_id.keep_known(spark, docs, "").where("lang IS NULL").collect()}
    m = lang_id.train(docs)
    assert m.score(["ab ba ab ba"])[1][0] < lang_id.LEAST_SCORE and kept == set()


def test_pipeline(spark, tmp_path, odd, empty):
    """Every stage against brute force over its own input, and the last one's pieces against the tokenizer's library."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from wideframe.llm import secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = clean_odd(odd).where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id") + 10**6)
    other = more.where("doc_id = 1000006").withColumn("text", F.lit("another text under the same id, and its password = hunter2hunter2"))
    sf = table_dir(tmp_path, documents=docs.unionByName(more).unionByName(other).withColumn("secret_key", F.lit("own")).withColumn("class_id", F.lit("own")))
    read = spark.read.parquet(f"{sf}/documents.parquet")
    columns = read.columns
    stages = dict(corpus_pipeline.STAGES)

    def after(name, df):
        out = stages[name](spark, df, sf).cache()
        assert out.columns == columns
        return out, [(r.doc_id, r.text) for r in out.collect()]

    rows = [(r.doc_id, r.text) for r in read.collect()]
    model = lang_id._trained(read)
    langs, p = model.score([t for _, t in rows])
    want = [x for x, lang, score in zip(rows, langs, p, strict=True) if lang != "und" and score >= lang_id.LEAST_SCORE]
    read, rows = after("language_id", read)
    assert sorted(rows) == sorted(want) and len(rows) > 150

    members = collections.defaultdict(list)
    for root, row in zip(brute_roots(rows), rows, strict=True):
        members[root].append(row)
    read, rows = after("near_dedup", read)
    kept = sorted(rows)
    assert len(kept) == len(members) < sum(map(len, members.values()))
    for own in members.values():  # one row of each class, with its least id
        (stays,) = {x for x in kept if x in own}
        assert stays[0] == min(i for i, _ in own)

    def redacted(text):
        spans = []
        for k, r in enumerate(secrets.RULES):
            spans += [(m.start(), k, m.end(), r.kind) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.min_len]
        out, at = [], 0
        for a, _, b, kind in sorted(spans):
            if b > at:
                out += [text[at : max(a, at)], f"[{kind}]"]
                at = max(at, b)
        return "".join([*out, text[at:]])

    read, rows = after("secrets", read)
    assert sorted(rows) == sorted((i, redacted(t)) for i, t in kept) and rows != kept

    slow = Tokenizer.from_file(packing.default_tokenizer())
    want = collections.Counter()
    for i, t in rows:
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 2]
        for k, (start, n) in enumerate(packing.cut(len(ids))):
            want[i, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert want == collections.Counter(out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    assert out.groupby("sequence_id")["length"].sum().max() <= 1024
    assert corpus_pipeline.run(spark, table_dir(tmp_path / "none", documents=empty)).count() == 0
