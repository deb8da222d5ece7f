"""Fingerprints, language model, BPE, language ID, toxicity: brute force, round trips, held-out accuracy, odd inputs."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quillrank.llm import bpe, fingerprint, langid, lblm, registry, toxicity
from quillrank.llm._common import fold

ODD = [None, "", " \n", "a", "a" * 5000, "é😀 ß x", "the same", "the same", "word " * 3000]
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- fingerprints


def test_equal_texts_have_equal_fingerprints_in_any_company():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc de") for _ in range(rng.randrange(400))) for _ in range(60)] + ["", "a", "aaaa", "x" * 10000]
    together = fingerprint.fingerprints(texts)
    assert together == [fingerprint.fingerprints([t])[0] for t in texts]
    assert len(set(together)) == len(set(texts))


def test_likeness_follows_shared_text():
    rng = random.Random(2)
    x, y = ("".join(rng.choice("abcdefgh ") for _ in range(4000)) for _ in range(2))
    a, b, c = fingerprint.fingerprints([x, "zz" + x[:3000] + "q" * 3, y])
    assert fingerprint.likeness(a, a) == 1 and fingerprint.likeness(a, b) > 0.5 and fingerprint.likeness(a, c) < 0.1


@pytest.mark.parametrize("parts", [1, 4])
def test_edited_texts_against_brute_force(spark, docs, parts):
    rng = random.Random(3)
    texts = {rng.randrange(10**6): t for t in ODD + ["".join(rng.choice("ab cd") for _ in range(rng.randrange(90))) for _ in range(80)]}
    got = {r["doc_id"]: r for r in fingerprint.edit_comparison(docs(texts).repartition(parts), "doc_id", "text").collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, u = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = fingerprint.fingerprints([t, edited, u])
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (a, b)
        assert got[i]["near_edited"] == fingerprint.likeness(a, b) and got[i]["near_next"] == fingerprint.likeness(a, c)


def test_fingerprints_of_no_and_one_and_idless_rows(spark, docs):
    assert fingerprint.edit_comparison(docs([]), "doc_id", "text").count() == 0
    assert fingerprint.edit_comparison(docs(["abcdef"]), "doc_id", "text").first()["near_next"] == 1
    rows = spark.createDataFrame([(None, "abc"), (None, "def"), (5, "x"), (5, "y")], "doc_id long, text string")
    assert fingerprint.edit_comparison(rows, "doc_id", "text").count() == 4
    assert fingerprint.edit_comparison(rows.filter("doc_id is null"), "doc_id", "text").count() == 2


# --- language model


def test_model_is_normalised():
    rng = np.random.default_rng(0)
    m = lblm.initial([f"w{i}" for i in range(20)], np.arange(24.0), np.array([4.0, 5, 6]), 276, 36)
    m.r, m.q = rng.normal(size=m.r.shape), rng.normal(size=m.q.shape)
    n = len(m.b)
    for w1, w2 in ((0, 0), (3, 5), (m.start, m.start), (4, m.start)):
        assert np.isclose(np.exp(m.log_probs(np.arange(n), np.full(n, w1), np.full(n, w2))).sum(), 1, atol=1e-4)


def test_training_learns_what_follows():
    m = lblm.initial(["a", "b", "c"], np.array([50.0, 300, 300, 300, 1]), np.ones(1), 951, 5)
    t = lblm.Trainer(m, 1)
    ids = np.tile([1, 2, 3], 3000)
    for _ in range(5):
        t.learn(*lblm.contexts(ids, np.array([9000]), m.start)[:3])
    p = np.exp(t.m.log_probs(np.array([2, 3]), np.array([1, 1]), np.array([3, 3])))
    assert p[0] > 0.8 > p[1]


def fine_model(least=5):
    """Two classes: words 0 to 3 with vectors of their own, each class's rare words with 40 of 100 tokens and more."""
    keys = np.array([9, 3, 7, 5], np.uint64)
    return lblm.fine(keys, np.array([0, 0, 1, 0]), np.array([30.0, 30, 50, 0]), np.array([101.0, 90.5]), least, 2)


def test_words_within_classes_are_normalised():
    f = fine_model()
    f.q[:] += np.random.default_rng(1).normal(size=f.q.shape)
    rows, group = np.arange(f.offs[-1]), np.repeat([0, 1], np.diff(f.offs))
    ctx = np.full(len(rows), f.shift + 1)
    p = np.exp(f.log_probs(rows, group, ctx, np.full(len(rows), 2)))
    assert np.allclose(np.bincount(group, p), 1, atol=1e-5) and np.isclose(f.rare[0], 101 - 30.5 - 30.5 - 0.5)


def test_two_words_of_one_hash_are_rare():
    f = lblm.fine(np.array([4, 8, 4], np.uint64), np.array([0, 0, 0]), np.array([6.0, 7, 8]), np.array([30.0]), 5, 2)
    assert f.keys.tolist() == [8] and f.offs.tolist() == [0, 2] and f.rare.tolist() == [22.5]


def test_words_within_a_class_learn_what_goes_before():
    m = lblm.initial(["a"], np.array([50.0, 300, 300]), np.ones(1), 951, 5)
    m.fine = lblm.fine(np.array([3, 5], np.uint64), np.zeros(2, int), np.array([300.0, 300]), np.array([602.0]), 5, m.start)
    t, f = lblm.Trainer(m, 1), m.fine
    x, y = f.row + f.shift
    for _ in range(60):  # a word follows itself
        t.learn_fine(np.tile(f.row, 50), np.zeros(100, int), np.tile([x, y], 50), np.full(100, m.start))
    p = np.exp(t.fine.log_probs(np.array([f.row[0], f.row[1]]), np.zeros(2, int), np.array([x, x]), np.full(2, m.start)))
    assert p[0] > 0.8 > 0.2 > p[1]


def test_base_scores_against_brute_force(spark, docs):
    texts = dict(enumerate([*ODD, "The the THE cat\tsat", "cat on a mat", "x y\x0bz", "a\x1cb a\x85b"] * 3))
    df = docs(texts)
    held = fold("doc_id", 5) == 1
    got = {r["doc_id"]: r for r in lblm.score(df, "doc_id", "text", ~held, top=5).collect()}
    import zlib
    from collections import Counter

    words = {i: [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"] for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter((w, k == len(words[i]) - 1) for i in train for k, w in enumerate(words[i]))
    n, v = sum(c.values()), len(c)
    for i, w in words.items():
        each = [c[x, k == len(w) - 1] for k, x in enumerate(w)]
        assert got[i]["train_tokens"] == n and got[i]["n_tokens"] == len(w) and got[i]["n_known"] == sum(x > 0 for x in each)
        assert np.isclose(got[i]["base_score"], sum(np.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in each))
        assert np.isfinite(got[i]["score"]) and got[i]["score"] < 0
    assert lblm.score(docs([]), "doc_id", "text", ~held).count() == 0


@pytest.mark.parametrize("most", [4_000_000, 2, 0])
def test_scores_against_brute_force(spark, docs, monkeypatch, most):
    import zlib
    from collections import Counter

    texts = dict(enumerate([*ODD, "The the THE cat\tsat", "cat on a mat", "unseen words here", "q w e r t y the cat"] * 8 + ["once seldom the mat", "never twice"] * 2))
    held, models, real = fold("doc_id", 5) == 1, [], lblm.trained
    monkeypatch.setattr(lblm, "trained", lambda *a: models.append(real(*a)) or models[-1])
    monkeypatch.setattr(lblm, "STRIPE", 3)
    monkeypatch.setattr(lblm, "MOST_OWN", most)
    got = {r["doc_id"]: r["score"] for r in lblm.score(docs(texts), "doc_id", "text", ~held, top=4).collect()}
    m, split = models[0], {i: (t or "").encode().lower().split() for i, t in texts.items()}
    c = Counter(w for i, x in split.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in x)
    own = {w.encode(): 1 + k for k, w in enumerate(m.words)}
    assert len(own) == 4 and m.counts[1:5].tolist() == sorted(c.values(), reverse=True)[:4] and m.kinds.sum() == len(c) - 4
    assert m.counts[5:].sum() == sum(c.values()) - m.counts[1:5].sum()
    f, group = m.fine, lambda w: zlib.crc32(w) % len(m.kinds)
    named = [w for w in c if c[w] >= f.least and w not in own]
    assert (most < 3 or len(named) > 2) and len(named) <= min(most, len(c) - 5) and len(f.keys) == len(named)
    row = {w: int(f.find([w], np.array([group(w)]))[0]) for w in named}
    assert len(set(row.values())) == len(named) and not set(row.values()) & set(f.offs[:-1].tolist())
    for i, x in split.items():
        ids = [own.get(w, 5 + group(w)) for w in x] + [0]
        deep = [row[w] + f.shift if w in row else k for w, k in zip(x, ids, strict=False)] + [0]
        total, w1, w2, f1, f2 = 0.0, m.start, m.start, m.start, m.start
        for k, y in enumerate(ids):
            z = m.q @ (m.r[w1] * m.c[0] + m.r[w2] * m.c[1]) + m.b
            total += z[y] - np.log(np.exp(z).sum())
            if y >= 5:
                g = y - 5
                h = np.append((f.r[f1] * f.c[0] + f.r[f2] * f.c[1])[:-1], 1)
                z = f.q[f.offs[g] : f.offs[g + 1]] @ h
                total += f.q[row.get(x[k], f.offs[g])] @ h - np.log(np.exp(z).sum())
                if x[k] not in row:
                    rare = m.counts[y] + 0.5 * (m.kinds[g] + 1) - sum(c[w] + 0.5 for w in named if group(w) == g)
                    total += np.log((c[x[k]] + 0.5) / rare)
            w1, w2, f1, f2 = y, w1, deep[k], f1
        assert np.isclose(got[i], total / np.log(10), rtol=1e-4)


def test_scores_beat_the_base_on_held_out_texts(spark, sf):
    got = registry.op2_lm_scores(spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum()


# --- BPE


def reference():
    c = bpe.codec(RANKS, public_tokenizers.PATTERN)
    return c, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_round_trips():
    c, ref = reference()
    rng = random.Random(4)
    for k in range(400):
        alphabet = rng.choice(["ab", "aab c", "thern ", "日本語é😀 ", "  \n\t x'sS", "0123 ", "🤦🏽‍♂️", "<|endoftext|>"])
        t = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 50, 500])))
        ids = c.encode(t)
        assert ids == ref.encode_ordinary(t) and c.decode(ids) == t.encode()


def test_bpe_of_a_very_long_pre_token():
    c, ref = reference()
    t = "".join(random.Random(5).choice("abcdefgh") for _ in range(60000))
    assert c.encode(t) == ref.encode_ordinary(t)


def test_bpe_rows(spark, docs):
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs(ODD), "doc_id", "text", RANKS, public_tokenizers.PATTERN).collect()}
    _, ref = reference()
    for i, t in enumerate(ODD):
        assert got[i]["ids"] == ref.encode_ordinary(t or "") and bytes(got[i]["decoded"]) == (t or "").encode()
    back = bpe.decode(bpe.encode_decode(docs(ODD), "doc_id", "text", RANKS, public_tokenizers.PATTERN), "doc_id", "ids", RANKS, public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate(ODD)}
    assert bpe.encode_decode(docs([]), "doc_id", "text", RANKS, public_tokenizers.PATTERN).count() == 0


# --- language ID


def test_forward_sums_all_segmentations():
    v = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    prob = np.random.default_rng(0).random((v.size, 2)) / 100
    number = {x: i + 1 for i, x in enumerate(v.names)}

    def brute(w):
        if not w:
            return np.ones(2)
        total = np.zeros(2)
        for j in range(1, min(len(w), v.longest) + 1):
            p = number.get(w[:j], 0 if j == 1 else None)
            if p is not None:
                total = total + prob[p] * brute(w[j:])
        return total

    words = ["▁the", "▁onénd☃x", "▁a", "▁"]
    assert np.allclose(langid.likelihoods(words, v, prob), np.log([brute(w) for w in words]))


def plain_forward(w, number, longest, prob):
    """Log-probability by the recurrence over a text of any length, rescaled as it goes."""
    a, scale = [np.ones(prob.shape[1])], np.zeros(prob.shape[1])
    for j in range(1, len(w) + 1):
        x = np.zeros(prob.shape[1])
        for n in range(1, min(longest, j) + 1):
            p = number.get(w[j - n : j], 0 if n == 1 else None)
            if p is not None:
                x = x + prob[p] * a[-n]
        a.append(x)
        a, top = a[-longest:], x
        scale, a = scale + np.log(top), [y / top for y in a]
    return scale


def test_long_runs_sum_all_segmentations_too(monkeypatch):
    v = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(4)
    prob = np.random.default_rng(0).random((v.size, 3)) / 100
    number = {x: i + 1 for i, x in enumerate(v.names)}
    longest = max(v.names, key=len)
    words = ["▁" + "".join(rng.choice(v.names[::97]) for _ in range(k)) for k in (1, 9, 40, 300)] + ["▁" + longest * 3, "▁" + "☃" * 50, "▁b"]
    want = [plain_forward(w, number, v.longest, prob) for w in words]
    for stretch, cells in ((4096, 40_000), (7, 40_000), (40, 10)):
        monkeypatch.setattr(langid, "STRETCH", stretch)
        monkeypatch.setattr(langid, "CELLS", cells)
        assert np.allclose(langid.likelihoods(words, v, prob), want)


def test_learning_from_long_runs_equals_learning_from_short_ones(monkeypatch):
    v = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    from collections import Counter

    counts = [Counter({"▁thehouse": 3, "▁onthehill": 1}), Counter({"▁dasxhaus☃": 2, "▁house": 1})]
    short = langid.learn(counts, v)
    monkeypatch.setattr(langid, "SHORT", 2)
    assert np.allclose(langid.learn(counts, v), short)


def test_language_id_held_out(spark):
    got = registry.op5_language_id(spark, "/root/testdata/sf0.01").toPandas().merge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas())
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_predictions_against_plain_forward(spark, docs):
    texts = {i: t for i, t in enumerate(["the cat sat on the mat", "die katze sitzt auf der matte", "the dog ran", "der hund lief weg", "☃", "½ ² ①", "x" * 3000, "The CAT", None])}
    rows = [(i, t, "de" if i in (1, 3) else None if i == 8 else "en") for i, t in texts.items()]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    m = langid.fit(df, "doc_id", "text", "lang", fold("doc_id", 3) >= 0, path)
    v = langid.vocabulary(path)
    number = {x: i + 1 for i, x in enumerate(v.names)}
    got = langid.predict(df, "doc_id", "text", m).collect()
    assert len(got) == 10 and m.languages == ["de", "en"]
    for r in got:
        t = texts[r["doc_id"]] or ""
        if not any(map(str.isalpha, t)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        words = t.lower().split()
        total = sum(plain_forward("▁" + w, number, v.longest, m.prob) for w in words)
        share = np.exp((total - total.max()) / np.sqrt(len(words)))
        assert r["lang_pred"] == m.languages[int(total.argmax())] and abs(r["score"] - share.max() / share.sum()) < 1e-4


def test_language_sample_keeps_its_bounds(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 5)
    rows = [(i, f"w{i} " * 20, f"l{i % 230:03}") for i in range(230 * 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(langid, "learn", lambda counts, pieces: seen.append(counts) or np.ones((pieces.size, len(counts))))
    m = langid.fit(df, "doc_id", "text", "lang", fold("doc_id", 3) >= 0, public_tokenizers.path("piece_bpe_32k.model"))
    assert len(m.languages) == 230 and all(len(c) == 5 for c in seen[0])
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 1)
    langid.fit(df, "doc_id", "text", "lang", fold("doc_id", 3) >= 0, public_tokenizers.path("piece_bpe_32k.model"))
    assert all(len(c) == 1 for c in seen[1])  # a first text is never refused


def test_language_id_of_odd_texts(spark, docs):
    df = docs([*ODD, "123 !!"])
    m = langid.fit(df, "doc_id", "text", "lang", fold("doc_id", 3) >= 0, public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in langid.predict(df, "doc_id", "text", m).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 9)] == ["und"] * 4 and got[4]["lang_pred"] == "en"
    assert langid.identified(df, "text", m).columns == df.columns
    none = langid.fit(docs([]), "doc_id", "text", "lang", fold("doc_id", 3) >= 0, public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["lang_pred"] for r in langid.predict(df, "doc_id", "text", none).collect()} == {"und"}


# --- toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = registry.op6_toxicity(spark, sf).filter("held_out").toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas())
    pos, neg = got[got["toxic"] == 1]["score"].to_numpy(), got[got["toxic"] == 0]["score"].to_numpy()
    assert (pos[:, None] > neg[None]).mean() > 0.88 and (pos >= 0.5).mean() > 0.7 and (neg >= 0.5).mean() < 0.05


def test_misspellings_share_subwords():
    rng = random.Random(6)
    clean = [" ".join("".join(rng.choice(["th", "er", "an", "on", "re", "in"]) for _ in range(3)) for _ in range(40)) for _ in range(300)]
    bad = [" ".join(t.split()[:20] + [rng.choice(["idiot", "moron", "stupid"])] + t.split()[20:]) for t in clean[:150]]
    m = toxicity.train(clean[150:] + bad, [0] * 150 + [1] * 150)
    scores = m.scores([clean[0] + " stupiid " + clean[1], clean[0] + " " + clean[1], clean[0] + " 1di0t " + clean[1]])
    assert scores[0] > 0.5 > scores[1] and scores[2] > 0.5


def test_toxicity_of_odd_inputs(spark, docs):
    df = docs(ODD)
    labels = spark.createDataFrame([(0, 1, None), (3, 1, 1), (4, 0, 0), (4, 0, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.filter("toxic = 0"), labels.filter("false")):
        m = toxicity.fit(df, lab, "doc_id", "text", "toxic")
        got = toxicity.score(df, "doc_id", "text", m).toPandas()
        assert len(got) == len(ODD) and got["score"].between(0, 1).all()
        assert toxicity.without_toxic(df, "text", m).columns == df.columns
    assert toxicity.score(docs([]), "doc_id", "text", m).count() == 0


def test_toxicity_of_unspaced_runs():
    rng = random.Random(6)
    clean = [" ".join("".join(rng.choice(["th", "er", "an", "on", "re", "in"]) for _ in range(3)) for _ in range(40)) for _ in range(300)]
    bad = [" ".join(t.split()[:20] + [rng.choice(["idiot", "moron", "stupid"])] + t.split()[20:]) for t in clean[:150]]
    m = toxicity.train(clean[150:] + bad, [0] * 150 + [1] * 150)
    joined = "".join(clean[0].split())
    scores = m.scores([joined, joined + "stupididiotmoron" * 3, joined + "stupididiotmoron" * 3 + joined])
    assert scores[0] < 0.5 < min(scores[1:])
    run = "".join(chr(0x4E00 + i) for i in range(999))
    grams = lambda words: {w[i : i + n] for w in words for n in toxicity.NGRAMS for i in range(len(w) - n + 1)}
    assert grams(toxicity.tokens(run)) == grams([run]) and max(map(len, toxicity.tokens(run))) <= toxicity.LONGEST
    assert toxicity.tokens("x" * 500 + " " + "ab" * 40) == ["xx", "ab" * 40]


def test_scores_against_plain_windows(spark, docs):
    rng = random.Random(6)
    good, bad = ["alpha", "beta", "gamma", "delta", "river"], ["vilest", "rotter"]
    texts = [" ".join(rng.choice(good) for _ in range(12)) + (" " + rng.choice(bad) if k % 2 else "") for k in range(120)]
    m = toxicity.calibrated(texts, [k % 2 for k in range(120)])
    gain = m.embeddings.astype(float) @ (m.weights[:, 1] - m.weights[:, 0])

    def plain(text):
        own = [gain[toxicity.gram_ids([w])[0]].mean() for w in toxicity.tokens(text)]
        best = max((sum(own[i : i + 5]) / len(own[i : i + 5]) for i in range(max(1, len(own) - 4))), default=0.0) if own else 0.0
        z = m.scale * (best + float(m.bias[1] - m.bias[0])) + m.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    odd = [*ODD, *texts[:6], "river vi1est", "x" * 200 + "rotter", "alpha beta gamma delta"]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(odd), "doc_id", "text", m).collect()}
    assert all(abs(got[i] - plain(t or "")) < 1e-5 for i, t in enumerate(odd))


def test_toxicity_sample_takes_repeated_ids_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 6)
    seen = []
    monkeypatch.setattr(toxicity, "calibrated", lambda texts, labels: seen.append(list(zip(texts, labels, strict=True))))
    docs = spark.createDataFrame([(i, f"t{i} " * (20_000 if i == 3 else 1)) for i in range(12)] + [(1, "again"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(1, 1), (0, None), (None, 1), (2, 1), (99, 1)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, "doc_id", "text", "toxic")
    toxicity.fit(docs.orderBy("text"), labels.orderBy("toxic"), "doc_id", "text", "toxic")
    assert seen[0] == seen[1] and len([1 for _, y in seen[0] if y == 1]) <= 6 and len([1 for _, y in seen[0] if y == 0]) == 6
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 100)
    toxicity.fit(docs, labels, "doc_id", "text", "toxic")
    assert ("again", 1) in seen[2] and max(len(t) for t, _ in seen[2]) > 40_000 and {y for t, y in seen[2] if t == "t2 "} == {0, 1}
