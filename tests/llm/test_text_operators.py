"""Personal data, BPE, quality and language against plain rules, exact references and held-out rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from fluvia.llm import bpe, langid, pii, quality

FOLDER = "/root/testdata/sf0.01"
HARD = ["", "a", " \n ", "x" * 20_000, "é" * 3000, "日本語テキスト🎉 ▁ x▁y", "\x00\x01", "1234 " * 4000, "a\tb\r\nc", "+1 (017) 555-7713", "@@@ a@ @b.c a@b.c_x@y.com", "1.2.3.4.5.6.7.8 300.1.1.1"]


def plain_spans(text):
    """The base patterns as they are written, leftmost and without retries."""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_base_spans_equal_the_patterns(spark):
    texts = [r["text"] for r in documents(spark).select("text").collect()] + HARD + [t for t, _ in pii.labelled(300, 5)]
    r = np.random.default_rng(0)
    texts += ["".join(r.choice(list("a1.@+- ()\n4"), 60)) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t[:80]


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_network_finds_held_out_spans():
    net, cases = pii.trained(), pii.labelled(400, 99)
    found = pii.model_spans(net, [t for t, _ in cases])
    hit = sum(len(set(f) & set(s)) for f, (_, s) in zip(found, cases, strict=True))
    assert hit > 0.75 * sum(len(s) for _, s in cases)
    assert hit > 0.85 * sum(map(len, found))


def test_network_leaves_clean_text_alone():
    clean = ["This work is licensed under the GNU General Public License, version 3.", "Version 2.0 of 2024-01-31, 17:45.", "no digits at all", "CC BY-NC 4.0."]
    assert pii.model_spans(pii.trained(), clean) == [[], [], [], []]


@pytest.mark.parametrize("text", ["10.0.²2.1", "a@", "@", "²²²²²²²²²²²²² ٤", "+", "x" * 500, "1" * 500, "at at.at dot"])
def test_network_takes_odd_texts(text):
    assert pii.all_spans(pii.trained(), [text])[0][0] == plain_spans(text)


def test_network_finds_forms_beyond_the_patterns():
    """Held-out texts in full-width digits and signs, which no pattern matches, and spelled-out addresses."""
    net, cases = pii.trained(), pii.labelled(300, 77)
    wide = [t.translate({c: c + 0xFEE0 for c in [*range(48, 58), 64]}) for t, _ in cases]
    assert not any(map(pii.base_spans, wide))
    found = pii.model_spans(net, wide)
    hit = sum(len(set(f) & set(s)) for f, (_, s) in zip(found, cases, strict=True))
    assert hit > 0.85 * sum(len(s) for _, s in cases) and hit > 0.9 * sum(map(len, found))
    plain = pii.model_spans(net, [t for t, _ in cases])
    spelled = [(f, {x for x in s if "at" in t[x[1] : x[2]] and "@" not in t[x[1] : x[2]]}) for f, (t, s) in zip(plain, cases, strict=True)]
    assert sum(len(set(f) & s) for f, s in spelled) > 0.7 * sum(len(s) for _, s in spelled) > 20


def test_best_path_and_scores_equal_plain_ones():
    import itertools

    import numpy as np

    net = pii.trained()
    e = np.random.default_rng(1).normal(size=(4, pii.TAGS)) * 3

    def total(path):
        t = net.w["t"] + net.ban
        return net.w["s"][path[0]] + net.ban0[path[0]] + sum(e[k, p] for k, p in enumerate(path)) + sum(t[p, q] for p, q in zip(path[:-1], path[1:], strict=True))

    assert tuple(net.viterbi(e)) == max(itertools.product(range(pii.TAGS), repeat=4), key=total)
    x = pii.char_class("mail bob.17@mail3.example.com now")[None]
    h = np.concatenate([net._lstm(x, "f", False)[0], net._lstm(x, "b", False)[0]], axis=2)
    assert np.abs(np.swapaxes(h @ net.w["o"], 0, 1) + net.w["c"][x] - net.scores(x)).max() < 1e-3


def test_long_stretches_are_decoded_over_windows():
    text = "1 2 a 3 " * 400 + "mail bob.17@mail3.example.com now " + "4 b 5 " * 400
    base, spans = pii.all_spans(pii.trained(), [text])[0]
    assert [text[s:e] for k, s, e in base if k == "email"] == ["bob.17@mail3.example.com"] and set(base) <= set(spans)


def test_op1_contract(spark):
    rows = {r["doc_id"]: r for r in pii.op1_pii(spark, FOLDER).collect()}
    docs = documents(spark).collect()
    assert len(rows) == len(docs)
    for d in docs:
        r, want = rows[d["doc_id"]], plain_spans(d["text"] or "")
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(r["spans"].split(","))


def test_redaction_keeps_columns(spark):
    df = spark.createDataFrame([(1, "call a@b.cc or 10.0.0.1", "x"), (1, None, None), (None, "", "y"), (1, None, None)], "doc_id bigint, text string, base string")
    got = sorted(map(tuple, pii.redact_pii(df).collect()), key=str)
    assert got == sorted([(1, "call [EMAIL] or [IP]", "x"), (1, None, None), (None, "", "y"), (1, None, None)], key=str)
    assert pii.redact_pii(df.limit(0)).count() == 0
    assert pii.find_pii(df.limit(0)).count() == 0
    assert pii.find_pii(df).count() == 4


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers")


def test_bpe_equals_tiktoken(spark, vocabulary):
    import tiktoken

    codec = bpe.codec(vocabulary.path("byte_bpe_multi_50k.tiktoken"), vocabulary.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = np.random.default_rng(1)
    texts = [d["text"] for d in documents(spark).limit(300).collect()] + HARD + ["".join(map(chr, r.integers(1, 0x3000, 50))) for _ in range(300)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == ref.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_bpe_memo_starts_anew(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    codec = bpe.ByteBpe(vocabulary.path("byte_bpe_50k.tiktoken"), vocabulary.PATTERN)
    for k in range(20):
        text = " ".join(f"word{k}x{j}" for j in range(40 + k))
        assert codec.decode(codec.encode(text)) == text.encode()


def test_bpe_frames(spark, vocabulary):
    path = vocabulary.path("byte_bpe_multi_50k.tiktoken")
    df = spark.createDataFrame([(1, "a b", 9), (1, "a b", 9), (2, None, None), (None, "", 1)], "doc_id bigint, text string, ids int")
    ids = bpe.encode_texts(df, path, vocabulary.PATTERN)
    back = bpe.decode_ids(ids, path, vocabulary.PATTERN)
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in back.collect()) == [("1", b"a b"), ("1", b"a b"), ("2", b""), ("None", b"")]
    assert bpe.encode_texts(df.limit(0), path, vocabulary.PATTERN).count() == 0


def test_quality_held_out(spark):
    out = {r["doc_id"]: r for r in quality.op3_quality(spark, FOLDER).collect()}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    assert len(out) == documents(spark).count()
    held = [(out[r["doc_id"]]["predicted"], r["quality"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["doc_id"] in out]
    assert all(out[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in labels if r["doc_id"] in out)
    assert np.mean([p == y for p, y in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out.values())


def test_quality_hard_rows(spark):
    df = spark.createDataFrame([(k, t, None) for k, t in enumerate(HARD)] + [(99, None, 1), (99, None, 1), (None, "x", 2)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(0, 1), (1, 0), (99, 1), (99, None), (None, 1)], "doc_id bigint, quality int")
    model = quality.fit(df, labels)
    assert quality.score_quality(df, model, ["doc_id"]).count() == len(HARD) + 3
    assert quality.good_documents(df, labels).columns == df.columns
    nothing = quality.fit(df, labels.limit(0))
    assert quality.score_quality(df.limit(0), nothing, ["doc_id"]).count() == 0


def test_attention_gradient():
    """The model's training lowers its loss, and each weight's step is the loss's slope."""
    r = np.random.default_rng(0)
    x, bags, y = r.normal(size=(12, quality.N_FEATURES)), np.array([3, 1, 5, 3]), np.array([1.0, 0, 1, 0])
    loss = lambda m: -np.mean(y * np.log(m.score(x, bags)) + (1 - y) * np.log(1 - m.score(x, bags)))
    m = quality.MilModel()
    before = loss(m)
    m.train(x, bags, y, rounds=60)
    assert loss(m) < 0.5 * before


def test_language_held_out(spark):
    out = langid.op4_langid(spark, FOLDER).join(documents(spark).select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97


def test_language_of_switched_words():
    texts = ["the cat and the dog of this house", "der hund und die katze von dem haus"] * 30
    model = langid.WordCrf(["de", "en"])
    model.train(texts, [1, 0] * 30)
    mixed = "the cat and the dog\nder hund und die katze"
    x = langid.Words([mixed])
    post, _ = model.marginals(model.emissions(x), x.head)
    assert (post[:5, 1] > 0.5).all() and (post[5:, 0] > 0.5).all()
    assert model.predict(["", "123 !", "日本", "the dog"])[0][:2] == ["und", "und"]


def test_forward_backward_equals_enumeration():
    import itertools

    r = np.random.default_rng(3)
    m = langid.WordCrf(["a", "b", "c"])
    m.trans = r.normal(size=(3, 3))
    e = r.normal(size=(4, 3))
    post, _ = m.marginals(e, np.array([0]))
    want = np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        w = np.exp(sum(e[t, s] for t, s in enumerate(path)) + sum(m.trans[a, b] for a, b in zip(path, path[1:])))
        for t, s in enumerate(path):
            want[t, s] += w
    assert np.allclose(post, want / want.sum(1, keepdims=True))


def test_language_hard_rows(spark):
    df = spark.createDataFrame([(k, t, "en" if k % 2 else None, 1) for k, t in enumerate(HARD)] + [(5, None, "de", 1)] * 2 + [(None, "und so", "de", 1)], "doc_id bigint, text string, lang string, score int")
    model = langid.fit(df)
    got = langid.identify(df, model)
    assert got.count() == len(HARD) + 3
    assert {r["lang_pred"] for r in got.where("doc_id = 5").collect()} >= {"und"}
    empty = langid.fit(df.limit(0))
    assert [r["lang_pred"] for r in langid.identify(df.limit(2), empty).collect()] == ["und", "und"]
