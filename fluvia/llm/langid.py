"""Language of words in code-switched text by a linear-chain conditional random field, trained in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm.common import map_slices, table
from fluvia.llm.quality import crc_bucket

#: Documents that training reads at most, those whose ids hash lowest, and bytes of their texts: one that would take more than is
#: left is passed over.
TRAIN_DOCS, TRAIN_BYTES = 3000, 2_800_000
#: Buckets of the hashed features: runs of 2, 3 and 4 characters with the word's ends (so affixes too), and whole words.
GRAMS, LEXICON = 1 << 15, 1 << 15


def _letters() -> np.ndarray:
    """A byte's place in a word: 0 for what parts words; capitals count as small letters."""
    out = np.zeros(256, np.int64)
    for c in range(97, 123):
        out[c] = c
        out[c - 32] = c
    out[128:] = np.arange(128, 256)
    return out


LETTERS = _letters()


class Words:
    """The words of texts as hashed features: `grams` of all bytes, which word each belongs to, and the lines as chains."""

    def __init__(self, texts: list[str]):
        raws = [t.lower().encode("utf-8", "surrogatepass") + b"\n" for t in texts]
        size = np.array([len(r) for r in raws], np.int64)
        buf = np.frombuffer(b"".join([b"\n", *raws, b"\n\n\n"]), np.uint8)
        b = LETTERS[buf]
        live = b > 0
        self.begin = np.flatnonzero(live[1:] & ~live[:-1]) + 1
        self.n = len(self.begin)
        self.doc = np.searchsorted(np.cumsum(size) + 1, self.begin, "right")
        line = np.cumsum(buf == 10)
        chain = line[self.begin]
        self.head = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]])) if self.n else np.zeros(0, int)
        if not self.n:
            return
        stop = np.flatnonzero(~live[1:] & live[:-1]) + 1
        length = stop - self.begin
        # each n-gram starts at a letter or at the mark before a word; those that run beyond the mark behind are void
        self.span = length + 1
        at = np.repeat(self.begin - 1 - np.concatenate([[0], np.cumsum(self.span)[:-1]]), self.span) + np.arange(self.span.sum())
        left = np.repeat(stop, self.span) - at  # characters up to the mark behind
        b1, b2, b3 = b[at + 1], b[np.minimum(at + 2, len(b) - 1)], b[np.minimum(at + 3, len(b) - 1)]
        two = b[at] * 257 + b1
        three = two * 257 + b2
        four = three * 257 + b3
        mix = lambda x, k: ((x * np.int64(0x9E3779B97F4A7C1 + 2 * k)) >> 24) & (GRAMS - 1)
        self.grams = np.stack([mix(two, 1), np.where(left >= 2, mix(three, 2), GRAMS), np.where(left >= 3, mix(four, 3), GRAMS)])
        self.first = np.concatenate([[0], np.cumsum(self.span)[:-1]])
        place = np.arange(self.span.sum()) - np.repeat(self.first, self.span)
        self.lexicon = (np.add.reduceat((two * (place * 2 + 1)) * np.int64(0x2545F4914F6CDD1D), self.first) >> 30) & (LEXICON - 1)


class WordCrf:
    """Scores of words by language from hashed features, and transitions between neighbours in a line."""

    def __init__(self, langs: list[str]):
        k = len(langs)
        self.langs = langs
        self.w = np.zeros((GRAMS + 1, k), np.float32)  # the last row is for void n-grams and stays 0
        self.lex = np.zeros((LEXICON, k), np.float32)
        self.trans = np.eye(k) * 2.0

    def emissions(self, x: Words) -> np.ndarray:
        e = self.lex[x.lexicon].astype(np.float64)
        for g in x.grams:
            e += np.add.reduceat(self.w[g], x.first) / np.sqrt(x.span)[:, None]
        return e

    def marginals(self, e: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over all chains at once; also the expected counts of transitions."""
        n, k = e.shape
        p = np.exp(e - e.max(1, keepdims=True))
        t = np.exp(self.trans)
        length = np.diff(np.append(head, n))
        order = np.argsort(-length, kind="stable")
        head, length = head[order], length[order]
        live = np.searchsorted(-length, -np.arange(length[0]), "left")  # chains longer than each step
        a, z = np.empty((n, k)), np.ones((n, k))
        cur = p[head]
        a[head] = cur = cur / cur.sum(1, keepdims=True)
        for s in range(1, length[0]):
            m = live[s]
            at = head[:m] + s
            cur = (cur[:m] @ t) * p[at]
            cur /= cur.sum(1, keepdims=True)
            a[at] = cur
        counts = np.zeros((k, k))
        for s in range(length[0] - 2, -1, -1):
            m = live[s + 1]
            at = head[:m] + s
            nxt = z[at + 1] * p[at + 1]
            back = nxt @ t.T
            back /= back.sum(1, keepdims=True)
            z[at] = back
            pair = a[at][:, :, None] * nxt[:, None, :] * t if self.counting else None
            if pair is not None:
                counts += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        post = a * z
        return post / post.sum(1, keepdims=True), counts

    counting = False

    def train(self, texts: list[str], y: list[int], rounds: int = 14, rate: float = 0.5, decay: float = 1e-6) -> None:
        """Gradient ascent on the chains' likelihood, a word's label being its document's."""
        self.counting = True
        parts = [(Words(texts[i : i + 200]), np.array(y[i : i + 200])) for i in range(0, len(texts), 200)]
        parts = [(x, lab[x.doc]) for x, lab in parts if x.n]
        k = len(self.langs)
        g2w, g2l, g2t = np.full(self.w.shape, 1e-2, np.float32), np.full(self.lex.shape, 1e-2, np.float32), np.full((k, k), 1e-2)
        for _ in range(rounds):
            for x, lab in parts:
                post, counts = self.marginals(self.emissions(x), x.head)
                d = post
                d[np.arange(x.n), lab] -= 1
                inner = np.ones(x.n, bool)
                inner[x.head] = False
                at = np.flatnonzero(inner)
                np.subtract.at(counts, (lab[at - 1], lab[at]), 1)
                spread = np.repeat(d / np.sqrt(x.span)[:, None], x.span, axis=0)
                gw = np.zeros_like(self.w)
                for g in x.grams:
                    for j in range(k):
                        gw[:, j] += np.bincount(g, weights=spread[:, j], minlength=GRAMS + 1)
                gl = np.stack([np.bincount(x.lexicon, weights=d[:, j], minlength=LEXICON) for j in range(k)], axis=1)
                gw[-1] = 0
                for w, g, g2 in ((self.w, gw / x.n + decay * self.w, g2w), (self.lex, gl / x.n + decay * self.lex, g2l), (self.trans, counts / x.n + 1e-4 * self.trans, g2t)):
                    g2 *= 0.98
                    g2 += g * g
                    w -= (rate * 0.1 * g / np.sqrt(g2 + 1e-9)).astype(w.dtype)
        self.counting = False

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """For each text the language of most of its words' probability, and its mean share; `und` and 0 without a letter."""
        x = Words(texts)
        total, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        if x.n and self.langs:
            post, _ = self.marginals(self.emissions(x), x.head)
            for j in range(len(self.langs)):
                total[:, j] = np.bincount(x.doc, weights=post[:, j], minlength=len(texts))
            count = np.bincount(x.doc, minlength=len(texts))
        share = total / np.maximum(count, 1)[:, None]
        best = share.argmax(1) if self.langs else count
        has = [bool(c) and (t.isascii() or any(ch.isalpha() for ch in t)) for c, t in zip(count, texts, strict=True)]
        return [self.langs[b] if h and self.langs else "und" for b, h in zip(best, has, strict=True)], [float(share[i, b]) if h and self.langs else 0.0 for i, (b, h) in enumerate(zip(best, has, strict=True))]


def fit(docs: DataFrame, limit: int = TRAIN_DOCS) -> WordCrf:
    """A field learned from text and lang of `limit` documents at most, those whose ids hash lowest. Rows with a null text
    or lang are not used; without any, every prediction is `und`."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    keyed = known.select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("h"), F.xxhash64("text", "lang").alias("t"))
    left, chosen = TRAIN_BYTES, []
    for r in keyed.select("doc_id", "h", "t", F.octet_length("text").alias("size")).orderBy("h", "doc_id", "t").limit(limit).collect():  # numbers alone
        if r["size"] <= left:
            chosen.append((r["h"], r["t"]))
            left -= r["size"]
    picked = docs.sparkSession.createDataFrame(chosen or [(None, None)], "h bigint, t bigint").distinct()
    rows = keyed.join(F.broadcast(picked), ["h", "t"]).dropDuplicates(["h", "t"]).collect()
    rows.sort(key=lambda r: (r["h"], r["t"]))
    langs = sorted({r["lang"] for r in rows})
    model, texts, y = WordCrf(langs), [r["text"] for r in rows], [langs.index(r["lang"]) for r in rows]
    if len(langs):
        model.train(texts, y)
    return model


def identify(docs: DataFrame, model: WordCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row. A null, empty or letterless text gives `und` and 0; repeated rows are kept."""

    def work(c: dict[str, list]) -> dict[str, list]:
        langs, scores = model.predict([t or "" for t in c[text_col]])
        return {id_col: c[id_col], "lang_pred": langs, "score": scores}

    return map_slices(docs, [id_col, text_col], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double", work)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents; rows whose hash of the id, modulo 3, is 1 are held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(crc_bucket("doc_id", 3) != 1))
    return identify(docs, model).select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
