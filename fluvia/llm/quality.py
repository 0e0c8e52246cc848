"""Document quality by attention-based multiple-instance learning over passages, trained in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm.common import map_slices, table

#: Bytes of a passage; the last of a text may be shorter.
PASSAGE = 512
#: Labelled documents that training reads at most, those of the smallest hash of the id.
TRAIN_DOCS = 6000
HIDDEN, GATE = 16, 8
THRESHOLD = 0.7

_GROUPS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n\t\r", ".", ",", "!?", "|", "#$%&*", "-_'\"()[]:;/"]


def _classes() -> np.ndarray:
    out = np.full(256, len(_GROUPS), np.int64)
    out[128:] = len(_GROUPS) + 1
    for k, group in enumerate(_GROUPS):
        out[[ord(c) for c in group]] = k
    return out


CLASSES = _classes()
N_CLASSES = len(_GROUPS) + 2
#: Buckets of the hashed trigrams of bytes, whose embeddings the encoder learns beside those of the shares.
GRAMS = 128
N_SHARES = N_CLASSES + 9
N_FEATURES = N_SHARES + GRAMS
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = np.random.default_rng(5).integers(1, 2**62, 256, dtype=np.int64)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the number of passages of each text (1 at least).

    They are shares of character classes and of repeated, capitalised and long words, and the roots of the shares of hashed
    trigrams, case aside; nothing but the text is read.
    """
    raws = [x.encode("utf-8", "surrogatepass") + b"\n" for x in texts]  # so an empty text has one passage too
    lens = np.array([len(r) for r in raws])
    buf = np.frombuffer(b"".join(raws), np.uint8)
    bags = -(-lens // PASSAGE)
    first = np.cumsum(lens) - lens
    within = np.arange(bags.sum()) - np.repeat(np.cumsum(bags) - bags, bags)
    starts = np.repeat(first, bags) + within * PASSAGE
    sizes = np.minimum(PASSAGE, np.repeat(first + lens, bags) - starts)
    n = len(starts)
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
    counts = np.bincount(owner * N_CLASSES + CLASSES[buf], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, :N_CLASSES] = counts / sizes[:, None]

    space = _SPACE[buf]
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if len(begin):
        sums = np.add.reduceat(np.where(space, 0, _MIX[buf]), begin)
        end = np.concatenate([begin[1:], [len(buf)]])
        long = end - begin  # with the white space behind
        passage = owner[begin]
        words = np.bincount(passage, minlength=n)
        per = lambda mask: np.bincount(passage, weights=mask, minlength=n) / np.maximum(words, 1)
        same = lambda lag: np.concatenate([np.zeros(min(lag, len(sums)), bool), (sums[lag:] == sums[:-lag]) & (passage[lag:] == passage[:-lag])])
        key = np.sort((sums & ((1 << 40) - 1)) + (passage << 40))
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        distinct = np.bincount(key[fresh] >> 40, minlength=n)
        head = CLASSES[buf[begin]]
        out[:, N_CLASSES] = distinct / np.maximum(words, 1)
        out[:, N_CLASSES + 1] = per(same(1))
        out[:, N_CLASSES + 2] = per(same(2) | same(3) | same(4))
        out[:, N_CLASSES + 3] = per(head == 0)
        out[:, N_CLASSES + 4] = per(long <= 4)
        out[:, N_CLASSES + 5] = per(long > 14)
        out[:, N_CLASSES + 6] = np.minimum(np.bincount(passage, weights=long, minlength=n) / np.maximum(words, 1) / 10, 4)
        out[:, N_CLASSES + 7] = per(head > 10)
    out[:, N_CLASSES + 8] = sizes / PASSAGE
    low = _LOWER[buf].astype(np.uint32)
    low = np.concatenate([low, np.zeros(2, np.uint32)])
    gram = ((low[:-2] * 65_536 + low[1:-1] * 256 + low[2:]) * np.uint32(2_654_435_761)) >> np.uint32(32 - 7)  # GRAMS is two to the 7
    for s in range(0, n, 4096):  # the counts of some passages at a time
        e = min(n, s + 4096)
        at = slice(starts[s], starts[e - 1] + sizes[e - 1])
        held = np.bincount((owner[at] - s) * GRAMS + gram[at], minlength=(e - s) * GRAMS).reshape(e - s, GRAMS)
        out[s:e, N_SHARES:] = np.sqrt(held / sizes[s:e, None])
    return out, bags


class MilModel:
    """Passages are encoded, weighed by gated attention within their document, and the weighted mean is scored."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.w = {"e": g(N_FEATURES, HIDDEN), "eb": np.zeros(HIDDEN), "v": g(HIDDEN, GATE), "u": g(HIDDEN, GATE), "a": g(GATE), "c": g(HIDDEN), "b": np.zeros(1)}
        self.mean, self.std = np.zeros(N_FEATURES), np.ones(N_FEATURES)

    def _forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        w, at = self.w, np.cumsum(bags) - bags
        h = np.tanh(x @ w["e"] + w["eb"])
        tv, su = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-h @ w["u"]))
        raw = (tv * su) @ w["a"]
        top = np.repeat(np.maximum.reduceat(raw, at), bags)
        alpha = np.exp(raw - top)
        alpha /= np.repeat(np.add.reduceat(alpha, at), bags)
        z = np.add.reduceat(alpha[:, None] * h, at)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))
        return {"h": h, "tv": tv, "su": su, "alpha": alpha, "z": z, "p": p}

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.std, bags)["p"]

    def train(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.03, decay: float = 1e-4) -> None:
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        x, at, w = (x - self.mean) / self.std, np.cumsum(bags) - bags, self.w
        m1 = {k: np.zeros_like(v) for k, v in w.items()}
        m2 = {k: np.zeros_like(v) for k, v in w.items()}
        for it in range(1, rounds + 1):
            f = self._forward(x, bags)
            ds = (f["p"] - y) / len(y)
            dz = ds[:, None] * w["c"]
            dzr = np.repeat(dz, bags, axis=0)
            da = (dzr * f["h"]).sum(1)
            draw = f["alpha"] * (da - np.repeat(np.add.reduceat(f["alpha"] * da, at), bags))
            dgate = draw[:, None] * w["a"]
            dv, du = dgate * f["su"] * (1 - f["tv"] ** 2), dgate * f["tv"] * f["su"] * (1 - f["su"])
            dh = (f["alpha"][:, None] * dzr + dv @ w["v"].T + du @ w["u"].T) * (1 - f["h"] ** 2)
            g = {"e": x.T @ dh, "eb": dh.sum(0), "v": f["h"].T @ dv, "u": f["h"].T @ du, "a": (f["tv"] * f["su"]).T @ draw, "c": f["z"].T @ ds, "b": ds.sum(keepdims=True)}
            for k in w:
                d = g[k] + decay * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.99 * m2[k] + 0.01 * d * d
                w[k] -= rate * (m1[k] / (1 - 0.9**it)) / (np.sqrt(m2[k] / (1 - 0.99**it)) + 1e-8)


def crc_bucket(col: str, n: int):
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_DOCS) -> MilModel:
    """A model learned from the texts of labelled documents, `limit` at most (those whose ids hash lowest).

    labels holds doc_id and 0/1; null labels are ignored, of several labels of a document the largest counts. Without
    labels, or with one class only, the model's scores say no more than that class.
    """
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # of a bounded size, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")
    # rows that repeat an id may be many: those of the smallest text hash are taken, `limit` at most in all
    rows = rows.orderBy(F.xxhash64("doc_id", "text")).limit(limit) if limit else rows
    kept = rows.select(F.col("text"), F.col("y"))

    def work(c: dict[str, list]) -> dict[str, list]:
        x, bags = features([t or "" for t in c["text"]])
        cut = np.split(x, np.cumsum(bags)[:-1])
        return {"y": c["y"], "n": [len(p) for p in cut], "x": [p.astype("<f4").tobytes() for p in cut]}

    got = map_slices(kept, ["text", "y"], "y int, n int, x binary", work).collect()
    model = MilModel()
    if got:
        got.sort(key=lambda r: bytes(r["x"]))  # the order of rows differs from run to run
        x = np.concatenate([np.frombuffer(r["x"], "<f4").reshape(-1, N_FEATURES) for r in got]).astype(float)
        model.train(x, np.array([r["n"] for r in got]), np.array([r["y"] for r in got], float))
    return model


def score_quality(docs: DataFrame, model: MilModel, carry: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The carried columns and a score, 0 to 1, of every row. A null text counts as empty; an empty one has one bare passage."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    names = [*dict.fromkeys([*carry, text_col])]

    def work(c: dict[str, list]) -> dict[str, list]:
        return {k: c[k] for k in carry} | {name: model.score(*features([t or "" for t in c[text_col]])).tolist()}

    return map_slices(docs, names, f"{schema}, `{name}` double", work)


def learned(docs: DataFrame, labels: DataFrame) -> MilModel:
    """The contract's model: labels of rows whose hash of the id, modulo 4, is 2 are held out."""
    return fit(docs, labels.where(crc_bucket("doc_id", 4) != 2))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    model = learned(docs, table(spark, sf_dir, "labels"))
    out = score_quality(docs, model, ["doc_id"])
    return out.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects; columns stay as they are."""
    names = docs.columns
    return score_quality(docs, learned(docs, labels), names, name="__score").where(F.col("__score") >= THRESHOLD).select(*names)
