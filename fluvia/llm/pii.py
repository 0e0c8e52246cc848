"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions trained in numpy."""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm.common import map_slices, table

KINDS = ("email", "ip", "card", "phone")
#: Characters that the network reads on each side of what every span has to hold (see TRIGGER).
REACH = 48
#: Characters of a window in which the network reads, and by which windows overlap; of a training window.
WIDTH, OVERLAP, TRAIN_WIDTH = 128, 48, 64
#: Windows that are read together.
AT_ONCE = 1024
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match of the pattern for addresses can only start where a run of digits starts: a later start would match less of the same run.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What a span can't be without (see sane): a digit of some script, an @ of some form, or a spelled-out address's middle.
SPELLED = r"\bat\b[\])}]?\x20?[\w-]{1,40}\x20?[\[({]?(?:\.\w|dot\b)"
TRIGGER = re.compile(r"[0-9@\uff20\uff10-\uff19\u0660-\u0669\u06f0-\u06f9\u0966-\u096f]|" + SPELLED)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, found from each @ so that long runs without one cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; ends are exclusive, positions are code points."""
    if not TRIGGER.search(text):
        return []
    out = [("email", s, e) for s, e in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# ---- the network -------------------------------------------------------------------------------------------------


#: Digits of other scripts and full-width forms, as the ASCII characters that they stand for.
SAME_AS = {0xFF01 + k: 33 + k for k in range(94)} | {0x3000: 32} | {base + k: 48 + k for base in (0x0660, 0x06F0, 0x0966) for k in range(10)}


def char_class(text: str) -> np.ndarray:
    """Indices of characters: 0 pads, printable ASCII by itself, 96 a letter, 97 white space, 98 anything else beyond. Full-width
    forms and other scripts' digits count as what they stand for."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not text.isascii() and (np.isin(codes, _OTHER_FORMS)).any():
        codes = np.frombuffer(text.translate(SAME_AS).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _CLASS[np.minimum(codes, 0x2000)]
    return out


_OTHER_FORMS = np.array(sorted(SAME_AS), np.uint32)


def _class_table() -> np.ndarray:
    codes = np.arange(0x2001)
    out = np.where((codes >= 32) & (codes < 127), codes - 31, 98)
    out[[9, 10, 13]] = 97
    out[0xAA:0x2000] = 96
    return out


_CLASS = _class_table()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """A bidirectional LSTM over characters whose scores meet learned transitions in a conditional random field."""

    def __init__(self, hidden: int = 20, seed: int = 7):
        r = np.random.default_rng(seed)
        n = hidden
        self.n = n
        self.w = {}
        for d in "fb":
            self.w[d + "x"] = r.normal(0, 0.2, (100, 4 * n))  # input weights, one row a character
            self.w[d + "h"] = r.normal(0, 1 / np.sqrt(n), (n, 4 * n))
            self.w[d + "x"][:, n : 2 * n] += 0.5  # forget gates start open
        self.w["o"] = r.normal(0, 0.2, (2 * n, TAGS))
        self.w["c"] = r.normal(0, 0.2, (100, TAGS))
        self.w["t"] = np.zeros((TAGS, TAGS))
        self.w["s"] = np.zeros(TAGS)
        #: A kind's inside tag can only follow the same kind's begin or inside tag.
        self.ban = np.zeros((TAGS, TAGS))
        self.ban0 = np.zeros(TAGS)
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            self.ban0[inside] = -1e4
            for p in range(TAGS):
                if p not in (inside, inside - 1):
                    self.ban[p, inside] = -1e4

    def _lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        b, length = x.shape
        h, c, n = np.zeros((b, self.n)), np.zeros((b, self.n)), self.n
        out, saved = np.zeros((length, b, n)), []
        steps = range(length) if d == "f" else range(length - 1, -1, -1)
        wx, wh = self.w[d + "x"], self.w[d + "h"]
        for t in steps:
            z = wx[x[:, t]] + h @ wh
            g = sigmoid(z[:, : 3 * n])
            i, f, o, u = g[:, :n], g[:, n : 2 * n], g[:, 2 * n :], np.tanh(z[:, 3 * n :])
            before = (h, c)
            c = f * c + i * u
            live = (x[:, t] > 0)[:, None]
            c = np.where(live, c, 0)
            tc = np.tanh(c)
            h = np.where(live, o * tc, 0)
            out[t] = h
            if keep:
                saved.append((t, i, f, o, u, tc, *before, live))
        return out, saved

    def _read(self, x: np.ndarray, d: str) -> np.ndarray:
        """As _lstm, in single precision and in place: states of all steps (time x windows x hidden); x is time x windows."""
        n, (length, b) = self.n, x.shape
        wx, wh = self.w[d + "x"].astype(np.float32), self.w[d + "h"].astype(np.float32)
        wx, wh = wx.copy(), wh.copy()
        wx[:, : 3 * n] *= 0.5  # a sigmoid is half a tanh of half its argument, plus a half
        wh[:, : 3 * n] *= 0.5
        h, c, out = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32), np.empty((length, b, n), np.float32)
        z, g = np.empty((b, 4 * n), np.float32), np.empty((b, 4 * n), np.float32)
        live = (x > 0).astype(np.float32)[:, :, None]
        padded = live.all(axis=(1, 2))
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            np.take(wx, x[t], axis=0, out=z)
            z += np.matmul(h, wh, out=g)
            np.tanh(z, out=z)
            z[:, : 3 * n] *= 0.5
            z[:, : 3 * n] += 0.5
            c *= z[:, n : 2 * n]
            c += z[:, :n] * z[:, 3 * n :]
            if not padded[t]:
                c *= live[t]
            h = np.tanh(c, out=out[t])
            h *= z[:, 2 * n : 3 * n]
            if not padded[t]:
                h *= live[t]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Tag scores of windows (windows x characters) -> windows x characters x tags."""
        x = np.ascontiguousarray(x.T)
        o = self.w["o"].astype(np.float32)
        got = self._read(x, "f") @ o[: self.n]
        got += self._read(x, "b") @ o[self.n :]
        got += self.w["c"].astype(np.float32)[x]
        return np.swapaxes(got, 0, 1)

    def viterbi(self, e: np.ndarray) -> list[int]:
        trans, best, back = self.w["t"] + self.ban, self.w["s"] + self.ban0 + e[0], []
        for row in e[1:]:
            m = best[:, None] + trans
            back.append(m.argmax(0))
            best = m.max(0) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int = 160, batch: int = 96, rate: float = 0.02, seed: int = 3) -> None:
        r, n = np.random.default_rng(seed), self.n
        mom = {k: np.zeros_like(v) for k, v in self.w.items()}
        var = {k: np.zeros_like(v) for k, v in self.w.items()}
        for it in range(1, rounds + 1):
            pick = r.integers(0, len(x), batch)
            xb, yb = x[pick], y[pick]
            length = xb.shape[1]
            hf, sf = self._lstm(xb, "f", True)
            hb, sb = self._lstm(xb, "b", True)
            h = np.concatenate([hf, hb], axis=2)
            e = h @ self.w["o"] + self.w["c"][xb.T]  # time x batch x tags
            trans = self.w["t"] + self.ban
            # forward-backward in probabilities, scaled at each step
            p, tr = np.exp(e - e.max(2, keepdims=True)), np.exp(np.maximum(trans, -50)) * (self.ban > -1)
            a, z = np.zeros_like(p), np.zeros_like(p)
            a[0] = p[0] * np.exp(self.w["s"]) * (self.ban0 > -1)
            a[0] /= a[0].sum(1, keepdims=True)
            for t in range(1, length):
                a[t] = (a[t - 1] @ tr) * p[t]
                a[t] /= a[t].sum(1, keepdims=True)
            z[-1] = 1
            gt = np.zeros_like(trans)
            for t in range(length - 2, -1, -1):
                nxt = z[t + 1] * p[t + 1]
                z[t] = nxt @ tr.T
                z[t] /= z[t].sum(1, keepdims=True)
                pair = a[t][:, :, None] * tr[None] * nxt[:, None, :]
                gt += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            post = a * z
            post /= post.sum(2, keepdims=True)
            de = post.copy()
            de[np.arange(length)[:, None], np.arange(batch)[None], yb.T] -= 1
            np.subtract.at(gt, (yb[:, :-1].ravel(), yb[:, 1:].ravel()), 1)
            de *= (xb.T > 0)[:, :, None]
            g = {"t": gt, "s": de[0].sum(0), "o": np.einsum("tbh,tbk->hk", h, de), "c": np.zeros_like(self.w["c"])}
            np.add.at(g["c"], xb.T, de)
            dh = de @ self.w["o"].T
            for d, saved, part in (("f", sf, dh[:, :, :n]), ("b", sb, dh[:, :, n:])):
                gx, gh = np.zeros_like(self.w[d + "x"]), np.zeros_like(self.w[d + "h"])
                nh, nc = np.zeros((batch, n)), np.zeros((batch, n))
                for t, i, f, o, u, tc, h0, c0, live in reversed(saved):
                    q = (part[t] + nh) * live
                    c = (nc + q * o * (1 - tc * tc)) * live
                    dz = np.concatenate([c * u * i * (1 - i), c * c0 * f * (1 - f), q * tc * o * (1 - o), c * i * (1 - u * u)], axis=1)
                    np.add.at(gx, xb[:, t], dz)
                    gh += h0.T @ dz
                    nh, nc = dz @ self.w[d + "h"].T, c * f
                g[d + "x"], g[d + "h"] = gx, gh
            now = rate * min(1, it / 10) * (1 - 0.9 * it / rounds)
            for k, v in g.items():
                v = np.clip(v / batch, -1, 1)
                mom[k] = 0.9 * mom[k] + 0.1 * v
                var[k] = 0.99 * var[k] + 0.01 * v * v
                self.w[k] -= now * (mom[k] / (1 - 0.9**it)) / (np.sqrt(var[k] / (1 - 0.99**it)) + 1e-6)


# ---- labelled spans ----------------------------------------------------------------------------------------------

SYLLABLES = "the an on er ti re in tion schä ver éau queé ción ado ñas und lich mente wh ble st ou of ing".split()


def labelled(count: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled texts from a fixed generator: personal data in usual and unusual forms, amid numbers that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card(sep: str) -> str:
        d = r.choice("3456789") + digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return sep.join(d[k : k + 4] for k in range(0, 16, 4))

    def good() -> tuple[str, str]:
        kind = r.choice(KINDS)
        name = "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))
        if kind == "email" and r.random() < 0.3:
            at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", "."), ("(at)", "(dot)"), ("[at]", ".")])
            return kind, name + r.choice(["", digits(2), dot + "".join(r.choice("abcdefghilmnoprstu") for _ in range(5))]) + at + r.choice(["mail", "post", "corp", "web"]) + digits(r.randint(0, 1)) + dot + r.choice(["com", "org", "net", "de"])
        if kind == "email":
            return kind, name + r.choice([".", "_", "-", "+", ""]) + digits(r.randint(0, 3)) + "@" + r.choice(["mail", "post", "corp", "web"]) + digits(r.randint(0, 1)) + r.choice([".example.com", ".org", ".co.uk", ".de"])
        if kind == "ip":
            return kind, ".".join(str(r.randint(0, 255)) for _ in range(4))
        if kind == "card":
            return kind, card(r.choice(["", "", " ", "-", "."]))
        return kind, r.choice(["+%s (%s) %s-%s", "+%s %s %s %s", "+%s-%s-%s-%s", "(+%s) %s %s %s", "00%s %s %s %s", "+%s.%s.%s.%s"]) % (digits(r.randint(1, 2)), digits(3), digits(3), digits(4))

    def bad() -> str:
        return r.choice([
            lambda: digits(r.randint(1, 4)), lambda: digits(r.randint(5, 12)), lambda: digits(r.randint(20, 40)), lambda: "Version " + digits(1) + "." + digits(1),
            lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2099)}", lambda: f"{r.randint(1900, 2099)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(0, 23)}:{digits(2)}:{digits(2)}",
            lambda: "token = \"" + "".join(r.choice("0123456789abcdef") for _ in range(40)) + "\"", lambda: "$" + digits(2) + "." + digits(2), lambda: word() + digits(2), lambda: "@" + word(), lambda: digits(2) + "%",
            lambda: "CC BY-NC " + digits(1) + ".0.", lambda: "v" + digits(1) + "." + digits(1) + "." + digits(1), lambda: digits(1) + "," + digits(3) + "," + digits(3), lambda: "+" + digits(r.randint(1, 3)), lambda: word() + " at " + word() + " dot " + word(), lambda: "at " + word() + "." + word(), lambda: word() + " (at) " + word(), lambda: "www." + word() + digits(1) + ".com/" + digits(3),
        ])()

    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(r.randint(3, 7)):
            text += " ".join(word() for _ in range(r.randint(1, 5))) + r.choice([" ", " ", " ", ", ", ". ", "\n", ": ", " ("])
            x = r.random()
            if x < 0.45:
                kind, s = good()
                spans.append((kind, len(text), len(text) + len(s)))
                text += s + r.choice([" ", " ", ". ", ", ", "\n", ") "])
            elif x < 0.85:
                text += bad() + r.choice([" ", " ", ". ", "\n"])
        out.append((text, spans))
    return out


def windows(length: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover a training text."""
    if length <= TRAIN_WIDTH:
        return [(0, length)]
    starts = [*range(0, length - TRAIN_WIDTH, TRAIN_WIDTH // 2), length - TRAIN_WIDTH]
    return [(s, s + TRAIN_WIDTH) for s in starts]


def training_set(texts: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for text, spans in texts:
        x, y = char_class(text), np.zeros(len(text), np.int64)
        for kind, s, e in spans:
            k = KINDS.index(kind)
            y[s], y[s + 1 : e] = 1 + 2 * k, 2 + 2 * k
        for s, e in windows(len(text)):
            xs.append(np.pad(x[s:e], (0, TRAIN_WIDTH - (e - s))))
            part = y[s:e].copy()
            if part[0] and part[0] % 2 == 0:  # a window may start inside a span
                part[0] -= 1
            ys.append(np.pad(part, (0, TRAIN_WIDTH - (e - s))))
    return np.array(xs), np.array(ys)


@functools.lru_cache(maxsize=2)
def trained(examples: int = 1500, rounds: int = 320, seed: int = 11) -> Tagger:
    """The network, fitted on `examples` generated texts; the same in every process and at every input size."""
    net = Tagger()
    net.train(*training_set(labelled(examples, seed)), rounds=rounds)
    return net


ADDRESS = re.compile(r".@.*(?:\.|\bdot\b).|.\W" + SPELLED, re.S)


def sane(kind: str, s: str) -> bool:
    """Whether a span of the network can be of its kind at all, full-width forms and other scripts' digits taken as ASCII."""
    s = s.translate(SAME_AS)
    digits = re.sub("[^0-9]", "", s)
    if kind == "email":
        return bool(ADDRESS.search(s))
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(x) < 4 and int(x) < 256 for x in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around everything that a span can't be without: no span lies outside of them."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        s, e = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def window_scores(net: Tagger, texts: list[str]) -> list[np.ndarray]:
    """Tag scores of every character of every text. Windows overlap, and a character's scores are those of the window in which it
    stands farther from the edge."""
    step, half = WIDTH - OVERLAP, OVERLAP // 2
    codes = [char_class(t).astype(np.uint8) for t in texts]
    count = [max(1, -(-(len(c) - OVERLAP) // step)) for c in codes]
    first = np.cumsum([0, *count])
    x = np.zeros((first[-1], WIDTH), np.uint8)
    for k, c in enumerate(codes):
        whole = np.zeros(count[k] * step + OVERLAP, np.uint8)
        whole[: len(c)] = c
        x[first[k] : first[k + 1]] = np.lib.stride_tricks.sliding_window_view(whole, WIDTH)[::step]
    got = np.empty((first[-1], WIDTH, TAGS), np.float32)
    for at in range(0, len(x), AT_ONCE):
        got[at : at + AT_ONCE] = net.scores(x[at : at + AT_ONCE])
    out = []
    for k, c in enumerate(codes):
        own, n = got[first[k] : first[k + 1]], len(c)
        if count[k] == 1:
            out.append(own[0, :n])
        else:
            parts = [own[0, : WIDTH - half], *own[1:-1, half : WIDTH - half], own[-1, half:]]
            out.append(np.concatenate(parts)[:n])
    return out


def model_spans(net: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans by the network alone. It reads every stretch that can hold one, in overlapping windows whose scores are reconciled
    into one sequence, over which one best path is taken."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    where = [(k, s, e) for k, text in enumerate(texts) for s, e in regions(text)]
    if not where:
        return out
    for (k, s, e), scored in zip(where, window_scores(net, [texts[k][s:e] for k, s, e in where]), strict=True):
        path, open_ = [*net.viterbi(scored), 0], None
        for t, tag in enumerate(path):
            if open_ and (tag % 2 == 1 or tag == 0):
                kind, start = open_
                span = texts[k][s + start : s + t].rstrip()
                if sane(kind, span):
                    out[k].append((kind, s + start, s + start + len(span)))
                open_ = None
            if tag % 2 == 1:
                open_ = KINDS[tag // 2], t
    return out


def all_spans(net: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """For each text its base spans, and those with the network's that touch none of them."""
    base, out = [base_spans(t) for t in texts], []
    more = model_spans(net, texts)
    for k, own in enumerate(base):
        taken = np.array(sorted((s, e) for _, s, e in own), np.int64).reshape(-1, 2)
        far = np.maximum.accumulate(taken[:, 1])  # the farthest end so far
        added = []
        for kind, s, e in more[k]:
            at = np.searchsorted(taken[:, 0], e)
            if not at or far[at - 1] <= s:
                added.append((kind, s, e))
        out.append((own, sorted(own + added, key=lambda x: (KINDS.index(x[0]), x[1]))))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) of every row: base and spans are arrays of (kind, start, end), by kind and start.

    A null text is taken as empty and has no spans. Repeated rows are kept. Other columns are not read.
    """
    net = trained()

    def work(c: dict[str, list]) -> dict[str, list]:
        found = all_spans(net, [x or "" for x in c["__text"]])
        as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        return {"__id": c["__id"], "base": [as_rows(b) for b, _ in found], "spans": [as_rows(a) for _, a in found]}

    span = "array<struct<kind: string, start: bigint, end: bigint>>"
    kept = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return map_slices(kept, ["__id", "__text"], f"__id {kept.schema[0].dataType.simpleString()}, base {span}, spans {span}", work).withColumnRenamed("__id", id_col)


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced by [KIND]; where spans overlap, the union is replaced by the first's.

    Other columns and the order of columns stay; a null text stays null.
    """
    net = trained()
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def work(c: dict[str, list]) -> dict[str, list]:
        out = []
        for text, (_, spans) in zip(c[text_col], all_spans(net, [x or "" for x in c[text_col]]), strict=True):
            parts, end = [], 0
            for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                if s >= end:
                    parts += [text[end:s], f"[{kind.upper()}]"]
                end = max(end, e)
            out.append(text if not spans else "".join(parts) + text[end:])
        return c | {text_col: out}

    return map_slices(docs, names, schema, work)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents: counts and digest of the base spans, and all spans."""
    found = find_pii(table(spark, sf_dir, "documents"))
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
