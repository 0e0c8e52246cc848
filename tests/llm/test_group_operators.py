"""Near-duplicates, neighbours, packing, lines, pages and the pipeline against brute force."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import corpus_pipeline
from fluvia.llm import html_text, lines, neighbours, packing, simhash, vectors_dedup
from fluvia.llm.common import connected_components

FOLDER = "/root/testdata/sf0.01"


def united(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        p, q = sorted((top(a), top(b)))
        up[q] = p
    return [top(x) for x in range(n)]


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (7, 7), (100, 102)] + [(200, k) for k in range(201, 260)]
    got = dict(map(tuple, connected_components(spark.createDataFrame([*chain, (None, 3)], "a bigint, b bigint")).collect()))
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100} | {k: 200 for k in range(200, 260)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- SimHash -------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    import re

    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    bits = collections.Counter(b for g in grams for h in [xxhash.xxh64_intdigest(g.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, c in bits.items() if 2 * c > len(grams))


@pytest.mark.parametrize("text", ["", " \t\n", "one", "Two Words", "ÀB c D\x0be\x1cf g", "a b c d e f " * 50, " x y z w"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_ball_hashing_finds_all_links(spark):
    r = np.random.default_rng(4)
    fps = set(r.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64).tolist())
    for f in list(fps)[:120]:
        for _ in range(3):  # neighbours at 1 to 5 bits, dense groups among them
            x = f % (1 << 64)
            for b in r.choice(64, r.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x - (1 << 64) if x >= 1 << 63 else x)
    fps = sorted(fps)
    pairs = simhash.close_pairs(spark.createDataFrame([(f,) for f in fps], "fp bigint")).collect()
    at = {f: k for k, f in enumerate(fps)}
    u = np.array(fps, np.int64).view(np.uint64)
    near = [(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if np.bitwise_count(u[i] ^ u[j]) <= 3]
    assert united(len(fps), [(at[p["a"]], at[p["b"]]) for p in pairs]) == united(len(fps), near)


def test_simhash_rows(spark):
    df = spark.createDataFrame([(5, "a b c d"), (3, "A b  c d"), (None, "a b c d"), (7, None), (8, ""), (8, ""), (9, "z " * 50_000)], "doc_id bigint, text string").withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(1))
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(df).collect())
    assert got == {(5, 3): 1, (3, 3): 1, (None, 3): 1, (7, 7): 1, (8, 7): 2, (9, 9): 1}
    assert simhash.simhash_groups(df.limit(0)).count() == 0
    kept = simhash.without_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 9]


def test_near_duplicates_without_ids(spark):
    """Different texts stay, whether they share an id or have none."""
    texts = ["one two three four", "five six seven eight nine", "ten eleven twelve thirteen"]
    rows = [(None, t) for t in texts[:2]] + [(4, texts[2]), (4, "alpha beta gamma delta"), (4, "alpha beta gamma delta"), (6, texts[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(str, simhash.without_near_duplicates(df).collect()))
    assert got == sorted(map(str, df.where("doc_id IS NOT NULL").distinct().unionByName(df.where(F.col("text") == texts[1])).collect()))


def test_near_duplicates_shuffle_texts_once(spark):
    """Where tables are too large to be sent to every task."""
    def shuffles(node):
        own = node.nodeName() == "Exchange" and any(n in node.output().toString() for n in ("text#", "first#"))  # as it is, or as an aggregate
        return own + sum(shuffles(node.children().apply(k)) for k in range(node.children().size()))

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "e f g h")], "doc_id bigint, text string")
        kept = simhash.without_near_duplicates(df)
        assert shuffles(kept._jdf.queryExecution().executedPlan().initialPlan()) == 1
        assert sorted(map(tuple, kept.collect()), key=str) == [(1, "a b c d"), (None, "e f g h")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_variants_of_many_parts(spark, monkeypatch):
    """Clustered fingerprints in many parts and small batches give the links of brute force."""
    monkeypatch.setattr(simhash, "PART_VARIANTS", 2000)
    r = np.random.default_rng(14)
    fps = set()
    for base in r.integers(-(2**63), 2**63 - 1, 12, dtype=np.int64).tolist():
        for _ in range(40):
            x = base % (1 << 64)
            for b in r.choice(64, r.integers(0, 4), replace=False):
                x ^= 1 << int(b)
            fps.add(x - (1 << 64) if x >= 1 << 63 else x)
    fps = sorted(fps)
    pairs = simhash.close_pairs(spark.createDataFrame([(f,) for f in fps], "fp bigint")).collect()
    at, u = {f: k for k, f in enumerate(fps)}, np.array(fps, np.int64).view(np.uint64)
    near = [(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if np.bitwise_count(u[i] ^ u[j]) <= 3]
    assert all(np.bitwise_count(u[at[p["a"]]] ^ u[at[p["b"]]]) <= 3 for p in pairs)
    assert united(len(fps), [(at[p["a"]], at[p["b"]]) for p in pairs]) == united(len(fps), near)


# ---- vectors -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(6)
    v = r.normal(size=(900, 16))
    v[300:500] = v[:200] + r.normal(size=(200, 16)) * 0.15
    v[500:560] = v[0]  # copies
    v[560:600] = v[1] * np.linspace(0.5, 3, 40)[:, None]  # the same direction
    rows = [(k, [float(x) for x in u]) for k, u in enumerate(v)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0, 2.0]), (1100, [float("inf")] * 16)]
    return v, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("kept", F.lit("x"))


def test_vector_groups(vectors):
    v, df = vectors
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    want = united(len(v), np.argwhere(np.triu(close)).tolist())
    got = {r["vec_id"]: r for r in vectors_dedup.vector_groups(df).collect()}
    assert len(got) == 906
    links = sum(got[k]["n_links"] for k in range(900))
    assert all(got[k]["n_links"] <= close[k].sum() for k in range(900)) and links >= 0.995 * close.sum()
    assert np.mean([got[k]["component_id"] == want[k] for k in range(900)]) > 0.99
    assert all((got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True) for k in (1000, 1001, 1002, 1003, 1004, 1100))
    assert vectors_dedup.vector_groups(df.limit(0)).count() == 0


def test_vectors_that_repeat_an_id(spark):
    """Each row is a vector of its own: alike under one id, unlike under one id, and copies."""
    a, alike, c = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 0.0, 1.0]

    def got(rows):
        return sorted(tuple(r) for r in vectors_dedup.vector_groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())

    assert got([(1, a), (1, alike), (2, c)]) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]
    assert got([(1, a), (1, c), (3, alike)]) == [(1, 0, 1, True), (1, 1, 1, True), (3, 1, 1, False)]
    assert got([(5, a), (4, a), (4, a), (7, alike)]) == [(4, 3, 4, True), (4, 3, 4, True), (5, 3, 4, False), (7, 3, 4, False)]


def test_full_buckets_are_compared_in_tiles(vectors, monkeypatch):
    v, df = vectors
    before = {r["vec_id"]: tuple(r) for r in vectors_dedup.vector_groups(df).collect()}
    monkeypatch.setattr(vectors_dedup, "TILE", 3)
    assert {r["vec_id"]: tuple(r) for r in vectors_dedup.vector_groups(df).collect()} == before


def test_neighbours(vectors):
    v, df = vectors
    rows = neighbours.valid_vectors(df.where("vec_id < 900"), "vec_id", "embedding")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(rows, F.col("id") % 100 == 0, lists=8).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 900, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        order = np.lexsort((np.arange(900), d))[:10]
        found = sorted(found)
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(abs(s - d[i]) < 1e-12 for _, i, s in found) and [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hit += len({f[1] for f in found} & set(order.tolist()))
    assert hit >= 0.9 * 90


def test_probes_are_not_fitted_on_the_copies_of_the_lowest_ids():
    r = np.random.default_rng(7)
    v = r.normal(size=(3000, 32))
    v[:1000] = v[0]
    c = neighbours.centres(v, 16)
    assert neighbours.probes(v, c, 10, 0.97) == neighbours.probes(v[r.permutation(3000)], c, 10, 0.97) > 4


def test_neighbours_probe_on_until_there_are_k(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "probes", lambda *_: 1)
    v = np.random.default_rng(8).normal(size=(120, 8))
    rows = spark.createDataFrame([(k, [float(x) for x in u]) for k, u in enumerate(v)], "id bigint, v array<double>")
    got = collections.Counter(r["query_id"] for r in neighbours.nearest(rows, F.lit(True), lists=40).collect())
    assert got == {k: 10 for k in range(120)}


def test_neighbours_of_few(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "id bigint, v array<double>")
    got = sorted(map(tuple, neighbours.nearest(rows, F.col("id") == 0).collect()))
    assert [g[:3] for g in got] == [(0, 1, 2), (0, 2, 1)] and got[0][3] == 0
    assert neighbours.nearest(rows.limit(0), F.lit(True)).count() == 0 and neighbours.nearest(rows, F.lit(False)).count() == 0


def test_neighbours_of_lengths_and_repeated_ids(spark):
    """Vectors meet those of their length; each row that repeats an id asks for itself and is found by the others."""
    rows = spark.createDataFrame([(100, [0.0, 0.0, 1.0]), (100, [0.0, 1.0, 0.0]), (3, [0.0, 0.5, 0.0]), (100, [1.0, 1.0]), (5, [4.0, 5.0]), (200, [7.0])], "id bigint, v array<double>")
    got = sorted(map(tuple, neighbours.nearest(rows, F.col("id") % 100 == 0).collect()))
    assert got == sorted([(100, 1, 3, 0.5), (100, 2, 100, 2**0.5), (100, 1, 3, 1.25**0.5), (100, 2, 100, 2**0.5), (100, 1, 5, 5.0)])


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_neighbour_recall_on_table(spark, scale):
    folder = FOLDER.replace("0.01", scale)
    out = neighbours.op6_neighbours(spark, folder).collect()
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    want = set()
    for q in np.flatnonzero(ids % 100 == 0):
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        want |= {(int(ids[q]), int(i)) for i in ids[np.lexsort((ids, d))[:10]]}
    assert len(want & {(r["query_id"], r["vec_id"]) for r in out}) >= 0.9 * len(want)


# ---- packing -------------------------------------------------------------------------------------------------------


def check_pieces(pieces, ids):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for d, start, length, seq, offset in pieces:
        assert length > 0
        by_doc[d].append((start, length))
        by_seq[seq].append((offset, length))
    assert sorted(by_doc) == list(range(len(ids)))
    for d, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[d])
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return [sum(n for _, n in by_seq[s]) for s in sorted(by_seq)]


def test_pack_places_every_id_once():
    r = np.random.default_rng(2)
    docs = [np.append(r.integers(3, 900, int(n)), packing.END_ID).astype(np.uint16) for n in [*r.integers(0, 3000, 300), 50_000, 0, 0, 4095, 4096]]
    sizes = check_pieces(packing.pack(docs), docs)
    assert all(s == 4096 for s in sizes[:-1])
    assert check_pieces(packing.pack([np.array([2], np.uint16)]), [[2]]) == [1]


def test_pack_prefers_lexical_neighbours():
    r = np.random.default_rng(3)
    topic = [np.append(r.integers(1000 * t, 1000 * t + 60, 1000), packing.END_ID).astype(np.uint16) for t in range(1, 9) for _ in range(8)]
    shared, total = 0, 0
    by_seq = collections.defaultdict(set)
    for d, _, _, seq, _ in packing.pack(topic):
        by_seq[seq].add(d // 8)
    for topics in by_seq.values():
        total += 1
        shared += len(topics) <= 2
    assert shared / total > 0.9


def test_op7_contract(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    hard = [(1, "Ünï café ΣΑΣ x y 日本"), (1, "Ünï"), (2, None), (None, ""), (3, "a\x1cb c\x85d"), (4, "q" * 9000), (5, "<|endoftext|> x")]
    df = spark.createDataFrame(hard, "doc_id bigint, text string").withColumn("offset", F.lit("z")).union(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", F.lit("")).where("doc_id > 100"))
    out = packing.packed(df, tokenizers.path("word_bpe_49k.json")).collect()
    want = collections.Counter()
    for r in df.collect():
        want[(r["doc_id"], len(ids := [*tk.encode(r["text"] or "", add_special_tokens=False).ids, 2]), zlib.crc32(np.array(ids, "<u4").tobytes()) if len(ids) <= 1 else 0)] += 1
    whole = collections.Counter()
    for r in out:
        if r["start"] == 0:
            whole[(r["doc_id"], r["doc_tokens"], r["ids_crc32"] if r["doc_tokens"] == 1 else 0)] += 1
    assert whole == want
    ids_of = {r["doc_id"]: [*tk.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in df.collect() if r["doc_id"] not in (1, None)}
    for r in out:
        if r["doc_id"] in ids_of:
            assert zlib.crc32(np.array(ids_of[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
    assert packing.packed(df.limit(0), tokenizers.path("word_bpe_49k.json")).count() == 0


# ---- lines ---------------------------------------------------------------------------------------------------------


def plain_shingles(line):
    return {line[k : k + 5] for k in range(max(1, len(line) - 4))}


def plain_dedup(rows):
    """By comparing all pairs of different lines."""
    spots = [(d, p, s.strip(" ")) for d, t in rows for p, s in enumerate((t or "").split("\n")) if t is not None and s.strip(" ")]
    kinds = sorted({s for _, _, s in spots})
    sets = [plain_shingles(s) for s in kinds]
    alike = [(i, j) for i in range(len(kinds)) for j in range(i + 1, len(kinds)) if sets[i] | sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = dict(zip(kinds, united(len(kinds), alike), strict=True))
    first = {}
    for d, p, s in sorted(spots, key=lambda x: x[:2]):
        first.setdefault(group[s], (d, p))
    return {(d, p) for d, p, s in spots if first[group[s]] != (d, p)}


def test_lines_equal_brute_force(spark):
    r = np.random.default_rng(8)
    vocabulary = ["".join(r.choice(list("abcdefghijklmnop"), 5)) for _ in range(400)]
    base = [" ".join(r.choice(vocabulary, r.integers(1, 60))) for _ in range(150)]
    rows = []
    for d in range(120):
        own = []
        for _ in range(r.integers(0, 6)):
            words = base[r.integers(0, 150)].split()
            if r.random() < 0.5:
                words[r.integers(0, len(words))] = vocabulary[r.integers(0, 400)]
            own.append(" ".join(words) + " " * int(r.integers(0, 2)))
        rows.append((d, "\n".join([*own, ""])))
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = plain_dedup(rows)
    missed = 0
    for x in got:
        t = dict(rows)[x["doc_id"]].split("\n")
        expected = "\n".join(s for p, s in enumerate(t) if (x["doc_id"], p) not in want)
        missed += x["text"] != expected
    assert missed <= 2  # banding misses few of the pairs that are just alike


def test_lines_of_large_groups(spark):
    """Many lines that are all alike are one group, without comparing all pairs."""
    r = np.random.default_rng(9)
    words = [f"word{k}" for k in range(60)]
    rows = []
    for d in range(300):
        own = list(words)
        own[int(r.integers(0, 60))] = f"other{d}"
        rows.append((d, " ".join(own)))
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got.agg(F.sum("n_dropped")).first()[0] == 299


@pytest.mark.parametrize("tile", [1024, 100])
def test_lines_of_a_template(spark, monkeypatch, tile):
    """Records of one template share full buckets and aren't alike; each one's near copy is found among them."""
    monkeypatch.setattr(lines, "TILE", tile, raising=False)
    r = np.random.default_rng(12)
    word = lambda: "".join(r.choice(list("abcdefghijklmnop"), 5))
    template, rows = [word() for _ in range(60)], []
    for _ in range(400):
        own = list(template)
        for k in range(0, 60, 6):
            own[k] = word()
        rows.append(" ".join(own))
        own[int(r.integers(0, 60))] = word()
        rows.append(" ".join(own))
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"))
    dropped = {x["doc_id"] for x in got.where("n_dropped > 0").collect()}
    assert dropped <= set(range(1, 800, 2)) and len(dropped) >= 392  # bands miss few


def test_lines_of_one_template_are_one_component(spark):
    """Lines of 24 words, four of which vary: a chain of alike pairs joins them all, though few pairs are alike."""
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("abcdefghijklmnop"), 6)) for _ in range(24)]
    rows = set()
    for _ in range(900):
        own = list(words)
        for k in (3, 9, 15, 21):
            own[k] = "".join(r.choice(list("abcdefgh"), 1)) * 6
        rows.add(" ".join(own))
    rows = sorted(rows)
    sets = [plain_shingles(t) for t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = len(set(united(len(rows), near)))
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).where("n_dropped = 0").count()
    assert want <= got <= want + 2


def test_lines_of_a_bucket_below_the_similarity(spark, monkeypatch):
    """Long lines of one family, nearly all pairs of which lie below the similarity: few pairs are counted whole, and no copy is missed."""
    r = np.random.default_rng(14)
    word = lambda: "".join(r.choice(list("abcdefghijklmnop"), 6))
    base, rows = [word() for _ in range(150)], []
    for k in range(140):
        own = list(base)
        for p in r.choice(150, 8, replace=False):
            own[p] = word()
        rows.append(" ".join(own))
        if k < 20:
            own[int(r.integers(0, 150))] = word()
            rows.append(" ".join(own))
    sets = [plain_shingles(t) for t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    tiles, tried = lines.tile_pairs, []

    def counted(*args):
        tried.append(lines.written(tiles(*args)))
        return tried[-1]

    monkeypatch.setattr(lines, "tile_pairs", counted)
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).where("n_dropped = 0").count()
    want = len(set(united(len(rows), near)))
    assert 100 < want <= got <= want + 2
    assert len(near) < 50 and sum(x.count() for x in tried) < 1000  # 6,189 by maps of MAP words alone


def test_line_wide_maps(spark):
    """They hold a bit for every shingle and count each once; what they rule out is below the similarity."""
    r = np.random.default_rng(15)
    texts = ["".join(r.choice(list("abcdé😀 "), n)) for n in (1, 4, 5, 6, 40, 700)] + ["ab" * 300, "x" * 20_050]
    got = {x["h"]: x for x in lines.wide_maps(spark.createDataFrame(list(enumerate(texts)), "h bigint, line string")).collect()}
    for k, t in enumerate(texts):
        n, set_bits = len(plain_shingles(t)), sum((w & (2**64 - 1)).bit_count() for w in got[k]["wide"])
        assert got[k]["n"] == n and len(got[k]["wide"]) == lines.WIDE and 0.9 * n <= set_bits <= n
    pairs = [(t, t[: len(t) - n] + "".join(r.choice(list("ABCDEF"), n))) for n in range(0, 160, 4) for t in [texts[5]]]
    rows = lines.wide_maps(spark.createDataFrame(list(enumerate(t for p in pairs for t in p)), "h bigint, line string"))
    x = rows.where("h % 2 = 0").select(F.shiftright("h", 1).alias("k"), F.col("n").alias("n_a"), F.col("wide").alias("wide_a"))
    both = x.join(rows.where("h % 2 = 1").select(F.shiftright("h", 1).alias("k"), F.col("n").alias("n_b"), F.col("wide").alias("wide_b")), "k")
    kept = {y["k"] for y in both.where(lines.within_wide("_a", "_b", 0.8)).collect()}
    similar = [len(plain_shingles(a) & plain_shingles(b)) / len(plain_shingles(a) | plain_shingles(b)) for a, b in pairs]
    assert {k for k, s in enumerate(similar) if s >= 0.8} <= kept <= {k for k, s in enumerate(similar) if s >= 0.75}


def test_lines_white_space(spark):
    """White space of any kind at the ends doesn't count, and lines of white space alone stay."""
    rows = [(1, "now\t\r\n\r\n \t\nlater on\r"), (2, "\u00a0now\nother words\n\r")]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("other words\n\r", 1)}


#: A line of a script without spaces, of 80 different characters.
WIDE = "".join(chr(0x4E00 + 37 * k) for k in range(80))


def test_lines_hard_rows(spark):
    rows = [(2, "same line here\n\n  same line here  \nx"), (1, "same line here"), (1, "same line here"), (None, "y"), (3, None), (4, ""), (5, WIDE), (6, WIDE + "！"), (7, "w" * 100_000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, h string").withColumn("n_lines", F.lit("z"))
    got = collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in lines.dedup_lines(df).collect())
    assert got == {(2, "\nx", 4, 2): 1, (1, "same line here", 1, 0): 2, (None, "y", 1, 0): 1, (3, None, 0, 0): 1, (4, "", 1, 0): 1, (5, rows[6][1], 1, 0): 1, (6, "", 1, 1): 1, (7, "w" * 100_000, 1, 0): 1}
    assert lines.dedup_lines(df.limit(0)).count() == 0
    assert set(lines.dedup_lines(df).columns) == {"doc_id", "text", "h", "n_lines", "n_dropped"}


def test_lines_read_every_character(spark):
    """As brute force over plain shingles of five characters finds them: what lies inside long words counts too."""
    r = np.random.default_rng(11)
    spelled = lambda n: "".join(r.choice(list("0123456789abcdef"), n))
    texts = [f"See https://example.com/{spelled(60)}" for _ in range(20)] + [f"/usr/share/lib/{spelled(50)}.so" for _ in range(20)]
    texts += ["漢字" * 3 + "".join(chr(0x4E00 + int(c)) for c in r.integers(0, 900, 20)) + spelled(30) for _ in range(20)]
    texts += ["😀" + "".join(chr(0x1F600 + int(c)) for c in r.integers(0, 60, 30)) for _ in range(10)] + ["ab", "abc", "abcd", "ab d"]
    texts += [t[:-1] + "z" for t in texts[:70:2]]
    sets = [{t[k : k + 5] for k in range(max(1, len(t) - 4))} for t in texts]
    assert sets == [plain_shingles(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = {k for k, top in enumerate(united(len(texts), near)) if top != k}
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).where("n_dropped > 0").collect()
    assert len(want) == 35 and {x["doc_id"] for x in got} == want


def test_line_bands_recall():
    """Lines just at the similarity share a band as often as is stated, one shingle or very many of them; long lines are read in parts."""
    r = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    near = [("".join(r.choice(letters, 90)), "".join(r.choice(letters, 10)), "".join(r.choice(letters, 10))) for _ in range(1500)]
    pairs = [(a + x, a + y) for a, x, y in near]
    sets = [[plain_shingles(t) for t in p] for p in pairs]
    expected = np.mean([1 - (1 - (len(a & b) / len(a | b)) ** lines.ROWS) ** lines.BANDS for a, b in sets])
    keys = np.array(lines.band_keys([t for p in pairs for t in p]))
    met = (keys[:, ::2] == keys[:, 1::2]).any(0)
    assert abs(met.mean() - expected) < 0.02 and expected > 0.97
    assert not any(set(k[::2]) & set(np.roll(k[1::2], 1)[met]) - set(k[1::2][met]) for k in keys)
    long = ["".join(r.choice(letters, n)) for n in (3 * lines.PART, 3, 7 * lines.PART + 11)]
    together, whole = lines.minima(long), []
    for t in long:
        h, _ = lines.shingles([t])
        whole.append([int(((h >> np.uint64(32)).astype(np.uint32) * m).min()) for m in lines.MULTIPLIERS])
    assert together.T.tolist() == whole
    assert lines.reach([p[0] for p in pairs], [p[1] for p in pairs], 0.8).tolist() == [len(a & b) >= 0.8 * len(a | b) for a, b in sets]
    size, bits = lines.size_and_map([t for p in pairs for t in p])
    assert size.tolist() == [len(s) for p in sets for s in p] and bits.shape == (3000, lines.MAP)


def test_lines_run_without_python(spark, monkeypatch):
    """Shingles, signatures and similarities are DataFrame operations: no function of Python is sent to the executors."""
    def refused(*_):
        raise AssertionError("Python on the executors")

    monkeypatch.setattr(DataFrame, "mapInArrow", refused)
    monkeypatch.setattr(DataFrame, "mapInPandas", refused)
    text = "a line of some length, long enough for many shingles, that comes twice"
    df = spark.createDataFrame([(1, text), (2, text + "."), (3, "another line altogether")], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["n_dropped"]) for r in lines.dedup_lines(df).collect()) == [(1, 0), (2, 1), (3, 0)]


def test_line_signatures_recall(spark):
    """As test_line_bands_recall, of the signatures that queries make; their bits rule out no pair, and similarities are exact."""
    r = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyzé😀 ")
    parts = [["".join(r.choice(letters, n)) for n in (90, 10, 10)] for _ in range(1500)]
    pairs = [(a + x, a + y) for a, x, y in parts]
    sets = [[plain_shingles(t) for t in p] for p in pairs]
    expected = np.mean([1 - (1 - (len(a & b) / len(a | b)) ** lines.ROWS) ** lines.BANDS for a, b in sets])
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(t for p in pairs for t in p)], "h bigint, line string")
    got = {x["h"]: x for x in lines.signatures(rows).collect()}
    both = [(got[2 * k], got[2 * k + 1]) for k in range(1500)]
    assert abs(np.mean([any(x[f"k{b}"] == y[f"k{b}"] for b in range(lines.BANDS)) for x, y in both]) - expected) < 0.02
    assert all((x["bits"] ^ y["bits"]).bit_count() <= lines.UNLIKE for x, y in both)
    ids = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(1500)], "a bigint, b bigint")
    want = {2 * k for k, (a, b) in enumerate(sets) if len(a & b) >= 0.82 * len(a | b)}
    assert 0 < len(want) < 1500 and {x["a"] for x in lines.alike(ids, rows, 0.82).collect()} == want
    assert {x["a"] for x in lines.near(ids, lines.maps(rows), 0.82).collect()} >= want


def test_lines_of_settled_buckets_have_no_maps(spark, monkeypatch):
    """Maps are made, and lines read again, only for buckets that hold several components after each line met its bucket's first."""
    r = np.random.default_rng(16)
    word = lambda: "".join(r.choice(list("abcdefghijklmnop"), 6))
    base, mapped = [[word() for _ in range(40)] for _ in range(30)], []
    rows = [" ".join([*own[:k], word(), *own[k + 1 :]]) for own in base for k in (3, 20, 37)] + ["alone " + word()]
    made = lines.maps
    monkeypatch.setattr(lines, "maps", lambda of: mapped.append(of.count()) or made(of))
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"))
    assert got.agg(F.sum("n_dropped")).first()[0] == 60
    assert sum(mapped) == 0


@pytest.mark.parametrize("most", [0, 100, 200_000])
def test_lines_alike_of_any_length(spark, monkeypatch, most):
    """Lines beyond LONG are compared shingle by shingle, others as arrays: both count different shingles, as brute force does."""
    monkeypatch.setattr(lines, "LONG", most)
    r = np.random.default_rng(17)
    text = lambda n: "".join(r.choice(list("abcdé😀 "), n))
    pairs = [("ab", "ab"), ("ab", "abc"), ("ab" * 20, "ab" * 100), ("abcde", "abcdef")]
    for n in (10, 60, 95, 120, 300):
        for changed in range(1, n // 4, max(1, n // 40)):
            t = text(n)
            pairs.append((t, text(changed) + t[changed:]))
    sets = [(plain_shingles(a), plain_shingles(b)) for a, b in pairs]
    rows = spark.createDataFrame(list(enumerate(t for p in pairs for t in p)), "h bigint, line string")
    ids = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(len(pairs))], "a bigint, b bigint")
    want = {2 * k for k, (a, b) in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)}
    assert 10 < len(want) < len(pairs) and {x["a"] for x in lines.alike(ids, rows, 0.8).collect()} == want


# ---- pages ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a\n  b<br>c</p><p>d", "a b c\n\nd"),
        ("<nav>x</nav><article><h1>T&eacute;</h1><p><b>bold<br><p>next</article><footer>f</footer>", "Té\n\nbold\n\nnext"),
        ("<div class='ad'>buy</div><p>text</p><aside>s</aside><form>f</form>", "text"),
        ("<script>var t='</p>'; if (a<b) x();</script><style>p{}</style><p>a<!-- <p>no</p> -->b</p>", "ab"),
        ("<article><p>main</p><div id='comments'><p>reader</p></div></article>", "main"),
        ("<ul><li>one<li>two</ul><table><tr><td>1<td>2</table>", "one\n\ntwo\n\n1\n\n2"),
        ("<p>1 &lt; 2 &#65;&#x42; &nosuch; 3 < 4</p>", "1 < 2 AB &nosuch; 3 < 4"),
        ("<article>unclosed <i>end", "unclosed end"),
        ("<div class='page has-sidebar'><p>a</p></div>", "a"),
        ("<div class='banner wrap'><article><div class='entry-header'><h1>T</h1></div>x</article>y</div>", "T\n\nx"),
        ("<main><p>x</p><article class='comment'>r</article></main>", "x"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page, set()) == text


def test_style_tree_removes_what_a_host_repeats(spark):
    page = lambda k: f"<html><body><div class='top'><p>Welcome to the site</p></div><div class='story'><p>Text {k} of its own {k * 7}</p></div><div class='end'><p>Call us</p></div></body></html>"
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(12)] + [(50, "http://other.example/", page(3)), (51, None, None), (52, "x", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert all(got[k] == f"Text {k} of its own {k * 7}" for k in range(12))
    assert got[50].startswith("Welcome") and got[51] == got[52] == ""
    html_few, html_text.FEW = html_text.FEW, 0
    try:
        assert {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()} == got
    finally:
        html_text.FEW = html_few
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_tree_decides_in_articles_and_without(spark):
    """Branches that a host repeats go by their importance alone, be they in an article or not; their names mean nothing here.
    The importance is recomputed by hand."""
    import math

    def page(k, inside):
        own = f"<div class='alpha'><p>Same greeting</p></div><div class='beta'><p>Words {k} and {k * 13}</p><p>More {k * 7}</p></div><div class='gamma'><b>{'Same end' if k % 4 else 'Other end'}</b></div>"
        return f"<html><body><{inside}>{own}</{inside}></body></html>"

    for inside in ("article", "section"):
        rows = [(k, f"https://{inside}.example/{k}", page(k, inside)) for k in range(16)]
        df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
        got = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
        # z1: one text on 16 pages; z3: one on 12 and one on 4, both of one presentation
        said = {"z1": 1 - math.log(16) / math.log(16), "z2": 1, "z3": 1 - (math.log(12) + math.log(4)) / 2 / math.log(16)}
        low = {k for k, v in said.items() if html_text.CONTENT * v < html_text.LOW}
        assert low == {"z1"}
        assert got == {k: f"Words {k} and {k * 13}\n\nMore {k * 7}\n\n" + ("Same end" if k % 4 else "Other end") for k in range(16)}


@pytest.mark.parametrize("page", ["<a " * 300_000, "<div>x" * 100_000, "<div>" * 100_000 + "</span>" * 100_000, '<a ">"' * 150_000 + "'", "</script " * 100_000, "<script></script " * 50_000, "<b>" * 50_000 + "<tr>" * 50_000, "<!-- " * 200_000, "<li><i>" * 50_000 + "x"])
def test_hostile_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_text.tree_rows(page)
    html_text.main_text(page, {1})
    assert time.process_time() - began < 20


def test_articles_of_table(spark):
    """The table's pages hold one article each; a plain reading of it is the main text."""
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in html_text.op10_html(spark, FOLDER).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


# ---- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, before = docs.columns, docs.count()
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).toPandas(), stage(spark, docs, FOLDER).schema)
        at[name] = docs
        if name != "packing":
            assert docs.columns == names
    assert before > at["quality"].count() == at["line_dedup"].count() > at["simhash"].count() == at["pii"].count()
    assert not at["pii"].where(F.col("text").rlike(r"[a-z0-9.]+@mail[0-9]\.example\.com")).count()
    assert at["pii"].where("n_chars <> length(text)").count() == 0
    assert at["packing"].select("doc_id").distinct().count() == at["pii"].count()
