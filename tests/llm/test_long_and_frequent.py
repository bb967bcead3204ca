"""Texts beyond a chunk and tokens beyond the frequent limit, as the workers really meet them."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbloom.llm import _arrow, _repeats, jaccard_join, permutation_index, preferences, substring_dedup, suffix_array_dedup
from orbloom.llm import language_id, media


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def covered(sequences, length):
    """Which units lie in a window that starts twice, by hashes of whole windows."""
    where = {}
    for d, s in enumerate(sequences):
        for i in range(len(s) - length + 1):
            where.setdefault(hash(s[i : i + length]), []).append((d, i))
    cut = [np.zeros(len(s), bool) for s in sequences]
    for at in where.values():
        if len(at) > 1:
            for d, i in at:
                cut[d][i : i + length] = True
    return cut


def test_a_text_of_several_chunks_in_bytes(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh") for _ in range(900))
    filler = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    # Passages over the end of the first chunk, in the middle, at the end, and in another document.
    text = filler(_repeats.CHUNK - 450) + passage + filler(270_000) + passage[100:700] + filler(20_000) + passage
    other = filler(3000) + passage[300:600] + filler(3000)
    assert len(text) > 2 * _repeats.CHUNK
    texts = [text, other, "é" + passage[:250]]
    raw = [t.encode() for t in texts]
    cut = covered(raw, 200)
    got = {r.doc_id: r for r in suffix_array_dedup.dedup(docs(spark, texts)).collect()}
    for d, (b, c) in enumerate(zip(raw, cut)):
        kept = np.frombuffer(b, np.uint8)[~c].tobytes()
        assert (got[d].n_bytes, got[d].n_removed, got[d].kept_sha256) == (len(b), int(c.sum()), hashlib.sha256(kept).hexdigest())
        assert got[d].n_spans == int(np.count_nonzero(np.diff(np.concatenate([[0], c.astype(int)])) == 1))
    assert cut[0].sum() > 2000


def test_a_text_of_several_chunks_in_words(spark):
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(5000)]
    words = [rng.choice(vocab) for _ in range(2 * _repeats.CHUNK + 5000)]
    passage = [rng.choice(vocab) for _ in range(120)]
    for at in (1000, _repeats.CHUNK - 60, 2 * _repeats.CHUNK - 20):
        words[at : at + 120] = passage
    texts = [" ".join(words), " ".join(passage[10:60]), " ".join(passage[:34])]
    seqs = [tuple(t.split()) for t in texts]
    cut = covered(seqs, 35)
    got = {r.doc_id: r for r in substring_dedup.dedup(docs(spark, texts)).collect()}
    for d, (s, c) in enumerate(zip(seqs, cut)):
        kept = " ".join(w for w, x in zip(s, c.tolist()) if not x)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(s), int(c.sum()), hashlib.sha256(kept.encode()).hexdigest())
    assert cut[0].sum() >= 360 and cut[1].all() and not cut[2].any()


def near_texts(sizes, per, seed):
    """For each size, ``per`` texts that share most words: one in three is an edited copy of the one before."""
    rng = random.Random(seed)
    out = []
    for size in sizes:
        base = [f"s{size}x{k}" for k in range(size)]
        for k in range(per):
            w = list(base)
            for _ in range(size // 14 + 1):
                w[rng.randrange(size)] = f"u{size}y{k}z{rng.randrange(10**6)}"
            out.append(w)
            if k % 3 == 0:
                v = list(w)
                v[rng.randrange(size)] = f"t{size}y{k}"
                out.append(v)
    return [" ".join(w) for w in out]


def components(texts, n, percent):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)], links


@pytest.mark.parametrize("sizes, n, percent", [((50, 190, 210), 3, 90), ((2000,), 3, 90), ((60, 200), 5, 80)])
def test_frequent_tokens_of_all_set_sizes(spark, sizes, n, percent):
    per = 75 if max(sizes) < 1000 else 66
    texts = near_texts(sizes, per, 9)
    want, links = components(texts, n, percent)
    df = docs(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df, n, percent).collect()}
    assert got == dict(enumerate(want)) and links > 20
    # The index really holds combinations: keys that are no token of any node, made from tokens of over FREQUENT nodes.
    nodes = _arrow.saved(jaccard_join._nodes(df, n, percent), "nodes")
    tokens = nodes.select(F.explode("keys").alias("key")).groupBy("key").count()
    assert tokens.where(F.col("count") > jaccard_join.FREQUENT).count() > 0
    combined = jaccard_join._postings(nodes, percent).join(tokens, "key", "left_anti").count()
    assert (combined > 0) == (min(sizes) * percent <= 100 * jaccard_join.COMBINED)


def test_near_copies_meet_their_centre_and_not_each_other(spark, monkeypatch):
    """Copies with a word changed link in all pairs; shorter texts of the family, which link with none, must not be the hubs."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base)]
    for k in range(150):
        w = list(base)
        w[rng.randrange(150)] = f"x{k}"
        texts.append(" ".join(w))
    for _ in range(150):
        gone = set(rng.sample(range(150), 4))
        texts.append(" ".join(v for i, v in enumerate(base) if i not in gone))
    rng.shuffle(texts)
    want, links = components(texts, 3, 90)
    made = {}

    def saved(df, name):
        table = _arrow.saved(df, name)
        made[name] = made.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(jaccard_join, "saved", saved)
    monkeypatch.setattr(jaccard_join, "PART", 40)  # votes of several parts
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs(spark, texts)).collect()}
    assert got == dict(enumerate(want)) and links > 10_000
    assert made["majorities"] > 0 and made["cross-pairs"] <= 2 * len(texts)


def test_bitmaps_travel_once_for_each_node(spark, monkeypatch):
    """Near copies are together in hundreds of lists; a line that other texts have too does not draw their votes."""
    rng = random.Random(8)
    line = [f"c{k}" for k in range(12)]
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(line + base)]
    for k in range(140):
        w = list(base)
        w[rng.randrange(120)] = f"x{k}"
        texts.append(" ".join(line + w))
    texts += [" ".join(line + [f"y{k}-{i}" for i in range(40)]) for k in range(160)]
    rng.shuffle(texts)
    want, links = components(texts, 5, 80)
    sent, made = [], {}

    def saved(df, name):
        table = _arrow.saved(df, name)
        made[name] = made.get(name, 0) + table.count()
        if "s0" in table.columns and name != "nodes":
            sent.append(table.count())
        return table

    monkeypatch.setattr(jaccard_join, "saved", saved)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs(spark, texts), 5, 80).collect()}
    assert got == dict(enumerate(want)) and links > 5_000
    assert made["postings"] > 20 * len(texts)
    assert 0 < max(sent) <= made["nodes"] == len(texts)
    assert made["cross-pairs"] <= 2 * len(texts)


def test_majority_of_bitmaps():
    rng = np.random.default_rng(6)
    sigs = [jaccard_join.signature(jaccard_join.bitmap(np.unique(rng.integers(0, 2**63, 700).astype(np.uint64)))) for _ in range(7)]
    bits = np.unpackbits(np.array(sigs, np.int64).view(np.uint8), axis=1)
    want = [sum(((v >> b) & 1) > 0 for v in column) > 3 for column in zip(*sigs) for b in range(64)]
    got = [(v >> b) & 1 > 0 for v in jaccard_join.majority(bits.sum(axis=0), len(sigs)) for b in range(64)]
    assert got == want


def test_null_and_repeated_ids_in_the_join(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text), (4, text), (4, text + " z"), (4, "other words here now"), (9, text), (None, None), (2, "")]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == sorted([(True, 0, 38, 4), (False, 4, 38, 4), (False, 4, 39, 4), (False, 4, 2, 4), (False, 9, 38, 4), (True, 0, 0, None), (False, 2, 0, 2)])


def test_neighbours_over_several_shards(spark):
    """More vectors than a shard holds, with ties between shards."""
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(2 * permutation_index.SHARD + 500, 6)), 1)
    rows = [(k, [float(v) for v in r], k % 3) for k, r in enumerate(x)]
    v = permutation_index.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = permutation_index.nearest(v, v.where("vec_id % 500 = 0"), 20).toPandas()
    x = np.float32(x).astype(float)
    hits = total = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g.score, s[g.vec_id], rtol=1e-12)
        assert g.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id.tolist() == g.vec_id.tolist()
        hits, total = hits + len(set(best.tolist()) & set(g.vec_id)), total + 20
    assert len(got.query_id.unique()) == -(-len(x) // 500) and hits / total >= 0.9


def test_awkward_rows_of_other_operators(spark):
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string, pair_id long")
    assert preferences.format_pairs(preferences.neighbour_pairs(empty)).count() == 0
    turns = [(0, 0, "user", "x" * 200_000, 7), (1, 0, "user", "x" * 200_000, 7), (1, 1, "assistant", "y", 7), (1, 1, "assistant", "y", 7)]
    r = preferences.format_pairs(preferences.neighbour_pairs(spark.createDataFrame(turns, empty.schema))).first()
    assert r.pair_id == 0 and r.prompt_turns == 1 and r.rejected.count("y") == 2
    texts = ["wort " * 40_000, "wort " * 40_000, None, "\U0001f600" * 50]
    got = media.store(spark.createDataFrame([(k // 2, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, payload string")).collect()
    assert len(got) == 4 and len({r.media_sha256 for r in got if r.n_bytes == 200_000}) == 1
    labelled = [(k, f"{w} " * 30, w[:2], "s") for k, w in enumerate(["das ist ein haus", "this is a house", "ceci est une maison"] * 20)]
    d = spark.createDataFrame([*labelled, (900, "das ist ein haus " * 60_000, None, "s")], "doc_id long, text string, lang string, score string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(d).collect()}[900] == "da"


def test_components_and_later_links(spark):
    rng = random.Random(2)
    first = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + k, 101 + k) for k in range(40)] + [(7, 7)]
    later = [(3, 110), (59, 200), (200, 201), (300, 301)]

    def want(edges):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            if a != b:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        return {x: find(x) for x in root}

    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    comp = jaccard_join.components(frame(first))
    assert {r.node: r.root for r in comp.collect()} == want(first)
    assert {r.node: r.root for r in jaccard_join.merged(comp, frame(later)).collect()} == want(first + later)
    assert jaccard_join.components(frame(first).where("false")).count() == 0
