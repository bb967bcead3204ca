"""Training-data operators against brute force, round trips and held-out accuracy, with awkward inputs."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbloom.llm import _repeats, jaccard_join, language_id, media, packing, permutation_index, preferences, sentencepiece_codec, substring_dedup, suffix_array_dedup
from orbloom.llm import html_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node string, hub int"


def tokenizers_path(name):
    return pytest.importorskip("public_tokenizers").path(name)


def docs(spark, texts):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), "x", "y", 1) for k, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    random.seed(1)
    vocab = ["".join(random.choice("abcdefgé") for _ in range(random.randint(1, 6))) for _ in range(300)]

    def prose(n):
        return " ".join(random.choice(vocab) for _ in range(n))

    passage = prose(60)
    base = prose(250)
    texts = [None, "", "   ", "one", "two words", base, base, prose(400), prose(2000)]
    for _ in range(8):
        w = base.split()
        for _ in range(random.randint(1, 4)):
            w[random.randrange(len(w))] = random.choice(vocab)
        texts.append(" ".join(w))
    texts += [f"{prose(30)} {passage}\n{prose(40)}" for _ in range(6)]
    texts += ["lo " * 300, "ab" * 400, base.upper(), "the end " * 50 + prose(10)]
    return texts


def removed_words(texts, length):
    ws = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + length]) for w in ws for i in range(len(w) - length + 1))
    out = []
    for w in ws:
        cut = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                cut[i : i + length] = [True] * length
        out.append((len(w), sum(cut), hashlib.sha256(" ".join(x for x, c in zip(w, cut) if not c).encode()).hexdigest()))
    return out


def removed_bytes(texts, length):
    bs = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in bs for i in range(len(b) - length + 1))
    out = []
    for b in bs:
        cut = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cut[i : i + length] = [True] * length
        spans = sum(c and not (i and cut[i - 1]) for i, c in enumerate(cut))
        out.append((len(b), sum(cut), spans, hashlib.sha256(bytes(x for x, c in zip(b, cut) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("many", [_repeats.MANY_COVERS, 1])
def test_substring_dedup_is_exact(spark, corpus, many, monkeypatch):
    monkeypatch.setattr(_repeats, "MANY_COVERS", many)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(docs(spark, corpus)).collect()}
    assert got == dict(enumerate(removed_words(corpus, 35)))


@pytest.mark.parametrize("many", [_repeats.MANY_COVERS, 1])
def test_suffix_array_dedup_is_exact(spark, corpus, many, monkeypatch):
    monkeypatch.setattr(_repeats, "MANY_COVERS", many)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array_dedup.dedup(docs(spark, corpus)).collect()}
    assert got == dict(enumerate(removed_bytes(corpus, 200)))


def test_long_documents_in_parts_and_empty_tables(spark, corpus, monkeypatch):
    monkeypatch.setattr(_repeats, "CHUNK", 300)
    rows = [(0, corpus[8]), (1, corpus[8]), (None, "short"), (None, corpus[8]), (7, "ab " * 50)]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(1, 0), (50, 50), (2000, 2000), (2000, 2000), (2000, 2000)]
    empty = docs(spark, [])
    assert substring_dedup.dedup(empty).count() == 0 and suffix_array_dedup.dedup(empty).count() == 0 and jaccard_join.join(empty).count() == 0


def test_reference_removal_by_broadcast_automata(spark, corpus):
    ref = spark.createDataFrame([(" ".join(corpus[5].split()[50:120]),), (None,)], "text string")
    r = {x.doc_id: x.n_removed for x in substring_dedup.remove_reference(docs(spark, corpus), ref).collect()}
    assert r[5] == 70 and r[7] == 0 and r[0] == 0


def test_corpus_order_sorts_suffixes():
    random.seed(2)
    parts = [bytes(random.choice(b"ab") for _ in range(random.randint(5, 80))) for _ in range(10)]
    text, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    order, _ = suffix_array_dedup.corpus_order(text, ends)
    suffixes = [bytes(text[i : ends[np.searchsorted(ends, i, "right")]]) for i in order]
    assert suffixes == sorted(suffixes)


def components(texts, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c) and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(k)) for k, s in enumerate(sets)]


@pytest.mark.parametrize("n,percent,frequent", [(3, 90, 64), (3, 90, 0), (5, 80, 0), (2, 60, 0), (5, 80, 10**9)])
def test_jaccard_join_is_exact(spark, corpus, n, percent, frequent, monkeypatch):
    """With ``frequent`` 0 most shared tokens count as frequent, so two-token combinations carry the join."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    texts = [*corpus, "a b c", "A b C", "a b c d", "x", "X", "x"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs(spark, texts), n, percent).collect()}
    assert got == dict(enumerate(components(texts, n, percent)))


def test_index_finds_all_pairs_with_any_counts(monkeypatch):
    """Random sets and arbitrary counts: linked sets always share a key, with combinations and without."""
    rng = np.random.default_rng(3)
    linked = 0
    for percent, combined in [(p, c) for p in (60, 80, 90) for c in (1, 30, 200)]:
        monkeypatch.setattr(jaccard_join, "COMBINED", combined)
        for _ in range(150):
            size = int(rng.integers(1, 120))
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 2**63, int(rng.integers(0, 8))).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if not len(b) or 100 * common < percent * (len(a) + len(b) - common):
                continue
            linked += 1
            x, y = (jaccard_join.extended_prefix(t, percent) for t in (a, b))
            share = rng.random()
            count = {t: (2 if t in set(x.tolist()) & set(y.tolist()) else 1) + (int(rng.integers(0, 500)) if rng.random() < share else 0) for t in {*x.tolist(), *y.tolist()}}
            rows = [{r[0]: r[2:] for r in zip(*(c.tolist() for c in jaccard_join.index_keys(t, np.array([count[v] for v in t.tolist()]), n, percent)))} for t, n in ((x, len(a)), (y, len(b)))]
            both = rows[0].keys() & rows[1].keys()
            assert both and any(all(u != v or u == 0 for u, v in zip(rows[0][k], rows[1][k])) for k in both)
    assert linked > 300


def thue_morse(n, inverted=False):
    return "".join("ab"[(k.bit_count() + inverted) & 1] for k in range(n))


def test_thue_morse_words_differ(spark):
    """Words on which polynomial hashes modulo a power of two agree."""
    p, q = thue_morse(1024), thue_morse(1024, True)
    rest = " ".join(f"w{k}" for k in range(34))
    words = [f"{p} {rest}", f"{q} {rest}"]
    assert [r.n_removed for r in substring_dedup.dedup(docs(spark, words)).collect()] == [0, 0]
    assert {r.doc_id: r.component_id for r in jaccard_join.join(docs(spark, [p, q, p])).collect()} == {0: 0, 1: 1, 2: 0}
    texts = [p, q, p[:300] + "x" + q[:300], " ".join(thue_morse(512).replace("a", "no ").replace("b", "yes ") for _ in range(2))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array_dedup.dedup(docs(spark, texts)).collect()}
    assert got == dict(enumerate(removed_bytes(texts, 200)))


def test_bitmaps_never_overstate():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 4000))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.5], rng.integers(0, 2**63, 50).astype(np.uint64)]))
        apart = len(np.setxor1d(a, b))
        x, y = (np.frombuffer(jaccard_join.bitmap(t), np.uint8) for t in (a, b))
        assert jaccard_join.bits_apart(x, y) <= apart
        folds = zip(jaccard_join.signature(x.tobytes()), jaccard_join.signature(y.tobytes()))
        assert sum(((u ^ v) & (2**64 - 1)).bit_count() for u, v in folds) <= apart


def test_packing_is_a_partition_into_full_sequences(spark, corpus):
    path = tokenizers_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    p = packing.pack(docs(spark, corpus), path, 256).toPandas()
    for k, t in enumerate(corpus):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        own = p[p.doc_id == k].sort_values("piece")
        assert own["start"].tolist() == list(range(0, len(ids), 256)) and own["length"].sum() == len(ids)
        assert own["ids_crc32"].tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own["start"], own["length"])]
    for _, s in p.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 256
    assert p["sequence_id"].nunique() <= -(-p["length"].sum() // 256) + 1
    assert packing.pack(docs(spark, []), path, 256).count() == 0


def test_word_tokenizer_equals_the_library():
    path = tokenizers_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    mine, lib = packing.WordTokenizer(path), Tokenizer.from_file(path)
    for t in ("It's ÉTÉ, don't!", "İstanbul ΟΔΟΣ ǅ ﬁ", "a b c ​ x\x1cy", "<|endoftext|> x<|startoftext|>", "日本語 😀👍 ñandú é", "123 4.5e6 __init__", "", " \n\t"):
        assert mine.encode(t.encode()).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_crossover_keeps_all_pieces():
    rng = np.random.default_rng(5)
    counts = np.zeros(101, np.int64)
    counts[rng.integers(1, 101, 400)] += rng.integers(1, 9, 400)
    a, b = packing.best_fit(counts, 100), packing.random_fit(counts, 100, rng)
    crossed, injected = packing.crossover(a, b, 100, rng)
    population, did = packing.evolve(counts, 100, 1, [b], [], 4, 6)
    assert injected > 0 and did.crossovers == 4 * 3 and did.injected > 0 and did.migrants == 1
    for child in (crossed, packing.mutate(a, 100, rng), *population):
        assert (packing.content_counts(child, 100) == counts).all() and all(sum(c) <= 100 for c in child)


def test_islands_evolve_and_exchange_elites(spark):
    """The result comes from crossover: no island starts from the greedy packing, and all generations run."""
    rng = np.random.default_rng(8)
    counts = np.bincount(np.clip(rng.lognormal(6, 0.9, 3000).astype(int), 1, 2047), minlength=2049)
    best, progress = packing.islands(spark, counts)
    assert (packing.content_counts(best, 2048) == counts).all()
    assert len(progress) == packing.ISLANDS * packing.EPOCHS
    assert all(p.crossovers == packing.GENERATIONS * (packing.POPULATION - packing.POPULATION // 2) and p.injected > 100 for p in progress)
    assert sum(p.migrants for p in progress) == packing.ISLANDS * (packing.EPOCHS - 1)
    first = min(sum(packing.random_fit(counts, 2048, np.random.default_rng(k)).values()) for k in range(6))
    assert sum(best.values()) < first and sum(best.values()) <= sum(packing.best_fit(counts, 2048).values())


def test_language_sample_has_all_languages(spark):
    """Rare languages are learned, repeated rows count once, and what is no learned language scores low."""
    rng = random.Random(3)
    sounds = {"aa": "aeiou", "bb": "bcdfg", "cc": "xyzwq"}

    def say(lang, n=60):
        return " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(2, 6))) for _ in range(n))

    rows = [(k, say("aa"), "aa") for k in range(300)] + [(k, say("bb"), "bb") for k in range(300, 330)] + [(k, say("cc"), "cc") for k in range(330, 342)]
    rows += [(400, "same row", "aa")] * 500 + [(None, "no id here", "aa"), (401, None, "bb"), (402, "12 34", "cc")]
    d = spark.createDataFrame([(k, t, x, "s", len(t or "")) for k, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x for x, _, _ in language_id.sample(language_id.learnable(d), 20)} == {"aa", "bb", "cc"}
    assert len(language_id.sample(language_id.learnable(d), 20)) <= 60
    got = {r.doc_id: r.lang_pred for r in language_id.identify(d).collect()}
    assert sum(got[k] == "cc" for k in range(330, 342)) >= 11 and got[401] == got[402] == "und"
    more = [(500, say("bb"), None, "s", 1), (501, "Это русский текст, который никто не учил, и он довольно длинный.", "aa", "s", 1), (502, "これは日本語です。とても長い文章です", "bb", "s", 1)]
    kept = language_id.keep_identified(d.unionByName(spark.createDataFrame(more, d.schema)))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == d.columns and {401, 402}.isdisjoint(ids) and ids.count(400) == 500 and set(range(342)) <= set(ids)
    assert kept.where("doc_id = 500").first().lang == "bb"


def test_language_id_held_out_accuracy_and_no_leak(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.identify(d).toPandas().merge(d.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(k).encode()) % 5 == 0) for k, h in zip(got.doc_id, got.held_out))
    changed = d.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit("xx")).otherwise(F.col("lang")))
    again = language_id.identify(changed).toPandas()
    assert again.sort_values("doc_id")[["lang_pred", "score"]].values.tolist() == got.sort_values("doc_id")[["lang_pred", "score"]].values.tolist()


def test_language_id_of_nothing(spark):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs(spark, [None, "", "123 !", "abc"])).collect()}
    assert [got[k] for k in range(3)] == [("und", 0.0)] * 3 and got[3][0] == "en"
    assert language_id.identify(docs(spark, [])).count() == 0


def unigram_best(codec, word):
    """Best score by plain dynamic programming."""
    best = [0.0] + [-1e300] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(max(0, e - codec.longest), e):
            v = codec.by_text[word[s:e]][1] if word[s:e] in codec.by_text else codec.unknown_score if e - s == 1 else None
            if v is not None:
                best[e] = max(best[e], best[s] + v)
    return best[-1]


def test_sentencepiece_round_trip_and_optimality(spark, corpus):
    path = tokenizers_path("piece_bpe_32k.model")
    c = sentencepiece_codec.codec(path)
    score = dict(zip(c.ids.tolist(), c.scores.tolist()))
    for w in ("theation", "internationalisation", "xyzzy", "a", "été", "aaaaaaaaaaaaaaaaaaaaaaa", "::;;"):
        ids = c.encode(w)
        assert sum(score[i] for i in ids.tolist()) == pytest.approx(unigram_best(c, "▁" + w))
    for w in ("x" * 3000, thue_morse(3000)):
        assert c._single("▁" + w) == np.frombuffer(c._batch(["▁" + w], len(w) + 1)[0], "<u4").tolist()
    texts = [*corpus, "tabs\tand\nlines", "  two  spaces ", "日本語 😀", "x" * 5000, thue_morse(1024), thue_morse(1024, True)]
    assert sentencepiece_codec.encode(docs(spark, []), path).count() == 0
    enc = sentencepiece_codec.encode(docs(spark, texts), path)
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(enc, path).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    assert all(r.round_trip for r in sentencepiece_codec.digests(docs(spark, texts), path).collect())


def test_media_payloads_and_features(spark, corpus):
    texts = [*corpus, "RIFF BM GIF89a %PDF- nothing real"]
    for r in media.store(docs(spark, texts)).collect():
        raw = (texts[r.doc_id] or "").encode()
        pay = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        wav = media.to_samples(pay)
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        mean, rms = sum(pay) / len(pay), (sum((x - 128) ** 2 for x in pay) / len(pay)) ** 0.5
        crossings = sum((x >= 128) != (y >= 128) for x, y in zip(pay, pay[1:]))
        assert r.feature == f"type=audio/wav;samples={len(pay)};min={min(pay)};max={max(pay)};mean={mean:.4f};rms={rms:.4f};crossings={crossings};embedded=none"
    assert media.store(docs(spark, [])).count() == 0


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def pdf(update=False):
    head = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n"
    out = head + b"xref\n0 1\ntrailer <<>>\nstartxref\n%d\n%%%%EOF" % len(head)
    return out + b"\n2 0 obj\n<<>>\nendobj\nxref\n0 1\ntrailer <<>>\nstartxref\n%d\n%%%%EOF" % (len(out) + 21) if update else out


def crc(data, bits, polynomial):
    c = 0
    for x in data:
        c ^= x << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial) & ((1 << bits) - 1) if c >> (bits - 1) else c << 1
    return c


def flac(values, block=16):
    """Blocks of constant 8-bit mono samples."""
    info = struct.pack(">HH", block, block) + bytes(6) + ((8000 << 44) | (7 << 36) | block * len(values)).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info
    for k, v in enumerate(values):
        head = bytes([0xFF, 0xF8, 0x60, 0x02, k, block - 1])
        frame = head + bytes([crc(head, 8, 0x07)]) + bytes([0x00, v])
        out += frame + crc(frame, 16, 0x8005).to_bytes(2, "big")
    return out


def test_carving_ends_objects_where_they_end():
    sound, image = media.to_samples(b"abcd" * 16), png()
    content = pdf() + b" text " + image + pdf(True) + flac([1, 2, 255, 7]) + sound + b"tail"
    want, at = [], 0
    for part, kind in ((pdf(), "application/pdf"), (b" text ", None), (image, "image/png"), (pdf(True), "application/pdf"), (flac([1, 2, 255, 7]), "audio/flac"), (sound, "audio/wav")):
        want += [(at, at + len(part), kind)] if kind else []
        at += len(part)
    assert media.confirmed(content) == want
    assert media.confirmed(flac([1, 2])[:-1]) == [] and media.confirmed(b"%PDF-1.4 startxref\n9\n%%EOF") == []


def test_sniffing_is_linear():
    import time

    began = time.time()
    for junk in (b"%PDF-1", b"PK\x03\x04" + bytes(30), b"%PDF-1 startxref\n5\n%%EOF "):
        assert media.confirmed(junk * 40_000) == []
    assert time.time() - began < 20


def test_sniffing_corrects_types_and_carves(spark):
    import gzip

    image, sound, packed = png(), media.to_samples(b"abcd" * 16), gzip.compress(b"x" * 100)
    assert media.sniff(image, "image/jpeg") == ("image/png", [])
    assert media.sniff(image[:-3], "image/png")[0] == "unknown"
    rows = [(1, b"junk" + image + b"--" + sound + packed, "text/plain"), (2, None, "image/png"), (3, b"BM", "image/bmp"), (4, b"", None)]
    got = media.carve(spark.createDataFrame(rows, "k long, c binary, t string"), "k", "c", "t").orderBy("k", "object").collect()
    assert [(r.k, r.sniffed, r.media_type, bytes(r.media)) for r in got] == [(1, "text/plain", "image/png", image), (1, "text/plain", "audio/wav", sound), (1, "text/plain", "application/gzip", packed)]


def test_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (1, 0, "user", "hi"), (1, 1, "assistant", "b"), (1, 2, None, None), (2, 0, "user", "q"), (4, 0, "user", "s"), (5, 0, "user", "s")]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    r = {x.pair_id: x for x in preferences.format_pairs(preferences.neighbour_pairs(t)).collect()}
    assert r[0].prompt == "<|user|>\nhi<|end|>\n" and r[0].prompt_turns == 1
    assert [r[0].chosen[s.start : s.end] for s in r[0].chosen_spans] == ["a<|end|>\n"]
    assert [r[0].rejected[s.start : s.end] for s in r[0].rejected_spans] == ["b<|end|>\n"]
    assert r[1].prompt == "" and r[1].rejected == "" and r[1].chosen == "<|user|>\nq<|end|>\n"
    assert r[2].prompt_turns == 1 and r[2].chosen == r[2].rejected == ""


def test_permutation_index_recall(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    x[50:80] = x[0]
    rows = [(k, [float(a) for a in v]) for k, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0])]
    v = permutation_index.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = permutation_index.nearest(v, v.where("vec_id % 20 = 0"), 20).toPandas()
    hit = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        top = np.lexsort((np.arange(3000), -s))[:20]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own["score"], x[own["vec_id"]] @ x[q])
        hit += len(set(top) & set(own["vec_id"]))
    assert hit / (150 * 20) >= 0.9
    few = permutation_index.nearest(v.where("vec_id < 3"), v.where("vec_id = 0"), 20).collect()
    assert len(few) == 2
    assert permutation_index.nearest(v.where("vec_id < 0"), v.where("vec_id < 0"), 20).count() == 0


def test_permutation_index_touches_few_postings():
    """10,000 directions without clusters, the hardest case: recall, and postings read against the 256 places of each vector."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((10_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    lifted = np.column_stack([x[rng.choice(len(x), permutation_index.PIVOTS, replace=False)], np.zeros(permutation_index.PIVOTS)])
    halves = [permutation_index.Shard(np.arange(lo, lo + 5000), x[lo : lo + 5000], lifted, 1.0) for lo in (0, 5000)]
    hit = read = 0
    for q in range(0, 10_000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        found = [h.search(np.array([q]), x[q : q + 1], 20) for h in halves]
        ids, scores = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
        hit += len(set(np.argsort(-s)[:20]) & set(ids[np.argsort(-scores)[:20]]))
        read += sum(h.near(h._order(np.append(x[q], 0)[None])[0], 1)[1] for h in halves)
    assert hit / 2000 >= 0.9 and read / (100 * len(x)) < 0.08 * permutation_index.PIVOTS


def test_permutation_index_repeated_ids_and_extra_columns(spark):
    rows = [(k % 6, [float(k), 1.0, -float(k * k)], "x", k) for k in range(12)]
    v = permutation_index.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, shard int"))
    got = permutation_index.nearest(v, v.where("vec_id = 3"), 20).collect()
    assert got and all(r.query_id == 3 and r.vec_id != 3 for r in got)


def test_html_blocks():
    page = "<html><head><title>t</title><script>var a='<p>x</p>'</script></head><body><ul class='nav'><li><a href=x>M</a></ul><article><h1>A &amp; B</h1><p><b>one\n two<br><p>three &lt;four&gt;</article><footer>f</footer>"
    assert [b.text for b in html_text.blocks(page)] == ["M", "A & B", "one two", "three <four>", "f"]
    assert html_text.blocks("") == [] and [b.text for b in html_text.blocks("a < b")] == ["a < b"]


def test_html_extraction_held_out(spark, sf_dir):
    rng = np.random.default_rng(123)
    pages = [html_text.training_page(rng) for _ in range(100)]
    got = html_text.label(html_text.model(), [b for b, _ in pages])
    assert np.concatenate([g == y for g, (_, y) in zip(got, pages)]).mean() > 0.98
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<body><nav><a>m</a></nav><article><h1>Title here</h1><p>Some text of the article, long enough.</p></article></body>")]
    out = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1] == out[2] == ("", 0) and out[3][0] == "Title here\nSome text of the article, long enough."


def _nested(k: int, inside: str) -> str:
    return '<div class="row">' * k + inside + "</div>" * k


_SAID = "The harbour council met on Tuesday to weigh a plan for the old pier, and heard from forty residents."


@pytest.mark.parametrize(
    "page",
    [
        '<body><div class="site-nav">' + _nested(12, "<a href=1>Home</a><p><a href=2>Contact us</a></p>") + '</div><div class="post-content">' + _nested(15, f"<h1>KEEP plan</h1><p>KEEP {_SAID}</p><p>KEEP {_SAID}</p>") + '</div><div class="site-footer">' + _nested(10, "<p>Copyright 2024 All rights reserved</p>") + "</div></body>",
        "<body><header>" + _nested(11, "<p>Daily News</p>") + "</header><main>" + _nested(30, f"<h1>KEEP Title</h1><p>KEEP {_SAID}</p><p>KEEP Mass <math><mi>m</mi></math> here grows.</p>") + "<aside>" + _nested(14, "<p>Related: more popular stories to read next.</p>") + '</aside></main><section class="comments">' + _nested(9, "<p>I do not agree with the council at all.</p><p>Reply</p>") + "</section><footer>" + _nested(9, "<p>Privacy policy</p>") + "</footer></body>",
        "<body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav><article><h1>KEEP One</h1>" + "".join(f"<p>KEEP {_SAID} {i}</p>" for i in range(40)) + '<div class="ad">' + _nested(10, "<p>Buy now, sponsored offer.</p>") + f"</div><p>KEEP {_SAID}</p></article><form><label>Email</label><button>Subscribe</button></form></body>",
        '<body><div id="cookie">' + _nested(9, "<p>We use cookies to improve the site. Accept.</p>") + f"</div><article><table><tr><td>KEEP cell one<td>KEEP cell two</table><ul><li>KEEP first</li><li>KEEP second</li></ul><blockquote>KEEP {_SAID}</blockquote></article></body>",
    ],
)
def test_html_pages_by_hand(page):
    found = html_text.blocks(page)
    marks = html_text.label(html_text.model(), [found])[0]
    assert [(b.text, bool(m)) for b, m in zip(found, marks)] == [(b.text, b.text.startswith("KEEP")) for b in found]


def test_html_places_and_words_are_whole():
    """The farthest ancestor, the last word and the true number of words are in a block's vector."""
    near, far = (html_text.blocks(f"<{t}>" + "<div>" * 300 + "<p>x")[0] for t in ("nav", "section"))
    assert (html_text.vectors([near]) != html_text.vectors([far])).any()
    a, b = (html_text.vectors(html_text.blocks("<p>" + "word " * 500 + w)) for w in ("cookies", "pier"))
    assert (a[0, html_text.PLACE : -html_text.SCALARS] != b[0, html_text.PLACE : -html_text.SCALARS]).any()
    assert a[0, -html_text.SCALARS + 1] == np.float32(np.log1p(501) / 3)
    deep = html_text.blocks("<div>" * 30_000 + "<p>a</p><p>b</p>" * 2_000)
    assert len(deep) == 4_000 and html_text.vectors(deep).shape == (4_000, html_text.WIDTH)
    assert [x.text for x in html_text.blocks("<svg><title>t</title><text>in it</text></svg> <noscript>n")] == ["in it n"]


def test_html_tables(spark):
    page = f"<body><article><p>{_SAID}</p></article></body>"
    rows = spark.createDataFrame([(1, "u", page, "z"), (1, "u", page, "z"), (None, None, None, None)], "page_id long, url string, html string, text string")
    out = html_text.extract(rows)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "u", _SAID, len(_SAID))] * 2 + [(None, None, "", 0)]
    assert html_text.extract(rows.limit(0)).count() == 0


def test_pipeline_stages(spark, corpus, tmp_path):
    tokenizers_path("word_bpe_49k.json")
    import corpus_pipeline

    docs(spark, corpus).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [d.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns
        out.write.parquet(f"{tmp_path}/{k}")
        d = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(d.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] > 0
    left = {r.doc_id: r.text for r in d.collect()}
    assert 7 in left and left[7] == corpus[7] and 6 not in left
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == seen[3]


def test_pipeline_keeps_one_row_of_repeated_null_and_shared_ids(spark):
    import corpus_pipeline

    rng = random.Random(5)
    a, b, c, d, e, f = (" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(6))
    given = [(1, a), (1, a), (1, a), (2, b), (None, b), (None, c), (None, c), (3, d), (7, d.upper()), (7, e), (4, f), (4, f.upper()), (9, ""), (9, ""), (None, None)]
    x = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in given], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.jaccard_stage(spark, x, "")
    assert out.columns == x.columns
    kept = sorted((r.doc_id or 0, (r.text or "").lower()) for r in out.collect())
    assert kept == sorted([(1, a), (2, b), (0, c), (3, d), (7, e), (4, f), (9, ""), (9, ""), (0, "")])
    left = sorted((r.doc_id or 0, r.text.lower()) for r in corpus_pipeline.suffix_stage(spark, out.where("text <> ''"), "").collect())
    assert left == sorted([(1, a), (2, b), (0, c), (3, d), (7, e), (4, f)])
