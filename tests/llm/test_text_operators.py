import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from lodestone.llm import byte_bpe, fingerprints, language_id, packing, substring_dedup
from lodestone.llm.merging import merge_long

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, kept string, row long"


def docs(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, "clash", "clash", 1) for r in rows], SCHEMA)


def odd_texts(n, seed=4):
    rng = random.Random(seed)
    alphabet = [*"ab'sLl  \n\t\r\x85\xa0\x1c１²½éßΩж中😀.,!?-_0123ΣİAZ", "'ll", "the", " the", "́"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_byte_bpe_equals_the_library(spark):
    c = byte_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    texts = odd_texts(1500) + ["", "a" * 3000, " " * 700 + "x", "é" * 900, "word " * 500]
    for text, (ids, data) in zip(texts, c.encode_texts(texts)):
        assert ids == " ".join(map(str, library.encode_ordinary(text))) and data == text.encode(), repr(text)
    rows = [(1, None), (2, ""), (2, ""), (None, "Hello, Wörld"), (4, "long word " * 20_000)]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.encode_documents(docs(spark, rows)).collect()}
    assert got == {(d, len(i := library.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows}
    assert byte_bpe.encode_documents(docs(spark, [])).count() == 0


def test_long_and_lockstep_merges_agree():
    c = byte_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(9)
    for _ in range(300):
        word = "".join(rng.choice("theinandor ") for _ in range(rng.randint(2, 60))).encode()
        assert c.merge([b"\xff" + word])[0] == merge_long([int(c.first[b]) for b in b"\xff" + word], c.table)


def test_word_ids_equal_the_library():
    w = packing.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = odd_texts(1500, 6) + ["", "é" * 900, "a<|endoftext|>b <|startoftext|> x", "<|ENDOFTEXT|> <|end oftext|> İ<|endoftext|>Σ", "Ça <|endoftext|>", " lead and trail "]
    rng = random.Random(11)
    texts += [t.replace("é", "<|endoftext|>") for t in odd_texts(300, 12)] + [" ".join(rng.choice(["the", "The", "cat.", "naïve", "<|startoftext|>"]) for _ in range(40)) for _ in range(50)]
    for _ in range(2):  # unknown words, then remembered ones
        flat, lengths = w.encode_texts(pa.array(texts))
        for text, ids in zip(texts, np.split(flat, np.cumsum(lengths)[:-1])):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_is_an_exact_partition(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "cat", "runs.", "over", "it!"]) for _ in range(rng.randint(0, 900)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "no stop " * 4000), (503, "odd <|endoftext|> text. " * 30), (None, "without an id")]
    got = packing.pack_documents(docs(spark, rows)).collect()
    sequences, documents = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
        documents.setdefault(r.doc_id, []).append(r)
    assert set(documents) == {d for d, _ in rows}
    for d, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(documents[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    last = {s for s in sequences if s + 1 not in sequences}  # a stream's last sequence holds what is left
    for sequence, pieces in sequences.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
        padding += 0 if sequence in last else 2048 - at
    assert padding < 0.01 * total
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_cuts_lie_at_sentence_or_document_ends_where_there_are_any():
    rng = random.Random(4)
    stops = np.zeros(10, bool)
    stops[7] = True
    lengths = [rng.randint(1, 400) for _ in range(300)]
    tokens = np.array([7 if rng.random() < 0.05 else 2 for _ in range(sum(lengths))])
    ends = np.cumsum(lengths)
    places, price = packing.cut_places(tokens, ends, stops)
    natural = {0, *ends.tolist(), *(np.flatnonzero(tokens == 7) + 1).tolist()}
    known = sorted(natural)
    assert natural <= set(places.tolist()) and np.diff(places).max() <= packing.STRIDE
    for at, cost in zip(places.tolist(), price.tolist()):
        assert (cost == packing.STRIDE_PENALTY) == (at not in natural)
        if at not in natural:  # only in long stretches
            i = np.searchsorted(known, at)
            assert known[i] - known[i - 1] > packing.STRIDE
    assert all(p == 0 for a, p in zip(places, price) if a in set(ends.tolist()))


def test_cheapest_cuts_against_all_choices():
    rng = random.Random(8)
    for _ in range(200):
        places = sorted({0, *(rng.randint(1, 40) for _ in range(9))})
        while any(b - a > 12 for a, b in zip(places, places[1:])):
            places = sorted({*places, *range(0, 40, 6)})
        penalties = [rng.randint(0, 5) for _ in places]

        def best(j):
            if j == 0:
                return 0
            last = j == len(places) - 1
            return (0 if last else penalties[j]) + min(best(i) + (0 if last else 12 - (places[j] - places[i])) for i in range(j) if places[j] - places[i] <= 12)

        cuts = packing.cheapest_cuts(places, penalties, 12)
        steps = [0, *cuts]
        assert all(b - a <= 12 for a, b in zip(steps, steps[1:])) and cuts[-1] == places[-1]
        assert sum(12 - (b - a) + penalties[places.index(b)] for a, b in zip(steps[:-1], steps[1:-1])) == best(len(places) - 1)


def brute_repeats(rows, window):
    seen = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for s in range(len(words) - window + 1):
            seen.setdefault(tuple(words[s : s + window]), d)
    out = []
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            if d is not None and seen[tuple(words[s : s + window])] < d:
                gone[s : s + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("vocabulary", [3, 5000])
def test_repeats_match_brute_force(spark, vocabulary):
    rng = random.Random(vocabulary)
    word = lambda: f"w{rng.randint(0, vocabulary)}"
    passages = [[word() for _ in range(rng.randint(45, 140))] for _ in range(6)]
    rows = []
    for i in range(70):
        words = [word() for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            words += p[a : len(p) - rng.randint(0, 20)] + [word() for _ in range(rng.randint(0, 5))]
        rows.append((i * 2, (" " if i % 2 else "\n").join(words)))
    rows += [rows[3], (1, rows[8][1]), (None, rows[9][1]), (300, None), (301, ""), (302, "same " * 400), (303, "same " * 300), (304, " ".join(passages[0]) + "\xa0x")]
    rows += [(305, rows[5][1] + " tail"), (305, "other start " + rows[6][1])]
    got = substring_dedup.dedup_query(docs(spark, rows).repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_repeats(rows, 50)
    if vocabulary == 3:
        kept = substring_dedup.remove_repeats(docs(spark, rows))
        assert kept.columns == docs(spark, rows).columns and kept.count() == len(rows)
        assert substring_dedup.dedup_query(docs(spark, [])).count() == 0


def plain_factors(rows):
    """The same parse without hashes of windows or blocks: anchors by a plain minimum, blocks by their words, runs one by one."""

    def blocks(words):
        keys = [int(k) for k in substring_dedup.Parsed([w.encode() for w in words]).span(0, np.arange(len(words) - 11), np.arange(12, len(words) + 1))]
        keys = [((k ^ k >> 29) * int(substring_dedup.BASES[1])) % 2**64 >> 32 for k in keys]
        place = [min(range(s, s + 39), key=lambda i: (keys[i], i)) for s in range(len(words) - 49)]
        starts = [s for s in range(len(place)) if s == 0 or place[s] != place[s - 1]]
        ends = [s - 1 + 50 for s in starts[1:]] + [len(words)]
        return [(a, b, tuple(words[a:b]), place[a] - a) for a, b in zip(starts, ends)]

    parsed = {d: blocks(t.split()) if len(t.split()) >= 50 else [] for d, t in rows}
    index = {}
    for d in sorted(parsed):
        for a, _, words, anchor in parsed[d]:
            index.setdefault((words, anchor), (d, a))
    out = []
    for d, found in parsed.items():
        open_ = None
        for a, b, words, anchor in found:
            ref, at = index[words, anchor]
            if ref >= d:
                open_ = None
            elif open_ and open_[3] == ref and at - open_[4] == a - open_[1]:
                open_[2] = b - open_[1]
            else:
                open_ = [d, a, b - a, ref, at]
                out.append(open_)
    return sorted(map(tuple, out))


def test_factors_equal_a_plain_parser(spark):
    rng = random.Random(33)
    word = lambda: f"w{rng.randint(0, 3000)}"
    passages = [[word() for _ in range(rng.randint(60, 260))] for _ in range(5)]
    rows = []
    for i in range(40):
        words = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            words += [word() for _ in range(rng.randint(0, 60))] + p[rng.randint(0, 20) : len(p) - rng.randint(0, 20)]
        rows.append((i * 3 + 1, " ".join(words)))
    got = sorted(map(tuple, substring_dedup.factor_documents(docs(spark, rows).repartition(3)).collect()))
    assert got == plain_factors(rows) and len(got) > 30
    texts = {d: t.split() for d, t in rows}
    for d, start, length, ref, at in got:
        assert ref < d and length >= 50 and texts[d][start : start + length] == texts[ref][at : at + length]


def test_fingerprints_and_edited_texts(spark):
    rng = random.Random(12)
    rows = [(i * 3, " ".join(f"word{rng.randint(0, 3000)}" for _ in range(rng.randint(150, 300)))) for i in range(80)]
    rows += [(500, rows[0][1]), (501, None), (502, ""), (503, "é" * 5)]
    ordered = sorted(rows)
    got = {r.doc_id: r for r in fingerprints.fingerprint_query(docs(spark, rows).repartition(3)).collect()}
    assert len(got) == len(rows)
    for (d, t), (e, u) in zip(ordered, ordered[1:] + ordered[:1]):
        t, u = t or "", u or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        differ = int(got[d].fingerprint, 16) ^ int(got[e].fingerprint, 16)
        assert got[d].near_next == pytest.approx(1 - differ.bit_count() / 128)
        differ = int(got[d].fingerprint, 16) ^ int(got[d].edited_fingerprint, 16)
        assert got[d].near_edited == pytest.approx(1 - differ.bit_count() / 128)
    assert got[0].fingerprint == got[500].fingerprint != got[3].fingerprint and got[501].fingerprint == got[502].fingerprint
    far = [got[d].near_next for d, _ in ordered[:78]]
    near = [got[d].near_edited for d, _ in ordered[:78]]
    assert sum(near) / len(near) > sum(far) / len(far) + 0.1
    assert fingerprints.fingerprint_query(docs(spark, [])).count() == 0
    one = fingerprints.fingerprint_query(docs(spark, [(7, "just one here")])).first()
    assert one.near_next == 1.0
    assert fingerprints.fingerprint_query(docs(spark, [(7, "tie a"), (7, "tie b"), (None, "first")])).count() == 3


def slow_simhash(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    terms = list(zip(words, words[1:])) if len(words) > 1 else [(w, "") for w in words]
    chain = lambda *parts: functools.reduce(lambda seed, p: xxhash.xxh64_intdigest(p.encode(), seed), parts, 42)
    votes, total = [0] * 128, 0
    for a, b in terms:
        weight = min(len(a.encode()) + len(b.encode()), 16)
        total += weight
        h = chain(a, b) << 64 | chain(b, "second", a)
        for i in range(128):
            votes[i] += weight * (h >> i & 1)
    return sum(1 << i for i in range(128) if 2 * votes[i] > total)


def test_fingerprints_equal_brute_force_in_any_bucketing(spark, monkeypatch):
    rng = random.Random(15)
    text = lambda: " ".join(rng.choice(["Alpha", "beta", "γάμμα", "d", "\t", "epsilon-zeta-eta-theta"]) for _ in range(rng.randint(0, 40)))
    rows = [(rng.choice([None, i // 2, 7]), text()) for i in range(150)]  # a third without an id, a third with one id
    results = []
    for size in (1 << 30, 200):
        monkeypatch.setattr(fingerprints, "BUCKET_BYTES", size)
        results.append(sorted(map(tuple, fingerprints.fingerprint_query(docs(spark, rows).repartition(3)).collect()), key=str))
    assert len(results[0]) == len(results[1]) == 150
    prints = sorted(r[3] for r in results[0])
    assert prints == sorted(r[3] for r in results[1]) == sorted(f"{slow_simhash(t):032x}" for _, t in rows)
    unique = sorted({d: t for d, t in rows if d not in (None, 7)}.items())
    for size in (1 << 30, 200):  # with distinct ids the whole result is the same
        monkeypatch.setattr(fingerprints, "BUCKET_BYTES", size)
        got = [tuple(r) for r in fingerprints.fingerprint_query(docs(spark, unique).repartition(3)).orderBy("doc_id").collect()]
        for (d, t), (_, u), r in zip(unique, unique[1:] + unique[:1], got):
            half = len(t) // 2
            edited = t[: len(t) - half] + u[:half]
            own, other, after = slow_simhash(t), slow_simhash(edited), slow_simhash(u)
            assert r == (d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{own:032x}", f"{other:032x}", 1 - (own ^ other).bit_count() / 128, 1 - (own ^ after).bit_count() / 128)


def test_near_pairs_over_a_whole_table(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "coalesce(text, '') AS text")
    prints = fingerprints.fingerprint_texts(texts.repartition("doc_id"), ["doc_id"], "text").withColumnRenamed("doc_id", "node")
    values = {}
    for r in prints.orderBy("node").collect():
        values.setdefault((r.fp_hi % 2**64) << 64 | r.fp_lo % 2**64, r.node)
    nodes = list(values.items())
    want = sorted((a, b, d) for i, (u, a) in enumerate(nodes) for v, b in nodes[i + 1 :] if (d := (u ^ v).bit_count()) <= 12)
    assert want
    for count in (2, 10**9):  # one block to a key, and several
        assert sorted(map(tuple, fingerprints.near_pairs(prints, 12, count).collect())) == want


def test_near_pairs_match_brute_force(spark):
    rng = random.Random(1)
    values = []
    for _ in range(25):
        v = rng.getrandbits(128)
        values += [v, v, *(v ^ sum(1 << b for b in rng.sample(range(128), rng.randint(1, 7))) for _ in range(3))]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(i, signed(v >> 64), signed(v & (1 << 64) - 1)) for i, v in enumerate(values)], "node long, fp_hi long, fp_lo long")
    got = sorted(tuple(r) for r in fingerprints.near_pairs(frame, 5).collect())
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    nodes = sorted(first.items(), key=lambda x: x[1])
    assert got == sorted((a, b, d) for i, (u, a) in enumerate(nodes) for v, b in nodes[i + 1 :] if (d := (u ^ v).bit_count()) <= 5)


def test_language_models_on_held_out_rows(spark):
    rng = random.Random(3)
    syllables = {"aa": ["ka", "mo", "ri", "tu"], "bb": ["sch", "ung", "ber", "lich"], "cc": ["жа", "ко", "ни"]}
    rows = [(i, " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(40)), lang) for i in range(300) for lang, s in [rng.choice(list(syllables.items()))]]
    extra = [(1000, None, "aa"), (1001, "12 !?", "bb"), (1002, "", None), (None, "kamo ritu", "aa"), (1003, "𐐀𐐁", None), (1004, "qxz wvf jpq " * 30, None)]
    got = {r.doc_id: r for r in language_id.predict_languages(docs(spark, rows + extra)).collect()}
    for d, _, lang in rows:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert got[d].lang_pred == lang and 0.5 < got[d].score <= 1 and not got[d].rejected
    assert [got[d].lang_pred for d in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred in syllables and got[1003].rejected
    assert got[1004].rejected and got[None].held_out
    kept = language_id.keep_known_language(docs(spark, rows + extra))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, _, _ in rows} | {None}
    assert language_id.predict_languages(docs(spark, [(1, "no training", None)])).first().lang_pred == "und"
    assert language_id.predict_languages(docs(spark, [])).count() == 0


def test_letters_beyond_the_basic_plane_take_part(spark):
    rng = random.Random(17)
    deseret = [chr(0x10400 + i) for i in range(40)]
    rows = [(i, " ".join("".join(rng.choice(deseret) for _ in range(5)) for _ in range(30)), "ds") for i in range(100)]
    rows += [(100 + i, " ".join("".join(rng.choice("kamori") for _ in range(5)) for _ in range(30)), "xx") for i in range(100)]
    odd = [(900, "\U0001f600\U0001f601", None), (901, "ka\U0001f600mo", None), (902, "".join(deseret[:30]), None)]
    got = {r.doc_id: r for r in language_id.predict_languages(docs(spark, rows + odd)).collect()}
    assert all(got[d].lang_pred == lang and not got[d].rejected for d, _, lang in rows)
    assert [got[d].lang_pred for d in (900, 901, 902)] == ["und", "xx", "ds"]


def slow_kneser_ney(trained):
    """Cross-entropy per character by dictionaries and Kneser-Ney's formula, one n-gram at a time."""
    letters = lambda t: [c for w in re.split(r"[\W\d_]+", t.lower()) if w for c in (*w, "")][:-1]
    level = {n: {} for n in range(1, 5)}

    def grams(text):
        seq = ["", "", "", *letters(text)]
        return [tuple(seq[i - 3 : i + 1]) for i in range(3, len(seq))]

    for text in trained:
        for g in grams(text):
            level[4][g] = level[4].get(g, 0) + 1
    for n in (3, 2, 1):
        for g in level[n + 1]:
            level[n][g[1:]] = level[n].get(g[1:], 0) + 1
    discount = {}
    for n in level:
        once, twice = (sum(c == k for c in level[n].values()) for k in (1, 2))
        discount[n] = once / (once + 2 * twice) if once and twice else 0.5

    def p(g):
        if not g:
            return language_id.UNSEEN
        n, total, kinds = len(g), 0, 0
        for h, c in level[n].items():
            if h[:-1] == g[:-1]:
                total, kinds = total + c, kinds + 1
        if not total:
            return p(g[1:])
        return max(level[n].get(g, 0) - discount[n], 0) / total + discount[n] * kinds / total * p(g[1:])

    return lambda text: sum(-math.log2(p(g)) for g in grams(text)) / len(grams(text))


def test_cross_entropies_match_brute_force(spark):
    rng = random.Random(19)
    syllables = {"aa": ["ka", "mo", "ri"], "bb": ["sch", "ung", "ka"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(6)), lang) for i, lang in enumerate(["aa", "bb"] * 15)]
    got = {r.doc_id: r for r in language_id.predict_languages(docs(spark, rows)).collect()}
    slow = {lang: slow_kneser_ney([t for d, t, own in rows if own == lang and zlib.crc32(str(d).encode()) % 5]) for lang in syllables}
    for d, text, _ in rows:
        entropy = {lang: f(text) for lang, f in slow.items()}
        best = min(sorted(entropy), key=lambda lang: round(entropy[lang], 9))
        assert got[d].lang_pred == best and got[d].cross_entropy == pytest.approx(entropy[best], rel=1e-9)


def test_kneser_ney_sums_to_one():
    keys, _ = language_id.four_grams(["the cat sat on the mat and the dog ran to the cat"] * 2)
    model = language_id.KneserNey.fit(*language_id.counted(keys))
    context = np.uint64(keys[20]) & ~np.uint64(0xFFFF)
    total = model.probability(context | np.arange(1 << 16, dtype=np.uint64)).sum()
    seen = np.unique(keys & np.uint64(0xFFFF))
    assert 0.9 < model.probability(context | seen).sum() <= 1.0 + 1e-9 and total > 0


def test_language_model_keeps_every_four_gram(spark):
    letters = np.random.default_rng(5).integers(0x4E00, 0x9F00, (700, 2000)).astype("<u2")
    rows = [(i, row.tobytes().decode("utf-16-le"), "zh") for i, row in enumerate(letters)]
    trained = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5]
    distinct = len(np.unique(language_id.four_grams(trained)[0]))
    (model,) = language_id.fit(docs(spark, rows)).models
    assert distinct > 1 << 20 and len(model.grams[4].hashes) == distinct
