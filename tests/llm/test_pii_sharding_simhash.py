import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from lodestone.llm import pii, sharding, simhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, row_no long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "clash", 7) for i, t in rows], SCHEMA)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_match_the_patterns_on_random_text():
    rng = random.Random(1)
    alphabet = ["a", "Z", "@", ".", "-", "+", " ", "(", ")", "1", "4", "0", "255", "é", "\n", "_", "4041894974608795", "x@y.z", "1.2.3.4", "+1 (2) 3", "٣"]
    for _ in range(20000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        assert [s for s in pii.spans(text) if s[0] in PATTERNS] == plain(text), repr(text)


def test_cues_and_schemes_add_spans():
    text = "IBAN: DE89 3704 0044 0532 0130 00 and https://bob:secret@host.example/x mailto:amy@example.org"
    kinds = Counter(k for k, _, _ in pii.spans(text))
    assert kinds["account"] == 1 and kinds["contact"] == 2
    assert pii.redact("call +44 20 7946 0958 now") == "call <PHONE> now"
    assert pii.redact(None) is None and pii.redact("") == ""


def test_pii_query_rows(spark):
    rows = [(1, "a@b.co " * 3), (1, "a@b.co " * 3), (2, None), (3, ""), (None, "ip 10.0.0.1"), (4, "x" * 300_000 + " me@x.org")]
    got = {(r.doc_id, r.n_email, r.n_ip) for r in pii.find_pii(docs(spark, rows)).collect()}
    assert got == {(1, 3, 0), (2, 0, 0), (3, 0, 0), (None, 0, 1), (4, 1, 0)}
    assert pii.find_pii(docs(spark, [])).count() == 0
    row = pii.find_pii(docs(spark, [(1, "é a@b.co")])).first()
    assert row.base_sha256 == hashlib.sha256(b"email:2:8").hexdigest()
    assert pii.redact_documents(docs(spark, rows)).columns == docs(spark, rows).columns


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100, 1000])
def test_shards_are_a_permutation(spark, n):
    rows = [(i * 3 if i % 5 else None, f"t{i}" if i % 7 else None) for i in range(n)]
    got = sharding.shard_rows(docs(spark, rows)).collect()
    assert len(got) == n
    assert {(r.shard, r.slot) for r in got} == {(i % 24, i // 24) for i in range(n)}
    sizes = Counter(r.shard for r in got)
    if n >= 24:
        assert max(sizes.values()) - min(sizes.values()) <= 1
    for r in got:
        assert r.size >= 8 and r.text_crc32 >= 0 and r.law == "rows" and r.grown_shard is None


def test_shards_do_not_depend_on_layout(spark):
    rows = [(i, f"é{i}") for i in range(300)]
    one = {(r.doc_id, r.shard, r.slot, r.text_crc32) for r in sharding.shard_rows(docs(spark, rows)).collect()}
    two = {(r.doc_id, r.shard, r.slot, r.text_crc32) for r in sharding.shard_rows(docs(spark, rows[::-1]).repartition(3)).collect()}
    assert one == two and {r[3] for r in one} == {zlib.crc32(t.encode()) for _, t in rows}
    slots = sorted((r[1] + 24 * r[2], r[0]) for r in one)
    assert [d for _, d in slots] != sorted(d for _, d in slots)


@pytest.mark.parametrize(
    "text, found",
    [
        ("IBAN: DE89 3704 0044 0532 0130 00 then", ["DE89 3704 0044 0532 0130 00"]), ("IBAN: DE00 0000 0000 0000 0000 00", []), ("iban GB29NWBK60161331926819.", ["GB29NWBK60161331926819"]), ("IBAN GB29 NWBK 6016 1331 9268 18", []),
        ("SSN 123-45-6789", ["123-45-6789"]), ("SSN 000-45-6789", []), ("Social Security no. 123 45 0000", []), ("routing number 021000021", ["021000021"]), ("routing number 021000022", []),
        ("account 123456 for 2 weeks", ["123456"]), ("account 111111", []), ("acct no. 12-3456-78", ["12-3456-78"]), ("passport X1234567", ["X1234567"]), ("passport control", []), ("account DE89370400440532013000", ["DE89370400440532013000"]),
        ("He lives at 12 Elm Street, Springfield, IL 62704 now", ["12 Elm Street, Springfield, IL 62704"]), ("P.O. Box 123", ["P.O. Box 123"]), ("Down the Street", []), ("Lange Hauptstraße 5, 10115 Berlin", ["Hauptstraße 5, 10115 Berlin"]), ("221B Baker St. is famous", ["221B Baker St."]),
        ("Drive 5 miles. 3 Streets", []),
    ],
)
def test_accounts_and_addresses_are_validated(text, found):
    assert [text[a:b] for k, a, b in pii.spans(text) if k in ("account", "address")] == found


def test_cues_take_linear_time():
    import time

    start = time.process_time()
    for part in ("IBAN: DE89 ", "1 A Street ", "12 A A A A Street", "account 1 ", "straße", "P.O. Box 1"):
        pii.spans(part * (500_000 // len(part)))
    assert time.process_time() - start < 60


def slow_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    low = {}
    for i, (d, _) in enumerate(prints):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, low[find(i)]) for i, (d, _) in enumerate(prints))


def near_copies(rng, n):
    out = []
    for i in range(n):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 120))]
        for c in range(rng.randint(1, 4)):
            copy = list(words)
            if copy and c:
                copy[rng.randrange(len(copy))] = "Changed"
            out.append((len(out), " ".join(copy)))
    return out


@pytest.mark.parametrize("limit", [2048, 4])
def test_groups_match_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash_dedup, "SHARD_LIMIT", limit)
    rows = near_copies(random.Random(3), 60) + [(900, None), (901, ""), (902, "é É"), (902, "é É")]
    prints = [(d, slow_fingerprint(t)) for d, t in rows]
    got = simhash_dedup.dedup_query(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((d, f"{f:016x}") for d, f in prints)
    assert sorted((r.doc_id, r.component_id) for r in got) == brute_groups(prints, 4)


def test_rows_without_an_id_link_but_never_name_a_group(spark):
    words = [f"w{i}" for i in range(200)]
    other = [f"v{i}" for i in range(200)]
    rows = [(5, " ".join(words)), (None, " ".join(words)), (9, " ".join(other)), (None, " ".join(other)), (None, "alone here " * 20), (None, "alone here " * 20), (None, None), (-(1 << 63), "smallest id of all")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash_dedup.dedup_query(docs(spark, rows)).collect()), key=str)
    low = -(1 << 63)
    assert got == sorted([(5, 5), (None, 5), (9, 9), (None, 9), (None, None), (None, None), (None, None), (low, low)], key=str)
    groups = sorted(((r.doc_id, r.component_id) for r in simhash_dedup.similar_groups(docs(spark, rows)).collect()), key=str)
    assert groups == sorted([(5, 5), (9, 9), *[(None, None)] * 5, (low, low)], key=str)
    assert simhash_dedup.keep_one_each(docs(spark, rows)).count() == len(rows)


def test_block_masks_cover_every_pair_within_the_radius():
    rng = random.Random(5)
    for count in (10, 10**6, 10**9):
        masks = simhash_dedup.block_masks(4, count)
        for _ in range(300):
            flipped = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not flipped & m for m in masks)


def test_dedup_empty_and_keep_one(spark):
    assert simhash_dedup.dedup_query(docs(spark, [])).count() == 0
    text = " ".join(f"word{i}" for i in range(300))
    kept = simhash_dedup.keep_one_each(docs(spark, [(3, text), (5, text), (6, text.replace("word7 ", "x ")), (9, "other text entirely here now")]))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 9]
    assert kept.columns[0:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_similar_documents_group_and_others_stay(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for _ in range(60):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(120, 400))]
        first = len(rows)
        for c in range(rng.randint(1, 5)):
            copy = list(words)
            for _ in range(len(words) // 90 if c else 0):  # similarity about 0.9 to the first
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9999)}"
            want[len(rows)] = first
            rows.append((len(rows), " ".join(copy)))
        rows.append((len(rows), " ".join(words[: len(words) // 3] + [f"y{rng.randint(0, 9999)}" for _ in words[len(words) // 3 :]])))
        want[len(rows) - 1] = len(rows) - 1
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_groups(docs(spark, rows)).collect()}
    assert set(got) == set(want)
    copies = [d for d in want if want[d] != d]
    assert sum(got[d] == want[d] for d in copies) >= 0.97 * len(copies)
    assert all(got[d] == d for d in want if want[d] == d)
    assert simhash_dedup.similar_groups(docs(spark, [])).count() == 0


def planted(rng, similarity):
    """Two texts of distinct five-word shingles whose sets have about this Jaccard similarity."""
    words = [f"w{rng.randint(0, 10**9)}" for _ in range(rng.randint(150, 400))]
    copy, n = list(words), len(words) - 4
    changed = round(n * (1 - similarity) / (1 + similarity) / 5)
    for at in rng.sample(range(5, len(words) - 5, 5), changed):
        copy[at] = f"x{rng.randint(0, 10**9)}"
    return " ".join(words), " ".join(copy)


def jaccard(a, b):
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("cell", [1 << 18, 600])
def test_only_pairs_of_the_shingle_similarity_link(spark, monkeypatch, cell):
    from lodestone.llm import similar_sets

    monkeypatch.setattr(similar_sets, "CELL_SHINGLES", cell)
    rng = random.Random(23)
    line = " ".join(f"common{i}" for i in range(12))
    pairs = [planted(rng, rng.uniform(0.6, 0.85)) for _ in range(150)]
    pairs = [(f"{a} {line}", f"{b} {line}") for a, b in pairs]
    rows = [(2 * i + c, t) for i, pair in enumerate(pairs) for c, t in enumerate(pair)]
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_groups(docs(spark, rows)).collect()}
    similar = [jaccard(a, b) >= 0.8 for a, b in pairs]
    assert 15 < sum(similar) < 100
    assert got == {2 * i + c: 2 * i if c == 0 or similar[i] else 2 * i + 1 for i in range(len(pairs)) for c in (0, 1)}


def test_no_pair_at_the_threshold_is_lost(spark):
    rng = random.Random(29)
    pairs = [p for p in (planted(rng, rng.uniform(0.8, 0.84)) for _ in range(400)) if 0.8 <= jaccard(*p) < 0.85]
    assert len(pairs) > 150
    rows = [(2 * i + c, t) for i, pair in enumerate(pairs) for c, t in enumerate(pair)]
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_groups(docs(spark, rows)).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_fingerprints_of_similar_sets_lie_within_the_radius():
    from lodestone.llm import similar_sets

    rng = np.random.default_rng(31)
    assert similar_sets.radius(0.8) == similar_sets.RADIUS
    for common, left, right in [(4, 1, 0), (8, 1, 1), (12, 3, 0), (16, 2, 2), (80, 10, 10), (800, 100, 100), (40_000, 10_000, 0)]:
        for _ in range(5):
            grams = rng.integers(0, 1 << 63, common + left + right, dtype=np.uint64)
            a, b = similar_sets.simhash(np.sort(grams[: common + left])), similar_sets.simhash(np.sort(np.r_[grams[:common], grams[common + left :]]))
            assert np.bitwise_count(a ^ b).sum() <= similar_sets.RADIUS
    s = np.sort(rng.integers(0, 1 << 63, 40_000, dtype=np.uint64))
    h = s.astype(object)
    for word in range(similar_sets.WORDS):
        v = [(int(x) + 0x9E3779B97F4A7C15 * (word + 1)) % (1 << 64) for x in h[:999]]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            v = [(x ^ (x >> shift)) * factor % (1 << 64) for x in v]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in v) > len(v))
        assert int(similar_sets.simhash(s[:999])[word]) % (1 << 64) == want


@pytest.mark.parametrize("limit", [2048, 3])
def test_shared_shingles_of_unlike_documents_make_no_candidates(spark, monkeypatch, limit):
    """Documents that happen to share some shingles must not chain into one component, which grows faster than the table."""
    from lodestone.llm import similar_sets

    rng = random.Random(37)
    phrases = [" ".join(f"p{i}x{j}" for j in range(6)) for i in range(40)]
    rows, pairs = [], set()
    for i in range(60):
        a, b = planted(rng, 0.85)
        shared = rng.sample(phrases, 8)
        pairs.add((2 * i + 1, 2 * i))
        rows += [(2 * i, " ".join([a, *shared])), (2 * i + 1, " ".join([b, *shared]))]
    seen, components = [], similar_sets.components

    def watched(links):
        seen.append({(max(r.a, r.b), min(r.a, r.b)) for r in links.collect() if r.a != r.b})
        return components(links)

    monkeypatch.setattr(similar_sets, "components", watched)
    monkeypatch.setattr(similar_sets, "SHARD_LIMIT", limit, raising=False)
    monkeypatch.setattr(similar_sets, "FREQUENT", 16)  # as in a table with more repeated shingles than the order knows
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_groups(docs(spark, rows)).collect()}
    assert seen[0] == pairs and got == {d: d - d % 2 for d, _ in rows}
