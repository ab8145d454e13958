import itertools
import random

import numpy as np
import pytest
import xxhash

from quillcast.llm.simhash_dedup import NEXT, covering_masks, fingerprint, link_fingerprints, masks_within, simhash_groups, verified_links


def plain_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(ids, prints, radius):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(list(zip(ids, prints)), 2):
        if (a ^ b).bit_count() <= radius:
            i, j = sorted((find(i), find(j)))
            root[j] = i
    return {i: find(i) for i in ids}


def test_fingerprint_matches_definition():
    for text in ["", " \n", "one", "a b c", "a b c d", "A B c d e", "x y z w x y z w x y z w", "né à l'été où il fait chaud"]:
        assert fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover_every_pattern_within_the_radius(radius):
    masks = covering_masks(list(range(16)), radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for size in range(radius + 1):
        for bits in itertools.combinations(range(16), size):
            assert any(not any(m >> b & 1 for b in bits) for m in masks)


@pytest.mark.parametrize("limit", [3, 50, 20000])
def test_no_link_is_lost(spark, limit):
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    prints = sorted(prints)
    rows = [(p - ((p >> 63) << 64), i) for i, p in enumerate(prints)]
    links = link_fingerprints(spark.createDataFrame(rows, "fp long, rep long"), 4, limit).collect()
    assert all((prints[r.a] ^ prints[r.b]).bit_count() <= 4 for r in links)
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        a, b = sorted((find(r.a), find(r.b)))
        root[b] = a
    expected = plain_groups(range(len(prints)), prints, 4)
    assert {i: find(i) for i in range(len(prints))} == expected


@pytest.mark.parametrize("radius", [1, 2, 4, 6])
def test_no_mask_is_empty_at_either_level(radius):
    masks = covering_masks(list(range(64)), radius)
    assert len(masks) == 2 ** (radius + 1) - 1 and min(m.bit_count() for m in masks) >= 16
    for m in masks:
        inner = covering_masks([b for b in range(64) if not m >> b & 1], radius)
        assert min(i.bit_count() for i in inner) >= 4 and not any(i & m for i in inner)
    rng = random.Random(5)
    for _ in range(300):
        bits = rng.sample(range(64), radius)
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_no_link_is_lost_at_radius_six_beyond_the_limit(spark):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(5):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for _ in range(40)}
    prints = sorted(prints)
    rows = [(p - ((p >> 63) << 64), i) for i, p in enumerate(prints)]
    links = link_fingerprints(spark.createDataFrame(rows, "fp long, rep long"), 6, 25).collect()
    assert all((prints[r.a] ^ prints[r.b]).bit_count() <= 6 for r in links)
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        a, b = sorted((find(r.a), find(r.b)))
        root[b] = a
    assert {i: find(i) for i in range(len(prints))} == plain_groups(range(len(prints)), prints, 6)


@pytest.mark.parametrize("radius", [9, 13])
def test_parts_cover_every_pattern_within_the_radius(radius):
    masks, rng = masks_within(list(range(64)), radius), random.Random(radius)
    assert all(masks) and len(set(masks)) == len(masks)
    for _ in range(2000):
        bits = rng.sample(range(64), radius)
        assert any(not any(m >> b & 1 for b in bits) for m in masks)
    few = masks_within(list(range(12)), 6)
    assert all(few) and all(any(not any(m >> b & 1 for b in bits) for m in few) for bits in itertools.combinations(range(12), 6))


def plain_similar(rows, width, least):
    """The smallest id linked to each, and the linked pairs, by the share of distinct shingles in common."""
    sets = {}
    for i, t in rows:
        words = (t or "").lower().split()
        sets[i] = frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))
    root, pairs = {i: i for i in sets}, []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if min(len(a), len(b)) >= least * max(len(a), len(b)) and (n := len(a & b)) >= least * (len(a) + len(b) - n):
            pairs.append((i, j))
            i, j = sorted((find(i), find(j)))
            root[j] = i
    return {i: find(i) for i in root}, pairs


def near_copies(seed=4):
    """Texts of 60 to 400 words, with copies of which a few words are replaced; two groups are large."""
    rng, words = random.Random(seed), [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(120):
        base = rng.choices(words, k=rng.randint(60, 400))
        rows.append(base)
        for _ in range(80 if g < 2 else rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.randint(1, max(2, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(copy)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_links_of_shared_shingles_against_brute_force(spark):
    rows = near_copies()
    roots, pairs = plain_similar(rows, 5, 0.8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash_groups(docs, width=5, radius=13, least=0.8).collect()}
    assert all(roots[i] == roots[got[i]] for i in roots)
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)
    assert sum(got[i] == roots[i] for i in roots) >= 0.95 * len(roots)


def test_texts_of_equal_majorities_are_no_copies(spark):
    rng = random.Random(8)
    rows = [(i, "la " * 400 + " ".join(f"w{rng.randrange(10**6)}" for _ in range(150))) for i in range(6)]
    rows += [(10, rows[0][1]), (11, rows[1][1].replace("la ", "la la ", 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash_groups(docs, width=5, radius=13, least=0.8).collect()}
    assert got == {i: i for i in range(6)} | {10: 0, 11: 1}


def test_links_behind_refused_ones_are_asked(spark):
    """Candidates all, some of one fingerprint; of few are the texts alike, whichever the forest asks first."""
    rng, n = random.Random(6), 60
    assert n > NEXT
    centre = rng.getrandbits(63)
    prints = [centre ^ sum(1 << b for b in rng.sample(range(40), rng.randint(0, 3))) for _ in range(n)]
    prints[10] = prints[11] = prints[12]
    group = {i: rng.randrange(12) for i in range(n)}
    rows = [(p, 0, i, i) for i, p in enumerate(prints)]
    same = spark.createDataFrame(list(group.items()), "id long, g long")

    def verify(links):
        return links.join(same.toDF("a", "x"), "a").join(same.toDF("b", "y"), "b").where("x = y").select("a", "b")

    contents = spark.createDataFrame(rows, "fp long, wide long, content long, rep long")
    links = verified_links(contents, verify, 6).collect()
    assert all(group[r.a] == group[r.b] for r in links)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        a, b = sorted((find(r.a), find(r.b)))
        root[b] = a
    assert all(find(i) == min(j for j in range(n) if group[j] == group[i]) for i in range(n))


def test_recall_in_the_lowest_shares(spark):
    """Pairs that share between 0.80 and 0.85 of their shingles, the hardest to find."""
    rng, words, rows = random.Random(12), [f"w{i}" for i in range(5000)], []
    for _ in range(150):
        base = rng.choices(words, k=200)
        copy = list(base)
        for at in rng.sample(range(5, 195), 4):
            copy[at] = rng.choice(words)
        rows += [base, copy]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    _, pairs = plain_similar(rows, 5, 0.8)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    low = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) < 0.85 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=5, radius=13, least=0.8).collect()}
    assert len(low) > 60 and sum(got[a] == got[b] for a, b in low) >= 0.9 * len(low)
    assert sum(i != c for i, c in got.items()) <= len(pairs)


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    expected = plain_groups([r.doc_id for r in rows], prints, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_groups(docs).collect()}
    assert got == {r.doc_id: (f"{p:016x}", expected[r.doc_id]) for r, p in zip(rows, prints)}


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(50_000))
    rows = [(4, None, 1, 2), (2, "", 1, 2), (None, "a b", 1, 2), (7, "a b", 1, 2), (9, "A  B", 1, 2), (9, "q r s t", 1, 2), (11, "q r s t", 1, 2), (12, long, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long, tbl long")
    got = sorted(((r.doc_id, r.component_id) for r in simhash_groups(docs).collect()), key=str)
    assert got == sorted([(4, 2), (2, 2), (None, None), (7, 7), (9, 7), (9, 7), (11, 7), (12, 12)], key=str)
    assert simhash_groups(docs.limit(0)).collect() == []
    verified = sorted(((r.doc_id, r.component_id) for r in simhash_groups(docs, least=0.8).collect()), key=str)
    assert verified == got and simhash_groups(docs.limit(0), least=0.8).collect() == []
    assert np.uint64(fingerprint(long.encode())) == plain_fingerprint(long)
