from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from promolift.llm import ngram_join, rtree, shingles
from promolift.llm.components import components
from tests.llm.helpers import documents

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """n_shingles and component of each row, by comparing all pairs."""
    sets = [shingle_set(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] == rows[j][0]
            shared = len(sets[i] & sets[j])
            linked = sets[i] and sets[j] and (same or 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared))
            if linked and rows[i][0] is not None and rows[j][0] is not None:
                root[find(i)] = find(j)
    out = []
    for i, (number, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        out.append((number, len(sets[i]), number if number is None else min(own)))
    return sorted(out, key=str)


def edited(text, share):
    words = text.split()
    return " ".join(random.choice("qwertz") * 3 if random.random() < share else word for word in words)


def made(n_groups, copies, length):
    random.seed(11)
    vocabulary = [f"w{n}" for n in range(300)]
    passage = " ".join(random.choices(vocabulary, k=30))
    rows = []
    for _ in range(n_groups):
        base = " ".join(random.choices(vocabulary, k=random.randint(1, length)))
        for _ in range(random.randint(1, copies)):
            text = edited(base, random.choice([0, 0, 0.01, 0.03, 0.06]))
            rows.append((len(rows), random.choice([text, text, text + " " + passage, text.upper()])))
    return rows


ODD = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "a"), (9005, "A"), (9006, "a b"), (None, "a"), (None, None), (9004, "a")]


@pytest.mark.parametrize("block, shingles_each, frequent", [(4096, 1 << 21, 32), (3, 1 << 21, 2), (4096, 500, 2)])
def test_against_brute_force(spark, monkeypatch, block, shingles_each, frequent):
    for name, value in (("BLOCK", block), ("BLOCK_SHINGLES", shingles_each), ("FREQUENT", frequent)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = made(60, 8, 200) + ODD + [(9010, "one two three four five six"), (9010, "seven eight nine ten eleven twelve"), (9011, "seven eight nine ten eleven twelve")]
    frame = documents(spark, rows)
    found = ngram_join.near_copies(frame)
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in found.collect()), key=str) == brute(rows)
    kept = ngram_join.keep_least(frame)
    leaves = {number for number, _, component in brute(rows) if number is not None and component < number}
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(n) for n, _ in rows if n not in leaves)


def test_empty_table(spark):
    assert ngram_join.near_copies(documents(spark, ODD).limit(0)).collect() == []
    assert len(ngram_join.near_copies(documents(spark, ODD[:3])).collect()) == 3


def test_shingle_counts_of_odd_texts():
    texts = ["", None, "a", "x " * 4, "é\u00a0b c d e f", "A\x0bb\x0cc\rd\te f", "w" * 3_000_000 + " a b c d e", "a b c d e " * 150_000]
    for text, found in zip(texts, shingles.shingle_sets(texts)):
        assert len(found) == len(shingle_set(text))


def _random_sets(seed, count, size):
    random = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        base = random.integers(0, 1 << 63, int(size * random.uniform(0.8, 1.2)), np.uint64)
        for _ in range(random.integers(1, 4)):
            keep = random.random(len(base)) < random.choice([1, 0.97, 0.9, 0.7])
            fresh = random.integers(0, 1 << 63, int((~keep).sum()), np.uint64)
            out.append(np.unique(np.concatenate((base[keep], fresh))))
    return [found for found in out if len(found)]


@pytest.mark.parametrize("size", [1, 9, 60, 300])
def test_no_link_is_lost_by_a_bound(size):
    sets = _random_sets(size, 60, size)
    sizes = np.array([len(found) for found in sets])
    for groups in (16, 64):
        bits = np.stack([rtree.bitmap(found, groups) for found in sets])
        assert (bits == rtree.folded(np.stack([rtree.bitmap(found, 256) for found in sets]), groups)).all()
        for labels in (np.arange(len(sets)), np.arange(len(sets)) % 7):
            points = rtree.Points(sizes, labels, bits)
            linked = np.zeros(len(sets), bool)
            for a in range(len(sets)):
                for b in range(a):
                    if labels[a] != labels[b] and ngram_join._links(sets[a], sets[b]):
                        linked[[a, b]] = True
            assert not (linked & ~rtree.meeting(points, None, 75)[0]).any()
            half = len(sets) // 2
            left, right = (rtree.Points(*(values[part] for values in points)) for part in (slice(half), slice(half, None)))
            meets = np.concatenate(rtree.meeting(left, right, 75))
            for a in range(half):
                for b in range(half, len(sets)):
                    if labels[a] != labels[b] and ngram_join._links(sets[a], sets[b]):
                        assert meets[a] and meets[b]


@pytest.mark.parametrize("size", [1, 9, 60, 300])
def test_links_span_all_components(size):
    sets = _random_sets(size + 1, 50, size)
    ids = np.arange(len(sets)) + 100
    for sides in (np.zeros(len(sets), np.int8), (np.arange(len(sets)) % 2 + 1).astype(np.int8)):
        found = ngram_join.SpanningLinks(ids, ids, sides, sets).find()
        root, wanted = {n: n for n in ids.tolist()}, {n: n for n in ids.tolist()}

        def top(of, n):
            while of[n] != n:
                n = of[n]
            return n

        for a, b in found:
            assert top(root, a) != top(root, b)
            root[top(root, a)] = top(root, b)
        for a in range(len(sets)):
            for b in range(a):
                if (not sides.any() or sides[a] != sides[b]) and ngram_join._links(sets[a], sets[b]):
                    wanted[top(wanted, 100 + a)] = top(wanted, 100 + b)
        groups = lambda of: sorted(sorted(n for n in of if top(of, n) == r) for r in of if of[r] == r)
        assert groups(root) == groups(wanted)


@pytest.mark.parametrize("words, edits", [(60, 1), (60, 2), (40, 1), (30, 1), (200, 3), (200, 6)])
def test_verified_pairs_grow_with_the_group_and_not_with_its_square(words, edits):
    random.seed(1)
    base = [f"w{random.randrange(5000)}" for _ in range(words)]
    counts = {}
    for size in (200, 400, 800):
        texts = []
        for _ in range(size):
            text = list(base)
            for place in random.sample(range(words), edits):
                text[place] = f"x{random.randrange(10**6)}"
            texts.append(" ".join(text))
        sets = shingles.shingle_sets(texts)
        links = ngram_join.SpanningLinks(np.arange(size), np.arange(size), np.zeros(size, np.int8), sets)
        links.find()
        counts[size] = links.verified
    assert all(verified <= 12 * size for size, verified in counts.items()), counts  # of size * (size - 1) / 2 pairs


def test_components(spark):
    random.seed(4)
    links = [(random.randint(0, 150), random.randint(0, 150)) for _ in range(90)] + [(n, n + 1) for n in range(200, 260)] + [(7, 7), (7, None), (3, 1), (1, 3)]
    root = {n: n for pair in links for n in pair if n is not None}
    for _ in root:
        for a, b in links:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    alone = {n for n in root if not any(n in pair and pair[0] != pair[1] and None not in pair for pair in links)}
    found = components(spark.createDataFrame(links, "a INT, b INT"))
    assert {row.node: row.component for row in found.collect()} == {n: r for n, r in root.items() if n not in alone}
    assert components(spark.createDataFrame([], "a STRING, b STRING")).collect() == []


def test_entries_stay_that_have_a_partner_of_their_size_in_their_cell():
    random = np.random.default_rng(5)
    for _ in range(60):
        count = int(random.integers(0, 60))
        cells = random.integers(0, 12, count).astype(np.uint64)
        sizes, partners = (random.integers(100, 110, count).astype(np.uint8) for _ in range(2))
        meets = (cells[:, None] == cells) & (sizes[:, None] <= partners) & (sizes <= partners[:, None])
        np.fill_diagonal(meets, False)
        assert ngram_join.partnered(cells, sizes, partners).tolist() == meets.any(1).tolist()


def test_linked_sets_are_partners_in_the_cell_of_their_first_common_shingle():
    random = np.random.default_rng(6)
    seen = 0
    for _ in range(3000):
        union = random.permutation(int(random.integers(1, 60)))
        cut, shared = len(union) - len(union) * 3 // 4, int(random.integers(0, len(union) + 1))
        sets = [np.sort(union[: len(union) - cut + shared]), np.sort(union[int(random.integers(0, cut + 1)) :])]
        common = np.intersect1d(*sets)
        if not len(common) or 100 * len(common) < 75 * len(np.union1d(*sets)):
            continue
        seen += 1
        n, m = map(len, sets)
        i, j = (np.searchsorted(found, common[:1]) for found in sets)
        assert i[0] < n - -(-75 * n // 100) + 1 and j[0] < m - -(-75 * m // 100) + 1
        assert m <= ngram_join.largest_partner(np.array([n]), i)[0] and n <= ngram_join.largest_partner(np.array([m]), j)[0]
    assert seen > 300


def test_points_that_share_only_late_shingles_do_not_meet():
    """Equal sizes, common first shingle behind a fifth of both sets: no link is possible, and no row is made."""
    found = [np.arange(100, dtype=np.uint64) + 1000 * (k + 1) for k in range(2)]
    for own in found:
        own[20:25] = np.arange(5, dtype=np.uint64) + 10
    first = [ngram_join._planes(own[:26], ngram_join.CELL_BYTES) for own in found]
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "n_shingles": [100, 100], "first": first})
    dealt = list(ngram_join._Deal(1)(iter([batch])))
    assert sum(part.num_rows for part in ngram_join._neighbours(iter(dealt))) == 0
