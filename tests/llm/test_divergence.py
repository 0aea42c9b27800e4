from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from promolift.llm import divergence
from tests.llm.helpers import DOCUMENTS, rows

NAMES = ("lang", "source", "part", "item", "value", "rank")
WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(documents, min_docs, top):
    """Everything written out densely: (text, lang, source) rows."""
    out = []
    documents = [tuple(value or "" for value in row) for row in documents]
    for lang in {row[1] for row in documents}:
        own = [(WORD.findall(text.translate(LOWER)), source) for text, of, source in documents if of == lang]
        within = Counter(term for terms, _ in own for term in set(terms))
        kept = [term for term, count in within.items() if count >= min_docs]
        counts = defaultdict(Counter)
        for terms, source in own:
            counts[source].update(terms)
        whole = sum(counts.values(), Counter())

        def shares(count):
            total = sum(count[term] for term in kept)
            return {term: 1 + 1_000_000_000 * (count[term] + 2) // (total + 2 * len(kept)) for term in kept}

        between = lambda p, q: (p - q) ** 2 // (p + q)
        ps, qs = {source: shares(count) for source, count in counts.items()}, shares(whole)
        for source in counts:
            found = {
                "pair": [(sum(between(ps[source][t], ps[o][t]) for t in kept), o) for o in counts if o != source],
                "term": [
                    (between(ps[source][t], qs[t]), t) for t in kept if counts[source][t] and ps[source][t] > qs[t]
                ],
            }
            for part, items in found.items():
                ranked = sorted(items, key=lambda item: (-item[0], item[1].encode()))
                ranked = ranked if part == "pair" else ranked[:top]
                out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def frame(spark, documents):
    full = [(k, text, lang, source, 1, "x", None, 7, "y") for k, (text, lang, source) in enumerate(documents)]
    return spark.createDataFrame(full, DOCUMENTS + ", term STRING, part STRING, block INT, rank STRING").repartition(3)


TABLE = [
    ("The Äpfel the äpfel 4four", "de", "a"), ("the cat", "de", "b"), ("cat CAT cat", "de", "b"), (None, "de", "c"),
    ("", None, None), ("the the cat", None, "a"), ("日本 日本 the", None, "b"), ("the cat 日本", None, None),
    ("once", "xx", "a"), ("words only", "xx", "b"), ("a b c d e f g", "en", "a"), ("a b c d e f g", "en", "a"),
    ("b a a", "en", "\x00odd\x00"), ("G F e", "en", "b"), ("İ ǅ ß", "en", "b"), ("İ", "e\x00n", "b"), ("İ x", "e\x00n", "c"),
]


@pytest.mark.parametrize("most", [1_000_000, 7])
def test_equals_the_written_out_sums(spark, most):
    found = divergence.audit(frame(spark, TABLE), min_docs=2, top_terms=2, terms_per_part=most)
    assert rows(found, *NAMES) == expected(TABLE, 2, 2)
    assert dict(found.dtypes)["value"] == "bigint" and dict(found.dtypes)["rank"] == "int"


def test_sources_in_several_tiles_and_terms_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 3)
    words = [f"w{chr(97 + k)}" for k in range(26)]
    table = [(" ".join(words[k % 7 : k % 11 + 9] * (k % 3 + 1)), "en", f"s{k % 5}") for k in range(40)]
    assert rows(divergence.audit(frame(spark, table), min_docs=3), *NAMES) == expected(table, 3, 10)


def test_a_third_of_the_rows_in_one_group_and_a_very_long_text(spark):
    table = [("common words here", "en", "hot")] * 40 + [(f"own{chr(97 + k)} common", "en", f"s{k % 4}") for k in range(20)]
    table += [("common long " * 60_000, "en", "s1"), ("x" * 400_000, "en", "s2")]
    assert rows(divergence.audit(frame(spark, table)), *NAMES) == expected(table, 10, 10)


@pytest.mark.parametrize("table", [[], [("one text", "en", "a")], [(None, None, None), (None, None, "b")]])
def test_tables_without_kept_terms(spark, table):
    assert rows(divergence.audit(frame(spark, table)), *NAMES) == expected(table, 10, 10)


def test_merged_rows_decide_as_documents_do_and_hold_fewer_terms():
    texts = ["common ab ab", "common ab", "common cd", "common cd cd cd", "common", "ef", "ef"] * 20
    columns = [pa.array([name] * len(texts)) for name in ("en", "s")]
    batch = pa.RecordBatch.from_arrays([*columns, pa.array(texts)], ["lang", "source", "text"])
    for merged, batches in ((1, [batch.slice(0, 70), batch.slice(70)]), (1 << 20, [batch])):
        seen, counted, held = Counter(), Counter(), 0
        for made in divergence._Tokenise(3, 45, merged)(iter(batches)):
            for row in made.to_pylist():
                assert len(set(row["terms"])) == len(row["terms"])
                (seen if row["role"] == "documents" else counted).update(
                    {term: row["weight"] or 1 for term in row["terms"]}
                )
                held += len(row["terms"]) if row["role"] == "counts" else 0
        assert counted == {"en\0" + t: n for t, n in Counter(" ".join(texts).split()).items()}
        within = Counter(term for text in texts for term in set(text.split()))
        assert {term for term in seen if seen[term] >= 45} == {"en\0" + term for term in within if within[term] >= 45}
        assert held < 25  # 240 occurrences


def test_hashes_tell_terms_apart_wherever_they_stand():
    names = [f"en\0{chr(97 + k % 26)}{k}é" for k in range(50_000)]
    found = divergence.hashes(pa.array(names))
    assert len(set(found.tolist())) == len(names)
    assert divergence.hashes(pa.array(names)[777:]).tolist() == found[777:].tolist()
    assert sorted(found % 3).count(0) == pytest.approx(len(names) / 3, rel=0.05)
