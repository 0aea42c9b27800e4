"""How far the sources of a language differ in their words, and which words set a source apart from its language.

Every language has a vocabulary of its own: the terms of at least ``min_docs`` of its documents. A ``CountVectorizer``
with that bound and the largest possible vocabulary learns it and turns terms into exact sparse vectors of counts; terms
are qualified by their language, so that one pass serves any number of languages. Terms are the runs of letters A to Z
and of characters from U+0080 on, only A to Z lower-cased.

The vectorizer's work is in its strings, so a task first merges some megabytes of its documents. What it learns from:
row j holds the terms of at least j of the merged documents, up to j = ``min_docs``, so that a term is in ``min_docs``
rows of all tasks if and only if it is in ``min_docs`` documents. What it counts: row b of a language and source holds
the terms whose number of occurrences there has binary digit b, and counts 2^b times.

Vocabularies travel through the driver and to every executor, so the terms are dealt by their hash into parts with a
bounded number of distinct terms each, every part is stored on its own, and the vectorizer runs once a part: the driver
holds one part's vocabulary at a time and each part is read alone.

The vectors are summed by language and source as sparse (group, term, count) rows. Pairs of sources are compared on
blocks of terms: a block holds only occurring counts, and a pair's sum comes from the terms that either source uses plus
one product for the terms that neither does. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promolift.llm.chunks import text_slices
from promolift.llm.common import drop_paths, map_batches, map_groups, new_path, written

MIN_DOCS = 10
TERMS_PER_PART = 1_000_000  # distinct terms a part may hold, rare ones included: about a seventh reach MIN_DOCS
MERGED_BYTES = 12 << 20  # of text, whose terms a task counts before they go to the vectorizer
ROW_TERMS = 8192  # in a row for the vectorizer
TOP_TERMS = 10
BLOCK_TERMS = 16_384
TILE_SOURCES = 128
LARGEST = 2**31 - 1

_GROUP = ["lang", "source"]
_INSIDE = bytes(65 <= byte <= 90 or 97 <= byte <= 122 or byte >= 128 for byte in range(256))
_OUTSIDE = bytes(byte for byte in range(256) if not _INSIDE[byte])
_FACTOR = 0x9E3779B97F4A7C15
_LOWER = bytes(byte + 32 if 65 <= byte <= 90 else byte for byte in range(256))


def _documents(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in (*_GROUP, "text")])


def terms_of(texts: pa.StringArray) -> pa.ListArray:
    """The terms of each text, by whole buffers of UTF-8: every byte above 0x7F belongs to a character of a term."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]].tobytes()
    offsets = offsets - offsets[0]
    inside = np.frombuffer(data.translate(_INSIDE), bool)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[begins] = inside[begins]  # a text does not continue the one before
    closes[begins[1:] - 1] = inside[begins[1:] - 1]
    opens = np.flatnonzero(opens)
    starts = np.zeros(len(opens) + 1, np.int32)
    np.cumsum(np.flatnonzero(closes) + 1 - opens, out=starts[1:])
    letters = data.translate(_LOWER, _OUTSIDE)
    terms = pa.Array.from_buffers(pa.string(), len(opens), [None, pa.py_buffer(starts), pa.py_buffer(letters)])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(opens, offsets), pa.int32()), terms)


def _qualified(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.ListArray, pa.Array, np.ndarray]]:
    """For each language of a slice: its rows, their terms, the distinct qualified terms and each term's place among
    them. A term holds no zero byte, so the last one in a qualified term ends its language."""
    for lang in pc.unique(batch.column("lang")):
        rows = batch.filter(pc.equal(batch.column("lang"), lang))
        terms = terms_of(rows.column("text"))
        numbered = terms.values.dictionary_encode()
        prefix = pa.scalar(lang.as_py() + "\0")
        distinct = pc.binary_join_element_wise(prefix, numbered.dictionary, "")
        yield rows, terms, distinct, numbered.indices.to_numpy()


def hashes(strings: pa.StringArray) -> np.ndarray:
    """A hash of each string's bytes, for dealing and estimates: a polynomial over all bytes, as differences of sums whose
    powers are divided away, then mixed."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets - offsets[0]
    powers, inverses = (
        np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(data), factor, np.uint64))))
        for factor in (_FACTOR, pow(_FACTOR, -1, 1 << 64))
    )
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    mixed = np.diff(sums[starts]) * inverses[starts[:-1]]
    for shift in (32, 29):
        mixed = (mixed ^ mixed >> np.uint64(shift)) * np.uint64(_FACTOR)
    return mixed ^ mixed >> np.uint64(32)


def _distinct_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the distinct qualified terms of each slice."""
    for batch in text_slices(batches):
        for _, _, distinct, _ in _qualified(batch):
            yield pa.RecordBatch.from_arrays([pa.array(hashes(distinct).view(np.int64))], ["digest"])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(keys)
    keys = keys[order]
    firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else order
    sums = np.add.reduceat(counts[order], firsts, dtype=np.int64) if len(keys) else counts.astype(np.int64)
    return keys[firsts], sums


class _Merge:
    """Terms of some documents: how many of the documents have each, and how often each language and source has it."""

    def __init__(self) -> None:
        self.bytes = 0
        self.groups: dict[tuple[str, str], int] = {}
        self.names: list[pa.Array] = [pa.array([], pa.string())]
        self.hashes = [np.zeros(0, np.uint64)]
        self.docs = [np.zeros(0, np.int64)]
        self.uses = [(np.zeros(0, np.int32),) * 3]
        self.seen = 0

    def add(self, batch: pa.RecordBatch) -> None:
        for rows, terms, distinct, places in _qualified(batch):
            size = max(1, len(distinct))
            document = np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
            found, counts = _summed(document * size + places, np.ones(len(places), np.int64))
            document, place = found // size, found % size
            pairs = zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist())
            group = np.array([self.groups.setdefault(pair, len(self.groups)) for pair in pairs], np.int64)
            used, counts = _summed(group[document] * size + place, counts)
            self.names.append(distinct)
            self.hashes.append(hashes(distinct))
            self.docs.append(np.bincount(place, minlength=len(distinct)))
            uses = (used // size, used % size + self.seen, counts)
            self.uses.append(tuple(values.astype(np.int32) for values in uses))
            self.seen += len(distinct)
        self.bytes += batch.column("text").nbytes

    def rows(self, parts: int, min_docs: int) -> Iterator[pa.RecordBatch]:
        numbered = pa.concat_arrays(self.names).dictionary_encode()
        distinct, codes = numbered.dictionary, numbered.indices.to_numpy().astype(np.int64)
        terms, docs = _summed(codes, np.concatenate(self.docs))
        part_of = np.zeros(len(distinct), np.int32)
        part_of[codes] = np.concatenate(self.hashes) % np.uint64(parts)
        size = max(1, len(distinct))
        used = np.concatenate([group * np.int64(size) + codes[place] for group, place, _ in self.uses])
        counts = np.concatenate([counts for _, _, counts in self.uses])
        self.names, self.docs, self.hashes, self.uses = [], [], [], []
        del numbered, codes
        used, counts = _summed(used, counts)
        group, place = used // size, used % size
        del used
        pairs = [*self.groups, ("", "")]  # the last for rows that stand for documents
        for part in range(parts):
            own = terms[part_of[terms] == part]
            for least in range(1, min_docs + 1):
                own = own[docs[own] >= least]
                if not len(own):
                    break
                yield self._lists(pairs, np.full(len(own), len(pairs) - 1), distinct.take(pa.array(own)), part, 0)
            own = np.flatnonzero(part_of[place] == part)
            digit = 0
            while len(own):
                here = own[counts[own] >> digit & 1 == 1]
                yield self._lists(pairs, group[here], distinct.take(pa.array(place[here])), part, 1 << digit)
                digit += 1
                own = own[counts[own] >> digit > 0]

    @staticmethod
    def _lists(
        pairs: list[tuple[str, str]], group: np.ndarray, terms: pa.Array, part: int, weight: int
    ) -> pa.RecordBatch:
        """Terms as lists of one group each, given in order of their groups."""
        within = np.arange(len(group)) - np.searchsorted(group, group)
        starts = np.flatnonzero(within % ROW_TERMS == 0)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(group)), pa.int32()), terms)
        langs, sources = (pa.array([pairs[number][k] for number in group[starts]], pa.string()) for k in range(2))
        columns = [langs, sources, lists, pa.array(np.full(len(starts), weight)), pa.array(np.full(len(starts), part, np.int32))]
        role = pa.array(["counts" if weight else "documents"] * len(starts), pa.string())
        return pa.RecordBatch.from_arrays([*columns, role], [*_GROUP, "terms", "weight", "part", "role"])


class _Tokenise:
    """Texts to lists of distinct qualified terms by part and role: ``documents`` to learn from, ``counts`` to count, each
    list ``weight`` times."""

    def __init__(self, parts: int, min_docs: int, merged_bytes: int):
        self.parts = parts
        self.min_docs = min_docs
        self.merged_bytes = merged_bytes

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = _Merge()
        for batch in text_slices(batches):
            merge.add(batch)
            if merge.bytes >= self.merged_bytes:
                yield from merge.rows(self.parts, self.min_docs)
                merge = _Merge()
        yield from merge.rows(self.parts, self.min_docs)


def _stored_terms(documents: DataFrame, min_docs: int, terms_per_part: int) -> tuple[DataFrame, str, list[int]]:
    """Merged documents' qualified terms, written to one folder a part and role."""
    spark = documents.sparkSession
    digests = map_batches(documents, _distinct_hashes, "digest long")
    parts = 1 + digests.agg(F.approx_count_distinct("digest")).first()[0] // terms_per_part
    schema = "lang STRING, source STRING, terms ARRAY<STRING>, weight LONG, part INT, role STRING"
    path = new_path(spark, "divergence-terms")
    tokenise = _Tokenise(parts, min_docs, MERGED_BYTES)
    map_batches(documents, tokenise, schema).write.partitionBy("part", "role").parquet(path)
    return spark.read.schema(schema).parquet(path), path, list(range(parts))


def _part_counts(spark: SparkSession, stored: DataFrame, part: int, min_docs: int) -> tuple[DataFrame | None, str | None]:
    """Counts by language, source and term of one part, and the folder they read; None where no term is kept."""
    own = stored.where(F.col("part") == part)
    vectorizer = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=LARGEST)
    try:
        model = vectorizer.fit(own.where("role = 'documents'").select("terms"))
    except IllegalArgumentException as error:
        if "vocabulary size should be > 0" not in str(error):
            raise
        return None, None
    path = new_path(spark, "divergence-vectors")
    model.write().save(f"{path}/model")
    rows = own.where("role = 'counts'").select(*_GROUP, "weight", "terms")
    model.transform(rows).select(*_GROUP, "weight", "vector").write.parquet(f"{path}/vectors")
    # A stored vector is a struct, whose fields Spark reads without the vector type.
    schema = "lang STRING, source STRING, weight LONG, vector STRUCT<indices: ARRAY<INT>, `values`: ARRAY<DOUBLE>>"
    vectors = spark.read.schema(schema).parquet(f"{path}/vectors")
    counts = (
        vectors.select(*_GROUP, "weight", F.expr("inline(arrays_zip(vector.indices, vector.`values`))"))
        .toDF(*_GROUP, "weight", "place", "count")
        .groupBy(*_GROUP, "place")
        .agg(F.sum(F.col("count").cast("long") * F.col("weight")).alias("count"))
    )
    vocabulary = spark.read.schema("vocabulary ARRAY<STRING>").parquet(f"{path}/model/data")
    names = vocabulary.select(F.posexplode("vocabulary").alias("place", "term")).select(
        "place", F.substring_index("term", "\0", -1).alias("term")
    )
    block = (F.lit(part).cast("long") * (1 << 20) + F.floor(F.col("place") / BLOCK_TERMS)).alias("block")
    return counts.join(names, "place").select(*_GROUP, "term", block, "place", "count"), path


def term_counts(frame: DataFrame, min_docs: int = MIN_DOCS, terms_per_part: int = TERMS_PER_PART) -> DataFrame:
    """Occurrences of each kept term by language and source, where there are any: lang, source, term, block, place (of
    the term in its block's vocabulary) and count. Written to the shared folder.

    Null lang, source and text count as empty; repeated rows count again; other columns are not read; an empty table and
    a table in which no term is kept give no rows.
    """
    spark = frame.sparkSession
    stored, path, parts = _stored_terms(_documents(frame), min_docs, terms_per_part)
    empty = spark.createDataFrame(
        [], "lang STRING, source STRING, term STRING, block LONG, place INT, count LONG"
    )
    counted = empty
    for part in parts:
        counts, read = _part_counts(spark, stored, part, min_docs)
        if counts is not None:
            counted = counted.unionByName(written(counts, f"divergence-counts-{part}")[0])
            drop_paths(spark, [read])
    drop_paths(spark, [path])
    return counted


def _probability(count: str) -> str:
    """p of a count, among ``total`` occurrences of ``kept`` terms: a long division, three digits at a time, so that no
    product outgrows a whole number before ``total`` reaches 9 * 10^15."""
    places, rest = [], f"({count} + 2)"
    for _ in range(3):
        places.append(f"({rest} * 1000) div (total + 2 * kept)")
        rest = f"(({rest} * 1000) % (total + 2 * kept))"
    return f"1 + (({places[0]}) * 1000 + {places[1]}) * 1000 + {places[2]}"


def _distance(p: str, q: str) -> str:
    return f"({p} - {q}) * ({p} - {q}) div ({p} + {q})"


def _between(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def block_sums(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Sums over one block of terms for every pair of two tiles of sources.

    Rows are (number, tile, unused, place, p): a source's number, its tile and its p of terms it does not use, and for
    each term that it does use, the term and its p. ``place`` is null in the one row that every source has.
    """
    lang, _, left_tile, right_tile = (part.as_py() for part in key)
    number, tile, unused, place, p = (
        rows.column(name).combine_chunks() for name in ("number", "tile", "unused", "place", "p")
    )
    used = place.is_valid().to_numpy(zero_copy_only=False)
    number, unused = number.to_numpy(), unused.to_numpy()
    sources, first = np.unique(number, return_index=True)
    unused, tile = unused[first], tile.to_numpy()[first]
    terms, column = np.unique(place.drop_null().to_numpy(), return_inverse=True)
    row = np.searchsorted(sources, number[used])
    ps = np.repeat(unused[:, None], len(terms), axis=1)
    ps[row, column] = p.drop_null().to_numpy()
    idle = np.ones(ps.shape, bool)
    idle[row, column] = False
    lefts = np.flatnonzero(tile == left_tile)
    rights = np.flatnonzero(tile == right_tile)
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    for left in lefts:
        against = rights[rights > left]
        own, idle_left = np.flatnonzero(~idle[left]), np.flatnonzero(idle[left])
        sums = _between(ps[left, own][None], ps[np.ix_(against, own)]).sum(axis=1)
        for at, right in enumerate(against):
            theirs = idle_left[~idle[right, idle_left]]
            neither = len(idle_left) - len(theirs)
            sums[at] += _between(unused[left], ps[right, theirs]).sum() + neither * _between(unused[left], unused[right])
        out.append((np.full(len(against), sources[left]), sources[against], sums))
    a, b, value = (pa.array(np.concatenate(values), pa.int64()) for values in zip(*out))
    return pa.table([pa.array([lang] * len(a), pa.string()), a, b, value], ["lang", "a", "b", "value"])


def audit(
    frame: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, terms_per_part: int = TERMS_PER_PART
) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: the divergence from each other source of the language;
    part ``term``: the ``top_terms`` terms by which the source's share is most above its language's.

    Null lang, source and text count as empty, a group without terms is compared as well, languages without kept terms
    have pairs of value 0, and an empty table gives an empty result. Equal values are ordered by the item's UTF-8 bytes.
    """
    counts = term_counts(frame, min_docs, terms_per_part)
    in_lang = Window.partitionBy("lang").orderBy("source")
    groups = _documents(frame).select(*_GROUP).distinct()
    by_term = counts.groupBy("lang", "block", "place").agg(F.sum("count").alias("lang_count"))
    by_term = written(by_term, "divergence-terms-of-languages")[0]
    langs = by_term.groupBy("lang").agg(F.sum("lang_count").alias("total"), F.count("*").alias("kept"))
    kept = langs.select("lang", "kept")
    totals = counts.groupBy(*_GROUP).agg(F.sum("count").alias("total"))
    numbered = (
        groups.join(totals, _GROUP, "left")
        .join(kept, "lang", "left")
        .fillna(0, ["total", "kept"])
        .withColumn("number", (F.row_number().over(in_lang) - 1).cast("long"))
        .withColumn("unused", F.when(F.col("kept") > 0, F.expr(_probability("0L"))))
    )
    numbered = written(numbered, "divergence-groups")[0]

    # Part term: each group's counts beside its language's.
    lang_p = by_term.join(langs, "lang").select("lang", "block", "place", F.expr(_probability("lang_count")).alias("q"))
    group_p = counts.join(numbered, _GROUP).withColumn("p", F.expr(_probability("count")))
    group_p = written(group_p.select(*_GROUP, "term", "block", "place", "number", "unused", "p"), "divergence-shares")[0]
    above = group_p.join(lang_p, ["lang", "block", "place"]).where("p > q")
    by_value = Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")
    terms = (
        above.select(*_GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_distance("p", "q")).alias("value"))
        .withColumn("rank", F.row_number().over(by_value))
        .where(F.col("rank") <= top_terms)
    )

    # Part pair: blocks of terms by tiles of sources; a source's row goes to each pair of tiles it is in.
    tiles = numbered.groupBy("lang").agg(F.floor(F.max("number") / TILE_SOURCES).alias("last_tile"))
    blocks = by_term.select("lang", "block").distinct().join(tiles, "lang")
    sentinels = numbered.where("kept > 0").join(blocks, "lang").selectExpr(
        "lang", "block", "number", "unused", "CAST(NULL AS INT) AS place", "CAST(NULL AS LONG) AS p", "last_tile"
    )
    used = group_p.join(tiles, "lang").select("lang", "block", "number", "unused", "place", "p", "last_tile")
    own = f"number div {TILE_SOURCES}"
    tiled = used.unionByName(sentinels).selectExpr(
        "lang", "block", "number", f"{own} AS tile", "unused", "place", "p",
        f"inline(transform(sequence(0L, last_tile), other -> struct(least(other, {own}), greatest(other, {own}))))",
    ).toDF("lang", "block", "number", "tile", "unused", "place", "p", "low_tile", "high_tile")
    by_block = tiled.groupBy("lang", "block", "low_tile", "high_tile")
    partial = map_groups(by_block, block_sums, "lang string, a long, b long, value long")
    sums = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = numbered.select("lang", "source", "number")
    other = numbered.select("lang", F.col("source").alias("item"), F.col("number").alias("other"))
    pairs = (
        one.join(other, "lang")
        .where("number <> other")
        .selectExpr("*", "least(number, other) AS a", "greatest(number, other) AS b")
        .join(sums, ["lang", "a", "b"], "left")
        .select(*_GROUP, F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
        .withColumn("rank", F.row_number().over(by_value))
    )
    return pairs.unionByName(terms)
