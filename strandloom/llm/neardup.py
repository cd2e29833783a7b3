"""Near duplicates by one-permutation hashing with optimal densification, banded buckets and star-shaped candidates.

A document's set holds its distinct word shingles (64-bit hashes). One hash per shingle fills ``bands * rows`` bins; an
empty bin takes the value of a bin chosen by universal hashing over its own number, so that the choice is independent
for every bin. ``rows`` bins form a band; a band's key names a bucket. Documents with equal sets are one class first.

Candidates are stars: every member of a bucket is paired with the bucket's smallest id, so a bucket of n gives n - 1
pairs. Links are confirmed on the full sets (100 * intersection >= threshold * union) in three steps, and components
are taken after each: each document with the star centre it shares most buckets with; the other star pairs whose ends
are still apart; and, so that no link is lost to a centre that is like neither of two documents, documents of a bucket
whose components are still apart are compared with one another. Large buckets are dealt anew by rare shingles for that:
of two sets at the threshold, the rarest ``n - ceil(threshold * n) + 1`` shingles of each meet in one at least, so what
makes a bucket large, a passage that many texts hold, no longer brings them together; where even such a group is large
it is compared block by block. Nothing is capped or sampled. At similarity 0.8 a pair shares no bucket with a
probability of (1 - 0.8^5)^36 < 1e-6.

Classes are nodes with numbers of their own; the smallest ids come in at the end. Rows that repeat an id count as one
document: each of their sets is a class, all these classes are linked, and all rows are returned.

Defined results: texts that are null, empty or without words have an empty set, stand alone under their own id and link
nothing; fewer words than a shingle make one shingle of the whole sequence; a null ``doc_id`` stands alone with a null
component and is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, staged

BANDS = 36
ROWS = 5
THRESHOLD = 80
CACHE_WORDS = 150_000
#: The bitmap that screens the documents for candidates has 2 to this power bits.
SCREEN_BITS = 24
#: Buckets from this size on are compared block by block; a block holds about so many documents, or fewer that have about
#: so many shingles together.
LARGE = 48
BLOCK = 512
BLOCK_SHINGLES = 1 << 19
#: Links that a task writes in a round of the components, about.
PART_LINKS = 1 << 13
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that never broadcasts it.

    A file's size on disk says little of its rows in memory: numbers in order take a byte or two each in Parquet, and some
    50 bytes in a hash table, which the driver would collect and hold once for each of the many joins.
    """
    return df.hint("merge")


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = out
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """text -> sorted distinct shingle hashes. ``bytes.lower`` and ``bytes.split`` know ASCII letters and blanks only."""

    def __init__(self, words: int):
        self.n, self.words = words, _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not parts:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, parts), np.uint64, len(parts))
        n = min(self.n, len(h))
        x = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            x = mix((x ^ h[j : len(h) - n + 1 + j]) * _M1 + np.uint64(j))
        return np.unique(x)


class Sketch:
    """Band keys of a set."""

    def __init__(self, bands: int, rows: int, seed: int = 11, tries: int = 64):
        self.bands, self.rows, self.k = bands, rows, bands * rows
        rng = np.random.default_rng(seed)
        self.detour = rng.integers(0, self.k, (tries, self.k))
        self.salt = mix(np.arange(1, self.k + 1, dtype=np.uint64) * _M1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        # Sorted values: the top bits give the bin, and the first value of each bin is its minimum.
        bins = ((shingles >> np.uint64(32)) * np.uint64(self.k)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        out = np.zeros(self.k, np.uint64)
        full = np.zeros(self.k, bool)
        own = bins[first].astype(np.int64)
        out[own], full[own] = shingles[first], True
        empty = np.flatnonzero(~full)
        for step in self.detour:
            if not len(empty):
                return out
            to = step[empty]
            hit = full[to]
            out[empty[hit]] = out[to[hit]]
            empty = empty[~hit]
        for i in empty:
            out[i] = out[own[np.searchsorted(own, i) % len(own)]]
        return out

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        x = mix(self.signature(shingles) ^ self.salt).reshape(self.bands, self.rows)
        key = np.arange(self.bands, dtype=np.uint64)
        for j in range(self.rows):
            key = mix(key * _M1 + x[:, j])
        return key.view(np.int64)


def set_digest(shingles: np.ndarray) -> str | None:
    return xxhash.xxh3_128_hexdigest(shingles.tobytes()) if len(shingles) else None


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit digest of the set; null if empty), keys: a row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketch = Shingler(words), Sketch(bands, rows)
        for batch in batches:
            n, digests, keys = [], [], []
            for text in batch.column(1):
                s = shingler(text.as_py())
                n.append(len(s))
                digests.append(set_digest(s))
                keys.append(sketch.keys(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "keys"])

    return docs.mapInArrow(lean(run), "doc_id long, n_shingles long, set_key string, keys array<long>")


def screened(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (doc_id), and few others.

    What is broadcast is a bitmap of hashed ids, 2 MB however many they are; the more there are, the more others pass.
    The first 12 bits of a hash name a row of the bitmap, 6 further ones a word in it and the last 6 the word's bit.
    """
    top = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - SCREEN_BITS)
    part, word, bit = F.shiftright(top, 12), F.shiftright(top, 6).bitwiseAND(63).cast("int"), top.bitwiseAND(63).cast("int")
    words = ids.select(part.alias("_part"), word.alias("word"), bit.alias("bit")).groupBy("_part", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    held = words.groupBy("_part").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    bitmap = held.select("_part", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.col("held")[i], F.lit(0).cast("long"))).alias("_bits"))
    return docs.join(F.broadcast(bitmap), (part == F.col("_part")) & (F.getbit(F.col("_bits")[word], bit) == 1), "left_semi")


def class_texts(docs: DataFrame, wanted: DataFrame, repeated: DataFrame, words: int) -> DataFrame:
    """class_id, text for the classes ``wanted`` (class_id, rep, set_key): one of the texts that have the class's set.

    A representative's id leads to its text; where rows repeat that id with other sets, the text's own set decides. The
    ids meet the texts in a shuffle, of screened texts only, so nothing on the driver grows with their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            right = [not again or set_key == set_digest(shingler(text.as_py())) for again, set_key, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["class_id", "text"]).filter(pa.array(right, pa.bool_()))

    marked = wanted.join(shuffled(repeated.select(F.col("doc_id").alias("rep"), F.lit(True).alias("again"))), "rep", "left").select(F.col("rep").alias("doc_id"), "class_id", F.when(F.col("again"), F.col("set_key")).alias("set_key"), F.coalesce("again", F.lit(False)).alias("again"))
    marked = staged(marked, "wanted-texts")
    return screened(docs, marked).join(shuffled(marked), "doc_id").select("class_id", "text", "again", "set_key").mapInArrow(lean(run), "class_id long, text string").dropDuplicates(["class_id"])


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """The pairs (a, b) that are links by their full sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held = Shingler(words), OrderedDict()

        def shingles(i: int, text: str) -> np.ndarray:
            if i in held:
                held.move_to_end(i)
            else:
                held[i] = shingler(text)
                if len(held) > 32:
                    held.popitem(last=False)
            return held[i]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i in range(len(a)):
                x, y = shingles(b[i], batch.column(3)[i].as_py()), shingles(a[i], batch.column(2)[i].as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    left = pairs.join(shuffled(texts.withColumnsRenamed({"class_id": "a", "text": "text_a"})), "a")
    both = left.join(shuffled(texts.withColumnsRenamed({"class_id": "b", "text": "text_b"})), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(lean(check), "a long, b long")


def linked_blocks(buckets: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """Links (a, b) that join the components within large buckets (key, class_id, component, size, weight).

    A bucket is cut into blocks of about ``BLOCK`` documents, more blocks if the texts are long (weight: the shingles of
    all its documents), and two blocks meet in a task, which counts all intersections at once as a product of incidence matrices, so no pair of documents becomes a row. What a task
    returns is a spanning forest over the components that it saw: at most one link for each document.
    """

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingler(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["class_id", "shingles"])

    def met(table: pa.Table) -> pa.Table:
        ids, comp = table.column("class_id").to_numpy(), table.column("component").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        sizes = np.array([len(s) for s in sets])
        _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = df[column] > 1
        row, (kept, column) = row[shared], np.unique(column[shared], return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, len(kept), 2048):
            lo, hi = np.searchsorted(column, [at, at + 2048])
            m = np.zeros((len(sets), min(2048, len(kept) - at)), np.float32)
            m[row[lo:hi], column[lo:hi] - at] = 1.0
            both += m @ m.T
        both = both.astype(np.int64)
        linked = (both > 0) & (100 * both >= threshold * (sizes[:, None] + sizes[None, :] - both))
        linked &= comp[:, None] != comp[None, :]
        top = {c: c for c in comp.tolist()}

        def root(c: int) -> int:
            while top[c] != c:
                top[c] = c = top[top[c]]
            return c

        out = []
        for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
            p, q = root(int(comp[i])), root(int(comp[j]))
            if p != q:
                top[max(p, q)] = min(p, q)
                out.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    sets = texts.join(shuffled(buckets.select("class_id").distinct()), "class_id", "left_semi").select("class_id", "text").mapInArrow(lean(shingled), "class_id long, shingles binary")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.least(F.col("size"), F.ceil(F.col("weight") / BLOCK_SHINGLES))).cast("int")
    own = F.pmod(F.xxhash64("class_id"), blocks).cast("int")
    dealt = buckets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "class_id", "component")
    return dealt.join(shuffled(sets), "class_id").groupBy("key", "lo", "hi").applyInArrow(met, "a long, b long")


def components(edges: DataFrame, n: int | None = None) -> DataFrame:
    """node, component (its smallest reachable node) for every node of the undirected edges (a, b), ``n`` of them if given.

    Alternates large-star and small-star rounds until nothing changes; each round is a few aggregations by node. What a
    round writes are distinct pairs, in parts by their number instead of one for each partition of a shuffle.
    """

    def links(pairs: DataFrame, n: int | None) -> DataFrame:
        pairs = pairs.filter("a <> b").distinct()
        return staged(pairs if n is None else pairs.coalesce(max(1, -(-n // PART_LINKS))), "links")

    edges = links(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), n)
    was = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if tuple(mark) == was:
            break
        was = tuple(mark)
        if not mark.n:
            break
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(shuffled(low), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(shuffled(small_low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_low.select("a", F.col("m").alias("b")))
        edges = links(small, mark.n)
    # Stars by now: no centre has an edge to a smaller node.
    return edges.select("a", "b").union(edges.select("b", "b")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components so far (node, component) joined by further links (a, b) between documents."""
    if labels is None:
        return staged(components(links), "components")
    joined = _labelled(links, labels).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    top = components(joined, links.count()).select(F.col("node").alias("component"), F.col("component").alias("top"))
    nodes = labels.union(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(shuffled(labels), "node", "left_anti").select("node", F.col("node").alias("component")))
    return staged(nodes.join(shuffled(top), "component", "left").select("node", F.coalesce("top", "component").alias("component")), "components")


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs with the components ca and cb of their ends."""
    for end in ("a", "b"):
        pairs = pairs.join(shuffled(labels.select(F.col("node").alias(end), F.col("component").alias("c" + end))), end, "left").withColumn("c" + end, F.coalesce("c" + end, end))
    return pairs


def rare_buckets(buckets: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """(key, size, weight, class_id, n, component) of large buckets' documents by their rare shingles, where several
    components meet.

    Shingles are ordered by the number of these documents that hold them; those of one document alone take places in
    its prefix but make no group.
    """

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingler(t.as_py()).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))], names=["class_id", "shingles"])

    nodes = buckets.select("class_id", "n", "component").distinct()
    sets = staged(texts.join(shuffled(nodes), "class_id", "left_semi").select("class_id", "text").mapInArrow(lean(shingled), "class_id long, shingles array<long>"), "large-sets")
    held = sets.select("class_id", F.explode("shingles").alias("key"))
    common = held.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    shared = held.join(shuffled(common), "key").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("shared"))
    places = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1 - (F.col("n") - F.size("shared"))
    prefix = shared.join(shuffled(nodes), "class_id").filter(places > 0).withColumn("key", F.explode(F.slice("shared", F.lit(1), places.cast("int"))))
    rows = staged(prefix.select(F.col("key.key").alias("key"), "class_id", "n", "component"), "rare-shingles")
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.sum("n").alias("weight")).filter("lo < hi").select("key", "size", "weight")
    return rows.join(shuffled(mixed), "key")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = staged(sketches(docs, words, bands, rows), "sketches")
    sets = found.filter("doc_id is not null and set_key is not null")
    grouped = sets.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    # Written once, so the numbers stay what they are.
    classes = staged(grouped.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    repeated = staged(sets.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).filter("lo < hi").select("doc_id"), "repeated-ids")

    # Buckets of distinct sets; those with one member go.
    spread = classes.select("class_id", "n", F.explode("keys").alias("key"))
    centres = spread.groupBy("key").agg(F.min("class_id").alias("centre"), F.max("class_id").alias("last"), F.min_by("n", "class_id").alias("centre_n")).filter("centre < last").drop("last")
    members = staged(spread.join(shuffled(centres), "key"), "buckets")
    alike = lambda x, y: 100 * F.least(x, y) >= threshold * F.greatest(x, y)
    stars = staged(
        members.filter("class_id <> centre").groupBy(F.col("class_id").alias("a"), F.col("centre").alias("b")).agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("centre_n").alias("m")).filter(alike(F.col("n"), F.col("m"))).select("a", "b", "shared"),
        "stars",
    )
    ids = members.select("class_id").distinct()
    texts = staged(class_texts(docs, classes.select("class_id", "rep", "set_key").join(shuffled(ids), "class_id", "left_semi"), repeated, words), "candidate-texts")

    best = stars.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b"))
    of_repeated = sets.join(shuffled(repeated), "doc_id", "left_semi").select("doc_id", "set_key").join(shuffled(classes.select("set_key", "class_id")), "set_key").select("doc_id", "class_id")
    same_id = of_repeated.join(shuffled(of_repeated.groupBy("doc_id").agg(F.min("class_id").alias("b"))), "doc_id").select(F.col("class_id").alias("a"), "b").filter("a <> b")
    labels = _merged(None, confirmed(best, texts, words, threshold).union(same_id))
    rest = _labelled(stars.join(shuffled(best), ["a", "b"], "left_anti").select("a", "b"), labels).filter("ca <> cb").select("a", "b")
    # Distinct, so the few links that the many tasks find are shuffled and not a file for each of them.
    labels = _merged(labels, staged(confirmed(rest, texts, words, threshold).distinct(), "confirmed"))

    # Buckets whose members still lie in several components.
    placed = members.join(shuffled(labels.select(F.col("node").alias("class_id"), "component")), "class_id", "left").select("key", "class_id", "n", F.coalesce("component", "class_id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).filter("lo < hi").select("key", "size")
    apart = staged(placed.join(shuffled(mixed), "key"), "mixed-buckets")
    rare = staged(rare_buckets(apart.filter(F.col("size") >= LARGE), texts, words, threshold), "rare-buckets")

    def met(buckets: DataFrame) -> DataFrame:
        x, y = buckets.select("key", F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca")), buckets.select("key", F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
        return x.join(shuffled(y), "key").filter((F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & alike(F.col("na"), F.col("nb"))).select("a", "b")

    pairs = met(apart.filter(F.col("size") < LARGE)).union(met(rare.filter(F.col("size") < LARGE))).distinct().join(shuffled(stars), ["a", "b"], "left_anti")
    links = confirmed(pairs, texts, words, threshold).union(linked_blocks(rare.filter(F.col("size") >= LARGE), texts, words, threshold))
    labels = _merged(labels, staged(links.distinct(), "confirmed"))

    placed = classes.select("set_key", "rep", "class_id").join(shuffled(labels.select(F.col("node").alias("class_id"), "component")), "class_id", "left").select("set_key", "rep", F.coalesce("component", "class_id").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = placed.join(shuffled(smallest), "component").select("set_key", "component_id")
    out = found.join(shuffled(of_class), "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
