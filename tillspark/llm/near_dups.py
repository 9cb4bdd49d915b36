"""Near-duplicate documents by weighted Jaccard similarity of their word shingles, with BagMinHash signatures.

A document is the multiset of its runs of five words. Two are linked if the overlap of the multisets is at least 0.8 of
their union; groups are what links connect.

Signatures. Weights (how often a shingle occurs) are cut into strips [0,1), [1,2), [2,4), [4,8), ... Each strip of a
shingle is a Poisson process whose rate is the strip's width. A point has a time, one of the signature's slots, and a
cell of the strip, found by halving it with fair coins; it counts if the cell is below the document's weight. So
documents share exactly the points below the smaller weight, and the earliest point of a slot is the same for two
documents with a probability that equals their weighted Jaccard similarity, without bias. Times are followed only up to
where all slots are likely filled, and further for the documents where they are not; the work
per document is one step per shingle and a few hundred points, whatever the number of slots times shingles.

Candidates share all rows of a band. Every candidate is compared by texts, exactly, before it counts; only the groups matter, so
a bucket is never expanded into pairs. First all members of a bucket are compared with one leader. What is then still in
different groups of a bucket is compared inside of tasks, cut into chunks of bounded size: signatures as matrices, then one text
against all its candidates at once, leaving out what has been linked by then. A task sends links that connect its
groups, never pairs. A pair is compared in the first band it shares. A link with similarity 0.8 is missed by all bands
with probability 7e-5.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.llm.shared import ByWord, bitmap, bound_batches, components, has_bit, held
from tillspark.runtime import heavy_keys, materialize, materialize_counted, salted_join, scratch

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
#: Share of equal slots below which a pair is not read: six deviations under the expected 0.8.
LEAST_EQUAL = 0.58
#: Shingles of the texts of one chunk, about. A bucket of k chunks sends each row to k places.
CHUNK = 500_000
#: Rounds with a leader before the chunks are compared; one does if rows then go to so few places on average.
LEADER_ROUNDS, PLACES = 4, 8
#: Shingles whose signatures are made at once, about; a longer text is signed alone.
SIGNED_AT_ONCE = 1 << 17

_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def shingles(words: list[str]) -> np.ndarray:
    """Hashes of all runs of five words; a shorter text is one run."""
    known = held("word hashes", lambda: ByWord(xxhash.xxh64_intdigest))
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < WORDS:
        return _mix(np.cumsum(_mix(h) * _ODD + np.uint64(len(h)))[-1:])
    out = np.zeros(len(h) - WORDS + 1, dtype=np.uint64)
    for i in range(WORDS):
        out = _mix(out * _ODD + h[i:len(h) - WORDS + 1 + i])
    return out


def signatures(bags: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """A row of ``slots`` 32-bit names per bag of shingles; a bag must not be empty."""
    n = len(bags)
    sizes = np.array([len(b) for b in bags])
    doc = np.repeat(np.arange(n), sizes)
    flat = np.concatenate(bags)
    order = np.lexsort((flat, doc))
    flat, doc = flat[order], doc[order]
    new = np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])))
    element, owner, weight = flat[new], doc[new], np.diff(np.append(new, len(flat)))
    # One process per shingle and strip that its weight reaches.
    keys, docs, weights, lows, widths = [], [], [], [], []
    low, width = 0, 1
    live = np.arange(len(element))
    while len(live):
        keys.append(_mix(element[live] + np.uint64((low + 1) * int(_ODD) % 2**64)))
        docs.append(owner[live])
        weights.append(weight[live])
        lows.append(np.full(len(live), low))
        widths.append(np.full(len(live), width))
        low, width = low + width, max(width, low + width) if low else 1
        live = live[weight[live] > low]
    key, doc, weight, low, width = map(np.concatenate, (keys, docs, weights, lows, widths))
    best, name = np.full(n * slots, np.inf), np.zeros(n * slots, dtype=np.uint32)
    limit = slots * (np.log(slots) + 3) / sizes
    time, count = np.zeros(len(key)), np.zeros(len(key), dtype=np.uint64)
    todo = np.arange(len(key))
    waiting = np.zeros(len(key), dtype=bool)  # their next point lies beyond the limit so far
    while True:
        while len(todo):
            k, d = key[todo], doc[todo]
            draw = _mix(k + (count[todo] + np.uint64(1)) * _ODD)
            fresh = ~waiting[todo]
            time[todo[fresh]] += -np.log(_unit(draw[fresh])) / width[todo[fresh]]
            near = time[todo] <= limit[d]
            waiting[todo] = ~near
            todo, draw, d = todo[near], draw[near], d[near]
            cell = low[todo] + (_unit(_mix(draw + np.uint64(7))) * width[todo]).astype(np.int64)
            ok = cell < weight[todo]
            place = d[ok] * slots + (_mix(draw[ok] ^ _ODD) % np.uint64(slots)).astype(np.int64)
            np.minimum.at(best, place, time[todo][ok])
            wins = best[place] == time[todo][ok]
            name[place[wins]] = (_mix(draw[ok][wins] + np.uint64(13)) >> np.uint64(32)).astype(np.uint32)
            count[todo] += np.uint64(1)
        open_docs = np.isinf(best).reshape(n, slots).any(axis=1)
        if not open_docs.any():
            return name.reshape(n, slots)
        limit[open_docs] *= 1.5
        todo = np.flatnonzero(open_docs[doc])


def _signatures_of_all(bags: list[np.ndarray]) -> np.ndarray:
    """The same for any number of bags, a bounded number of shingles at once."""
    out, group, size = [np.zeros((0, SLOTS), np.uint32)], [], 0
    for bag in bags:
        if group and size + len(bag) > SIGNED_AT_ONCE:
            out.append(signatures(group))
            group, size = [], 0
        group.append(bag)
        size += len(bag)
    if group:
        out.append(signatures(group))
    return np.concatenate(out)


def counted(bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(bag, return_counts=True)


def overlaps(one: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarities of a bag, as different shingles and their counts, and others; none is empty."""
    flat, counts = np.concatenate([u for u, _ in others]), np.concatenate([n for _, n in others])
    starts = np.cumsum([0] + [len(u) for u, _ in others[:-1]])
    at = np.minimum(np.searchsorted(one[0], flat), len(one[0]) - 1)
    both = np.add.reduceat(np.where(one[0][at] == flat, np.minimum(one[1][at], counts), 0), starts)
    return both / (one[1].sum() + np.add.reduceat(counts, starts) - both)


def overlap(one: np.ndarray, other: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    a, n = np.unique(one, return_counts=True)
    b, m = np.unique(other, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = np.minimum(n[i], m[j]).sum()
    return float(shared / (len(one) + len(other) - shared)) if len(one) or len(other) else 0.0


_SIGNED = "doc_id long, t1 long, t2 long, digest binary, size long, bands array<long>, slots binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, bags = [], []
        for text in batch.column("text"):
            words = words_of(text.as_py())
            digests.append(hashlib.blake2b("\x1f".join(words).encode(), digest_size=16).digest())
            bags.append(shingles(words) if words else np.zeros(0, np.uint64))
        full = [i for i, b in enumerate(bags) if len(b)]
        names = _signatures_of_all([bags[i] for i in full])
        keyed = np.zeros((len(full), BANDS), dtype=np.uint64)
        for r in range(ROWS):
            keyed = _mix(keyed * _ODD + names[:, r::ROWS].astype(np.uint64))
        at = {i: k for k, i in enumerate(full)}
        short = names.astype(np.uint16)
        yield pa.RecordBatch.from_arrays([
            *(batch.column(c) for c in ("doc_id", "t1", "t2")), pa.array(digests, pa.binary()), pa.array([len(b) for b in bags], pa.int64()),
            pa.array([keyed[at[i]].astype(np.int64).tolist() if i in at else [] for i in range(len(bags))], pa.list_(pa.int64())),
            pa.array([short[at[i]].tobytes() if i in at else b"" for i in range(len(bags))], pa.binary()),
        ], names=["doc_id", "t1", "t2", "digest", "size", "bands", "slots"])


def _equal_share(one: pa.Array, other: pa.Array) -> pa.Array:
    a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(len(x), -1) for x in (one, other))
    return pa.array((a == b).mean(axis=1) if len(one) else np.zeros(0), pa.float64())


def _text_overlap(one: pa.Array, other: pa.Array) -> pa.Array:
    known: dict[str, np.ndarray] = {}

    def bag(text: str) -> np.ndarray:
        if text not in known:
            if len(known) > 64:
                known.clear()
            known[text] = shingles(words_of(text))
        return known[text]

    return pa.array([overlap(bag(a.as_py()), bag(b.as_py())) for a, b in zip(one, other)], pa.float64())


def _links(pairs: DataFrame, signed: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar: first by sizes and signatures, then by the texts themselves. Few b may have most pairs."""
    equal_share, text_overlap = F.arrow_udf(_equal_share, "double"), F.arrow_udf(_text_overlap, "double")
    side = lambda t, c: t.select(*(F.col(x).alias(f"{c}_{x}" if x != "id" else c) for x in t.columns))

    def with_sides(rows: DataFrame, table: DataFrame) -> DataFrame:
        # The same joins at every size: what is joined grows with the documents.
        heavy = heavy_keys(rows.groupBy("b").agg(F.count(F.lit(1)).alias("n")), ["b"], "n")
        return salted_join(rows.join(side(table, "a").hint("merge"), "a"), side(table, "b").hint("merge"), ["b"], ["a"], heavy=heavy)

    near = with_sides(pairs, signed).filter(F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size"))
    near = materialize(near.filter(equal_share("a_slots", "b_slots") >= LEAST_EQUAL).select("a", "b"))
    return with_sides(near, texts).filter(text_overlap("a_text", "b_text") >= similarity).select("a", "b")


def _linked(rows: list[tuple], similarity: float) -> Iterator[tuple[bytes, bytes]]:
    """Links that connect the groups of one cell. ``rows`` are (band, chunk, id, group, size, bands, slots, text)."""
    chunks = np.array([r[1] for r in rows])
    sizes = np.array([r[4] for r in rows])
    slots = np.frombuffer(b"".join(r[6] for r in rows), np.uint16).reshape(len(rows), -1)
    earlier = np.array([r[5] for r in rows], np.int64)[:, :rows[0][0]]
    number = {g: i for i, g in enumerate(dict.fromkeys(r[3] for r in rows))}
    group = np.array([number[r[3]] for r in rows])
    across = chunks.min() != chunks.max()
    bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bag(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in bags:
            bags[i] = counted(shingles(words_of(rows[i][7])))
        return bags[i]

    for i in range(len(rows) - 1):
        rest = np.arange(i + 1, len(rows))
        small, large = np.minimum(sizes[i], sizes[rest]), np.maximum(sizes[i], sizes[rest])
        rest = rest[(group[rest] != group[i]) & (small >= similarity * large) & ((chunks[rest] != chunks[i]) | (not across))]
        if len(rest):
            rest = rest[((slots[rest] == slots[i]).mean(axis=1) >= LEAST_EQUAL) & ~(earlier[rest] == earlier[i]).any(axis=1)]
        for first in range(0, len(rest), 256):
            some = rest[first:first + 256]
            some = some[group[some] != group[i]]
            if not len(some):
                continue
            found = overlaps(bag(i), [bag(int(j)) for j in some])
            for j in some[found >= similarity]:
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    yield rows[i][2], rows[int(j)][2]


def _compare(similarity: float):
    """Rows come sorted by cell; the links of each cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_rows: list[tuple] = []
        cell = None

        def links(rows: list[tuple]) -> pa.RecordBatch:
            pairs = list(_linked(rows, similarity)) if len({r[3] for r in rows}) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != cell:
                    if held_rows:
                        yield links(held_rows)
                    held_rows, cell = [], row[0]
                held_rows.append(row[1:])
        if held_rows:
            yield links(held_rows)

    return run


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, kept, text_1, text_2): one row per row of ``docs``; class_id is the smallest id of its group.

    Words are runs of letters, digits and underscores, in lower case. Texts with the same words are one group, compared
    with others once. A text of fewer than five words is one shingle. NULL texts, and texts without words, link with
    nothing. A row whose id is NULL links with nothing and is kept with a NULL class. A row is judged by its own text: rows that share
    an id may be in different groups. ``kept`` tells the rows with the id and the text that represent their group: the smallest
    id, and of the texts under it the one whose hashes, ``text_1`` and ``text_2``, are least. Other columns are ignored. No rows in,
    no rows out.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    full = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.xxhash64(full).alias("t1"), F.xxhash64(F.lit(1), full).alias("t2"), F.col(text).alias("text"))
    with scratch(spark) as job:
        signed = materialize(rows.mapInArrow(_sign, _SIGNED))
        some = signed.filter((F.col("size") > 0) & F.col("doc_id").isNotNull())
        # Equal texts are one node, named by the hash of their words.
        nodes = materialize(some.groupBy(F.col("digest").alias("id")).agg(
            F.min(F.struct("doc_id", "t1", "t2")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"),
            F.first("bands").alias("bands"), F.first("slots").alias("slots")))
        members = nodes.select("id", F.posexplode("bands").alias("band", "key"))
        bucket = ["band", "key"]
        shared = materialize(members.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        members = materialize(salted_join(members, shared.select(*bucket).hint("merge"), bucket, ["id"], "left_semi", heavy=heavy_keys(shared, bucket, "n")))
        wanted, n_wanted = materialize_counted(nodes.join(members.select("id").distinct().hint("merge"), "id", "left_semi").select("id", "first.t1", "first.t2"))
        sent = spark.sparkContext.broadcast(bitmap(wanted, n_wanted, F.col("t1")))
        read = F.arrow_udf(lambda t: pa.array(has_bit(sent.value, t.to_numpy())), "boolean")
        found_texts = rows.filter(F.col("text").isNotNull()).filter(read("t1")).groupBy("t1", "t2").agg(F.first("text").alias("text"))
        texts = materialize(wanted.join(found_texts.hint("merge"), ["t1", "t2"]).select("id", "text"))
        slim = nodes.select("id", "size", "slots")
        found, groups = None, None
        for turn in range(LEADER_ROUNDS + 1):
            labelled = members.withColumn("group", F.col("id")) if groups is None else members.join(groups, "id", "left").select(
                *bucket, "id", F.coalesce("component", "id").alias("group"))
            mixed = labelled.groupBy(*bucket).agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi")
            mixed = materialize(mixed.select(*bucket, "n"))
            open_rows = materialize(salted_join(labelled, mixed.select(*bucket).hint("merge"), bucket, ["id"], "left_semi", heavy=heavy_keys(mixed, bucket, "n"))
                                    .join(nodes.select("id", "size").hint("merge"), "id"))
            cells = materialize(open_rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("size") / CHUNK).cast("int").alias("k")))
            left = cells.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("k")).alias("places")).first()
            if not left.rows:
                break
            last = turn == LEADER_ROUNDS or turn > 0 and left.places <= PLACES * left.rows
            heavy = heavy_keys(cells, bucket, "n")
            if last:
                chunk = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
                cut = salted_join(open_rows, cells.select(*bucket, "k").hint("merge"), bucket, ["id"], heavy=heavy).withColumn("chunk", chunk)
                cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
                cell = F.xxhash64(*bucket, F.least("chunk", "other"), F.greatest("chunk", "other"))
                sides = nodes.select("id", "bands", "slots").join(texts, "id").hint("merge")
                cut = cut.join(sides, "id").select(
                    F.struct(cell.alias("cell"), *bucket, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")).alias("cell"),
                    "band", "chunk", "id", "group", "size", "bands", "slots", "text")
                new = cut.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(_compare(similarity), "a binary, b binary")
            else:
                # First one leader for all buckets of a crowd, which suits copies of one text; then one of each bucket's own.
                draw = F.xxhash64("id") if turn == 0 else F.xxhash64("id", *bucket, F.lit(turn))
                leaders = open_rows.groupBy(*bucket).agg(F.min_by(F.struct("id", "group"), F.struct(draw, "id")).alias("l"))
                pairs = salted_join(open_rows, leaders.hint("merge"), bucket, ["id"], heavy=heavy).filter(F.col("group") != F.col("l.group"))
                new = _links(materialize(pairs.select(F.col("id").alias("a"), F.col("l.id").alias("b")).distinct()), slim, texts, similarity)
            new, more = materialize_counted(new)
            found = new if found is None else found.unionByName(new)
            if more or groups is None:
                groups = materialize(components(found))
            if last:
                break
        named = nodes.select(F.col("id").alias("digest"), "first", "n", *(() if groups is not None else (F.col("id").alias("class"),)))
        if groups is not None:
            named = named.join(groups.withColumnRenamed("id", "digest"), "digest", "left").withColumn("class", F.coalesce("component", "digest")).drop("component")
        named = materialize(named)
        least = materialize(named.groupBy("class").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("nodes")))
        named = salted_join(named, least.select("class", "least"), ["class"], ["digest"], heavy=heavy_keys(least, ["class"], "nodes")).select("digest", "least", "n")
        named = materialize(named)
        told = salted_join(some.select("doc_id", "t1", "t2", "digest"), named.select("digest", "least"), ["digest"], ["doc_id"], heavy=heavy_keys(named, ["digest"], "n"))
        told = told.select("doc_id", F.col("least.doc_id").alias("class_id"), (F.struct("doc_id", "t1", "t2") == F.col("least")).alias("kept"), "t1", "t2")
        rest = signed.filter((F.col("size") == 0) | F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"), "t1", "t2")
        return job.keep(told.unionByName(rest).withColumnsRenamed({"t1": "text_1", "t2": "text_2"}))
