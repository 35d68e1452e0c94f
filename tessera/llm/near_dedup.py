"""Near-duplicate detection: MinHash signatures in a multi-index Hamming join.

A document's signature has 32 symbols of b = 14 bits (the low bits of a MinHash each), its
distance to another is the number of differing symbols. The signature is split into 8 chunks of 4
symbols. By the pigeonhole principle, two signatures at a distance of up to 15 have a chunk that differs in one
symbol at most; so each chunk is filed under its four keys that leave out one symbol, and
such pairs meet under a key. Pairs that meet and may reach the similarity are confirmed on their full
sets of shingles. What they may reach is bounded by their sizes, by the signatures' distance and by a parity
bitmap: bit i says whether an odd number of a set's hashes fall on i, so two bitmaps differ in
at most as many bits as their sets do in elements, and no pair with the similarity is lost there.

Documents of equal sets are one class, and the join runs over classes. Under each key
all members are first held against the smallest one, so a large group of near copies costs as
many pairs as it has members. Components of these links come next. Where a key still holds several of them (its smallest
member was none of the group: it shares a passage with it, say), its members are held against one drawn by hash, a few times
over; then only members that are still in different components are held against one another. Where many are left in a key (texts that share a
long passage, say, and nothing else) they meet again by their rarest shingles: two sets of the similarity share one of the
rarest quarter of each. What is still crowded is dealt in blocks, so no task holds a group whole. No pair that meets
and may be a link goes untested.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, discard, keep, mixed, text_bytes, tidy, word_hashes

WORDS, PERCENT = 5, 75
CHUNKS, LANES, BITS = 8, 4, 14
#: Longs in the parity bitmap of a set.
PARITY = 16
#: Up to so many members a key's pairs cost less (some 20 ns each for the bitmaps) than spreading their shingles; beyond, they meet by rare shingles.
#: Either way keys are dealt in blocks; two blocks take a task under a second.
CROWD, BLOCK = 8192, 4096
#: So often members are held against one of their key before they are held against one another; fewer if that links nothing more.
TURNS = 3
#: Up to so many ids are broadcast to find the texts that are to be confirmed; beyond, the texts are shuffled.
BROADCAST_IDS = 1_000_000
#: Up to so many links (16 MB) one task of an executor finds the components; beyond, stars do, with many more shuffles.
LOCAL_LINKS = 1_000_000
SKETCH = [f"s{i}" for i in range(CHUNKS)] + [f"p{i}" for i in range(PARITY)]
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, with repeats, and the n + 1 offsets of the texts' parts."""
    word, bounds = word_hashes(raw, offsets)
    count = np.diff(bounds)
    parts = np.maximum(count - words + 1, (count > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(parts)])
    begin = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1] - bounds[:-1], parts)
    size = np.repeat(np.minimum(count, words), parts)
    h = size.astype(np.uint64)
    for i in range(words):
        ok = i < size
        h[ok] = mixed(h[ok] * _STEP + word[begin[ok] + i])
    return h, out_bounds


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """CHUNKS longs for each text, each of LANES symbols of BITS bits in lanes one bit wider; 0 without shingles."""
    some = np.flatnonzero(np.diff(bounds))
    out = np.zeros((CHUNKS, len(bounds) - 1), np.int64)
    if len(some):
        seeds = mixed(np.arange(1, CHUNKS * LANES + 1, dtype=np.uint64)) | np.uint64(1)
        for k, seed in enumerate(seeds):
            low = mixed(np.minimum.reduceat(h * seed, bounds[:-1][some])) & np.uint64((1 << BITS) - 1)
            out[k // LANES, some] |= low.astype(np.int64) << (k % LANES * (BITS + 1))
    return out


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """The parity bitmaps of the sets, PARITY longs each."""
    out = np.zeros((PARITY, len(sets)), np.int64)
    for i, x in enumerate(sets):
        if len(x):
            odd = np.bincount((x >> np.uint64(20)) & np.uint64(64 * PARITY - 1), minlength=64 * PARITY) & 1
            out[:, i] = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return out


def described(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, n_shingles, a digest (h1, h2) of the set, the signature s0, s1, ..., the parity bitmap p0, p1, ..."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for a, b in blocks(offsets, 1 << 20):
                h, bounds = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                sets = [np.unique(h[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
                size = np.array([len(s) for s in sets])
                h1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                h2 = np.array([mixed(s * _STEP).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(h1), pa.array(h2), *map(pa.array, signatures(h, bounds)), *map(pa.array, parities(sets))], names=names)

    names = ["doc_id", "n_shingles", "h1", "h2", *SKETCH]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in names[1:])])
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(tidy(describe), schema)


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Class and sorted shingle hashes of the texts of these ids."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for a, b in blocks(offsets, 1 << 20):
                h, bounds = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                sets = [np.unique(h[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                cls = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["cls", "hashes"])

    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.select(F.col(id_col).alias("id"), text_col).join(wanted, "id", "left_semi").mapInArrow(tidy(expand), "cls long, hashes array<long>")


def reachable(percent: int) -> Column:
    """Whether sets of these sizes and bitmaps can have the similarity."""
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a.p{i}").bitwiseXOR(F.col(f"b.p{i}"))) for i in range(PARITY)])
    # |A ^ B| = |A| + |B| - 2 |A & B|, and |A & B| is percent / (100 + percent) of |A| + |B| at least
    return (small * 100 >= large * percent) & (apart * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * |intersection| >= percent * |union|."""
    left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("ha")), "a")
    both = left.join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb")).cast("long")
    return both.where(common * 100 >= (F.size("ha") + F.size("hb") - common) * percent).select("a", "b").distinct()


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b), ascending, and for each the smallest that can be reached."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    comp, x, y = np.arange(len(nodes)), place[: len(a)], place[len(a) :]
    while len(x):
        np.minimum.at(comp, np.maximum(x, y), np.minimum(x, y))  # roots only, so every two rounds leave half of a component's at most
        while ((up := comp[comp]) != comp).any():
            comp = up
        x, y = comp[x], comp[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[comp]


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node that can be reached) of every node in links (a, b).

    Each job leaves plans, threads and code with the driver, so up to LOCAL_LINKS links are gone through by one task, in one job; more are by ``starred``.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := list(batches):
            ends = (np.concatenate([x.column(i).to_numpy() for x in found]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*map(pa.array, smallest_reached(*ends))], names=["node", "comp"])

    if links.count() > LOCAL_LINKS:
        return starred(links)
    return links.select("a", "b").where("a <> b").coalesce(1).mapInArrow(tidy(joined), "node long, comp long")


def starred(links: DataFrame) -> DataFrame:
    """What ``components`` returns, of any number of links and without holding them anywhere.

    Large and small stars in turn (Kiveris et al., 2014): a node's larger neighbours are tied to its smallest, then its smaller ones
    are, until nothing changes. The rounds grow with the logarithm of the nodes, not with the longest path; each round's edges are written to the shared folder.
    """
    spread = lambda e: e.union(e.select("b", "a")).toDF("node", "to")
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = state(edges)
    while before[0]:
        both = spread(edges)
        least = both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("least"))
        large = both.where("to > node").join(least, "node").select(F.col("least").alias("a"), F.col("to").alias("b")).distinct()
        large = keep(large, "edges")
        least = large.groupBy("b").agg(F.min("a").alias("least"))
        tied = large.join(least, "b")
        small = tied.select(F.col("least").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        small = keep(small, "edges")
        discard(edges, large)
        edges, now = small, state(small)
        if now == before:
            break
        before = now
    return spread(edges).groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("comp"))


def led(members: DataFrame, turn: int) -> DataFrame:
    """Of members (key, cls, comp) the pairs (a < b) of a key's leader, drawn anew in each turn, and its members of other components."""
    leaders = members.groupBy("key").agg(F.min_by(F.struct("cls", "comp"), F.xxhash64("cls", "key", F.lit(turn))).alias("lead"))
    met = members.join(leaders, "key").where(F.col("comp") != F.col("lead.comp"))
    return met.select(F.least("cls", "lead.cls").alias("a"), F.greatest("cls", "lead.cls").alias("b")).distinct()


def paired(members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a < b) of members (key, cls, comp, n, sketch) of a key that may be links between two components.

    A crowded key is dealt in blocks of about BLOCK members, and every two blocks meet in a task's group of their own.
    """
    many = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "blocks")
    dealt = members.join(many, "key").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = keep(dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks"), "dealt")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "i", "j")])
    once = (F.col("a.i") == F.col("a.j")) | (F.col("a.own") != F.col("b.own"))
    met = dealt.alias("a").join(dealt.alias("b"), same & once & (F.col("a.cls") < F.col("b.cls")) & (F.col("a.comp") != F.col("b.comp")) & reachable(percent))
    return met.select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct()


def rare_keys(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """cls, key (a shingle's hash): for each member its rarest shingles among all members', as many as any set of the similarity must share one of.

    Of |A| shingles a similar set has percent of them at least; so of the other |A| - that + 1 in any common order the two share the first they share.
    Shingles of one member alone are left out after they have been counted.
    """
    each = sets.join(members, "cls", "left_semi").select("cls", F.explode("hashes").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("df"))
    ranked = each.join(often, "key").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("by"))  # a document's own shingles
    first = F.size("by") - F.ceil(F.size("by") * F.lit(percent) / 100) + 1
    return ranked.select("cls", F.explode(F.slice("by", F.lit(1), first.cast("int"))).alias("x")).where("x.df > 1").select("cls", F.col("x.key").alias("key"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id it is linked to, over any number of links), kept.

    Words are what stands between ASCII white space after lower-casing A-Z. A text of fewer words than a shingle is one shingle;
    null, empty and blank texts have none and are linked with nothing (their own component, kept). Rows that repeat an id are documents of their own,
    whether their texts are equal or not; each gets a row, and those of the component's smallest id are kept. Rows without id get n_shingles, a null
    component and are kept, and link nothing. Without rows the result is empty; other columns are not read.
    """
    base = keep(described(docs, id_col, text_col, words), "signatures")
    # a class is known by its sets' sum of hashes, and told from others by both digests and the size
    classes = keep(
        base.where("n_shingles > 0 and doc_id is not null").groupBy(F.col("h1").alias("cls"), "h2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"), *(F.min(s).alias(s) for s in SKETCH)), "classes"
    )
    masks = [~(((1 << BITS) - 1) << (i * (BITS + 1))) for i in range(LANES)]
    keys = F.array(*(F.xxhash64(F.lit(c * LANES + i), F.col(f"s{c}").bitwiseAND(F.lit(m))) for c in range(CHUNKS) for i, m in enumerate(masks)))
    members = classes.select("cls", "rep", F.explode(keys).alias("key"))
    leaders = keep(members.groupBy("key").agg(F.min_by("cls", F.struct("rep", "cls")).alias("leader"), F.count("*").alias("many")).where("many > 1").select("key", "leader"), "leaders")
    met = keep(members.drop("rep").join(leaders, "key"), "met")  # members of keys that are not alone
    known = classes.select("cls", "n", *SKETCH)
    near = lambda pairs: pairs.join(known.alias("a"), F.col("p.a") == F.col("a.cls")).join(known.alias("b"), F.col("p.b") == F.col("b.cls")).where(reachable(percent)).select("p.a", "p.b")
    first = met.where("cls <> leader").select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b")).distinct()
    tried = keep(near(first.alias("p")), "pairs")
    sets = full_sets(docs, classes.join(met.select("cls").distinct(), "cls", "left_semi").select(F.col("rep").alias("id")).distinct(), id_col, text_col, words)
    if not base.where("doc_id is not null").groupBy("doc_id", "h1").count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates(["cls"])  # rows that are repeated with their id
    sets = keep(sets, "sets")
    links = keep(confirmed(tried, sets, percent), "links")
    scratch = [met, leaders, sets, tried, links]
    labels = keep(components(links), "labels")

    def still_open() -> DataFrame:
        """Members of the keys that hold several components."""
        all_ = met.join(labels, met["cls"] == labels["node"], "left").select("key", "cls", F.coalesce("comp", "cls").alias("comp"))
        several = all_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("many")).where("lo <> hi")
        scratch.append(keep(all_.join(several.select("key", "many"), "key"), "open"))
        return scratch[-1]

    open_ = still_open()
    for turn in range(1, TURNS):
        next_ = keep(near(led(open_, turn).alias("p")).join(tried, ["a", "b"], "left_anti"), "pairs")
        more = keep(confirmed(next_, sets, percent), "links")
        scratch += [next_, more]
        if more.isEmpty():
            break
        tried, links = tried.union(next_), links.union(more)
        labels = keep(components(links), "labels")
        open_ = still_open()
    rest = open_.join(known, "cls")
    crowded = rest.where(F.col("many") > CROWD)
    second = paired(rest.where(F.col("many") <= CROWD).drop("many"), percent)
    if not crowded.isEmpty():
        each = keep(crowded.drop("key", "many").dropDuplicates(["cls"]), "crowded")
        second = second.union(paired(each.join(rare_keys(each.select("cls"), sets, percent), "cls"), percent)).distinct()
    second = keep(second.join(tried, ["a", "b"], "left_anti"), "pairs2")
    more = keep(confirmed(second, sets, percent), "links2")
    if not more.isEmpty():
        labels = keep(components(links.union(more)), "labels")
    named = classes.join(labels, classes["cls"] == labels["node"], "left").select(F.col("cls").alias("c1"), F.col("h2").alias("c2"), "rep", F.coalesce("comp", "cls").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component"))
    found = keep(named.join(smallest, "comp").select("c1", "c2", "component"), "components")
    discard(*scratch, second, more)
    out = base.select("doc_id", "n_shingles", "h1", "h2").join(found, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component).alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
