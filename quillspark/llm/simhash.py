"""SimHash near-duplicates: fingerprints, sharded BK-trees, components.

Method: a BK-tree keeps each fingerprint's children keyed by their integer Hamming distance
to it; a search for everything within ``radius`` of q follows only edges e with
|e - d(q, node)| <= radius. Trees are sharded: two fingerprints that differ in at most r bits
agree on one of r + 1 blocks of bits, so every link is inside a shard keyed by the first bits of
some block, as many as make shards of about SHARD fingerprints. A shard far above that is dealt
anew by a second block. The trees are built and searched where the shuffle puts a shard: to
broadcast them would gather all fingerprints in the driver.
A shard gives a spanning forest of its links, never all pairs of a group.
"""

from __future__ import annotations

from math import acos, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import Forest, connected_components
from .shared import batches_of, discard, quoted, sifted, staged, text_or_empty

SEED = 42
#: Fingerprints in a shard, about; and the number above which a shard is dealt by a second block.
SHARD, HOT_SHARD = 2048, 1 << 17
#: A subtree of so many fingerprints is a leaf of the tree: its members are compared one by one.
LEAF = 128


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words of a whole text, repeats included.

    ASCII letters are lower-cased; words end at ASCII white space. Fewer words: one shingle of
    them all. None: no shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends)], dtype=np.uint64)


def fingerprint(text: str, width: int = 3) -> int:
    """64-bit SimHash of a whole text, as a signed integer; 0 for a text without words."""
    hashes = shingle_hashes(text, width)
    n, ones = len(hashes), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0]) if n else 0


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long) of every row; a null text counts as empty, fingerprint 0."""

    def run(it):
        for batch in batches_of(it):
            fps = [fingerprint(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _blocks(bits: list[int], radius: int, width: int) -> list[int]:
    """Masks of the first ``width`` bits of each of radius + 1 equal blocks of ``bits``."""
    edges = [len(bits) * i // (radius + 1) for i in range(radius + 2)]
    return [sum(1 << b for b in bits[s : min(e, s + width)]) for s, e in zip(edges, edges[1:])]


def key_bits(n: int, shard: int = SHARD) -> int:
    """Bits of a shard key: the shards of a block have about ``shard`` of ``n`` fingerprints each."""
    return max(0, (n // shard).bit_length() - 1)


def _part(mask: int) -> Column:
    return F.col("fp").bitwiseAND(F.lit(mask - ((mask >> 63) << 64)).cast("long"))


def _dealt(reps: DataFrame, radius: int, shard: int, hot: int) -> DataFrame:
    """(no, part, fp, rep): a row for each shard of a fingerprint."""
    n = reps.count()
    width = key_bits(n, shard)
    masks = _blocks(list(range(64)), radius, width)
    keys = F.explode(F.array(*(F.struct(F.lit(no).alias("no"), _part(m).alias("part")) for no, m in enumerate(masks))))
    keyed = reps.select("fp", "rep", keys.alias("k")).select("k.no", "k.part", "fp", "rep")
    if n <= hot:  # then no shard can be above it
        return keyed
    large = keyed.groupBy("no", "part").count().where(F.col("count") > hot).select("no", "part", F.lit(True).alias("large"))
    keyed = keyed.join(large, ["no", "part"], "left")
    out = keyed.where("large is null").drop("large")
    for no, mask in enumerate(masks):
        # the bits outside the first key differ in at most radius places too
        rest = _blocks([b for b in range(64) if not mask >> b & 1], radius, 16)
        second = F.explode(F.array(*(F.struct(F.lit((no + 1) * 1000 + k).alias("no"), _part(mask | m).alias("part")) for k, m in enumerate(rest))))
        out = out.unionByName(keyed.where((F.col("no") == no) & F.col("large")).select("fp", "rep", second.alias("k")).select("k.no", "k.part", "fp", "rep"))
    return out


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints, each a row of 64-bit words."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16)


def tree_links(fps: np.ndarray, radius: int, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Positions (i, j) of a spanning forest of all links of the distinct fingerprints of a shard.

    ``fps`` has a row of 64-bit words each. Those of one of ``groups`` count as linked already.

    The tree is walked a node at a time for all searchers at once: a node's first fingerprint is
    the parent, its other members hang below it by their distance, and the searchers at
    distance d go down the edges d - radius to d + radius. What is already in one component is
    not searched again, so a dense cluster costs little more than its tree.
    """
    bits = fps.view(np.uint64).reshape(len(fps), -1)
    forest = Forest(len(fps))
    if groups is not None:
        forest.up = np.unique(groups, return_index=True)[1][np.unique(groups, return_inverse=True)[1]]
    todo: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(fps)), None)]  # None: the members search each other
    while todo:
        members, seekers = todo.pop()
        if len(members) == 0 or (seekers is not None and len(seekers) == 0):
            continue
        everyone = members if seekers is None else np.concatenate([members, seekers])
        rs = forest.roots(everyone)
        if (rs == rs[0]).all():
            continue
        if len(members) <= LEAF:
            other = members if seekers is None else seekers
            near = _distance(bits[members][:, None], bits[other][None, :]) <= radius
            for k in np.nonzero(near.any(axis=1))[0]:
                forest.star(int(members[k]), other[near[k]])
            continue
        parent, rest = int(members[0]), members[1:]
        edge = _distance(bits[rest], bits[parent])
        order = np.argsort(edge, kind="stable")
        rest, edge = rest[order], edge[order]
        labels, starts = np.unique(edge, return_index=True)
        ends = np.append(starts[1:], len(rest))
        if seekers is None:
            forest.star(parent, np.append(rest[edge <= radius], parent))
            reach = np.searchsorted(edge, labels + radius, "right")
            for s, e, r in zip(starts, ends, reach):
                todo += [(rest[s:e], None), (rest[s:e], rest[e:r])]
        else:
            far = _distance(bits[seekers], bits[parent])
            forest.star(parent, np.append(seekers[far <= radius], parent))
            todo += [(rest[s:e], seekers[np.abs(far - d) <= radius]) for s, e, d in zip(starts, ends, labels)]
    return forest.edges


def fingerprint_links(reps: DataFrame, radius: int = 3, shard: int = SHARD, hot: int = HOT_SHARD) -> DataFrame:
    """(fp long, rep long) of distinct fingerprints -> edges (a, b) between reps.

    The edges span the same components as all links at ``radius`` or fewer bits.
    Rows are dealt by shard key and sorted, so a task sees each shard in one run of rows
    and holds one shard's fingerprints (16 bytes each) at a time.
    """
    keyed = _dealt(reps.where("rep is not null"), radius, shard, hot)
    keyed = keyed.select("no", "part", "fp", "rep").repartition("no", "part").sortWithinPartitions("no", "part", "fp")

    def links(no, part, fp, rep):
        edges = tree_links(fp, radius)
        return rep[np.array(edges)] if edges else None

    return _by_shard(keyed, links)


def _by_shard(keyed: DataFrame, links) -> DataFrame:
    """Edges (a, b) that ``links`` (arrays of one shard's columns -> pairs or None) gives for each run of equal (no, part)."""

    def run(it):
        held: list[pd.DataFrame] = []
        for pdf in it:
            if pdf.empty:
                continue
            tail = held[-1].iloc[-1] if held else None
            same = tail is not None and tail.no == pdf.no.iloc[-1] and tail.part == pdf.part.iloc[-1]
            held.append(pdf)
            if same and pdf.no.iloc[0] == tail.no and pdf.part.iloc[0] == tail.part:
                continue
            whole = pd.concat(held, ignore_index=True) if len(held) > 1 else pdf.reset_index(drop=True)
            last = ((whole.no == whole.no.iloc[-1]) & (whole.part == whole.part.iloc[-1])).to_numpy()
            cut = int(np.argmax(last))
            held = [whole.iloc[cut:]]
            yield from shards(whole.iloc[:cut])
        if held:
            yield from shards(pd.concat(held, ignore_index=True))

    def shards(pdf: pd.DataFrame):
        if len(pdf) < 2:
            return
        columns = [pdf[c].to_numpy() for c in pdf.columns]
        no, part = columns[:2]
        starts = np.append(np.nonzero(np.append(True, (no[1:] != no[:-1]) | (part[1:] != part[:-1])))[0], len(pdf))
        found = [links(*(c[s:e] for c in columns)) for s, e in zip(starts, starts[1:]) if e - s > 1]
        found = [f for f in found if f is not None]
        if found:
            pairs = np.concatenate(found)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return keyed.mapInPandas(run, "a long, b long")


def simhash_groups(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long, component_id long), one row for every row of ``docs``.

    component_id is the least doc_id reachable over links of ``radius`` or fewer differing
    bits. Null texts are empty; texts without words have fingerprint 0 and link like any
    other; repeated rows stay repeated; a null doc_id gets its group's id, and null where
    the group has no other; an empty table gives an empty one; other columns are not used.
    """
    prints = staged(fingerprints(docs, width, id_col, text_col), "fingerprints")
    reps = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    roots = connected_components(fingerprint_links(reps, radius))
    groups = reps.join(roots, reps.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(groups, "fp", "left").select("doc_id", "fp", "component_id")


def fingerprint_hex(col: str = "fp"):
    return F.lpad(F.lower(F.hex(col)), 16, "0")


# near-duplicates by similarity: fingerprints propose, shingle sets decide

#: Words of the long fingerprint, all compared by the trees.
LONG = 4
#: Shard keys of a set: each of the least values of so many hash functions.
KEYS, KEY_MINIMA = 20, 4
#: A link's fingerprints differ in at most its mean plus so many standard deviations; surely like ones in its mean less as many.
SIGMAS = 3.5
#: Pairs of one set that a task verifies.
HUB = 500
_ODD = np.random.default_rng(11).integers(1, 1 << 63, max(LONG, KEYS * KEY_MINIMA), dtype=np.uint64) | np.uint64(1)


def _mixed(hashes: np.ndarray, ways: int) -> np.ndarray:
    """Hashes x ways: each hash mixed in several ways."""
    h = hashes[:, None] * _ODD[None, :ways]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """LONG words of SimHash bits of a set of hashes, each word from hashes mixed in its own way."""
    ones, n = np.zeros(64 * LONG, dtype=np.int64), len(hashes)
    for at in range(0, n, 2048):
        h = _mixed(hashes[at : at + 2048], LONG)
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n, bitorder="little").view("<i8")


def shard_keys(hashes: np.ndarray) -> np.ndarray:
    """KEYS keys of a set. Two sets of similarity s agree on one with a chance of s ** KEY_MINIMA, whatever the table's size."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(KEYS * KEY_MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, _mixed(hashes[at : at + 1024], KEYS * KEY_MINIMA).min(axis=0))
    rows = least.reshape(KEYS, KEY_MINIMA)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def bit_odds(similarity: float) -> float:
    """Chance that a bit differs between two large sets of one size and this Jaccard similarity."""
    return acos(2 * similarity / (1 + similarity)) / pi


def radius_for(n: int, similarity: float) -> int:
    """Bits in which the fingerprints of a link differ, all but one in some thousands; ``n``: elements of the smaller set.

    In small sets many bits are near a tie, which one element more decides.
    """
    bits, odds = 64 * LONG, min(0.5, bit_odds(similarity) + 0.4 / sqrt(max(n, 1)))
    return min(bits, int(bits * odds + SIGMAS * sqrt(bits * odds * (1 - odds))))


def sure_radius(similarity: float) -> int:
    """Bits below which nearly all pairs of large sets are links."""
    bits, odds = 64 * LONG, bit_odds(similarity)
    return max(0, int(bits * odds - SIGMAS * sqrt(bits * odds * (1 - odds))))


def _set_prints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, nth, sig, n, fp, keys, hashes) of every row: sig is a digest of the set, hashes are its 32 low bits."""

    def run(it):
        for batch in batches_of(it, 128):
            sets = [np.unique(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()]
            longs = lambda f: pa.array([f(x) for x in sets], pa.list_(pa.int64()))
            columns = [batch.column(0), batch.column(2), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int32()), longs(long_fingerprint), longs(shard_keys), pa.array([np.unique(x.astype(np.uint32)).view(np.int32) for x in sets], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "nth", "sig", "n", "fp", "keys", "hashes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("nth"))
    return rows.mapInArrow(run, "doc_id long, nth long, sig binary, n int, fp array<long>, keys array<long>, hashes array<int>")


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _shards(members: DataFrame, n: int, *columns: str) -> DataFrame:
    """``members`` (key, rep, ...) by shard: rows of one key follow each other in a task."""
    keyed = _split(members.select(F.lit(0).alias("no"), F.col("key").alias("part"), "rep", *columns), n)
    return keyed.repartition("no", "part").sortWithinPartitions("no", "part", "rep")


def _forests(members: DataFrame, n: int, similarity: float) -> DataFrame:
    """Edges (a, b): in each shard a spanning forest of what its tree finds, of surely like sets as far as these reach."""
    sure = sure_radius(similarity)

    def links(no, part, rep, size, fp):
        bits = np.stack(fp)
        edges = tree_links(bits, sure)
        forest = Forest(len(bits))
        for i, j in edges:
            forest.star(i, np.array([j]))
        edges = edges + tree_links(bits, radius_for(int(size.min()), similarity), forest.roots(np.arange(len(bits))))
        return rep[np.array(edges)] if edges else None

    return _ordered(_by_shard(_shards(members, n, "n", "fp"), links))


def _settled(members: DataFrame, n: int, similarity: float) -> DataFrame:
    """Edges (a, b) between groups: in each shard a spanning forest of all links between sets of different groups; whole sets decide.

    Only sets whose fingerprints are near are compared, and only while they are in different components.
    """

    def links(no, part, rep, size, fp, group, hashes):
        bits, radius, m = np.stack(fp), radius_for(int(size.min()), similarity), len(rep)
        forest = Forest(m)
        forest.up = np.unique(group, return_index=True)[1][np.unique(group, return_inverse=True)[1]]
        lengths = np.array([len(h) for h in hashes])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        ids = np.unique(np.concatenate(hashes), return_inverse=True)[1]
        marked = np.zeros(int(ids.max()) + 1, np.int32)
        for i in range(m - 1):
            roots = forest.roots(np.arange(m))
            others = i + 1 + np.nonzero(roots[i + 1 :] != roots[i])[0]
            others = others[_distance(bits[others], bits[i]) <= radius]
            if not len(others):
                continue
            own = ids[starts[i] : starts[i] + lengths[i]]
            marked[own] = 1
            both = np.add.reduceat(marked[ids], starts)[others] if len(others) > 8 else np.array([marked[ids[starts[j] : starts[j] + lengths[j]]].sum() for j in others])
            marked[own] = 0
            forest.star(i, others[both >= similarity * (lengths[i] + lengths[others] - both)])
        return group[np.array(forest.edges)] if forest.edges else None

    return _ordered(_by_shard(_shards(members, n, "n", "fp", "group", "hashes"), links))


def _split(keyed: DataFrame, n: int) -> DataFrame:
    """Shards above HOT_SHARD of ``n`` fingerprints in equal parts: each two of them are a shard, so every pair still meets."""
    if n <= HOT_SHARD:
        return keyed
    large = keyed.groupBy("no", "part").count().where(F.col("count") > HOT_SHARD).select("no", "part", F.ceil(F.col("count") / HOT_SHARD).cast("int").alias("parts"))
    marked = keyed.join(large, ["no", "part"], "left")
    hot = marked.where("parts is not null").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    hot = hot.withColumn("part", F.xxhash64("part", F.least("own", "other"), F.greatest("own", "other")))
    return marked.where("parts is null").select(*keyed.columns).unionByName(hot.select(*keyed.columns))


def near_duplicate_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row of ``docs``: groups of documents of like shingle sets.

    Two documents are linked if the Jaccard similarity of their sets of ``width``-word
    shingles is ``similarity`` or more; sets that are equal are linked, also empty ones. Sets
    meet in shards keyed by least hashes; there BK-trees over whole SimHash fingerprints
    propose, and a proposal is a link only if the sets bear it out. A tree gives a forest; where
    one of its proposals failed, all its sets are dealt to their shards once more, whole, and
    each near pair of different groups is compared there.
    Null texts are empty; rows without doc_id give no group its id and their component_id is
    that of equal sets, or null; an empty table gives an empty one; other columns aren't used.
    """
    prints = staged(_set_prints(docs, width), "set-prints")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "nth")))
    heads = prints.groupBy("sig").agg(least.alias("least"))
    reps = staged(heads.select("sig", F.col("least.doc_id").alias("rep"), F.col("least.nth").alias("nth")), "set-reps")
    known = reps.where("rep is not null")
    # a set's own row has its keys: the first passes carry keys alone, and fingerprints follow to those that meet
    own = prints.join(known.select("nth", "rep"), "nth").select("rep", "n", "fp", "keys")
    keyed = staged(own.select("rep", F.explode("keys").alias("key")), "set-keys")
    shared = staged(keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "set-shared")
    meeting = sifted(keyed, shared, "key").join(shared, "key", "left_semi")
    members = staged(meeting.join(own.select("rep", "n", "fp"), "rep"), "set-members")
    discard(keyed)
    discard(shared)
    n = members.count()
    pairs = staged(_forests(members, n, similarity), "set-pairs")
    sets = _sets_of(pairs, prints, known)
    checked = staged(_verified(pairs, sets, similarity), "set-checked")
    good, bad = checked.where("good").select("a", "b"), checked.where("not good").select("a", "b")
    roots = connected_components(good)
    groups = reps.join(roots, reps.rep == roots.node, "left").select("sig", F.coalesce("root", "rep").alias("component_id"))
    if not bad.isEmpty():
        # failed proposals connect whole groups of good ones: those with an end of one are all that a link may have been lost in
        ends = bad.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        hit = ends.join(roots, F.col("rep") == F.col("node"), "left").select(F.coalesce("root", "rep").alias("group")).distinct()
        # a root has no row of its own
        lost = roots.join(hit, F.col("root") == F.col("group"), "left_semi").select(F.col("node").alias("rep"), F.col("root").alias("group")).union(hit.select("group", "group"))
        doubtful = staged(members.join(lost, "rep").select("key", "rep", "n", "fp", "group"), "set-doubtful")
        # a shard of one group has nothing to compare: its sets aren't copied there
        mixed = doubtful.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("key")
        more = staged(_settled(doubtful.join(mixed, "key", "left_semi").join(sets, "rep"), n, similarity), "set-more")
        discard(doubtful)
        merged = connected_components(more).withColumnRenamed("root", "least")
        discard(more)
        groups = groups.join(merged, F.col("component_id") == F.col("node"), "left").select("sig", F.coalesce("least", "component_id").alias("component_id"))
    out = staged(prints.select("doc_id", "sig").join(groups, "sig").select("doc_id", "component_id"), "groups")
    for done in (prints, reps, members, pairs, sets, checked):
        discard(done)
    return out


def _sets_of(pairs: DataFrame, prints: DataFrame, known: DataFrame) -> DataFrame:
    """(rep, hashes) of the documents in ``pairs``, staged. Their places are staged first: only sets that these may name are shuffled."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    own = staged(known.select("rep", "nth").join(wanted, "rep", "left_semi"), "set-places")
    out = staged(sifted(prints.select("nth", "hashes"), own, "nth").join(own, "nth").select("rep", "hashes"), "set-proposed")
    discard(own)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` with ``good``: whether the sets' similarity is high enough. A set of many pairs goes to several tasks."""

    def dealt(df: DataFrame, end: str, other: str, side: str) -> DataFrame:
        parts = pairs.groupBy(F.col(end).alias("rep")).agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts"))
        own = sets.join(parts, "rep").select(F.col("rep").alias(end), F.col("hashes").alias(side), "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("at"))
        many = df.join(parts.withColumnRenamed("rep", end), end).withColumn("at", F.pmod(F.xxhash64(other), F.col("parts")).cast("int")).drop("parts")
        return many.join(own.drop("parts"), [end, "at"]).drop("at")

    met = dealt(dealt(pairs, "a", "b", "x"), "b", "a", "y")
    both = F.size(F.array_intersect("x", "y"))
    met = met.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), both.alias("both"))
    good = F.col("both") >= similarity * (F.col("nx") + F.col("ny") - F.col("both"))
    return met.groupBy("a", "b").agg(F.max(good).alias("good"))  # rows that share a doc_id have several sets


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of ``near_duplicate_groups``: that with the least doc_id.

    Rows without doc_id stay. Rows that share a doc_id are one document: they stay or go together.
    """
    groups = near_duplicate_groups(docs, width, similarity)
    # staged, its size is known, and where it is small the documents aren't shuffled
    gone = staged(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    discard(groups)
    return docs.join(gone, "doc_id", "left_anti").select(*quoted(docs.columns))
