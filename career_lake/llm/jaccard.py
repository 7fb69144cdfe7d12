"""N-gram Jaccard join by prefix trees (operator 5).

1. Every document becomes the set of the 64-bit hashes of its distinct word
   n-grams. Equal sets collapse to one.
2. One global order: by the number of sets that hold an n-gram (or one with the
   same first 48 bits of hash; any fixed order is right), then by its hash.
   Chunks of documents ask the buckets of the hash range for the numbers
   (chunks.py). N-grams of one set come first in the order and meet nothing,
   so a set keeps the rest, in order, and its size.
3. Sets x and y with Jaccard >= t share one of the first |x| - ceil(t |x|) + 1
   n-grams of either. These are the branches of the tree's root: a branch is
   an n-gram with the sets that hold it among their first.
4. In star rounds each set of a branch meets one set of the branch. Branches
   whose sets are linked with one star by then are done, and rounds go on while
   they shrink the rest. In what is left, pairs of a branch that are not connected are
   kept if their lengths, the places of the n-gram in both, and parity sketches
   (the sets differ in at least as many elements as these in bits) allow
   enough overlap; branches of many sets are cut into blocks that meet in turn.
5. Pairs are verified by tries: the ordered sets that one set shall meet are
   stored in a trie (BAND elements a node) that the set traverses; nodes
   share the overlap of their prefix, and a subtree is pruned when its
   remaining length cannot reach the needed overlap. Tasks take at most CHUNK
   sets; the sets of one partner are dealt to several.
6. Components of the links.

Null or word-less texts have an empty set and no link. With fewer than n words
the whole sequence is the one element. Repeated rows are equal sets; rows of
one doc_id, or of none (null), are told apart by their texts. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from career_lake.llm.chunks import ANSWER, answer, answered, chunked, meet, ordered, received, send
from career_lake.llm.graph import components
from career_lake.llm.text import STEP, Rolling, Words, batches, column_bytes, mix, powers
from career_lake.session import discard, settle

#: Elements of a trie node.
BAND = 16
_PLACE = powers(STEP[1], BAND)
#: Sets and elements that one task of the trie join takes at most.
CHUNK, CHUNK_ELEMENTS = 384, 600_000
#: Sets of a branch that meet in one block.
BLOCK = 2048
#: Bits of a parity sketch, and rows of sketches that are compared at once.
SKETCH, ROWS = 512, 64


def shingle_sets(w: Words, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each row."""
    h = w.hashes()
    roll = Rolling(h)
    grams = roll.window(n)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield roll.spans(np.array([a]), np.array([b - a]))
        else:
            yield grams[:0]


def first_elements(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many of a set's first elements hold one of any set with Jaccard >= num/den."""
    return size - (size * num + den - 1) // den + 1


def _profiles(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, row_key, n_shingles and two hashes of the whole set."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for lo, hi, buf, off in batches(rb, "text"):
                sizes, d1, d2 = [], [], []
                for s in shingle_sets(Words(buf, off, lower=True), n):
                    sizes.append(len(s))
                    d1.append(int(np.bitwise_xor.reduce(mix(s))) if len(s) else 0)
                    d2.append(int(np.add.reduce(mix(s + np.uint64(1)))) if len(s) else 0)
                marks = (pa.array(np.array(d, np.uint64).astype(np.int64)) for d in (d1, d2))
                yield pa.RecordBatch.from_arrays([rb.column(0)[lo:hi], rb.column(1)[lo:hi], pa.array(sizes, pa.int64()), *marks], names=["doc_id", "row_key", "n_shingles", "d1", "d2"])

    return docs.select("doc_id", "row_key", "text").mapInArrow(run, "doc_id long, row_key long, n_shingles long, d1 long, d2 long")


class _Grams:
    """The sets of a chunk's documents but its copies, laid end to end, and the chunk's distinct n-grams (48 bits)."""

    def __init__(self, docs: pa.Table, told: pa.Table, n: int) -> None:
        copies = [x for x, b in zip(told["answer"].to_pylist(), told["bucket"].to_pylist(), strict=True) if b < 0]
        gone = np.frombuffer(b"".join(copies), ">i8").astype(np.int64)
        self.docs = ordered(docs.filter(pa.array(~np.isin(docs["doc_id"].to_numpy(), gone))))
        sets = list(shingle_sets(Words(*column_bytes(self.docs["text"]), lower=True), n))
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.all = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.keys, self.inv, self.counts = np.unique(self.all >> np.uint64(16), return_inverse=True, return_counts=True)


def _sum_counts(t: pa.Table) -> pa.Table:
    low, at = received(t["keys"], np.uint32)
    high, _ = received(t["more0"], np.uint16)
    more, _ = received(t["more1"], np.uint32)
    keys = high.astype(np.uint64) << np.uint64(32) | low
    _, inv = np.unique(keys, return_inverse=True)
    return answer(t, np.bincount(inv, more)[inv].astype(np.uint32) if len(keys) else np.zeros(0, np.uint32), at)


def _branching_sets(docs: DataFrame, copies: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """docs(row_key, text) without the rows of copies(row_key): id, size, elements (in global order, without those of one set), heads (elements among the first), sketch.

    Only sets with such heads; the others have no link.
    """
    docs, buckets, chunks = chunked(docs, "text", "row_key")
    # Rows like answers, of a bucket that is none, tell the chunks their copies.
    none = copies.select(F.pmod(F.xxhash64("row_key"), F.lit(chunks)).alias("chunk"), F.lit(-1).alias("bucket"), F.unhex(F.lpad(F.hex("row_key"), 16, "0")).alias("answer"), F.lit(b"").alias("of"))

    def ask(t: pa.Table, told: pa.Table) -> pa.Table:
        g = _Grams(t, told, n)
        # Sorted keys: the first 16 of their 48 bits hardly change, so they take no room apart.
        high, low = (g.keys >> np.uint64(32)).astype(np.uint16), g.keys.astype(np.uint32)
        return send(t["chunk"][0].as_py() if t.num_rows else 0, g.keys << np.uint64(16), buckets, high, g.counts.astype(np.uint32), short=low)

    def tell(t: pa.Table, told: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"id": [], "size": [], "elements": [], "heads": [], "sketch": []}
        if t.num_rows:
            g = _Grams(t, told, n)
            sets = answered(told.filter(pc.greater_equal(told["bucket"], 0)), np.uint32)[g.inv] if len(g.all) else np.zeros(0, np.uint32)
            row = np.repeat(np.arange(len(g.sizes)), g.sizes)
            shared = np.flatnonzero(sets > 1)
            shared = shared[np.lexsort((g.all[shared], sets[shared], row[shared]))]
            cut = np.searchsorted(row[shared], np.arange(len(g.sizes) + 1))
            ids = g.docs["doc_id"].to_numpy()
            heads = first_elements(g.sizes, num, den) - (g.sizes - np.diff(cut))
            for r in np.flatnonzero((heads > 0) & (np.diff(cut) > 0)):
                s = g.all[shared[cut[r] : cut[r + 1]]]
                rows["id"].append(ids[r])
                rows["size"].append(g.sizes[r])
                rows["elements"].append(s.tobytes())
                rows["heads"].append(s[: heads[r]].astype(np.int64))
                rows["sketch"].append(sketch(s))
        return pa.table(
            [pa.array(rows["id"], pa.int64()), pa.array(rows["size"], pa.int64()), pa.array(rows["elements"], pa.binary()), pa.array(rows["heads"], pa.list_(pa.int64())), pa.array(rows["sketch"], pa.binary())],
            names=list(rows),
        )

    sent = meet(docs, none, ask, "bucket int, chunk long, keys binary, more0 binary, more1 binary")
    told = sent.groupBy("bucket").applyInArrow(_sum_counts, ANSWER)
    return meet(docs, told.union(none), tell, "id long, size long, elements binary, heads array<long>, sketch binary")


def sketch(s: np.ndarray) -> bytes:
    """Bit b is the parity of the number of elements that fall on b."""
    odd = np.bincount((mix(s) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class Trie:
    """Ordered sets with shared prefixes; a node holds up to BAND elements.

    sizes: of the whole sets; their elements that no other set has are not stored.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray) -> None:
        self.keys, codes = np.unique(np.concatenate(sets), return_inverse=True)
        lens = np.array([len(s) for s in sets])
        begin = np.concatenate(([0], np.cumsum(lens)))
        self.sizes, self.lens, none = sizes, lens, len(self.keys)
        rows, parent, depth = np.arange(len(sets)), np.zeros(len(sets), np.int64), 0
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        while len(rows):
            at = begin[rows][:, None] + np.arange(depth, depth + BAND)
            content = np.where(at < begin[rows + 1][:, None], codes[np.minimum(at, len(codes) - 1)], none)
            label = mix((mix(content.astype(np.uint64) + np.uint64(1)) * _PLACE).sum(1) + mix(parent.astype(np.uint64) + np.uint64(7)))
            _, first, node = np.unique(label, return_index=True, return_inverse=True)
            long, low = np.zeros(len(first), np.int64), np.full(len(first), 1 << 60)
            np.maximum.at(long, node, lens[rows])
            np.minimum.at(low, node, sizes[rows])
            self.levels.append((rows, node, content[first], parent[first], long, low))
            depth += BAND
            stay = lens[rows] > depth
            rows, parent = rows[stay], node[stay]

    def probe(self, s: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Rows whose Jaccard similarity with the set s (of `size` elements in all) is at least num/den."""
        flag = np.zeros(len(self.keys) + 1, bool)
        place = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        flag[place[self.keys[place] == s]] = True
        found, above, alive = [], np.zeros(1, np.int64), np.ones(len(self.sizes), bool)
        for depth, (rows, node, content, parent, long, low) in enumerate(self.levels):
            here = alive[rows]
            if not here.any():
                break
            live = np.unique(node[here])
            overlap = np.zeros(len(content), np.int64)
            overlap[live] = (above[parent[live]] if depth else 0) + flag[content[live]].sum(1)
            rest = np.minimum(len(s) - overlap[live], np.maximum(long[live] - (depth + 1) * BAND, 0))
            dead = np.ones(len(content), bool)
            dead[live[(overlap[live] + rest) * (den + num) >= num * (size + low[live])]] = False
            mine, of = rows[here], node[here]
            ended = self.lens[mine] <= (depth + 1) * BAND
            found.append(mine[ended & ~dead[of] & (overlap[of] * (den + num) >= num * (size + self.sizes[mine]))])
            alive[mine[ended | dead[of]]] = False
            above = overlap
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs(a, b) whose sets have Jaccard >= num/den, by tries of the sets that one set meets."""
    members = pairs.join(sets.select(F.col("id").alias("b"), "size", "elements"), "b")
    load = members.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(F.length("elements") / 8) / CHUNK_ELEMENTS)).cast("int").alias("cells"))
    probes = load.join(sets, load.a == sets.id).select("a", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.col("id").alias("b"), "size", "elements")
    members = members.join(load, "a").select("a", F.pmod(F.xxhash64("b"), "cells").cast("int").alias("cell"), "b", "size", "elements")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, at = (pdf["a"] == pdf["b"]).to_numpy(), pdf["b"].to_numpy()
        found = at[:0]
        if own.any() and not own.all():
            sets = [np.frombuffer(x, np.uint64) for x in pdf["elements"]]
            size, me, rest = pdf["size"].to_numpy(), int(np.flatnonzero(own)[0]), np.flatnonzero(~own)
            found = at[rest[Trie([sets[i] for i in rest], size[rest]).probe(sets[me], int(size[me]), num, den)]]
        return pd.DataFrame({"a": np.full(len(found), pdf["a"].iloc[0]), "b": found}, dtype="int64")

    return probes.union(members).groupBy("a", "cell").applyInPandas(run, "a long, b long")


def _possible(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Pairs of a branch's block that are not connected, whose first shared n-gram is this branch's, and that lengths, places and sketches allow.

    place: the n-gram's place among the set's stored elements; earlier: those
    before it; alone: the set's elements that no other set has. A pair meets in
    every branch that both sets have, but is put out by the first of them only.
    """
    pdf = pdf.sort_values(["size", "id"])
    ids, root, size, alone, place, side = (pdf[c].to_numpy() for c in ("id", "root", "size", "alone", "place", "side"))
    bits = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(pdf), -1)
    earlier = [frozenset(x) for x in pdf["earlier"]]
    cross = side.any() and not side.all()
    out_a, out_b = [], []
    for lo in range(0, len(ids), ROWS):
        hi = min(lo + ROWS, len(ids))
        most = int(np.searchsorted(size, size[hi - 1] * den // num, "right"))  # larger sets are too long for all of these rows
        r, c = slice(lo, hi), slice(lo + 1, most)
        if most <= lo + 1:
            continue
        both = size[r, None] + size[None, c]
        ok = (np.arange(lo, hi)[:, None] < np.arange(lo + 1, most)[None]) & (root[r, None] != root[None, c]) & (size[r, None] * den >= size[None, c] * num)
        if cross:
            ok &= side[r, None] != side[None, c]
        after = size - alone - place
        room = np.minimum(after[r, None], after[None, c])  # nothing shared comes before the first shared n-gram
        ok &= room * (den + num) >= num * both
        i, j = np.nonzero(ok)
        for k in range(0, len(i), 1 << 17):
            x, y = i[k : k + (1 << 17)] + lo, j[k : k + (1 << 17)] + lo + 1
            differ = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) + alone[x] + alone[y]
            fits = np.flatnonzero(differ * (den + num) <= (den - num) * (size[x] + size[y]))
            first = np.fromiter((earlier[p].isdisjoint(earlier[q]) for p, q in zip(x[fits].tolist(), y[fits].tolist(), strict=True)), bool, len(fits))
            out_a.append(ids[x[fits[first]]])
            out_b.append(ids[y[fits[first]]])
    a, b = (np.concatenate(o) if o else ids[:0] for o in (out_a, out_b))
    return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)}, dtype="int64")


def _blocks(entries: DataFrame, num: int, den: int) -> DataFrame:
    """The possible pairs (a, b) of entries(gram, id, root, size, alone, place, earlier, sketch)."""
    count = entries.groupBy("gram").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    e = entries.join(count, "gram").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    # Every two blocks of a branch meet in one cell, and each block with itself.
    e = e.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    e = e.select("gram", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "root", "size", "alone", "place", "earlier", "sketch")
    return e.groupBy("gram", "low", "high").applyInPandas(lambda pdf: _possible(pdf, num, den), "a long, b long").distinct()


def _links(sets: DataFrame, num: int, den: int, label: str) -> DataFrame:
    """Links (a, b) that connect what all links connect."""
    alone = F.col("size") - (F.length("elements") / 8).cast("long")
    entries = sets.select("id", "size", alone.alias("alone"), F.posexplode("heads").alias("place", "gram"))
    links, tested, live, last, turn = None, None, None, None, 0
    rooted, least = entries.withColumn("root", F.col("id")), 2
    while True:
        # A branch goes on if sets of it are apart, and if it has pairs that were not tested.
        open_ = rooted.groupBy("gram").agg(F.count("*").alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.min_by("id", _deal("id", turn)).alias("star"), F.min_by("size", _deal("id", turn)).alias("star_size"))
        live_before, live = live, settle(rooted.join(open_.where(f"m >= {least} and r0 <> r1").select("gram", "star", "star_size"), "gram"), f"{label}-live{turn}")
        if live_before is not None:
            discard(live_before)
        n = live.count()
        if not n or (last is not None and n > last * 0.7):
            break
        near = live.where("id <> star").where(F.least("size", "star_size") * den >= F.greatest("size", "star_size") * num)
        pairs = near.select(F.col("star").alias("a"), F.col("id").alias("b")).distinct()
        pairs = settle(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), f"{label}-pairs{turn}")
        tested = pairs if tested is None else tested.union(pairs)
        found = settle(_verified(pairs, sets, num, den), f"{label}-links{turn}")
        links = found if links is None else links.union(found)
        near = components(links, f"{label}-near")
        rooted = live.select("gram", "id", "size", "alone", "place").join(near, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("component", "id")).drop("node", "component")
        last, turn, least = n, turn + 1, 3
    if links is None or not n:
        return links if links is not None else sets.sparkSession.createDataFrame([], "a long, b long")
    pairs = _blocks(live.join(sets.select("id", "sketch", "heads"), "id").withColumn("earlier", F.slice("heads", F.lit(1), F.col("place"))), num, den)
    done = tested.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = settle(pairs.join(done, ["a", "b"], "left_anti"), f"{label}-rest")
    return links.union(settle(_verified(pairs, sets, num, den), f"{label}-links"))


def _deal(key: str, turn: int) -> Column:
    return F.col(key) if turn == 0 else F.xxhash64(F.col(key), F.lit(turn))


def ngram_groups(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, row_key, n_shingles, group of each row.

    row_key: a hash of doc_id and text. group: the same number for rows that
    links of Jaccard >= num/den connect; null for rows without words.
    """
    label = "jaccard"
    docs = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    docs = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    profile = settle(_profiles(docs, n), f"{label}-profiles")
    ids = ["n_shingles", "d1", "d2"]
    classes = settle(profile.where("n_shingles > 0").groupBy(*ids).agg(F.min("row_key").alias("rep")), f"{label}-classes")
    copies = profile.join(classes.withColumnRenamed("rep", "row_key"), [*ids, "row_key"], "left_anti").select("row_key")
    copies = settle(copies.distinct(), f"{label}-copies")
    sets = _branching_sets(docs.select("row_key", "text"), copies, n, num, den)
    sets = settle(sets.dropDuplicates(["id"]), f"{label}-sets")
    joined = components(_links(sets, num, den, label), f"{label}-components")
    of_rep = classes.join(joined, classes.rep == joined.node, "left").select(*ids, F.coalesce("component", "rep").alias("group"))
    return profile.join(of_rep, ids, "left").select("doc_id", "row_key", "n_shingles", "group")


def ngram_components(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the group; its own without words) of each row."""
    found = settle(ngram_groups(docs, n, num, den, text, key), "jaccard-groups")
    low = found.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("low"))
    return found.join(low, "group", "left").select("doc_id", "n_shingles", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))
