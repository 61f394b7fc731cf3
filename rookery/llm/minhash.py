"""Near-duplicates by ProbMinHash sketches, banding and verification.

A text is a set of shingles of five words, each with a weight. Every shingle
sends arrivals, a Poisson process with its weight as rate, each to a register
drawn at random; a register keeps the shingle that came first. The chance that
two texts keep the same one is their probability Jaccard similarity. Arrivals
are made in order of time for all of a batch's texts at once, and a text stops
when no further one could be first anywhere.

Equal texts are one from the start. Sketches are cut into bands; texts with an
equal band may be near, and the exact Jaccard similarity of their shingles
decides. As that similarity is of sets, all weights are equal here, and the
probability Jaccard similarity is the one that is verified, however often either
text repeats a passage. First each text is held against a few of its bucket's texts (stars),
which joins most groups, and decides all pairs of a small bucket. Where the other
texts of a bucket still belong to different groups, blocks of them are held against
each other: every pair of a bucket that could join two groups is decided, and only
pairs that do leave the task. Texts that share no bucket never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import binary, stage
from .links import components

SHINGLE, SIMILARITY = 5, 0.8
#: Two texts of similarity 0.8 share none of 30 bands of 5 registers 7 times in a million.
BANDS, ROWS = 30, 5
#: Texts of a block; marks of needed texts at most; tasks that the copies of one text are dealt to.
BLOCK, MARKS, SALTS = 256, 1 << 27, 32

_ODD = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(1, 65)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, the same in every process, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(texts: list[bytes], hashes: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: owner, hash and how often. A text of fewer words is one shingle; one without words has none."""
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((h for w in words for h in map(hashes.__getitem__, w)), np.uint64, int(n.sum()))
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), count)
    first = np.repeat(np.cumsum(n) - n, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    key = np.zeros(len(owner), np.uint64)
    for i in range(size):
        inside = i < n[owner]
        key += np.where(inside, mix64(flat[np.minimum(first + i, max(0, len(flat) - 1))] + _ODD[i]) * _ODD[i], np.uint64(0))
    key = mix64(key + np.minimum(n[owner], size).astype(np.uint64))
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], key[at], np.diff(np.append(at, len(key)))


def prob_minhash(owner: np.ndarray, key: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """Registers of each text: the shingle that arrived first (0 where none did)."""
    time = np.full(texts * registers, np.inf)
    held = np.zeros(texts * registers, np.uint64)
    live, clock, k = np.arange(len(key)), np.zeros(len(key)), 0
    while len(live):
        k += 1
        draw = mix64(key[live] + np.uint64(int(_ODD[0]) * 2 * k % (1 << 64)))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        clock = clock - np.log(uniform) / weight[live]
        slot = owner[live] * registers + (mix64(draw + _ODD[1]) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(time, slot, clock)
        first = time[slot] == clock
        held[slot[first]] = key[live[first]]
        latest = time.reshape(texts, registers).max(axis=1)
        on = clock < latest[owner[live]]  # a later arrival can't be first any more
        live, clock = live[on], clock[on]
    return held.reshape(texts, registers)


def sketches(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """(id, h1, h2, bands) for rows (id, text): a hash of the text (null for a null
    text), and hashes of its bands (none for a text without words). Each shingle weighs 1, however often it comes: what is verified is the similarity of sets."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = Words()
        for batch in batches:
            out, digests = [], []
            for at in range(0, len(batch), 256):
                some = binary(batch.column(1).slice(at, 256)).to_pylist()
                digests += [xxhash.xxh3_128_digest(t) for t in some]
                owner, key, _ = shingles(some, hashes, size)
                held = prob_minhash(owner, key, np.ones(len(key)), len(some), bands * rows).reshape(len(some), bands, rows)
                band = np.zeros((len(some), bands), np.uint64) + _ODD[2] * np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    band = mix64(band + held[:, :, r] * _ODD[r])
                worded = np.zeros(len(some), bool)
                worded[owner] = True
                out += [b if ok else [] for b, ok in zip(band.view(np.int64).tolist(), worded.tolist(), strict=True)]
            whole = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(whole[:, i], mask=null) for i in (0, 1)), pa.array(out, pa.list_(pa.int64()))], ["id", "h1", "h2", "bands"])

    return docs.select("id", "text").mapInArrow(sketched, "id bigint, h1 bigint, h2 bigint, bands array<bigint>")


def _sets(texts: list[bytes], hashes: Words, size: int) -> list[np.ndarray]:
    out = []
    for at in range(0, len(texts), 256):
        some = texts[at : at + 256]
        owner, key, _ = shingles(some, hashes, size)
        out += np.split(key, np.searchsorted(owner, np.arange(1, len(some))))
    return out


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """The `pairs` (a, b) that are near."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Words()
        for batch in batches:
            near = []
            sides = [binary(batch.column(c)).to_pylist() for c in (2, 3)]
            for at in range(0, len(batch), 256):
                for x, y in zip(*(_sets(side[at : at + 256], hashes, size) for side in sides), strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                    near.append(common > 0 and common >= similarity * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    a, b = (texts.select(F.col("id").alias(c), F.col("text").alias(f"of_{c}")) for c in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "of_a", "of_b").mapInArrow(verify, "a bigint, b bigint")


def _likely(rows: DataFrame, needed: DataFrame, most: int = MARKS) -> DataFrame:
    """`rows` (id, text) less most of those whose id isn't in `needed`, before
    anything is shuffled: a mark for each needed id's hash, `most` marks at most (16 MB), goes to all
    tasks. Rows that are needed always stay; what else stays, a join drops."""
    size = min(most, max(1 << 16, 1 << (8 * needed.count()).bit_length()))
    slot = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(size))
    words = needed.select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("bits")).toPandas()
    marks = np.zeros(size // 32, np.uint32)
    marks[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    shared = rows.sparkSession.sparkContext.broadcast(marks)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(2).to_numpy()
            on = (shared.value[s >> 5] >> (s & 31).astype(np.uint32)) & 1
            yield batch.select(["id", "text"]).filter(pa.array(on.astype(bool)))

    return rows.select("id", "text", slot.alias("s")).mapInArrow(marked, "id bigint, text string")


def _across(members: DataFrame, similarity: float, size: int, block: int) -> DataFrame:
    """Links (a, b) between groups, for `members` (id, text, component, family: a bucket):
    enough of the near pairs of one bucket to join the groups that they join."""
    counts = members.groupBy("family", "component").agg(F.count("*").alias("n"))
    large = counts.where(F.col("n") >= block).select("family", "component", F.col("component").alias("own"))
    dealt = members.join(large, ["family", "component"], "left").withColumn("own", F.coalesce("own", F.lit(-1)))  # small groups share blocks
    pools = stage(dealt.groupBy("family", "own").agg(F.ceil(F.count("*") / block).alias("blocks")), "pools")
    dealt = dealt.join(pools, ["family", "own"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).drop("blocks")
    each = pools.select("family", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    other = each.select("family", F.col("own").alias("own2"), F.col("block").alias("block2"))
    task = F.xxhash64("family", "own", "block", "own2", "block2")
    meet = each.join(other, "family").where("own < own2 or (own = own2 and own = -1 and block <= block2)").withColumn("task", task)
    sides = meet.select("family", "own", "block", "task").unionByName(meet.select("family", F.col("own2").alias("own"), F.col("block2").alias("block"), "task")).distinct()
    rows = dealt.join(sides, ["family", "own", "block"]).select("task", "id", "component", "text")

    def compare(group: pa.Table) -> pa.Table:
        ids, parts = group.column("id").to_numpy(), group.column("component").to_pylist()
        sets = _sets(group.column("text").combine_chunks().cast(pa.binary()).to_pylist(), Words(), size)
        sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, token = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        order = np.argsort(token, kind="stable")
        by_token, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(token))])
        mine = np.split(token, np.cumsum(sizes)[:-1]) if len(sets) else []
        at = {p: p for p in parts}

        def top(x: int) -> int:
            while at[x] != x:
                at[x] = at[at[x]]
                x = at[x]
            return x

        found = []
        for i, tokens in enumerate(mine):  # of each text, how much it shares with every other one
            if not len(tokens):
                continue
            spans = [by_token[starts[t] : starts[t + 1]] for t in tokens]
            common = np.bincount(np.concatenate(spans), minlength=len(sets))
            for j in np.flatnonzero(common >= similarity * (sizes[i] + sizes - common)):
                x, y = top(parts[i]), top(parts[j])
                if x != y:
                    at[max(x, y)] = min(x, y)
                    found.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return rows.groupBy("task").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """A row for each distinct id of `docs`: doc_id, class_id (the smallest id with
    an equal text), component_id (the smallest id reachable by links, between
    equal texts and texts of `similarity` or more) and kept (doc_id = component_id).

    Ids are whole numbers; a null id is one id that links with nothing and is kept.
    A null text links with nothing, a text without words with its equals only; one
    of fewer than `size` words is one shingle. If an id comes with several texts,
    it links through each. Other columns aren't read; an empty table gives none.

    Shuffled are hashes of texts and of bands, and of the texts only those that share a band."""
    base = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    found = stage(sketches(base, bands=bands, rows=rows, size=size), "sketches")
    named = found.where("id is not null")
    # Of a text with copies the smallest id; a text without any needs no join. Copies are dealt to SALTS tasks.
    classes = named.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("class"), F.count("*").alias("n")).where("n > 1").drop("n")
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = named.where("h1 is not null").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    member = salted.join(classes, ["h1", "h2", "salt"], "left").withColumn("class", F.coalesce("class", "id"))
    member = stage(member.select("id", "class", F.when(F.col("id") == F.col("class"), F.col("bands")).alias("bands")), "members")

    # Stars: each text of a bucket against a few of its texts.
    banded = member.where("id = class").select("id", F.explode("bands").alias("band"))
    order = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id"))["id"] for k in (1, 2)]
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")  # few of all bands
    banded = stage(banded.join(shared, "band"), "shared_bands")
    pivots = banded.groupBy("band").agg(F.array_distinct(F.array(F.min("id"), F.max("id"), *order)).alias("pivots"))
    star = banded.join(pivots, "band").select("id", F.explode("pivots").alias("pivot")).where("id <> pivot")
    pairs = stage(star.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    needed = stage(needed, "needed")
    texts = stage(_likely(base.where("text is not null"), needed).join(needed, "id", "left_semi").dropDuplicates(["id", "text"]), "texts")
    links = stage(_verified(pairs, texts, similarity, size).distinct(), "near")

    # Groups by links; an id with several texts joins its classes.
    several = member.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b")
    several = several.select("a", "b").unionByName(member.join(several.select("id"), "id").select(F.col("id").alias("a"), F.col("class").alias("b")))
    groups = stage(components(links.unionByName(several).toDF("u", "v")).select(F.col("node").alias("id"), "component"), "groups")

    # Pairs that no star has decided: of a bucket's texts besides its pivots, if they belong to several groups. Buckets of the same texts are one.
    others = banded.join(pivots, "band").where(~F.array_contains("pivots", F.col("id"))).select("band", "id")
    placed = stage(others.join(groups, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component")), "placed")
    marks = [F.count("*").alias("n"), F.min("id").alias("x"), F.max("id").alias("y"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("t")]
    open_ = placed.groupBy("band").agg(F.min("component").alias("p"), F.max("component").alias("q"), *marks).where("p <> q")
    open_ = open_.groupBy("n", "x", "y", "s", "t").agg(F.min("band").alias("band")).select("band")
    members = stage(placed.join(open_, "band").select("id", "component", F.col("band").alias("family")), "open").join(texts, "id")
    more = stage(_across(members, similarity, size, block), "across")
    if more.limit(1).count():
        lead = groups.select(F.col("id").alias("k"), "component")
        ends = more.join(lead.toDF("a", "u"), "a", "left").join(lead.toDF("b", "v"), "b", "left").select(F.coalesce("u", "a").alias("u"), F.coalesce("v", "b").alias("v"))
        merged = components(ends).select(F.col("node").alias("component"), F.col("component").alias("final"))
        lone = merged.join(groups.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("id"), F.col("final").alias("component"))
        groups = groups.join(merged, "component", "left").select("id", F.coalesce("final", "component").alias("component")).unionByName(lone)

    leaders = groups.select(F.col("id").alias("class"), "component")
    told = member.groupBy("id").agg(F.min("class").alias("class")).join(leaders, "class", "left").select("id", "class", F.coalesce("component", "class").alias("component"))
    rest = found.select("id").distinct().where("id is null").unionByName(named.select("id").distinct().join(member.select("id"), "id", "left_anti"))
    everyone = told.unionByName(rest.select("id", F.col("id").alias("class"), F.col("id").alias("component")))
    return everyone.select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
