import collections
import random

import pyarrow as pa
import pytest

from rookery.llm import lines

WS = " \t\n\v\f\r"


def key_of(line):
    key = "".join(c.lower() if c.isascii() else c for c in line.strip(WS))
    return key if len(key) >= 20 else None


def brute(rows):
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if (k := key_of(line)) is not None:
                holders[k].add(i)
    order = lambda i: (i is not None, i)
    last = {k: max(ids, key=order) for k, ids in holders.items() if len(ids) >= 3}
    return sorted(((i, "\n".join(x for x in (t or "").split("\n") if (k := key_of(x)) is None or last.get(k, i) == i)) for i, t in rows), key=str)


@pytest.mark.parametrize("partitions", [1, 7])
def test_as_brute_force(spark, partitions):
    rnd = random.Random(5)
    pool = [" ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.randint(3, 12))) for _ in range(60)] + ["é" * 19, "é" * 20, "x" * 19, "Ünïcode Über Alles Straße", "", "  "]
    hot = "Everyone Says This Line Now"
    rows = []
    for i in range(150):
        own = [rnd.choice(["", " ", "\t", "\r"]) + (x.upper() if rnd.random() < 0.2 else x) for x in rnd.choices(pool, k=rnd.randint(0, 9))]
        own += [hot + rnd.choice(["", " ", "\r"])] * rnd.randint(0, 3)
        rows.append((i, "\n".join(own)))
    rows += [(None, pool[0] + "\n" + hot), (None, pool[0] + "\n" + hot), (3, rows[3][1]), (4, hot), (900, None), (901, ""), (902, "\n\n"), (903, (hot + "\n") * 5000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, keep int, text_key string")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(tuple, lines.drop_lines(docs).collect()), key=str) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert lines.keep_bitmaps(docs.limit(0)).count() == 0 == lines.line_digests(docs.limit(0)).count()


def test_tasks_that_share_a_hash():
    """However sorted rows are cut into tasks and batches, rows that are dropped, and open ones by the summaries, are those of one task."""
    rnd = random.Random(6)
    rows = []
    for h in range(12):
        docs = sorted(rnd.sample(range(100), rnd.choice([1, 2, 3, 4, 40])), reverse=True)
        rows += [(h // 3, h, d, d * 7, 1, b"") for d in docs for _ in range(rnd.choice([1, 1, 3]))]
    want = set()
    for h in {r[1] for r in rows}:
        docs = {r[2] for r in rows if r[1] == h}
        want |= {(h, d) for d in docs if len(docs) >= 3 and d != max(docs)}
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for _ in range(60):
        cuts = sorted({0, len(rows), *(rnd.randrange(len(rows)) for _ in range(rnd.randint(0, 9)))})
        told = []
        for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            size = rnd.choice([1, 2, 5, 1000])
            batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : min(i + size, b)], strict=True), kinds, strict=True)], ["h1", "h2", "doc", "text_key", "n_lines", "places"]) for i in range(a, b, size)]
            told += [r for x in lines.stream(iter(batches), part) for r in x.to_pylist()]
        got = {(r["h2"], r["doc"]) for r in told if r["kind"] == lines.DROP}
        for h in {r["h2"] for r in told if r["kind"] == lines.ENDS}:
            ends = sorted((r for r in told if r["kind"] == lines.ENDS and r["h2"] == h), key=lambda r: r["part"])
            n = sum(r["documents"] for r in ends) - sum(p["last"] == q["doc"] for p, q in zip(ends, ends[1:], strict=False))
            if n >= 3:
                got |= {(h, r["doc"]) for r in told if r["kind"] == lines.OPEN and r["h2"] == h and r["doc"] != ends[0]["doc"]}
        assert got == want


def test_bitmaps():
    assert lines.kept_lines(b"a\nb\n", None) == [b"a", b"b", b""]
    assert lines.keys_of(b" \tABC\xc3\x89 and twenty letters\r\nshort\nabc\xc3\x89 AND twenty letters") == (3, {"abcÉ and twenty letters".encode(): [0, 2]})
