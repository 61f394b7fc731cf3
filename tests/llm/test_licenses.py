import random
import re
import time

from rookery.llm.licenses import NOTICES, PHRASES, scan, scan_licenses

ARGS = (PHRASES, tuple(NOTICES), 10)


def test_base_places_as_brute_force():
    rnd = random.Random(3)
    parts = ["mit", "MIT", "license", "license,", "cc", "by", "CC-BY", "gnu", "general", "public", "apache", "é", "mit license mit license", "\n", "-", "cc by cc by", "gnu general public license"]
    for _ in range(600):
        text = " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        places = sorted((i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        n, exact, _ = scan(text.encode(), *ARGS)
        assert n == len(words) and sorted((m[2], m[0]) for m in exact) == places


def test_near_notices_are_found_with_their_edits():
    _, exact, near = scan(b"x Relased under the MIT Licence, see y", *ARGS)
    assert not exact and ("mit", "released under the mit license", 1, 5) in {m[:4] for m in near}
    assert all(m[4] <= len(m[1]) // 10 for m in near)
    assert scan("ceci n'est pas une licence".encode(), *ARGS)[1:] == ([], [])


def test_every_misspelling_within_the_bound_is_found():
    rnd = random.Random(4)
    for notice, label in NOTICES:
        for _ in range(20):
            wrong = list(notice)
            for _ in range(len(notice) // 10):
                wrong[rnd.randrange(1, len(wrong) - 1)] = rnd.choice("qxzjk")
            assert label in {m[0] for m in scan(f"w {''.join(wrong)} v".encode(), *ARGS)[2]}, "".join(wrong)


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edits_of_all_kinds_and_their_spans_as_brute_force():
    rnd = random.Random(5)
    for notice, label in NOTICES:
        k = len(notice) // 10
        for _ in range(12):
            wrong = list(notice)
            for _ in range(rnd.randint(0, k)):
                at, how = rnd.randrange(1, len(wrong) - 1), rnd.randrange(3)
                wrong[at : at + (how != 0)] = [] if how == 1 else [rnd.choice("qxzjk")]
            wrong = "".join(wrong)
            words = wrong.split()
            before = [rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randint(0, 4))]
            near = scan(" ".join([*before, *words, "omega", "delta"]).encode(), *ARGS)[2]
            mine = [m for m in near if m[1] == notice]
            assert len(mine) == 1, (notice, wrong, near)
            _, _, first, last, edits = mine[0]
            text = [*before, *words, "omega", "delta"]
            # As few edits as the best span of words that holds the notice, and those that its own span needs.
            best = min(edits_between(" ".join(text[i : j + 1]), notice) for i in range(len(text)) for j in range(i, len(text)))
            assert edits_between(" ".join(text[first : last + 1]), notice) <= edits <= k and best <= edits
            assert first <= len(before) + 1 and last >= len(before) + len(words) - 2


def test_neighbouring_notices_are_all_told():
    near = scan(b"mozilla publik licence mozilla public license", *ARGS)[2]
    assert [(m[2], m[3]) for m in near if m[0] == "mpl"] == [(0, 2), (3, 5)]


def test_a_very_long_text_of_misspelt_notices():
    text = b"released under the mit licence and " * 60_000  # 2 MB
    began = time.time()
    n, exact, near = scan(text, *ARGS)
    assert n == 360_000 and not exact and len([m for m in near if m[1] == "released under the mit license"]) == 60_000
    assert time.time() - began < 60


def test_repeated_rows_stay(spark):
    df = spark.createDataFrame([(1, "MIT license"), (1, "MIT license"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_base) for r in scan_licenses(df).collect()) == [(0, 0), (1, 1), (1, 1)]


def test_rows(spark):
    rows = [(1, "Released under the MIT License.", "a"), (2, None, "b"), (None, "", "c"), (3, "Licensed under CC BY-NC 4.0.", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].base_labels, got[1].labels, got[1].score) == (5, 1, 3, "mit", "mit", 1.0)
    assert (got[2].n_words, got[2].first_word, got[2].labels, got[2].score) == (0, None, "", 0.0)
    assert got[3].base_labels == "cc-by" and got[None].n_base == 0
    assert scan_licenses(df.limit(0)).count() == 0
