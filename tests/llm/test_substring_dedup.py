import random

from groundwork.llm.substring_dedup import cut_words, remove_repeats, repeated_passages, tune

from .helpers import EDGES, docs


def prose(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n)]


def brute(rows, n):
    """Words of each text that lie in an exact passage of n words that a smaller id has too."""
    seen, out = {}, {}
    for i, t in sorted(r for r in rows if r[0] is not None):
        w = (t or "").lower().split()
        hit = set()
        for at in range(len(w) - n + 1):
            first = seen.setdefault(tuple(w[at : at + n]), i)
            if first != i:
                hit |= set(range(at, at + n))
        if hit:
            out[i] = hit
    return out


def corpus():
    rng = random.Random(9)
    passages = [prose(rng, n) for n in (50, 51, 60, 90, 200)]
    line = " ".join(prose(rng, 12))
    rows = []
    for i in range(120):
        w = prose(rng, rng.randrange(5, 200))
        if i % 2:
            at = rng.randrange(len(w))
            w[at:at] = passages[i % 5]
        text = " ".join(w)
        rows.append((100 + i, text + "\n" + line if i % 3 == 0 else text))
    return rows, passages, rng


def test_exact_passages_are_all_found_and_nothing_else(spark):
    rows, passages, _ = corpus()
    rows += EDGES + [(900, rows[7][1]), (901, rows[7][1].upper())]
    found = repeated_passages(docs(spark, rows), min_words=50).collect()
    got = {}
    for r in found:
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
        assert r["kept_doc_id"] < r["doc_id"] and r["end_word"] - r["start_word"] >= 50
    want = brute(rows, 50)
    assert got.keys() == want.keys()
    for i in want:
        assert want[i] <= got[i] and len(got[i] - want[i]) <= 2  # a chance word at either end
    clean = remove_repeats(docs(spark, rows), spark.createDataFrame(found)).collect()
    assert len(clean) == len(rows)
    text = {r["doc_id"]: r["text"] for r in clean}
    for p in passages:
        assert sum(" ".join(p) in " ".join((t or "").lower().split()) for t in text.values()) == 1
    for i, t in rows:
        if i not in want:
            assert text[i] == t


def test_substituted_words_and_clusters(spark):
    rng = random.Random(4)
    base = prose(rng, 100)
    near = list(base)
    for at in (30, 70):
        near[at] = "other"
    far = [w if n % 3 else "other" for n, w in enumerate(base)]
    rows = [(1, " ".join(prose(rng, 30) + base)), (2, " ".join(near + prose(rng, 30))), (3, " ".join(far)), (4, " ".join(base))]
    found = repeated_passages(docs(spark, rows), min_words=50).collect()
    assert {(r["doc_id"], r["kept_doc_id"]) for r in found} == {(2, 1), (4, 1)}
    assert len({r["cluster_id"] for r in found}) == 1
    assert {r["end_word"] - r["start_word"] for r in found if r["doc_id"] == 2} == {100}


def test_smaller_texts_that_hold_less_hide_no_pair(spark):
    rng = random.Random(21)
    base = prose(rng, 54)
    near = list(base)
    near[6] = "other"
    rows = [(n, " ".join(prose(rng, 20) + base[at : at + 44] + prose(rng, 20))) for n, at in enumerate((0, 4, 10))]
    rows += [(10 + n, " ".join(prose(rng, 30) + base[n : n + 6] + prose(rng, 30))) for n in range(0, 49)]
    rows += [(100, " ".join(prose(rng, 10) + base)), (101, " ".join(base + prose(rng, 10))), (102, " ".join(prose(rng, 40) + near))]
    found = repeated_passages(docs(spark, rows).coalesce(1), min_words=50).collect()
    assert {r["doc_id"] for r in found} == {101, 102} and {r["kept_doc_id"] for r in found} <= {100, 101}
    got = {i: set().union(*(range(r["start_word"], r["end_word"]) for r in found if r["doc_id"] == i)) for i in (101, 102)}
    assert set(range(54)) <= got[101] and set(range(40, 94)) <= got[102]


def test_second_occurrences_and_runs_of_equal_words(spark):
    rng = random.Random(22)
    line, passage = prose(rng, 30), prose(rng, 30)
    rows = [
        (1, " ".join(line + prose(rng, 40) + line + passage)),  # the line comes twice, the passage only after the second
        (2, " ".join(prose(rng, 33) + line + passage)),
        (10, " ".join(prose(rng, 9) + ["run"] * 45 + prose(rng, 9))),
        (11, " ".join(prose(rng, 9) + ["run"] * 119 + prose(rng, 9))),
        (12, " ".join(prose(rng, 71) + ["run"] * 119 + prose(rng, 20))),
        (13, " ".join(prose(rng, 50) + ["run"] * 200)),
    ]
    got = {}
    for r in repeated_passages(docs(spark, rows), min_words=50).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    want = brute(rows, 50)
    assert got.keys() == want.keys() == {2, 12, 13}
    for i in want:
        assert want[i] <= got[i] and len(got[i] - want[i]) <= 2


def alike(a, b, n):
    """Whether two runs of n words have five-word shingles of Jaccard 0.8 in place, with equal shingles at both ends."""
    same = [x == y for x, y in zip(a, b)]
    match = [all(same[i : i + 5]) for i in range(n - 4)]
    return match[0] and match[-1] and 10 * sum(match) >= 8 * (2 * (n - 4) - sum(match))


def test_every_run_with_a_substituted_word_is_found_and_nothing_else(spark):
    rng = random.Random(31)
    n = 50
    passages = [prose(rng, k) for k in (50, 53, 60, 75)]
    rows = []
    for i in range(90):
        w = prose(rng, rng.randrange(20, 60))
        for _ in range(2):
            p = list(passages[rng.randrange(4)])
            for at in range(rng.randrange(2, 40), len(p), rng.choice([20, 31, 46, 60])):
                p[at] = rng.choice("xyz")
            at = rng.randrange(len(w))
            w[at:at] = p[rng.randrange(3) : len(p) - rng.randrange(3)]
        rows.append((i, " ".join(w)))
    want = {}
    split = {i: t.split() for i, t in rows}
    for i, a in split.items():
        for j in range(i):
            b = split[j]
            # runs that can be alike share their first shingle
            at = {}
            for y in range(len(b) - n + 1):
                at.setdefault(tuple(b[y : y + 5]), []).append(y)
            for x in range(len(a) - n + 1):
                for y in at.get(tuple(a[x : x + 5]), ()):
                    if alike(a[x : x + n], b[y : y + n], n):
                        start, end = x, x + n
                        while start and y - x + start and a[start - 1] == b[y - x + start - 1]:
                            start -= 1
                        while end < min(len(a), len(b) - y + x) and a[end] == b[y - x + end]:
                            end += 1
                        want.setdefault(i, set()).update(range(start, end))
    got = {}
    for r in repeated_passages(docs(spark, rows), min_words=n).collect():
        a, b = split[r["doc_id"]][r["start_word"] : r["end_word"]], split[r["kept_doc_id"]][r["kept_start_word"] :]
        assert any(alike(a[x : x + n], b[x : x + n], n) for x in range(len(a) - n + 1))
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    found, all_ = sum(len(want[i] & got.get(i, set())) for i in want), sum(map(len, want.values()))
    assert all_ > 2000 and found >= 0.95 * all_
    assert all(got[i] <= want.get(i, set()) for i in got)


def test_every_pair_behind_a_smaller_text_that_holds_too_little(spark):
    rng = random.Random(32)
    rows = []
    for n in range(20):
        passage = prose(rng, 52)
        for i, own in ((1, passage[: 48]), (5, passage), (9, passage)):
            rows.append((100 * n + i, " ".join(prose(rng, 30) + own + prose(rng, 30))))
    found = {(r["doc_id"], r["kept_doc_id"]) for r in repeated_passages(docs(spark, rows), min_words=50).collect()}
    assert found == {(100 * n + 9, 100 * n + 5) for n in range(20)}


def test_repeated_ids_with_other_texts_and_null_ids(spark):
    rng = random.Random(33)
    passage, own = prose(rng, 60), prose(rng, 100)
    rows = [(1, " ".join(prose(rng, 20) + passage)), (7, " ".join(passage + prose(rng, 30))), (7, " ".join(own)), (None, " ".join(prose(rng, 25) + passage)), (1, None), (8, " ".join(own)), (8, " ".join(own))]
    df = docs(spark, rows)
    found = repeated_passages(df, min_words=50)
    clean = sorted((r["doc_id"] is None, r["doc_id"], len((r["text"] or "").split())) for r in remove_repeats(df, found).collect())
    assert clean == [(False, 1, 0), (False, 1, 80), (False, 7, 30), (False, 7, 100), (False, 8, 0), (False, 8, 0), (True, None, 25)]


def test_very_long_text_and_clashing_names(spark):
    rng = random.Random(34)
    long_ = prose(rng, 60_000)
    rows = [(1, " ".join(long_), 5, "a"), (2, " ".join(prose(rng, 10) + long_[30_000:30_200]), 6, "b"), (3, " ".join(["same"] * 30_000), 7, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __spans int, doc string")
    found = repeated_passages(df).collect()
    assert [(r["doc_id"], r["start_word"], r["end_word"], r["kept_doc_id"], r["kept_start_word"]) for r in found] == [(2, 10, 210, 1, 30_000)]
    clean = {r["doc_id"]: r for r in remove_repeats(df, spark.createDataFrame(found)).collect()}
    assert {i: r["__spans"] for i, r in clean.items()} == {1: 5, 2: 6, 3: 7} and len(clean[2]["text"].split()) == 10 and clean[3]["text"] == rows[2][1]


def test_empty_and_hot(spark):
    assert repeated_passages(docs(spark, [])).collect() == []
    text = " ".join(f"w{n}" for n in range(80))
    found = repeated_passages(docs(spark, [(i, text) for i in range(300)])).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in found} == {(i, 0, 80) for i in range(1, 300)}
    assert all(r["kept_doc_id"] < r["doc_id"] for r in found) and len({r["cluster_id"] for r in found}) == 1


def test_pieces():
    assert tune(0.8, 0.95) == (2, 1)
    assert cut_words(b" a b\nc d ", [(1, 3)]) == b" a d "
    assert cut_words(b"a b", [(0, 2)]) == b""
    assert cut_words(b"a b c", [(0, 1), (0, 2), (7, 9)]) == b"c"
