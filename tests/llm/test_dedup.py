"""Exact, line and near dedup against brute force, with nulls, ties, repeated rows and clashing names."""

from collections import defaultdict

import numpy as np
import pytest

from tesserae.llm import exact_dedup, line_dedup, near_dup
from tesserae.llm.common import WORD

SCHEMA = "doc_id long, text string, id string, `__row` int, node int"
ODD = [
    (3, "same text", "a", 1, 1), (1, "same text", "b", 2, 2), (None, "same text", "c", 3, 3), (1, "same text", "b", 2, 2), (5, None, "d", 4, 4),
    (5, None, "d", 4, 4), (6, "", "e", 5, 5), (7, "", "f", 6, 6), (8, "other", "g", 7, 7), (8, "different", "g", 7, 7),
]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_exact_dedup_rules(spark):
    got = rows(exact_dedup.exact_dedup(spark.createDataFrame(ODD, SCHEMA)))
    want = [ODD[1], ODD[4], ODD[5], ODD[6], ODD[8], ODD[9]]
    assert got == sorted(want, key=repr)
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.exact_dedup(empty).columns == empty.columns


def test_exact_dedup_heavy_and_light_agree(spark):
    data = [(i, f"t{i % 7}" if i % 2 else f"u{i % 90}", "x", 0, 0) for i in range(600)]
    df = spark.createDataFrame(data, SCHEMA)
    first = {}
    for r in data:
        first.setdefault(r[1], r[0])
    for counters in (1, 8, 1024):
        assert sorted(r.doc_id for r in exact_dedup.exact_dedup(df, counters=counters).collect()) == sorted(first.values())


def test_misra_gries_bound():
    rng = np.random.default_rng(0)
    data = np.concatenate([np.full(400, 7), rng.integers(100, 10_000, 600)])
    rng.shuffle(data)
    held = exact_dedup.misra_gries(np.array_split(data, 9), 20)
    assert 400 - len(data) / 21 <= held[7] <= 400 and len(held) <= 20


def grams(t, n=1):
    w = WORD.findall((t or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)] if w else [])


def near_brute(data, t, n=1):
    """{id: (smallest id of its class, number of links)} and the ids that stay."""
    sets = {i: grams(x, n) for i, x in data}
    root, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets.items()):
        for j, y in list(sets.items())[a + 1 :]:
            if x and y and len(x & y) >= t * len(x | y) - 1e-12:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (find(i), links[i]) for i in sets}, {i for i in sets if find(i) == i}


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            text = out[int(rng.integers(0, len(out)))][1].split()
            for _ in range(int(rng.integers(0, 4))):
                if text:
                    text[int(rng.integers(0, len(text)))] = vocabulary[int(rng.integers(0, 120))]
        else:
            text = [vocabulary[k] for k in rng.integers(0, 120, int(rng.integers(1, 90)))]
        out.append((i, " ".join(text)))
    return [*out, (n, None), (n + 1, ""), (n + 2, "?!")]


@pytest.mark.parametrize(("t", "n"), [(near_dup.THRESHOLD, near_dup.NGRAM), (0.85, 1), (0.6, 3), (0.75, 2)])
def test_near_dedup_against_brute_force(spark, monkeypatch, t, n):
    monkeypatch.setattr(near_dup, "TILE", 3)  # components of several tiles
    data = corpus(round(10 * t) + n)
    df = spark.createDataFrame(data, "doc_id long, text string")
    classes, kept = near_brute(data, t, n)
    assert {r.doc_id for r in near_dup.near_dedup(df, t, n).collect()} == kept
    assert {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_classes(df, t, n).collect()} == classes


def test_a_family_is_one_class_without_its_hubs(spark, monkeypatch):
    """With one block for each node in the first round most links are left to the second."""
    monkeypatch.setattr(near_dup, "HUB_KEYS", 1)
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(150)]
    data = [(i, " ".join([w if rng.random() > 0.06 else f"x{rng.integers(0, 900)}" for w in base])) for i in range(80)]
    data += [(900, " ".join(f"y{i}" for i in range(9000)) + " tail"), (901, " ".join(f"y{i}" for i in range(9000)))]  # very long
    df = spark.createDataFrame(data, "doc_id long, text string")
    classes, _ = near_brute(data, near_dup.THRESHOLD, near_dup.NGRAM)
    assert classes[901] == (900, 1)
    assert {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_classes(df).collect()} == classes


def test_every_near_pair_shares_enough_blocks():
    rng = np.random.default_rng(4)
    bands = near_dup.Bands(near_dup.THRESHOLD)
    for _ in range(300):
        base = np.unique(rng.integers(0, 2**32, int(rng.integers(8, 300)), dtype=np.uint32))
        other = base[rng.random(len(base)) > rng.random() * 0.14]
        if len(other) < near_dup.THRESHOLD * len(base):
            continue
        need = int(bands.needs(np.array([len(other)]))[0])
        left, right = (near_dup.block_keys(base, bands), near_dup.block_keys(other, bands))
        a, b = set(np.concatenate([k for k, _ in left] or [np.empty(0)]).tolist()), set(np.concatenate([k for k, _ in right] or [np.empty(0)]).tolist())
        if bands.shape(bands.of(len(other)))[0] >= 1 and len(other) != len(base):
            assert len(a & b) >= need


def test_common_blocks_are_left_out_and_no_near_pair_is_lost():
    """By the order of rarity every near pair still shares enough blocks, and texts of common words meet less often by chance."""
    rng = np.random.default_rng(8)
    bands = near_dup.Bands(near_dup.THRESHOLD)
    common, p = rng.integers(0, 2**32, 200, dtype=np.uint32), 1 / np.arange(1, 201)
    sets = [np.unique(np.concatenate([rng.choice(common, 90, p=p / p.sum()), rng.integers(0, 2**32, 60, dtype=np.uint32)])) for _ in range(150)]
    words, counts = np.unique(np.concatenate(sets), return_counts=True)
    rarity = near_dup.Rarity(words[counts > 1], counts[counts > 1], len(sets))

    def keys(members, order):
        return np.concatenate([k for k, _ in near_dup.block_keys(members, bands, rarity=order)])

    def chance(order):
        return int((np.unique(np.concatenate([keys(s, order) for s in sets]), return_counts=True)[1] - 1).sum())

    assert chance(rarity) < chance(None) / 3
    for s in sets:
        other = s[rng.random(len(s)) > rng.random() * 0.14]
        if near_dup.THRESHOLD * len(s) <= len(other) < len(s):
            assert len(set(keys(s, rarity).tolist()) & set(keys(other, rarity).tolist())) >= bands.needs(np.array([len(other)]))[0]
            split = [k.tolist() for at in (range(0, 30), range(30, len(bands.edges))) for k, _ in near_dup.block_keys(s, bands, rarity=rarity, probes=at)]
            assert sorted(sum(split, [])) == sorted(keys(s, rarity).tolist())


def test_near_classes_in_passes(spark, monkeypatch):
    """Several passes find what plain loops find, and cover all probes."""
    monkeypatch.setattr(near_dup, "PASS_KEYS", 1)
    monkeypatch.setattr(near_dup, "PASSES", 3)
    data = corpus(21, 40)
    df = spark.createDataFrame(data, "doc_id long, text string")
    passes = near_dup._passes(near_dup._sets(df, 1, "doc_id", "text").dropDuplicates(["node"]), near_dup.THRESHOLD)[1]
    assert len(passes) == 3 and passes[0].start == 0 and all(a.stop == b.start for a, b in zip(passes, passes[1:]))
    classes, _ = near_brute(data, near_dup.THRESHOLD, near_dup.NGRAM)
    assert {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_classes(df).collect()} == classes


def test_shuffle_files_are_deleted_once_a_table_is_written(spark):
    import time

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size())}

    before = shuffled()
    near_dup.materialize(spark.range(1000).repartition(3, "id"), "test-free")
    for _ in range(50):
        if not (left := {x for x in shuffled() - before if x.startswith("shuffle_") and x.endswith(".data")}):
            break
        time.sleep(0.2)
    assert not left


def test_near_dedup_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    got = rows(near_dup.near_dedup(df))
    assert got == sorted([ODD[1], ODD[4], ODD[5], ODD[6], ODD[7], ODD[8], ODD[9]], key=repr)
    assert near_dup.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_dup.near_classes(spark.createDataFrame([], SCHEMA)).count() == 0
    # three texts that are alike have an id; of the rows that share id 1 two are equal, and id 8 has two texts
    want = [(1, 1, 1), (3, 1, 1), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 8, 0), (8, 8, 0)]
    assert rows(near_dup.near_classes(df)) == sorted(want, key=repr)
    two = spark.createDataFrame([(1, "a b c d e f g h"), (1, "a b c d e f g h i"), (2, "a b c d e f g h")], "doc_id long, text string")
    assert rows(near_dup.near_classes(two, 0.85, 1)) == [(1, 1, 2), (1, 1, 2), (2, 1, 2)]
    named = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y")], "name string, body string")
    assert rows(near_dup.near_classes(named, id_col="name", text_col="body")) == [("a", "a", 1), ("b", "a", 1)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcde "), 20)) for _ in range(12)]
    docs = []
    for i in range(25):
        lines = []
        for _ in range(4):
            x = list(base[int(rng.integers(0, 12))])
            if rng.random() < 0.5:
                at = int(rng.integers(1, 18))
                x[at : at + int(rng.integers(0, 2))] = "z" * int(rng.integers(0, 2))
            lines.append("".join(x))
        docs.append((i, "\n".join(lines)))
    docs += [(90, None), (91, ""), (92, "short\nshort")]
    seen, want = [], {}
    for i, t in docs:
        kept = []
        for x in (t or "").split("\n") if t is not None else []:
            key = x.strip()
            if len(key) < line_dedup.LEAST_CHARS:
                kept.append(x)
                continue
            if not any(abs(len(key) - len(o)) <= 1 and edits(key, o) <= 1 for o in seen):
                kept.append(x)
            seen.append(key)
        want[i] = None if t is None else "\n".join(kept)
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup_odd_rows(spark):
    """Null ids come last, ties on the id go to the row's hash, equal rows are returned alike, names may clash, lines may be very
    long, and lines that are too short stay."""
    long = "abcdefghij" * 4000
    data = [(None, "the very same line", 1), (2, "the very same line\nshort", 1), (2, "the very same line\nshort", 1), (3, "the very same linE", 2), (4, long, 0), (5, long + "x", 0), (6, "short\nshort", 0), (7, None, 0), (8, "", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, `line` int").withColumnRenamed("line", "h")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(df).collect()), key=repr)
    want = [(2, "the very same line\nshort", 2, 0)] * 2 + [(3, "", 1, 1), (4, long, 1, 0), (5, "", 1, 1), (6, "short\nshort", 2, 0), (7, None, 0, 0), (8, "", 1, 0), (None, "", 1, 1)]
    assert got == sorted(want, key=repr)
    tied = spark.createDataFrame([(1, "another line of text", "a"), (1, "another line of text!", "b")], "doc_id long, text string, row string")
    assert sorted(r.n_dropped for r in line_dedup.line_dedup(tied).collect()) == [0, 1]
    named = spark.createDataFrame([("b", "a line in a table"), ("a", "a line in a table")], "name string, body string")
    assert {r.name: r.text for r in line_dedup.line_dedup(named, id_col="name", text_col="body").collect()} == {"a": "a line in a table", "b": ""}
