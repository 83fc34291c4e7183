import random
import re
from collections import Counter

import pytest

from tracelight.llm.ngram_jaccard import choose_bands, ngram_jaccard, one_of_each

SCHEMA = "doc_id long, text string, a long, c int, n string"


def brute(rows):
    def grams(t):
        w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [grams(r[1]) for r in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in near[i])]) for i in range(len(rows))]
    ids = lambda i: min((rows[j][0] is None, rows[j][0] or 0) for j in range(len(rows)) if root[j] == root[i])
    return [(rows[i][0], len(near[i]), None if ids(i)[0] else ids(i)[1]) for i in range(len(rows))], root


def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out = [" ".join(text(rng.randint(20, 120))) for _ in range(25)]
    for size in (40, 6):
        base = text(130)
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(130)] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    out += [out[0], out[0].upper(), out[1] + ".", "", None, "!!!", "!!!", "one two", "One, two!", "one two three", "a b c d e", "x " * 3000]
    return [(i, t, i, i, "n") for i, t in enumerate(out)] + [(0, out[0], 0, 0, None), (None, out[2], None, None, None)]


@pytest.mark.parametrize("small", [16, 2])
def test_against_brute_force(spark, small):
    rows = corpus()
    want, root = brute(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = ngram_jaccard(docs, small=small, block=8)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_links, r.class_id) for r in got.collect()), key=key) == sorted(want, key=key)


def test_chained_buckets(spark):
    """Windows that slide over one long text: neighbours are alike, and all buckets hang together."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(700)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 110]), i, i, "n") for i in range(280)]
    rows += [(1000 + i, rows[i][1] + ".", i, i, "n") for i in range(0, 280, 9)]
    want, _ = brute(rows)
    got = ngram_jaccard(spark.createDataFrame(rows, SCHEMA).repartition(4), small=2, block=8).collect()
    assert sorted((r.doc_id, r.n_links, r.class_id) for r in got) == sorted(want)
    assert max(n for _, n, _ in want) < 30 and len({c for *_, c in want}) == 1


def test_long_texts(spark):
    """Two texts of a megabyte that differ in some words, among short ones."""
    rng = random.Random(2)
    words = [rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(250_000)]
    other = list(words)
    for _ in range(2000):
        other[rng.randrange(len(other))] = "new"
    rows = [(1, " ".join(words), 0, 0, ""), (2, " ".join(other), 0, 0, ""), (3, "one two three", 0, 0, "")]
    got = ngram_jaccard(spark.createDataFrame(rows, SCHEMA), small=1).collect()
    assert sorted((r.doc_id, r.n_links, r.class_id, r.kept) for r in got) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_one_of_each(spark):
    rows = corpus()
    _, root = brute(rows)
    kept = one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "a", "c", "n"]
    assert kept.count() == len(set(root))


def test_empty(spark):
    assert ngram_jaccard(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bands_reach_the_recall():
    bands, rows = choose_bands(0.8, 0.99999, 160)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99999 and bands * rows <= 160


def test_rows_without_words_all_stay(spark):
    columns = "doc_id long, text string, lang string"
    bare = [(None, None, "en"), (None, "", "de"), (None, "", "de"), (7, "!?", "en"), (7, "!?", "fr")]
    rows = bare + [(8, "one and the same text", "en"), (8, "one and the same text", "en"), (9, "one and the same text", "en")]
    kept = [tuple(r) for r in one_of_each(spark.createDataFrame(rows, columns)).collect()]
    assert Counter(r for r in kept if r[0] not in (8, 9)) == Counter(bare)
    assert [r for r in kept if r[0] in (8, 9)] == [(8, "one and the same text", "en")]
