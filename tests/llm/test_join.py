"""Families over several blocks, and one row of each component by row."""

import random

import pytest

from netlens.llm import cells, ngram_join
from tests.llm.test_llm import prose, shingle_set


def counted(texts):
    sets = [shingle_set(t) for t in texts]
    linked = [[b for b in range(len(sets)) if a != b and s and 100 * len(s & sets[b]) >= 80 * len(s | sets[b])] for a, s in enumerate(sets)]
    return [(len({sets[b] for b in linked[a]} - {sets[a]}), len(linked[a])) for a in range(len(sets))]


@pytest.mark.parametrize("members,shingles", [(256, 1 << 18), (4, 1 << 18), (256, 600)])
def test_links_of_a_family_over_blocks(spark, monkeypatch, members, shingles):
    """Near copies around the threshold, exact copies among them, dealt over one block or many: every link is counted."""
    monkeypatch.setattr(cells, "BLOCK_MEMBERS", members)
    monkeypatch.setattr(cells, "BLOCK_ELEMENTS", shingles)
    rng = random.Random(12)
    words = prose(rng, 160).split()
    texts = []
    for i in range(40):
        copy = list(words)
        for _ in range(rng.randrange(1, 6)):  # each edit changes five shingles of some 156, so many pairs lie near 0.8
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(9)}"
        texts.append(" ".join(copy))
    texts += texts[:5] + [texts[3]] * 4 + [prose(rng, 100) for _ in range(10)] + [None, "", "one two"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = sorted(ngram_join.jaccard_components(docs).collect(), key=lambda r: r.doc_id)
    want = counted(texts)
    assert [(r.links_found, r.row_links) for r in found] == want
    assert len({w[0] for w in want[:40]}) > 5  # near the threshold: members differ in how many they link with
    pairs = ngram_join.jaccard_links(docs).count()
    assert 2 * pairs == sum({r.class_key: r.links_found for r in found if r.class_key is not None}.values())


def test_one_row_of_each_component(spark):
    """By row, not by doc_id: clean rows stay whatever their doc_id, one copy of each stays, columns of any name are kept."""
    rng = random.Random(2)
    a, other, third = (prose(rng, 80) for _ in range(3))
    near = a.replace(a.split()[40], "changed")
    rows = [(5, a, 1), (5, a, 2), (5, near, 3), (9, near, 4), (9, other, 5), (None, third, 6), (None, third, 7), (None, a, 8), (1, None, 9), (2, "", 10), (3, "", 11), (1, None, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    found = ngram_join.keep_one_of_each(docs.withColumn("row_", docs.row * 2))
    assert found.columns == ["doc_id", "text", "row", "row_"]
    kept = found.collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept if r.doc_id != 5) == sorted(map(str, [(9, other), (None, third), (1, None), (1, None), (2, ""), (3, "")]))
    assert [r.text in (a, near) for r in kept if r.doc_id == 5] == [True]
    assert all(r.row_ == 2 * r.row for r in kept)


def test_one_of_each_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert ngram_join.keep_one_of_each(docs).count() == 0
