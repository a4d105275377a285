"""Variant groups against all pairs in plain Python; the gram bounds against every edit of a word."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from netlens.llm import queries, spelling

SCHEMA = "doc_id long, text string, n long, word string"


def plain_words(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(rows):
    n = plain_words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v.encode()), default=None) for w in n}
    form = {w: b if b and n[b] >= 5 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def found_groups(frame):
    rows = frame.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_query_equals_all_pairs(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert found_groups(queries.op13_spelling_variants(spark, sf_dir)) == plain_groups(rows)


def made_up(rng):
    """Clusters of variants over a small alphabet, with accents, chains of forms, ties and repeated letters."""
    words = ["".join(rng.choices("aabbé", k=rng.randint(6, 8))) for _ in range(260)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaaa", "aaaaaab", "abcdefgh", "abcdefgi", "abcdefg", "xabcdefgh"]
    counts = {w: rng.choice([4, 5, 6, 25, 30, 126, 700]) for w in words}
    text = [w for w, n in counts.items() for _ in range(n)]
    rng.shuffle(text)
    return text


def test_dense_variants(spark):
    rng = random.Random(6)
    text = made_up(rng)
    rows = [(i, " ".join(text[i * 150 : (i + 1) * 150])) for i in range(len(text) // 150 + 1)]
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA).repartition(4)
    want = plain_groups(rows)
    assert sum(v[0] is not None for v in want.values()) > 10 and sum(v[3] for v in want.values()) > 200
    assert found_groups(spelling.group_variants(docs)) == want


@pytest.mark.parametrize("size", [0, spelling.GRAMS])
def test_near_words_share_a_prefix_gram(spark, size):
    """Every pair one edit apart is found, also where a shared gram is rare in one word's lists and frequent in the other's."""
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefgh", k=rng.randint(6, 12))) for _ in range(150)]
    words = set(base)
    for word in base * 4:
        at, letter = rng.randrange(len(word) + 1), rng.choice("abcdefgh")
        words.add(rng.choice([word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :]]))
    words = sorted(w for w in words if len(w) >= spelling.LENGTH)
    found = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    pairs = spelling.near_words(spelling.index(found, spelling.dictionary(found, size) if size else [])).select("a", "b").collect()
    assert sorted(tuple(r) for r in pairs) == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_odd_rows(spark):
    many = "Étienne Àÿ×÷Àé Āletters lettersĀ UPPER upperCASE UPPERCASE x" + "y" * 5000 + " \U0001f600smiling cafés-bars "
    rows = [(None, many * 7), (1, None), (2, ""), (3, many), (3, many), (4, "short " * 9), (5, "é" * 300_000 + " " + "longest " * 50)]
    rows += [(i, "variant letters upperase") for i in range(10, 420)]
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA).repartition(3)
    assert found_groups(spelling.group_variants(docs)) == plain_groups(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 0, "")], [(1, "one two", 0, "")]])
def test_no_words(spark, rows):
    assert spelling.group_variants(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_runs_end_with_their_text(spark):
    rows = [(1, "letter"), (2, "letters"), (3, "letter")] * 6
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA).coalesce(1)
    assert {r["word"]: r["n"] for r in spelling.words(docs).collect()} == plain_words(rows)


@pytest.mark.parametrize("entries", [[], ["abc", "abca", "bca", "aab", "aabb"], ["aaa", "aaaa", "aba", "abab", "bab", "baba"]])
def test_bounds_hold_for_every_edit(entries):
    """Grams that a word shares with any word one edit away, at the same place from its start or end, are never fewer than the bound."""
    cutter, rng = spelling.Cutter(entries), random.Random(7)
    for _ in range(150):
        word = "".join(rng.choices("abc", k=rng.randint(6, 9)))
        grams, affected = cutter.decompose(word)
        assert len(grams) == len(word) - 1 and affected < len(grams)
        edits = {word[:i] + c + word[i + d :] for i in range(len(word) + 1) for c in ("", "a", "b", "c") for d in (0, 1) if i + d <= len(word)} - {word}
        for other in (e for e in edits if len(e) >= 5):
            theirs, _ = cutter.decompose(other)
            shift = len(theirs) - len(grams)
            same = sum(
                (i < len(theirs) and theirs[i] == g) or (0 <= i + shift < len(theirs) and theirs[i + shift] == g) for i, g in enumerate(grams)
            )
            assert same >= len(grams) - affected, (word, other)


def test_dictionary_is_bounded_and_pruned_by_frequency(spark):
    words = spark.createDataFrame([("banana",), ("bananas",), ("cabana",)], "word string")
    assert set(spelling.dictionary(words, 3)) == {"ana", "ban", "bana"}
    assert len(spelling.dictionary(words, 1000)) == len({w[i : i + k] for w in ("banana", "bananas", "cabana") for k in (3, 4) for i in range(len(w) - k + 1)})


def test_roots_follow_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}" if i < 9 else None) for i in range(10)], "word string, form string").withColumn("n", F.lit(1))
    assert {r["word"]: r["root"] for r in spelling.roots(forms).collect()} == {f"w{i}": "w9" for i in range(9)}
