"""Line dedup and the blocks of texts: what is sent, and how much is held."""

import itertools
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa

from netlens.llm import cells, line_dedup, texts


def test_small_cells_share_a_comparison():
    rng = np.random.default_rng(5)
    groups = []
    for g in range(6):
        base = np.unique(rng.integers(0, 99, 60).astype(np.uint64))  # cells have shingles in common
        groups.append({100 * g + i: (1 + i, 0, np.delete(base, i)) for i in range(2 + g % 3)})
    rows = lambda found: sorted(zip(*[c.to_pylist() for c in found.columns]), key=str)
    apart = sorted((r for group in groups for r in rows(cells.cell_links(group, True, 80))), key=str)
    assert apart and rows(cells.family_links(groups, 80)) == apart


def test_bucket_links_whatever_the_parts(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(30)]
    lines = [" ".join(rng.choices(words, k=9)) for _ in range(60)]
    lines += [line[:-1] + "!" for line in lines[:25]]
    keys = texts.signed(line_dedup.line_keys(pa.array(lines)))
    buckets = {}
    for key, bands in zip(keys.tolist(), line_dedup.band_keys(pa.array(lines)).tolist()):
        for place in enumerate(bands):
            buckets.setdefault(place, set()).add(key)
    want = {(min(b), key) for b in buckets.values() for key in b if key != min(b)}
    docs = spark.createDataFrame([(i, "\n".join(lines[i : i + 5]) + "\n \n") for i in range(0, len(lines), 5)], "doc_id long, text string").repartition(3)
    for parts in (1, 7):
        assert {tuple(r) for r in line_dedup.bucket_links(docs, parts).collect()} == want
    assert want and "bands" not in line_dedup.scan_lines(docs).columns


def test_texts_are_held_in_small_blocks():
    column = pa.array([" ".join(str(i + k) for k in range(2_000)) for i in range(600)])
    list(texts.shingles(next(texts.blocks(column)), 5))  # makes the tables of powers
    tracemalloc.start()
    for block in texts.blocks(column):
        for _ in texts.shingles(block, 5):
            pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


def test_line_keys_are_taken_in_small_blocks():
    lines = pa.array([f"line {i} " + "abcdefgh" * 20 for i in range(20_000)])
    line_dedup.line_keys(lines.slice(0, 3))  # makes the tables of powers
    tracemalloc.start()
    keys = line_dedup.line_keys(lines)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(keys.tolist())) == 20_000
    assert most < 4 << 20


def test_cells_of_two_blocks_compare_across_them_only():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 40).astype(np.uint64)
    members = {}
    for key in range(30):
        other = base.copy()
        other[: key % 9] = rng.integers(0, 1 << 60, key % 9).astype(np.uint64)
        members[key] = (key + 1, key % 2, np.unique(other))
    found = cells.cell_links(members, False, 80).to_pylist()
    expect = {}
    for a, (_, block, one) in members.items():
        near = [b for b, (_, k, two) in members.items() if k != block and 100 * len(np.intersect1d(one, two)) >= 80 * len(np.union1d(one, two))]
        if near:
            expect[a] = (len(near), sum(members[b][0] for b in near))
    assert {r["a"]: (r["links"], r["rows"]) for r in found if r["b"] is None} == expect


def test_cells_count_the_same_whatever_they_count_at_once(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 60, 90).astype(np.uint64)
    members = {key: (key + 1, key % 2, np.unique(np.concatenate([base[key % 11 :], base[: key % 3]]))) for key in range(40)}
    for whole in (True, False):
        rows = []
        for columns in (1, 7, 16, 90, 1 << 12):
            monkeypatch.setattr(cells, "COLUMNS", columns)
            rows.append(cells.cell_links(members, whole, 80).to_pylist())
        assert rows[0] and all(found == rows[0] for found in rows)


def test_minima_match_as_often_as_sets_are_alike_and_stand_for_themselves():
    rng = np.random.default_rng(8)
    for shared, apart in ((4, 1), (8, 2), (40, 10), (240, 60), (5, 5), (150, 150)):
        sets = []
        for _ in range(300):
            hashes = texts.mix(rng.integers(1, 1 << 62, shared + apart).astype(np.uint64))
            sets += [hashes[: shared + apart // 2], np.concatenate([hashes[:shared], hashes[shared + apart // 2 :]])]
        at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        found = line_dedup.minima(np.concatenate(sets), at)
        assert abs((found[::2] == found[1::2]).mean() - shared / (shared + apart)) < 0.02
        if shared == 4 * apart:
            met = (found[::2] == found[1::2]).reshape(300, line_dedup.BANDS, line_dedup.ROWS).all(axis=2).any(axis=1)
            assert met.mean() > 0.98
    sizes = [1, 2000, 7, 300, 1, 60, 100, 100, 3]
    sets = [texts.mix(rng.integers(1, 1 << 62, n).astype(np.uint64)) for n in sizes]
    sets[6] = np.resize(sets[2], 5_000)  # few different hashes, often repeated
    sets[7] = np.resize(sets[3][:250], 700_000)
    found = line_dedup.minima(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
    for i, hashes in enumerate(sets):  # whatever else is in the batch, in any order, repeated or not
        hashes = rng.permutation(np.unique(hashes))
        assert (line_dedup.minima(hashes, np.array([0, len(hashes)]))[0] == found[i]).all()


def test_shingles_of_short_long_and_foreign_lines():
    rng = random.Random(4)
    lines = ["a", "ab", "abcdefg", "abcdefgh", "äb", "ß" * 9, "日本語の長い行です。まだ続く", "x" * 300, "abc\u0000", "\U0001f600" * 8, "tail"]
    lines += ["".join(rng.choices("ab é", k=rng.randrange(1, 40))) for _ in range(300)] + ["".join(x) for x in itertools.product("abc", repeat=8)]
    known, seen = {}, {}
    for order in (lines, lines[::-1], [""] + lines, *[[x] for x in lines[:30]]):  # alone, ASCII and other lines are in blocks of their own
        found = []
        for hashes, at in line_dedup.line_shingles(pa.array(order)):
            found += [hashes[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        assert len(found) == len(order)
        for line, hashes in zip(order, found):
            grams = [line[i : i + 8] for i in range(max(1, len(line) - 7))]
            assert len(hashes) == len(grams)
            for gram, value in zip(grams, hashes):
                assert known.setdefault(gram, value) == value and seen.setdefault(value, gram) == gram
    assert len(known) > 6_561


def test_blank_lines_have_no_key():
    blank, ink = ["", " ", "\t \r", "\x0b\x0c "], ["  a", "a  ", "\u00a0", "a\u0000", "a", "\u0000a", " \t."]
    for order in (blank + ink, ink + blank, [x for pair in zip(blank, ink) for x in pair], ink, blank, blank[:1], []):
        keys = line_dedup.line_keys(pa.array(order, pa.string()))
        assert [bool(k) for k in keys.tolist()] == [x in ink for x in order]
        assert len({k for k in keys.tolist() if k}) == len(set(order) & set(ink))


def test_long_lines_do_not_hash_every_shingle_for_every_minimum():
    rng = np.random.default_rng(9)
    hashes, at = texts.mix(rng.integers(1, 1 << 62, 60 * 2_000).astype(np.uint64)), np.arange(61) * 2_000
    seeds = rng.integers(1, 1 << 32, line_dedup.BANDS * line_dedup.ROWS, dtype=np.uint64).astype(np.uint32)

    def each():
        high, low = (hashes >> np.uint64(32)).astype(np.uint32), hashes.astype(np.uint32) | np.uint32(1)
        turned = np.empty_like(high)
        for seed in seeds:
            np.minimum.reduceat(np.add(np.multiply(high, seed, out=turned), low, out=turned), at[:-1])

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    lines = pa.array(["".join(chr(97 + c) for c in rng.integers(0, 26, 2_007)) for _ in range(60)])
    assert least(lambda: line_dedup.band_keys(lines)) < 1.2 * least(each)  # shingles included; before: more than 2
