"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from netlens.llm import bpe, forest, graph, langid, line_dedup, ngram_join, packing, quality, queries, substring_dedup, texts, token_files, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string"
VOWELS = {"en": "the and with of", "fr": "le une déjà où"}


def prose(rng, words, pool="abcdefghij"):
    return " ".join("".join(rng.choices(pool, k=rng.randint(2, 8))) for _ in range(words))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, rng.choice([3, 40, 120, 300])) for _ in range(25)]
    passage = prose(rng, 60)
    found = []
    for i, text in enumerate(base):
        found.append((i * 3, text + ("\n" + passage if i % 6 == 0 else "") + "\nshared closing line of every text"))
    for i in range(12):  # near copies of one document, and copies of others
        words = base[2].split() if len(base[2].split()) > 30 else (base[2] + " " + prose(random.Random(9), 90)).split()
        words[rng.randrange(len(words))] = f"edit{i}"
        found.append((200 + i, " ".join(words)))
    found += [(300, base[1]), (301, base[1].upper()), (302, None), (303, ""), (304, " \n\t "), (305, "x" * 9000), (306, prose(rng, 6000)), (None, base[3]), (307, base[4]), (307, base[4])]
    found += [(308, "It's <|endoftext|> ünïcode  　 tab\there  two  blanks\r\n\n\n 日本語 123,456 don't 's")]
    return [(i, t, "en", "s", len(t or ""), 0.5, "r") for i, t in found]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def union(items, pairs):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def test_ngram_join_equals_all_pairs(docs, rows):
    sets = [shingle_set(r[1]) for r in rows]
    pairs = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    roots = union(range(len(rows)), pairs)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[roots[i]] = min(least.get(roots[i], r[0]), r[0])
    want = sorted(((r[0], len(sets[i]), least.get(roots[i])) for i, r in enumerate(rows)), key=str)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()), key=str)
    assert got == want
    assert any(c not in (None, i) for i, _, c in got)


def test_ngram_join_counts_every_link(spark, rows):
    words = prose(random.Random(8), 300).split()  # a family of near copies, each linked to every other
    rows = rows + [(400 + i, " ".join([*words[: 30 * i], f"edit{i}", *words[30 * i + 1 :]]), "en", "s", 0, 0.5, "r") for i in range(9)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sets = [shingle_set(r[1]) for r in rows]
    linked = [[b for b in range(len(rows)) if a != b and s and 100 * len(s & sets[b]) >= 80 * len(s | sets[b])] for a, s in enumerate(sets)]
    want = sorted(((r[0], len({sets[b] for b in linked[i]} - {sets[i]}), len(linked[i])) for i, r in enumerate(rows)), key=str)
    found = ngram_join.jaccard_components(docs).collect()
    assert sorted(((r.doc_id, r.links_found, r.row_links) for r in found), key=str) == want
    assert max(n for _, n, _ in want) > 5
    pairs = {frozenset((sets[a], sets[b])) for a in range(len(rows)) for b in linked[a] if sets[a] != sets[b]}
    links = ngram_join.jaccard_links(docs).collect()
    assert len(links) == len({(r.a, r.b) for r in links}) == len(pairs)
    assert {r.a for r in links} | {r.b for r in links} == {r.class_key for r in found if r.links_found}


def test_empty_tables(spark, no_docs):
    assert ngram_join.jaccard_components(no_docs).count() == 0
    assert line_dedup.drop_repeated_lines(no_docs).count() == 0
    assert substring_dedup.repeated_spans(no_docs).count() == 0
    assert packing.pack(no_docs).count() == 0
    assert langid.predict(no_docs, langid.fit(no_docs)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, label int")
    assert quality.score(no_docs, quality.fit(no_docs, labels), "q").count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert forest.nearest(vectors, 5, 50).count() == 0
    assert topk.top_inner_products(vectors, 20, 20).count() == 0
    assert bpe.encode(no_docs, queries.vocabulary(queries.BYTE_BPE)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)]
    want = union({x for p in pairs for x in p}, pairs)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k in got}
    assert {k for k, v in want.items() if any(k in p and p[0] != p[1] for p in pairs)} == set(got)


def test_prefixes_hold_enough_shared_shingles():
    rng = np.random.default_rng(3)
    for _ in range(200):
        common = rng.integers(0, 1 << 60, rng.integers(5, 80)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 60, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(2))
        known = np.sort(rng.choice(common, 5, replace=False))
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            (m, p, _), (n, q, _) = (ngram_join.choose_prefix(x, known, np.full(5, 50), 80) for x in (a, b))
            assert len(np.intersect1d(p, q)) >= min(m, n)


def test_line_dedup_keeps_one_line_of_each_component(docs, rows):
    lines = sorted(((r[0] if r[0] is not None else -1, n, line) for r in {r[:2] for r in rows} if r[1] is not None for n, line in enumerate(r[1].split("\n"))))
    kinds = sorted({line for _, _, line in lines if line.strip()})
    sets = {k: frozenset(k[i : i + 8] for i in range(len(k) - 7)) or frozenset([k]) for k in kinds}
    roots = union(kinds, [(a, b) for i, a in enumerate(kinds) for b in kinds[:i] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    seen, left = set(), {}
    for i, _, line in lines:
        if not line.strip() or roots[line] not in seen:
            left.setdefault(i, []).append(line)
        if line.strip():
            seen.add(roots[line])
    got = line_dedup.drop_repeated_lines(docs)
    assert got.columns == [*docs.columns, "n_removed", "n_lines"]
    for r in got.collect():
        assert r.text == (None if r.doc_id == 302 else "\n".join(left.get(-1 if r.doc_id is None else r.doc_id, [])))


def test_line_dedup_finds_every_link_inside_mixed_buckets(spark):
    rng = random.Random(4)
    form = prose(rng, 12)
    lines = []
    for _ in range(300):  # near copies of one form, two by two
        line = form + " " + prose(rng, 6)
        lines += [line, line[:-1] + "!"]
    lines = sorted(set(lines))
    bands = line_dedup.band_keys(__import__("pyarrow").array(lines))
    sets = [frozenset(x[i : i + 8] for i in range(len(x) - 7)) for x in lines]
    met = np.array([(bands == b).any(axis=1) for b in bands])
    pairs = [(a, b) for a, b in zip(*np.nonzero(met)) if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = len(set(union(range(len(lines)), pairs).values()))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert want < 310 and line_dedup.drop_repeated_lines(docs).where("text <> ''").count() == want


def test_substring_dedup_finds_long_repeats_and_nothing_else(docs, rows):
    spans = substring_dedup.repeated_spans(docs).collect()
    text = {r[0]: r[1] for r in rows}
    carriers = {i * 3 for i in range(25) if i % 6 == 0}
    assert carriers - {0} <= {s.doc_id for s in spans}
    for s in spans:
        piece = text[s.doc_id].encode()[s.start : s.end].decode()
        assert len(piece.split()) >= substring_dedup.MIN_WORDS - 1
    # No text is lost: every word sequence that was cut still stands in an earlier document.
    cut = {r.doc_id: r.text for r in substring_dedup.drop_repeated_spans(docs).collect()}
    assert cut[302] is None and cut[303] == "" and cut[305] == "x" * 9000 or len(cut[305]) < 9000
    assert cut[0] == text[0] and sum(len(t or "") for t in cut.values()) < sum(len(t or "") for t in text.values())


def test_chunks_resist_insertions():
    text = prose(random.Random(2), 800)

    def digests(value):
        block = next(texts.blocks(__import__("pyarrow").array([value])))
        return set(next(substring_dedup.chunks(block))[1].tolist())

    a, b = digests(text), digests("some words in front " + text[:1500] + " INSERTED " + text[1500:])
    assert len(a & b) > 0.9 * len(a)


def test_packing_pads_least(docs, rows):
    def words(text):
        return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))

    found = packing.pack(docs, buckets=3).collect()
    assert sorted(r.n_tokens for r in found) == sorted(words(r[1]) for r in rows)
    assert len({(r.bucket, r.batch, r.slot) for r in found}) == len(rows)
    assert all(r.n_tokens <= r.bucket and r.slot < max(1, packing.BUDGET // r.bucket) for r in found)
    rounded = [max(8, -(-words(r[1]) // 8) * 8) for r in rows]
    kinds = sorted(set(rounded))
    best = min(
        sum(min(b for b in (x, y, kinds[-1]) if b >= n) for n in rounded)
        for x in kinds for y in kinds
    )
    assert sum(r.bucket for r in found) == best


def test_quality_and_language(spark):
    rng, data = random.Random(8), []
    for i in range(240):
        good, lang = i % 3 != 0, "en" if i % 2 else "fr"
        words = [rng.choice((VOWELS[lang] + " " + prose(rng, 3, "aeiost" if lang == "en" else "éèàuvx")).split()) for _ in range(40)]
        data.append((i, " ".join(words if good else [w + "%%%" for w in words]), lang, int(good)))
    data += [(900, None, "en", 1), (901, "", "fr", 0), (902, "12 34 !", None, None), (None, "the and with", "en", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, label int")
    train = docs.where("doc_id is null or doc_id % 4 <> 2")
    scored = quality.score(docs, quality.fit(train.select("doc_id", "text"), train.select("doc_id", "label")), "q").collect()
    assert len(scored) == len(data) and all(0 <= r.q <= 1 for r in scored)
    assert all((r.q >= 0.5) == bool(r.label) for r in scored if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 4 == 2)
    found = {r.doc_id: r for r in langid.predict(docs, langid.fit(train)).collect()}
    assert [found[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in found.values())
    assert all(found[i].lang_pred == lang for i, _, lang, _ in data if i is not None and i < 900 and i % 4 == 2)


def test_searches_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(400, 8)).astype(np.float32)
    data[50:90] = data[3]
    rows = [(int(i), [float(x) for x in v], "t") for i, v in enumerate(data)]
    rows += [(1000, None, "t"), (1050, [0.0] * 8, "t"), (1100, [float("nan")] * 8, "t"), (1150, [1.0, None] + [0.0] * 6, "t"), (None, [1.0] * 8, "t"), (1200, [1.0], "t")]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType())])
    vectors = spark.createDataFrame(rows, schema)
    exact = data.astype(np.float64)
    unit = exact / np.linalg.norm(exact, axis=1, keepdims=True)
    found = forest.nearest(vectors, 5, 50).collect()
    hits = 0
    for q in range(0, 400, 50):
        score = unit[q] @ unit.T
        order = [i for i in np.lexsort((np.arange(400), -np.round(score, 12))) if i != q][:5]
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - score[r.vec_id]) < 1e-12 for r in mine)
        hits += len({r.vec_id for r in mine} & set(order))
    assert hits >= 0.9 * 40 and not {r.query_id for r in found} - set(range(0, 400, 50))

    whole = np.vstack([np.floor(64 * exact), np.zeros((1, 8))]).astype(np.int64)
    ids = np.append(np.arange(400), 1050)
    top = topk.top_inner_products(vectors, 20, 20).collect()
    for q in [*range(0, 400, 20)]:
        score = whole @ whole[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        mine = sorted((r for r in top if r.query_id == q), key=lambda r: r["rank"])
        assert [(r.vec_id, r.score) for r in mine] == [(ids[i], score[i]) for i in order]


def test_token_files_and_bpe_equal_the_tokenizer(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    path = queries.vocabulary(queries.WORD_BPE)
    token_files.write_tokens(docs, str(tmp_path / "ids"), path, 1)
    tokens = token_files.read_tokens(spark, str(tmp_path / "ids"))
    word = Tokenizer.from_file(path)
    want = {}
    for i, t, *_ in rows:
        ids = word.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), 0)
    got = token_files.token_digests(tokens).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == set(want) and len(got) == len(rows)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in tokens.where("doc_id = 306").collect()] == [306]

    path = queries.vocabulary(queries.BYTE_BPE)
    whole = Tokenizer.from_file(path)
    found = bpe.digests(bpe.decode(bpe.encode(docs, path), path)).collect()
    expect = []
    for i, t, *_ in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        expect.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, found), key=str) == sorted(expect, key=str)
    straight = bpe.decoded_digests(bpe.encode(docs, path), path).collect()
    assert sorted(map(tuple, straight), key=str) == sorted(expect, key=str)


def test_forgetting_pieces_keeps_ids(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "PIECES", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 3000)
    rng = random.Random(8)
    values = [prose(rng, rng.choice([0, 3, 900])) for _ in range(20)]
    encoder = bpe.ChunkEncoder(queries.vocabulary(queries.BYTE_BPE))
    found = [ids.tolist() for block in texts.blocks(pa.array(values), 4000) for ids in encoder.encode(block)]
    assert found == [e.ids for e in encoder.tokenizer.encode_batch(values, add_special_tokens=False)]


def test_chunked_bpe_on_odd_texts():
    import pyarrow as pa

    rng = random.Random(3)
    pieces = ["<|endoftext|>", " ", "  ", "\n", "\t", "it's", " don't", "é", "日本", " ", "　", "123", "!!", "a" * 40, " the", " ", "'s", "x́", "ß", "<|endof"]
    values = ["".join(rng.choices(pieces, k=rng.randint(0, 400))) for _ in range(150)]
    encoder = bpe.ChunkEncoder(queries.vocabulary(queries.BYTE_BPE))
    found = [ids.tolist() for block in texts.blocks(pa.array(values)) for ids in encoder.encode(block)]
    assert found == [e.ids for e in encoder.tokenizer.encode_batch(values, add_special_tokens=False)]
    pieced = token_files.PieceEncoder(queries.vocabulary(queries.WORD_BPE))
    assert [i.tolist() for i in pieced.encode(values)] == [e.ids for e in pieced.tokenizer.encode_batch(values, add_special_tokens=False)]


def test_pieces_part_letters_from_marks():
    encoder = token_files.PieceEncoder(queries.vocabulary(queries.WORD_BPE))
    values = ["One,two (one) TWO! it's", "two7one \"one's\" <|endoftext|>One,", "", "Éone.\u0301two e\u0301, a_b", "\u00bb.one one"]
    assert [i.tolist() for i in encoder.encode(values)] == [e.ids for e in encoder.tokenizer.encode_batch(values, add_special_tokens=False)]
    fresh = token_files.PieceEncoder(queries.vocabulary(queries.WORD_BPE))
    flat, bounds = fresh.encode_flat(["One,two (one) TWO!", None, "one"], 1)
    # What has the same ids everywhere is looked up once, whatever marks touch it.
    assert sorted(fresh.codes) == ["!", "(", ")", ",", "one", "two"]
    expect = [[*fresh.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in ("One,two (one) TWO!", "", "one")]
    assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == expect


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs.count(), corpus_pipeline.stage(step(spark, docs, sf_dir), name)
        assert 0 < docs.count() <= before
        assert name == "packing" or docs.columns == names
    assert docs.select(F.countDistinct("doc_id")).first()[0] == docs.count()
