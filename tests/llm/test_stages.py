"""The stages on columns of any name and on odd rows; the rows of run() against a plain version of its stages."""

import random

import pyarrow as pa

import corpus_pipeline
from netlens.llm import line_dedup, packing, quality, substring_dedup
from netlens.llm.common import BATCH_BYTES, small_batches, stage
from tests.llm.test_llm import prose, shingle_set, union

CLASHING = "doc_id long, text string, lines string, _row int, n_lines int, n_removed int, _quality double, quality double, _spans string, row string, gone_lines int, cut_spans int"


def clashing(spark, texts):
    rows = [(i, t, "l", i, 7, 8, 0.5, 0.25, "s", "r", 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASHING)


def test_columns_of_any_name_pass_through(spark):
    rng = random.Random(4)
    passage = prose(rng, 120)
    docs = clashing(spark, ["one line\nanother line", "one line", None, "", passage + "\n" + prose(rng, 30), prose(rng, 30) + "\n" + passage])
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, label int")
    for found in (line_dedup.drop_repeated_lines(docs), substring_dedup.drop_repeated_spans(docs), quality.score(docs, quality.fit(docs, labels), "quality_")):
        rows = found.collect()
        assert found.columns[: len(docs.columns)] == docs.columns and len(rows) == 6
        assert all((r["lines"], r["_row"], r["n_lines"], r["_quality"], r["quality"], r["row"]) == ("l", r["doc_id"], 7, 0.5, 0.25, "r") for r in rows)


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    """A repeated id, and a repeated row, add no more than the sample's bound to what the driver collects."""
    monkeypatch.setattr(quality, "SAMPLE", 5)
    rng = random.Random(6)
    rows = [(1, prose(rng, 20)) for _ in range(60)] + [(2, "the same text")] * 60 + [(3, prose(rng, 20, "xyz"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, label int")
    seen = []
    descend = quality.descend
    monkeypatch.setattr(quality, "descend", lambda found, signs, scale: seen.append(signs) or descend(found, signs, scale))
    quality.fit(docs, labels)
    assert len(seen[0]) == 7 and sorted(seen[0]) == [-1.0] * 2 + [1.0] * 5


def plain_lines(rows):
    """Exact and near repeats of lines in plain Python: 8-character shingles, Jaccard 0.8, the first line of a component stays."""
    lines = sorted({line for _, t in rows for line in (t or "").split("\n") if line.strip()})
    grams = {line: {line[i : i + 8] for i in range(max(1, len(line) - 7))} for line in lines}
    pairs = [(a, b) for a in lines for b in lines if a < b and 10 * len(grams[a] & grams[b]) >= 8 * len(grams[a] | grams[b])]
    roots, seen, out = union(lines, pairs), set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        kept = []
        for line in (t or "").split("\n"):
            root = roots.get(line)
            if root is None or root not in seen:
                kept.append(line)
            seen.add(root) if root is not None else None
        out.append((i, None if t is None else "\n".join(kept)))
    return out


def plain_join(rows):
    sets = [shingle_set(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots, best = union(range(len(rows)), pairs), {}
    for k, (i, _) in enumerate(rows):
        best[roots[k]] = min(best.get(roots[k], i), i)
    return [row for k, row in enumerate(rows) if best[roots[k]] == row[0]]


def test_pipeline_rows_equal_a_plain_version(spark, tmp_path):
    """Quality by the model's own scores, lines and near copies by brute force, passages by the spans of the operator, then packing."""
    rng = random.Random(9)
    good = [prose(rng, rng.choice([60, 150])) for _ in range(14)]
    bad = [" ".join(["zq"] * rng.randint(20, 60)) for _ in range(8)]
    passage = prose(rng, 90)
    texts = [g + "\nshared closing line of every text" for g in good] + bad
    texts += [good[0].replace(good[0].split()[30], "edited"), good[1] + "\n" + passage, good[2] + " tail\n" + passage, passage + "\n" + prose(rng, 40)]
    words = good[3].split()  # the same words in other lines: a copy for the join, not for the lines
    texts.append("\n".join(" ".join(words[i : i + 13]) for i in range(0, len(words), 13)))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int("zq" not in t), 0) for i, t in rows if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"])

    kept = [(i, t) for i, t in rows if "zq" not in t]
    kept = plain_join(plain_lines(kept))
    table = spark.createDataFrame([(i, t) for i, t in kept], "doc_id long, text string")
    cut = {r.doc_id: r.text for r in substring_dedup.drop_repeated_spans(table).collect()}
    want = stage(spark.createDataFrame([(i, cut[i], "en", "s", len(cut[i])) for i, _ in kept], docs.schema), "test-packed")
    assert [r.asDict() for r in found] == [r.asDict() for r in sorted(packing.pack(want).collect(), key=lambda r: r["doc_id"])]
    assert len(found) < len(rows) - len(bad) and {r["doc_id"] for r in found} == {i for i, _ in kept}


def test_stages_send_batches_of_few_bytes(spark):
    """However long the texts are, a batch between Spark and a Python worker is a few MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    try:
        small = spark.createDataFrame([(1, "one text", 8)], "doc_id long, text string, n_chars long")
        for step in (corpus_pipeline.chunk_dedup, corpus_pipeline.fuzzy_line_dedup, corpus_pipeline.ngram_jaccard_join):
            spark.conf.set(name, "64m")
            step(spark, small, "")
            found = spark.range(3000, numPartitions=1).selectExpr("repeat('abcdefgh', 1250) as text").mapInArrow(sizes, "size long").collect()
            assert len(found) > 6 and max(r["size"] for r in found) <= 2 * BATCH_BYTES
        spark.conf.set(name, "1m")
        small_batches(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)
