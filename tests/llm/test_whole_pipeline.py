"""The pipeline stage by stage against plain Python, and cases that its operators were weak in."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortide.llm import line_crf, mixing, ngram_join, token_files, url_filter
from test_llm import ALNUM, PLAIN, brute_components, by_id, lower, small_texts

FOLDER = "/root/testdata/sf0.001"


def read(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def hit(text, windows):
    words = ALNUM.findall(lower(text))
    return any(tuple(words[i:i + k]) in windows for k in {len(w) for w in windows} for i in range(len(words) - k + 1))


def test_every_stage_and_the_whole(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    docs = read(spark, "documents")

    def stored(name, df):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    good = stored("good", stages["quality classifier"](spark, docs, FOLDER))
    scores = line_crf.classify(docs, read(spark, "labels")).where("predicted = 1").select("doc_id")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(good) == ids(scores) and 0 < good.count() < docs.count()

    one = stored("one", stages["n-gram Jaccard join"](spark, good, FOLDER))
    classes = brute_components({r.doc_id: r.text for r in good.collect()})
    assert ids(one) == sorted({c for _, c in classes.values()})

    clean = stored("clean", stages["benchmark decontamination"](spark, one, FOLDER))
    windows = set()
    for r in read(spark, "benchmark").collect():
        w = ALNUM.findall(lower(r.text))
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    want = [r.doc_id for r in one.collect() if not hit(r.text, windows)]
    assert ids(clean) == sorted(want) and len(want) < one.count()

    mixed = stored("mixed", stages["mixing sources to target weights"](spark, clean, FOLDER))
    texts = {r.doc_id: (r.source, r.text) for r in clean.collect()}
    sizes = Counter()
    for source, text in texts.values():
        sizes[source] += len(PLAIN.findall(text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, mixing.capped_targets([sizes[s] for s in names],
                                                    [1 + i % 3 for i in range(len(names))])))
    words = Counter()
    for r in mixed.collect():
        source, text = texts[r.doc_id]
        assert r.source == source and text.startswith(r.text)
        words[source] += len(PLAIN.findall(r.text))
    assert all(abs(words[s] - targets[s]) <= 1 for s in names)

    got = sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32").collect()),
                 key=lambda r: r[1])
    code, start, out = token_files.Encoder(token_files.tokenizer_path()), 0, []
    for r in sorted(mixed.collect(), key=lambda r: (r.doc_id, r.text.encode())):
        own = code.full.encode(r.text, add_special_tokens=False).ids + [2]
        out.append((r.doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert got == out


def test_one_id_on_unlinked_texts_keeps_both(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, a, 0), (1, b, 1), (2, a + " more", 2), (3, b, 3), (1, a, 4), (None, a, 5), (4, "", 6), (4, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key_of_doc int")
    kept = sorted((str(r.doc_id), str(r.text)[:1]) for r in ngram_join.keep_one(docs).collect())
    assert kept == [("1", "a"), ("1", "b"), ("4", ""), ("4", "N"), ("None", "a")]


@pytest.mark.parametrize("dense", [2, 1 << 20])
def test_shingles_added_up_in_a_chunk(spark, monkeypatch, dense):
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    texts = dict(enumerate(small_texts()))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = by_id(ngram_join.similarity_components(docs))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute_components(texts)


def test_a_common_shingle_leaves_a_chunk_once(spark):
    common = " ".join(f"c{i}" for i in range(5))
    rows = spark.createDataFrame([(i, f"{common} own{i} word{i}") for i in range(900)], "id long, text string").coalesce(1)
    packed = ngram_join.pack(rows, 5, 4, ngram_join.DENSE).collect()
    sent = {k: sum(len(r.body) // 5 for r in packed if r.kind == k) for k in (ngram_join.ONE, ngram_join.ADDED)}
    assert sent == {ngram_join.ONE: 1800, ngram_join.ADDED: 1}
    added = next(r for r in packed if r.kind == ngram_join.ADDED)
    assert np.frombuffer(added.sizes, "<u4").tolist() == [900]


def test_blocks_are_chosen_whole_and_the_last_in_part():
    rng = np.random.default_rng(1)
    for quota, block in ((0, 7), (1, 7), (340, 7), (1000, 7), (2999, 64), (3000, 5), (50, 1)):
        sizes = np.array([0, 400, 1, 0, 99, 500, 0])
        got = mixing.taken_words(sizes, quota, block, np.random.default_rng(3))
        assert got.sum() == quota and (got <= 3 * sizes).all() and (got >= 0).all()
        again = mixing.taken_words(sizes, quota, block, np.random.default_rng(3))
        assert (got == again).all()
        # The same by marking words.
        total, marks = int(sizes.sum()), np.zeros(int(sizes.sum()), int)
        marks += quota // total
        left = quota % total
        blocks = -(-total // block)
        begin = int(np.random.default_rng(3).integers(blocks))
        for b in [*range(begin, blocks), *range(begin)]:
            own = slice(b * block, min(b * block + min(block, left), total))
            marks[own] += 1
            left -= own.stop - own.start
            if left <= 0:
                break
        ends = np.cumsum(sizes)
        assert ((got % np.maximum(sizes, 1)) > 0).sum() <= 3  # whole but at the ends of what is taken
        assert got.tolist() == [int(marks[e - s:e].sum()) for s, e in zip(sizes, ends)]
    assert rng is not None and not mixing.taken_words(np.zeros(3, int), 5, 4, rng).any()


def test_the_mix_reaches_its_targets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 5000)
    rows = [(i, " ".join(["w"] * (i * 37 % 400)), "abc"[i % 3] if i % 11 else None) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"),
                                                 F.max(F.col("taken") - 3 * F.col("size")).alias("over"))
    for r in got.collect():
        assert abs(r.n - r.t) <= 1 and r.over <= 0
    parts = mixing.mixed_rows(docs).groupBy("source").agg(F.sum(mixing.text_size(F.col("text"))).alias("n")).collect()
    assert {r.source: r.n for r in parts} == {r.source: r.n for r in got.collect()}


def test_a_cut_text_is_a_prefix():
    text = " \tone  two\nthrée four "
    assert [mixing.first_words(text, n) for n in (1, 2, 3)] == [" \tone", " \tone  two", " \tone  two\nthrée"]


def test_rates_leave_out_the_own_fold(spark):
    rows = [(i, f"http://{h}/{i}", h, f"/{i}", float(y)) for i, (h, y) in enumerate(
        [(f"x.h{k % 3}", k % 2) for k in range(60)] + [("only.one", 1)])]
    labelled = spark.createDataFrame(rows, "page_id long, url string, host string, path string, label double")
    folds = {r.url: r.fold for r in labelled.select("url", url_filter.fold_of(F.col("url")).alias("fold")).collect()}
    got = {(r.of_suffix1, r.of_fold): r.rate_suffix1
           for r in url_filter.rates_outside(url_filter.suffix_counts(labelled), "suffix1").collect()}
    for _, url, host, _, _ in rows:
        rest = [y for _, u, h, _, y in rows if h.split(".")[-1] == host.split(".")[-1] and folds[u] != folds[url]]
        assert got[host.split(".")[-1], folds[url]] == pytest.approx((sum(rest) + 5) / (len(rest) + 10))
    alone = rows[-1]
    assert got["one", folds[alone[1]]] == 0.5


def test_long_documents_are_learnt_from(spark):
    good = "\n".join(f"A plain line of words that ends well, number {i}." for i in range(400))
    bad = "\n".join("BUY NOW!!! $$$ ### | BUY | NOW" for _ in range(400))
    rows = [(i, good if i % 2 else bad) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    field = line_crf.train(docs, labels, sample_lines=5000)
    assert 2 <= field.fitted_on <= 13
    assert line_crf.train(docs, labels, sample_lines=10).fitted_on == 1
    kept = line_crf.keep_good(docs, labels)
    assert {r.doc_id % 2 for r in kept.collect()} == {1} and kept.count() == 20
    assert line_crf.keep_good(docs, labels.limit(0)).count() == 40


def test_capitals_of_all_scripts():
    own = lambda t: line_crf.measures(t, set())[0] * len(t)
    assert [round(own(t)) for t in ("Ab cD", "Привет Мир", "Ελλάδα", "漢字", "ÀÉß", "żÓŁw")] == [2, 2, 1, 0, 2, 2]
    assert re.fullmatch("[A-Z]", "Q")
