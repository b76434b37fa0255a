"""The dealt operators against brute force, on small tables with nulls, ties, repeats and skew."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortide.llm import (decontaminate, license_scan, line_crf, mixing, ngram_join, quality_rules,
                           substring_dedup, token_files, toxicity, url_filter)
from cohortide.llm import queries as llm
from cohortide.llm.words import Texts
from compare import difference, duck

FOLDER = "/root/testdata/sf0.001"
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, source string, n_words long, kept string, score double"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def small_texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["Über", "señal", "don't", "a"]
    passage = " ".join(rng.choices(words, k=60))
    out = [None, "", " \n\t ", "one", "two words", "x" * 5000]
    for i in range(60):
        own = rng.choices(words, k=rng.randint(1, 160))
        if i % 3 == 0:
            own[len(own) // 2:len(own) // 2] = passage.split()
        out.append("\n".join(" ".join(own[k:k + 9]) for k in range(0, len(own), 9)))
    base = rng.choices(words, k=150)
    for _ in range(40):  # near copies
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append(" ".join(own))
    out += [out[20]] * 12 + [" ".join(words * 40)]
    out.append("All rights reserved. Licensed under CC BY-NC 4.0 and cc by, General Public License")
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "a", "b", "a", "a"][i % 5], None, "clash", 0.5)
            for i, t in enumerate(small_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return dict(enumerate(small_texts()))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 100)] + [(None, 1, 1), (5, None, None), (9999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_substring_dedup(docs, texts, empty):
    got = by_id(substring_dedup.digest(substring_dedup.dedup_substrings(docs)))
    seen = {}
    for d, t in texts.items():
        w = PLAIN.findall(t or "")
        for i in range(len(w) - 12):
            seen.setdefault(tuple(w[i:i + 13]), d)
    removed = 0
    for d, t in texts.items():
        w = PLAIN.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if seen[tuple(w[i:i + 13])] < d:
                gone[i:i + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        removed += sum(gone)
        assert (got[d].n_words, got[d].n_removed) == (len(w), sum(gone))
        assert got[d].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert removed > 1000 and len(got) == len(texts)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_substring_dedup_spreads_a_common_passage(spark, docs, monkeypatch):
    want = sorted(substring_dedup.digest(substring_dedup.dedup_substrings(docs)).collect())
    monkeypatch.setattr(substring_dedup, "DEALT", 50)
    monkeypatch.setattr(substring_dedup, "PART", 1)
    assert sorted(substring_dedup.digest(substring_dedup.dedup_substrings(docs)).collect()) == want
    # A passage in every row, in surroundings that differ; each of two tasks sends it once.
    passage = " ".join(f"passage{k}" for k in range(40))
    rows = spark.createDataFrame(
        [(i, i, f"{' '.join(f'a{i}x{k}' for k in range(12))} {passage} "
                f"{' '.join(f'b{i}x{k}' for k in range(12))}") for i in range(400)],
        "id long, key long, text string").repartition(2)
    sent = substring_dedup.send_segments(rows, 13, 4, substring_dedup.common_minimizers(rows, 13))
    load = {}
    for r in sent.collect():
        load[r.bucket] = load.get(r.bucket, 0) + int(np.frombuffer(r.runs, np.uint8).sum())
    assert sum(load.values()) == 400 * 24 + 2 * 28 and max(load.values()) < 2 * sum(load.values()) / 16


def test_suffix_automaton_states_first_documents():
    rng = random.Random(1)
    shard, texts = substring_dedup.SuffixAutomaton(), []
    for d in range(30):
        texts.append(rng.choices(range(4), k=40))
        shard.add(texts[-1], d)
    asked = rng.choices(range(4), k=300)
    for k, first in enumerate(shard.first_documents(asked, 5, 99)):
        own = asked[k:k + 5]
        want = next((d for d, t in enumerate(texts) for i in range(36) if t[i:i + 5] == own), 99)
        assert first == want


def test_quality_rules_equal_their_sql(spark, docs):
    con = duck(FOLDER)
    assert difference(llm.queries()["op2_quality_rules"](spark, FOLDER), con, quality_rules.ORACLE) is None
    plan = llm.queries()["op2_quality_rules"](spark, FOLDER)._jdf.queryExecution().toString()
    assert not re.search("Exchange|Python|Arrow", plan)
    again = by_id(docs.transform(quality_rules.document_rules))
    assert again[0].base_failed and not again[0].kept and again[0].n_words == 0


def test_decontamination(spark, docs, texts, empty):
    w = ALNUM.findall(lower(texts[21]))
    items = [(1, " ".join(w[3:30]).upper()), (2, "two words"), (3, ""), (4, None), (None, "one"),
             (10, " ".join(w[3:30])), (11, "x" * 5000)]
    table = spark.createDataFrame(items, "item_id long, text string")
    for shard_bytes in (1 << 20, 200):
        got = by_id(decontaminate.digest(decontaminate.benchmark_hits(docs, table, shard_bytes=shard_bytes)))
        for d, t in texts.items():
            own, hit, keys = ALNUM.findall(lower(t)), set(), set()
            for key, text in items:
                words = ALNUM.findall(lower(text))
                for i in range(max(1, len(words) - 9) if words else 0):
                    p = words[i:i + 10]
                    for j in range(len(own) - len(p) + 1):
                        if own[j:j + len(p)] == p:
                            hit |= set(range(j, j + len(p)))
                            keys |= {str(key)} - {"None"}
            r = got[d]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(own), len(hit), len(keys), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(keys)).encode()).hexdigest()
    spans = by_id(decontaminate.benchmark_hits(docs, table))[4].spans
    assert [(s.start, s.end) for s in spans] == [(0, 9)]
    assert decontaminate.benchmark_hits(empty, table).count() == 0
    assert decontaminate.drop_contaminated(docs, table).columns == docs.columns
    assert decontaminate.drop_contaminated(docs, table.limit(0)).count() == docs.count()


def test_token_files_round_trip(spark, docs, texts, empty):
    from tokenizers import Tokenizer

    odd = ["<|endoftext|>a", "a\x1cb", "İstanbul ΣΑΣ é é", "it's we'LL x1y22 !!?", "a b　c"]
    rows = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame(list(enumerate(odd, 1000)), "doc_id long, text string"))
    plain = Tokenizer.from_file(token_files.tokenizer_path())
    got, start = by_id(token_files.token_digest(rows)), 0
    for d, t in [*texts.items(), *enumerate(odd, 1000)]:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[d].start, got[d].n_tokens) == (start, len(ids))
        assert got[d].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_files.token_digest(empty).count() == 0


def test_license_scan(docs, texts, empty):
    got = by_id(license_scan.digest(license_scan.license_spans(docs)))
    for d, t in texts.items():
        w = ALNUM.findall(lower(t))
        places = [(i, v) for p, v in license_scan.PHRASES.items() for i in range(len(w))
                  if w[i:i + len(p.split())] == p.split()]
        r = got[d]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({v for _, v in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert "cc-by-nc" in got[len(texts) - 1].labels
    assert license_scan.license_spans(empty).count() == 0


def test_url_filter(spark):
    urls = [None, "no scheme", "http://net/", "https://A.Example.NET/en/x?y=1", "http://example.net/de/1",
            "http://m.example.com/de/9#t", "http://x.org/fr/", "http://x.org/en/?a=b&c=d", "http://notnet/x",
            "http://example.net", "ftp://example.com?x=/de/"] * 3
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)],
                                  "page_id long, url string, html string")
    want = [None, None, "net/", "example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None]
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for i in range(len(urls)):
        r, rule = got[i], want[i % len(want)]
        assert r.rule == rule and r.verdict in ("allow", "block")
        if rule:
            assert r.verdict == ("allow" if rule in ("example.net/en/", "org/fr/") else "block")
    assert (got[0].host, got[1].path, got[3].host, got[3].path) == ("", "", "a.example.net", "/en/x")
    assert (got[9].path, got[10].host, got[10].path) == ("", "example.com", "")
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages.where("page_id = 7")).collect()} == {"allow"}


def test_suffix_rates_cover_all_labelled_urls(spark):
    hosts = [f"a.{k}.h{k % 7}" for k in range(100)]
    rows = [(i, f"http://{h}/{i}", h, f"/{i}", float(i % 3 == 0 or h.endswith("h2")))
            for i, h in enumerate(hosts * 4)]
    labelled = spark.createDataFrame(rows, "page_id long, url string, host string, path string, label double")
    got = url_filter.fit_trees(labelled, sample=60)(labelled.drop("label")).collect()
    for k in (1, 2):
        by = {}
        for _, _, h, _, y in rows:
            by.setdefault(".".join(h.split(".")[-k:]), []).append(y)
        for r in got:
            own = by[".".join(r.host.split(".")[-k:])]
            assert r[f"rate_suffix{k}"] == pytest.approx((sum(own) + 5) / (len(own) + 10))


@pytest.mark.parametrize("operator", [line_crf.classify, toxicity.score_toxicity])
def test_classifiers_handle_odd_rows(docs, labels, empty, operator):
    got = by_id(operator(docs, labels))
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
    assert operator(empty, labels).count() == 0
    assert operator(docs, labels.limit(0)).count() == docs.count()


def test_line_field_learns_quality(spark):
    got = llm.queries()["op8_line_crf"](spark, "/root/testdata/sf0.01").where("held_out")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    right = got.join(known, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).head()[0]
    assert right > 0.95


def test_toxicity_learns(spark):
    got = llm.queries()["op6_toxicity"](spark, "/root/testdata/sf0.01").where("held_out")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    right = got.join(known, "doc_id").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).head()[0]
    assert right > 0.9


def test_word_counts_are_exact(spark, docs, texts, monkeypatch):
    kind = {d: [None, 0, 1][d % 3] for d in texts}
    # More words than any fixed number of cells could keep apart.
    many = {10_000 + i: " ".join(f"z{i}q{k}" for k in range(3000)) for i in range(60)}
    every = {**texts, **many}
    rows = spark.createDataFrame([(t, kind.get(d)) for d, t in every.items()], "text string, label int")
    want = {}
    for d, t in every.items():
        for w in set(ALNUM.findall(lower(t))):
            own = want.setdefault(w, [0, 0, 0])
            own[0] += 1
            if kind.get(d) is not None:
                own[1 + kind[d]] += 1
    names = list(want)
    h = Texts(pa.array([" ".join(names)]), toxicity.ALNUM).hashes().view(np.int64)
    for held in (toxicity.HELD, 100):
        monkeypatch.setattr(toxicity, "HELD", held)
        counts = toxicity.count_words(rows)
        got = {r.word: [r.n, r.ordinary, r.toxic] for r in counts.collect()}
        assert got == {int(x): want[w] for x, w in zip(h, names)}
    words, ratios = toxicity.word_model(counts)
    sums = np.array(list(want.values()), float).sum(0)
    for k, d in enumerate(toxicity.DISCOUNTS):
        at = np.searchsorted(words, h.view(np.uint64))
        at[np.append(words, np.uint64(0))[at] != h.view(np.uint64)] = len(words)
        logs = []
        for c in (1, 2):
            own = np.maximum(np.array([want[w][c] for w in names]) - d * sums[c] / sums[1:].min(), 0)
            shared = np.array([want[w][0] for w in names]) / sums[0]
            logs.append(np.log(own / sums[c] + (1 - own.sum() / sums[c]) * shared))
        assert np.allclose(ratios[k][at], logs[1] - logs[0], atol=1e-5)


def test_forward_backward_equals_enumeration():
    e, same = np.array([0.3, -1.0, 2.0, 0.5]), np.array([0.7, -0.2])
    p, pair = line_crf.forward_backward(e, np.array([3, 0, 1]), same)
    total, good, both = 0.0, np.zeros(3), np.zeros(2)
    for k in range(8):
        y = [k >> i & 1 for i in range(3)]
        weight = np.exp(sum(e[i] * y[i] for i in range(3))
                        + sum(same[y[i]] for i in range(2) if y[i] == y[i + 1]))
        total, good = total + weight, good + weight * np.array(y)
        both += [weight * sum(y[i] == y[i + 1] == v for i in range(2)) for v in (0, 1)]
    assert np.allclose(p[:3], good / total) and np.allclose(p[3], 1 / (1 + np.exp(-0.5)))
    assert np.allclose(pair[:3].sum(0), both / total)


def brute_components(texts):
    sets = {}
    for d, t in texts.items():
        w = PLAIN.findall(lower(t))
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in texts}


@pytest.mark.parametrize("cell", [256, 3])
def test_ngram_join(docs, texts, empty, monkeypatch, cell):
    monkeypatch.setattr(ngram_join, "CELL", cell)  # several cells for a check
    got = by_id(ngram_join.similarity_components(docs))
    want = brute_components(texts)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert ngram_join.similarity_components(empty).count() == 0
    if cell == 3:
        extra = docs.unionByName(docs.where("doc_id < 9").withColumn("doc_id", F.lit(None).cast("long")))
        kept = ngram_join.keep_one(extra.unionByName(docs))
        assert kept.columns == docs.columns
        ids = [r.doc_id for r in kept.collect()]
        assert ids.count(None) == 9 and sorted(x for x in ids if x is not None) == sorted(
            {c for _, c in want.values()})


def test_mixing(docs, texts, empty):
    got = by_id(mixing.mix(docs))
    assert {d: r.taken for d, r in by_id(mixing.mix(docs)).items()} == {d: r.taken for d, r in got.items()}
    source = {d: [None, "a", "b", "a", "a"][d % 5] for d in texts}
    size = {d: len(PLAIN.findall(t or "")) for d, t in texts.items()}
    names = ["a", "b", None]
    sums = [sum(size[d] for d in texts if source[d] == s) for s in names]
    targets = mixing.capped_targets(sums, [1, 2, 3])
    for s, n, target in zip(names, sums, targets):
        rows = [got[d] for d in texts if source[d] == s]
        assert {(r.source_size, r.target) for r in rows} == {(n, float(target))}
        assert abs(sum(r.taken for r in rows) - target) <= 2
    assert all(r.size == size[d] and 0 <= r.taken <= 3 * r.size for d, r in got.items())
    assert mixing.mix(empty).count() == 0
    copies = mixing.mixed_rows(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in copies} == {
        d: -(-r.taken // r.size) for d, r in got.items() if r.taken}


def test_mixing_keeps_a_tiny_source_beside_a_large_one(spark):
    rows = [(0, "three small words", "tiny"), (1, " ".join(["few"] * 40), "small")]
    rows += [(i, "w " * 100_000, "large") for i in range(2, 32)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken"), F.first("target")).collect()
    taken = {s: (n, target) for s, n, target in got}
    assert {s: t for s, (_, t) in taken.items()} == {"tiny": 9, "small": 120, "large": 2_999_914}
    assert all(abs(n - target) <= 2 for n, target in taken.values())
    assert {"tiny", "small"} <= {r.source for r in mixing.mixed_rows(docs).collect()}


def test_apportionment_of_very_many_seats():
    shares = [4.8e9 - 15_003.5, 15_000.0, 3.0, 0.5]
    for scale in (1, 0.999):
        got = mixing.sainte_lague([s * scale for s in shares], 4_800_000_000)
        assert got.sum() == 4_800_000_000 and np.abs(got - shares).max() <= 1


def test_apportionment_is_by_highest_quotients():
    rng = random.Random(5)
    for _ in range(50):
        shares = [rng.random() * rng.choice([1, 10]) for _ in range(rng.randint(1, 9))]
        seats = rng.randint(0, 40)
        quotients = sorted(((s / (2 * k + 1), -i) for i, s in enumerate(shares) for k in range(41)), reverse=True)
        want = [sum(-i == j for _, i in quotients[:seats]) for j in range(len(shares))]
        assert list(mixing.sainte_lague(shares, seats)) == want
    assert [float(x) for x in mixing.capped_targets([10, 90], [9, 1])] == [30.0, 70.0]


def test_pipeline_stages(spark, docs, tmp_path):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = out.orderBy("start").collect()
    ends = np.cumsum([r.n_tokens for r in rows])
    assert [r.start for r in rows] == [0, *ends[:-1].tolist()]
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_native_operator_reads_no_python():
    assert "pandas" not in json.dumps(open(quality_rules.__file__).read())
