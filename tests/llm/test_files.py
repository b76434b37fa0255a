"""Token files as files, and the size of the decontamination automaton."""

import glob
import random
import resource

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cohortide.llm import decontaminate, token_files


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(5000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 900)))) for i in range(1500)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tokens") / "files")
    token_files.write_tokens(docs, path, row_group_bytes=256 << 10, page_bytes=8 << 10)
    return path


def test_encodings_row_groups_and_page_indexes(folder):
    groups = 0
    for name in glob.glob(f"{folder}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                kinds = set(column.encodings)
                if column.path_in_schema.startswith("ids"):
                    assert kinds & {"RLE_DICTIONARY", "PLAIN_DICTIONARY"}
                else:
                    assert "DELTA_BINARY_PACKED" in kinds and column.has_column_index
                assert column.has_offset_index
    assert groups > 4


def test_a_read_of_counts_leaves_the_ids(spark, folder):
    rows = token_files.read_tokens(spark, folder, ("doc_id", "n_tokens"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan
    some = token_files.read_tokens(spark, folder).where("doc_id = 700")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,700)" in plan
    row = some.collect()[0]
    assert row.n_tokens == len(row.ids)
    before = rows.where("doc_id < 700").agg(F.sum("n_tokens")).head()[0]
    assert row.start == before


def test_forgotten_words_are_encoded_again(monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN", 300)
    monkeypatch.setattr(token_files, "PARTS", 50)
    code, rng = token_files.Encoder(token_files.tokenizer_path()), random.Random(3)
    for _ in range(30):
        texts = [" ".join("".join(rng.choices("abcdefgDÜ", k=4)) + rng.choice(["", ".", "!?"])
                          for _ in range(rng.randint(0, 3000))) for _ in range(3)] + [None, ""]
        flat, n = code.encode(pa.array(texts), [2])
        want = [code.full.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
        assert n.tolist() == list(map(len, want)) and flat.tolist() == sum(want, [])
    # Merges happen from 2**15 new words on.
    known = token_files.Known()
    for k in range(8):
        own = np.arange(k * 20_000, (k + 1) * 20_000, dtype=np.uint64)
        known.add(own, np.column_stack([own, np.full(len(own), k)]).astype(np.int32).ravel(), np.full(len(own), 2))
        there, start, size = known.find(own)
        assert there.all() and (size == 2).all() and (known.pool[start] == own.astype(np.int32)).all()


def test_a_text_longer_than_a_slice(spark):
    words = ["".join(random.Random(i).choices("abcdef", k=6)) for i in range(997)]
    text = " ".join(words * 1500)
    assert len(text) > 10_000_000
    got = token_files.token_digest(spark.createDataFrame([(1, "one"), (2, text)], "doc_id long, text string"))
    rows = {r.doc_id: r for r in got.collect()}
    code = token_files.Encoder(token_files.tokenizer_path())
    per = [len(code._whole(w)) // 4 for w in words]
    assert rows[2].n_tokens == 1500 * sum(per) + 1 and rows[2].start == rows[1].n_tokens


def test_automaton_memory_by_byte_of_text():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(30_000)]
    items = [(str(i), " ".join(rng.choices(words, k=400))) for i in range(800)]
    size = sum(len(t) for _, t in items)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    windows = decontaminate.Windows(items, 10)
    used = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024
    nodes = windows.found.get_stats()["nodes_count"]
    assert nodes <= 10 * 800 * 400 + 1
    assert used < 250 * size, f"{used / size:.0f} bytes of memory for a byte of text"


def test_dropping_by_several_shards_shuffles_nothing(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [(k, " ".join(texts[k].split()[:30])) for k in range(0, 60)]
    table = spark.createDataFrame(items, "item_id long, text string")
    one = decontaminate.drop_contaminated(docs, table)
    many = decontaminate.drop_contaminated(docs.withColumn("id", F.lit("clash")), table, shard_bytes=2000)
    want = {r.doc_id for r in decontaminate.benchmark_hits(docs, table).collect() if not r.hits}
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in many.collect()} == want
    assert len(want) <= 1440 and many.columns == ["doc_id", "text", "id"]
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = decontaminate.drop_contaminated(source, table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
