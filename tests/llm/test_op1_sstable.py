import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm import sstable
from tessella.llm.common import new_folder
from tests.conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in sstable.op1_sstable(spark, SF).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, None, "x"), (3, "", "y"), (3, "a b", "z"), (-5, "long " * 20000, None), (3, "a b", "z")]])
def test_edges_and_lookup(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").coalesce(1)
    manifest = sstable.write_shards(df, PATH, 1, new_folder(spark, "t"))
    got = sstable.read_shards(manifest).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((r[0] is not None, r[0] or 0) for r in rows)
    ends = sorted((r.start, r.start + len(r.ids) // r.width) for r in got)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and (not ends or ends[0][0] == 0)
    assert len(sstable.lookup(manifest, 3)) == sum(r[0] == 3 for r in rows)
    assert sstable.lookup(manifest, 4) == []


def test_shards_are_closed_at_a_size(spark):
    rows = [(i * 7 % 2503, f"text number {i} " * (i % 5)) for i in range(2503)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    manifest = sstable.write_shards(df, PATH, 1, new_folder(spark, "t"), shard_bytes=1)
    parts = manifest.orderBy("shard").collect()
    assert len(parts) > df.rdd.getNumPartitions() and all(a["last"] <= b["first"] for a, b in zip(parts, parts[1:]))
    got = sorted((r.doc_id, r.start, len(r.ids) // r.width, zlib.crc32(sstable.le32(r.ids, r.width))) for r in sstable.read_shards(manifest).collect())
    assert got == sorted(brute(rows))
    assert len(sstable.lookup(manifest, 1000)) == 1


def test_shard_file_round_trip(tmp_path):
    path = str(tmp_path / "a.sst")
    keys = [sstable.key_of(i * 3) for i in range(-500, 500)]
    with open(path, "wb") as f:
        w = sstable.Writer(f, 2, block_bytes=200)
        for i, k in enumerate(keys):
            w.add(k, bytes([i % 256, 0] * (i % 7)))
        w.finish()
    r = sstable.Reader(path)
    assert len(r.rows) > 20 and [k for k, _, _ in r] == keys and r.n_keys == 1000
    assert all(r.get(k) == [bytes([i % 256, 0] * (i % 7))] for i, k in enumerate(keys))
    assert sum(r.may_have(sstable.key_of(i)) for i in range(1, 3000, 3)) < 50


def test_the_cache_of_a_worker_is_bounded():
    from tessella.llm import tokens

    enc = tokens.encoder(PATH, sstable.CACHE_ENTRIES)
    assert enc.limit == sstable.CACHE_ENTRIES < 500_000 and enc is tokens.encoder(PATH, sstable.CACHE_ENTRIES)
    small, text = tokens.CachedEncoder(PATH, 50), " ".join(f"word{i}x" for i in range(40))
    for i in range(5):
        assert small.encode(f"{text} and{i}") == enc.encode(f"{text} and{i}") and len(small.cache) <= 200
