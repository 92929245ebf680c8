import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import mixing, packing
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_packing_equals_brute_force(spark):
    tok = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by = defaultdict(list)
    seq = set()
    for r in packing.op8_packing(spark, SF).collect():
        by[r.doc_id].append(r)
        assert r.length & r.length - 1 == 0 and 1 <= r.length <= 1024 and r.offset == 0
        assert r.sequence_id not in seq
        seq.add(r.sequence_id)
    assert by.keys() == texts.keys()
    for d, t in texts.items():
        ids, at = np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)


def test_packing_edges(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "x y " * 30000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = packing.pack(df, PATH, 0).collect()
    assert sum(r.length for r in got if r.doc_id != 2) == 3 and len({r.sequence_id for r in got}) == len(got)
    assert packing.pack(df.limit(0), PATH, 0).count() == 0
    assert packing.piece_lengths(2053, 1024) == [1024, 1024, 4, 1] and packing.piece_lengths(0, 8) == []
    with pytest.raises(ValueError):
        packing.pack(df, PATH, 0, 1000)


def test_buckets_hold_one_length(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    packed = packing.pack(df, PATH, 0)
    packing.write_buckets(packed, str(tmp_path / "b"))
    want = {r.length: (r.n, r.s) for r in packed.groupBy("length").agg(F.count("*").alias("n"), F.sum("start").alias("s")).collect()}
    assert len(want) == 11
    for length, (n, s) in want.items():
        got = packing.read_bucket(spark, str(tmp_path / "b"), length)
        r = got.agg(F.count("*"), F.sum("start"), F.min("length"), F.max("length"), F.max(F.octet_length("ids")), F.min(F.octet_length("ids"))).first()
        assert tuple(r) == (n, s, length, length, 4 * length, 4 * length)
        assert got.select(F.shiftright("sequence_id", packing.PARTITION_BITS + packing.ROW_BITS)).distinct().collect() == [(length.bit_length() - 1,)]


def test_mixing_equals_sql(spark):
    got = sorted(tuple(r) for r in mixing.op6_mixing(spark, SF).select("doc_id", "copy", "n_copies", "rate", "shuffle_key", "text_md5").collect())
    sql = mixing.OP6_SQL.replace("FROM documents", f"FROM '{SF}/documents.parquet'")
    want = duckdb.sql(f"SELECT doc_id, copy, n_copies, rate, shuffle_key, text_md5 FROM ({sql})").fetchall()
    assert got == sorted(want) and len(got) > 100


def test_mixing_mean_and_edges(spark, monkeypatch):
    df = spark.range(20000).select("id", F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.when(F.col("id") % 4 > 0, F.lit("a")).alias("source"), F.lit(9).alias("copy"))
    w = spark.createDataFrame([("a", 1.0), (None, 1.0)], "source string, weight double")
    for broadcast in (20_000, 0):  # and by salts
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
        by = {r.source: (r.n, r.rate) for r in mixing.replicate(df, w).groupBy("source").agg(F.count("*").alias("n"), F.first("rate").alias("rate")).collect()}
        assert math.isclose(by[None][1], 2.0) and math.isclose(by["a"][1], 2 / 3)
        assert abs(by[None][0] - 10000) < 400 and abs(by["a"][0] - 10000) < 400
    few = df.limit(50).repartition(1)
    n = mixing.replicate(few, spark.createDataFrame([("a", 1.0)], "source string, weight double"), epochs=100).count()
    assert abs(n - 5000) < 400  # a mean above CHUNK, and a source without weight
    assert mixing.replicate(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, "", "s"), (1, "", "s")], "doc_id long, text string, source string")
    assert mixing.replicate(odd, epochs=50).count() > 50
