import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from tessella.llm import trie
from tests.conftest import SF

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append(((t is not None, t or 0), r or "", x or ""))
    said = {c: [(r, x) for _, r, x in sorted(v)] for c, v in by.items()}
    members, ended = defaultdict(list), defaultdict(list)
    for c in sorted(said):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(said.get(c - int(abs(c) % 100) * (1 if c > 0 else -1), [])[:h] + said[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ended[path].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(",".join(map(str, ended[p]))))
        for p, m in members.items()
    )


def of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_query_equals_sql_and_brute_force(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = of(trie.op13_prefix_trie(spark, SF))
    assert got == brute([tuple(r) for r in df.collect()]) and len(got) > 40
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS FROM '{SF}/conversations.parquet'")
    assert sorted(duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM ({trie.OP13_SQL})").fetchall()) == got


@pytest.mark.parametrize("hot", [1000, 3])
def test_random_conversations(spark, monkeypatch, hot):
    monkeypatch.setattr(trie, "HOT", hot)
    monkeypatch.setattr(trie, "CHUNK", 40)
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 420, 3), -100, -7, -250, 10**12 + 100, 10**12 + 103]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "", None, "é\U0001f600", "x" * 3000])))
    rows += [(c, t, "user", "same") for c in range(1000, 1400) for t in range(3)] + [(None, 1, "user", "a")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", depth int, digest string")
    assert of(trie.trie(trie.grafted(trie.ordered_turns(df)))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], [(0, None, None, None), (0, None, None, None)], [(1, 0, "user", "a")]])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert of(trie.trie(trie.grafted(trie.ordered_turns(df)))) == brute(rows)


def test_role_and_text_do_not_run_together(spark):
    rows = [(101, 9, "ab", "c"), (102, 9, "a", "bc"), (103, 9, "", "abc")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert trie.ordered_turns(df).select("said").distinct().count() == 3


def test_long_conversation(spark):
    rows = [(100, i, "user", str(i)) for i in range(120)] + [(1, i, "user", str(i)) for i in range(120)]
    assert of(trie.trie(trie.grafted(trie.ordered_turns(spark.createDataFrame(rows, SCHEMA))))) == brute(rows)
