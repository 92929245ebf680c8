import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

from tessella.llm import chat
from tests.conftest import SF


def brute(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", odd), (-7, 1, "assistant", odd)]
    df = chat.op7_chat(spark, SF)
    got = df.drop("formatted_chars").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS FROM '{SF}/conversations.parquet'")
    assert sorted(duckdb.sql(chat.OP7_SQL).fetchall()) == sorted(tuple(r) for r in df.collect())


NASTY = ["", None, "\\", "\\\\", "<|", "<\\|", "<\\\\|", "<|end|>\n", "a<|end|>", "|>\n", "\\<|\\", "é<|assistant|>\nx", "\\|", "<", "x" * 200_000]


def test_escapes_and_spans(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)] + [(2, i, "assistant", t) for i, t in enumerate(NASTY)]
    rows += [(3, 0, r, "t") for r in NASTY[:-1]]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, node int")
    got = chat.format_trees(chat.chains(df)).withColumn("turns", chat.read_back(chat.F.col("formatted"))).collect()
    assert len(got) == 3
    for r in got:
        key = lambda x: (x[1], x[2] or "", x[3] or "")
        want = [((x[2] or ""), (x[3] or "")) for x in sorted((x for x in rows if str(x[0]) == r.tree), key=key)]
        assert sorted((t.role, t.text) for t in r.turns) == sorted(want)
        masked = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        esc = lambda t: t.replace("\\", "\\\\").replace("<|", "<\\|").replace("|>", "|\\>")
        assert [esc(t.text) for t in r.turns if t.role == "assistant"] == masked


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], [(None, 1, "user", "a"), (None, 1, "user", "a"), (4, None, "assistant", "b"), (4, 2, "user", None)]])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_trees(chat.chains(df), best=1).collect()
    assert len(got) == len({r[0] for r in rows})
    assert sum(r.formatted.count("<|end|>") for r in got) == len(rows)


def test_branches_and_circles(spark):
    tree = [("t", 1, None, 1.0), ("t", 2, 1, 5.0), ("t", 3, 1, 2.0), ("t", 4, 3, 9.0), ("t", 5, 3, None), ("t", 6, 99, 0.5), ("u", 1, 2, 1.0), ("u", 2, 1, 1.0), ("u", 3, None, 1.0)]
    df = spark.createDataFrame([(*r, "user", f"m{r[1]}") for r in tree], "tree string, node long, parent long, score double, role string, text string")
    got = {(r.tree, r.leaf): r for r in chat.format_trees(df).collect()}
    path = {k: re.findall("m\\d", r.formatted) for k, r in got.items()}
    assert path == {("t", 4): ["m1", "m3", "m4"], ("t", 2): ["m1", "m2"], ("t", 5): ["m1", "m3", "m5"], ("t", 6): ["m6"], ("u", 3): ["m3"]}
    assert [got["t", x].rank for x in (4, 2, 5, 6)] == [1, 2, 3, 4] and got["t", 4].score == 12
    assert {k[1] for k in ((r.tree, r.leaf) for r in chat.format_trees(df, best=1).collect()) if k[0] == "t"} == {4}


def test_deep_chain(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", str(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_trees(chat.chains(df)).collect()
    assert len(got) == 1 and re.findall(r"\n(\d+)<", got[0].formatted) == [str(i) for i in range(600)] and got[0].score == 600
