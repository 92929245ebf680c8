import random
import re
import time

from pyspark.sql import functions as F

from tessella.streaming import tokens

TAG = re.compile("</?(?:think|tool)>")


def brute(text):
    """Segments of a whole text, by its tags."""
    out, kind, held, at = [], "text", "", 0
    for m in [*TAG.finditer(text), None]:
        held += text[at : m.start() if m else len(text)]
        at = m.end() if m else at
        name = m[0].strip("</>") if m else ""
        if m is None or m[0][1] != "/" or kind == name:
            if held:
                out.append((kind, held))
            held = ""
            kind = name if m and m[0][1] != "/" else "text"
    return [(i, *x) for i, x in enumerate(out)]


def test_tags_cut_anywhere():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["<think>", "</think>", "<tool>", "</tool>", "a", "<", "<t", "b c", "</", ">"]) for _ in range(rng.randrange(12)))
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(8)))
        assert tokens.split_text([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]) == brute(text)


def stream(spark, folder):
    return spark.readStream.schema("session string, seq long, text string, last boolean").option("maxFilesPerTrigger", 1).parquet(folder)


def test_fragments_in_any_order_over_batches(spark, tmp_path):
    rng = random.Random(2)
    texts = {f"s{i}": "".join(rng.choice(["<think>", "</think>", "<tool>", "</tool>", "word ", "<", "é"]) for _ in range(rng.randrange(1, 30))) for i in range(12)} | {"empty": ""}
    rows = []
    for s, t in texts.items():
        parts = [t[i : i + 3] for i in range(0, len(t), 3)] or [None]
        rows += [(s, i, x, i == len(parts) - 1) for i, x in enumerate(parts)]
        rows.append((s, len(parts) + 5, "after the end", False))
    rows += [(None, 0, "x", True), ("t", None, "x", True), ("open", 0, "<think>unfinished", False)] + rows[:20]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "session string, seq long, text string, last boolean")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    got = tokens.written_segments(spark, stream(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    have = {}
    for r in got.orderBy("session", "n").collect():
        have.setdefault(r.session, []).append((r.n, r.kind, r.text))
    assert have == {s: brute(t) for s, t in texts.items() if brute(t)}


def test_gaps_are_passed_over(spark, tmp_path):
    part = lambda rows, name: spark.createDataFrame(rows, "session string, seq long, text string, last boolean").coalesce(1).write.parquet(str(tmp_path / name))
    part([("a", 0, "one ", False), ("a", 2, "three", True)], "in/x=1")
    frames = spark.readStream.schema("session string, seq long, text string, last boolean, x int").parquet(str(tmp_path / "in")).drop("x")
    q = tokens.segments(frames, patience=500).writeStream.format("memory").queryName("gaps").outputMode("append").trigger(processingTime="200 milliseconds").start()
    for _ in range(120):
        if spark.table("gaps").count():
            break
        time.sleep(0.5)
    q.stop()
    assert [(r.n, r.kind, r.text) for r in spark.table("gaps").collect()] == [(0, "text", "one three")]
