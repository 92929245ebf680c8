import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import blocks
from tessella.operators import figures, segmentation
from tests.conftest import SF


def test_longest_pattern():
    p = segmentation.Patterns([("a", "b", "c"), ("a", "b"), ("b",)])
    t = ["a", "b", "x", "a", "b", "c", "a"]
    assert [p.longest(t, i, len(t)) for i in range(len(t))] == [2, 1, 0, 3, 1, 0, 0] and p.longest(t, 3, 5) == 2


def slow_chains(tokens, probs, bits, most):
    out = []
    for token in dict.fromkeys(tokens):
        if segmentation.token_class(token) == "break":
            continue
        chain, pairs = [token], set()
        while len(chain) < most:
            best = None
            for b in dict.fromkeys(tokens):
                at = [i for i in range(1, len(tokens)) if (tokens[i - 1], tokens[i]) == (chain[-1], b)]
                if not at or segmentation.token_class(b) == "break" or (chain[-1], b) in pairs or -math.log2(max(probs[at[-1]], 1e-300)) >= bits:
                    continue
                if best is None or (probs[at[-1]], at[-1]) > best[:2]:
                    best = (probs[at[-1]], at[-1], b)
            if best is None:
                break
            pairs.add((chain[-1], best[2]))
            chain.append(best[2])
        out.append(tuple(chain))
    return out


def test_chains_equal_search():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(0, 30)
        tokens = [rng.choice(["a", "b", "c", " ", ",", "d"]) for _ in range(n)]
        probs = [rng.choice([0.2, 0.8, 0.9, 0.95, 1.0]) for _ in range(n)]
        chains = segmentation.chain_patterns(tokens, probs)
        assert chains == slow_chains(tokens, probs, segmentation.CHAIN_BITS, segmentation.CHAIN_TOKENS)
        for harmonic in (False, True):
            phrases, p, owner = segmentation.transition_chain(tokens, probs, harmonic=harmonic)
            i = 0
            while i < n:
                if segmentation.token_class(tokens[i]) == "break":
                    assert owner[i] == -1
                    i += 1
                    continue
                size = max(len(c) for c in chains + [(tokens[i],)] if tuple(tokens[i : i + len(c)]) == c)
                own = probs[i : i + size]
                assert owner[i : i + size] == [owner[i]] * size and phrases[owner[i]] == ("".join(tokens[i : i + size]).strip() or tokens[i])
                assert math.isclose(p[owner[i]], size / sum(1 / x for x in own) if harmonic else math.prod(own))
                i += size


def test_anchored_runs():
    tokens = ["The", " ", "fox", " ", "ran", ".", " ", "So", "\n", "it", "\n"]
    probs = [0.01, 0.9, 0.5, 0.9, 0.9, 0.9, 0.9, 0.02, 0.9, 0.03, 0.001]
    got = segmentation.anchored_runs(tokens, probs, 0.05, 0.8)
    assert got == [(10, 0.001, "\\n"), (0, 0.01, "The"), (7, 0.02, "So"), (9, 0.03, "it")]
    assert segmentation.anchored_runs(tokens, probs, 0.6, 0.8, 3) == got[:3]
    assert segmentation.anchored_runs(tokens, probs, 0.5, 0.8)[-1] == (2, 0.5, "fox ran.")
    assert segmentation.anchored_runs([" "], [0.0], 0.5, 0.8) == [(0, 0.0, "<WS@0>")] and segmentation.anchored_runs([], [], 1, 1) == []
    assert len(segmentation.anchored_runs(["a"] * 40, [0.1] + [0.9] * 39, 0.1, 0.5)[0][2]) == 24


def test_a_common_token_is_no_large_key(spark):
    docs = spark.createDataFrame([(i, "a b " * 50 + f"w{i}") for i in range(40)] + [(7, "a b"), (None, None)], "doc_id long, text string")
    got = segmentation.corpus_tokens(docs).collect()
    assert len(got) == 41  # no tokens, no row
    share = {}
    for r in got:
        for t, p in zip(r.tokens, r.probabilities):
            share.setdefault(t, set()).add(round(p, 12))
    n = sum(len(r.tokens) for r in got)
    assert all(len(v) == 1 for v in share.values()) and share[" "] == {round(sum(r.tokens.count(" ") for r in got) / n, 12)}
    assert sorted("".join(r.tokens) for r in got) == sorted(["a b " * 50 + f"w{i}" for i in range(40)] + ["a b"])


def slow_slots(parts, slots):
    parts = [x.strip() for x in parts if x.strip()]
    if not parts:
        return [""] * slots
    while len(parts) < slots:
        i = max(range(len(parts)), key=lambda i: (len(parts[i]), -i))
        two = blocks.halves(parts[i])
        if len(two) < 2:
            break
        parts[i : i + 1] = two
    if len(parts) > slots:
        out = [[] for _ in range(slots)]
        for i, x in enumerate(parts):
            out[min(slots - 1, int(i * slots / len(parts)))].append(x)
        return ["\n\n".join(x) for x in out]
    return parts + [""] * (slots - len(parts))


def test_blocks(spark):
    table = "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n| 5 | 6 |"
    assert blocks.halves(table) == ["| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |", "| a | b |\n| --- | --- |\n| 5 | 6 |"]
    assert blocks.halves("a\n\nb\n\nc") == ["a", "b\n\nc"] and blocks.halves("a\nb\nc\nd") == ["a\nb", "c\nd"] and blocks.halves("short") == ["short"]
    long = "x" * 250 + "! " + "y" * 300
    assert blocks.halves(long) == ["x" * 250 + "!", "y" * 300]
    rng = random.Random(4)
    for _ in range(400):
        parts = [rng.choice([table, long, "p\n\nq\n\nr", "one", "", " ", "1\n2\n3\n4\n5", "z" * 900]) for _ in range(rng.randrange(6))]
        slots = rng.randrange(1, 9)
        assert blocks.split_blocks(parts, slots) == slow_slots(parts, slots)
    assert blocks.split_blocks(["a"], 0) == []
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n\n").alias("b"), (F.col("doc_id") % 7 + 1).cast("int").alias("n"))
    for r in d.withColumn("s", blocks.slots_of(F.col("b"), F.col("n"))).collect():
        assert r.s == slow_slots(list(r.b), r.n)


def slow_assignment(images, captions):
    left, groups = list(range(len(images))), [[] for _ in captions]
    for g, c in zip(groups, captions):
        if left:
            best = max(left, key=lambda i: (figures.score(c, images[i]), -i))
            g.append(best)
            left.remove(best)
    if groups:
        groups[-1] += left
    return groups


def test_images_and_captions(spark):
    c = lambda *x: figures.image_class(*x)
    assert figures.score("系统架构", c("image/png", "", 50000, 300, 300)) == 160 and figures.score("系统架构", c(None, "A.SVG", 50000, 10, 10)) == -140
    assert figures.score("指示灯", c("image/jpeg", "", 150000, 300, 300)) == 260 and figures.score("刀片", c("image/jpg", "", 20000, 100, 100)) == 80
    assert figures.score("安装的步骤", c("", "x.png", 90000, 100, 100)) == 150 and figures.score("x", c("", "", 0, 0, 0)) == -460
    rng = random.Random(5)
    words = ["系统架构图", "前面板", "指示灯说明", "内部组件", "安装步骤", "刀片正面", "其他", "插框"]
    rows, texts = [], []
    for d in range(40):
        for s in ("a", "b"):
            for i in range(rng.randrange(9)):
                rows.append((d, s, i, rng.choice(["image/png", "image/jpeg", None]), rng.choice(["x.emf", "y.jpg", None]), rng.randrange(200_000), rng.choice([None, 20, 300]), 100))
            texts += [(d, s, i, rng.choice([*words, " "])) for i in range(rng.randrange(6))]
    got = figures.images_to_captions(
        spark.createDataFrame(rows, "doc int, section string, at int, media_type string, filename string, size int, width int, height int"),
        spark.createDataFrame(texts, "doc int, section string, at int, caption string"),
    )
    have = {(r.doc, r.section, r.image): r.caption for r in got.collect()}
    want = {}
    for d in range(40):
        for s in ("a", "b"):
            own = [r for r in rows if r[:2] == (d, s)]
            caps = [(i, t) for x, y, i, t in texts if (x, y) == (d, s) and t.strip()]
            for (i, _), group in zip(caps, slow_assignment([c(*r[3:]) for r in own], [t for _, t in caps])):
                want |= {(d, s, own[n][2]): i for n in group}
    assert have == want and len(have) > 100


@pytest.mark.parametrize("name", ["phrase_segments", "tool_call_log", "catalog_payload", "markdown_export", "transition_segments", "anchored_phrases", "block_slots", "figure_captions", "rendered_pages"])
def test_whole_table_against_brute_force(spark, name):
    from tessella.plans import QUERIES

    got = [tuple(r) for r in QUERIES[name](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(BRUTE[name](spark), key=str)


def _shares(spark):
    import re
    from collections import Counter

    docs = {r.doc_id: re.findall(r"\w+|\s+|[^\w\s]", r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n = Counter(t for x in docs.values() for t in x)
    total = sum(n.values())
    return {d: (t, [n[x] / total for x in t]) for d, t in docs.items()}


def _segments(spark):
    for d, (t, p) in _shares(spark).items():
        phrases, _, owner = segmentation.positive_pmi(t, p)
        if phrases:
            yield d, len(phrases), sum(o >= 0 for o in owner)


def _transitions(spark):
    for d, (t, p) in _shares(spark).items():
        chains = {}
        for c in segmentation.chain_patterns(t, p) + [(x,) for x in t]:
            chains.setdefault(c[0], set()).add(c)
        sizes, i = [], 0
        while i < len(t):
            if segmentation.token_class(t[i]) == "break":
                i += 1
                continue
            sizes.append(max(len(c) for c in chains[t[i]] if tuple(t[i : i + len(c)]) == c))
            i += sizes[-1]
        if sizes:
            yield d, len(sizes), sum(sizes), max(sizes)


def _anchored(spark):
    import re

    for d, (t, p) in _shares(spark).items():
        runs = []
        for i in range(len(t)):
            if p[i] <= 1e-3:
                tail = []
                for x, q in list(zip(t, p))[i + 1 : i + 24]:
                    if q < 5e-3 or "\n" in x:
                        break
                    tail.append(x)
                    if re.search("[。！？.!?]", x):
                        break
                runs.append((p[i], i, re.sub(r"\s+", " ", "".join([t[i], *tail])).strip()))
        for n, (_, i, phrase) in enumerate(sorted(runs)[:10], 1):
            yield d, n, i, phrase


def _slots(spark):
    import hashlib

    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for i, x in enumerate(slow_slots((r.text or "").split("\n"), r.doc_id % 7 + 1)):
            yield r.doc_id, i, hashlib.md5(x.encode()).hexdigest()


def _figures(spark):
    from tessella.functions.text import heading_key
    from tessella.plans.documents import illustrated

    images, captions = illustrated(spark, SF)
    own, caps = {}, {}
    for r in images.orderBy("at").collect():
        own.setdefault((r.doc, r.section), []).append(r)
    for r in captions.withColumn("key", heading_key(F.col("caption"))).orderBy("at").collect():
        if r.caption.strip():
            caps.setdefault((r.doc, r.section), []).append(r)
    for key, cs in caps.items():
        mine = own.get(key, [])
        classes = [figures.image_class(*r[3:]) for r in mine]
        for c, group in zip(cs, slow_assignment(classes, [c.key for c in cs])):
            for n in group:
                yield *key, mine[n]["at"], c["at"]


def _rendered(spark):
    import hashlib

    from tessella.functions import markdown
    from tessella.operators import trees
    from tessella.plans.documents import paged

    p = paged(spark, SF)
    marks = {}
    for r in trees.text_markers(p).orderBy("ord").collect():
        marks.setdefault((r.doc, r.page), []).append((r.title, r.level))
    key = lambda x: "".join(c for c in x.lower() if c.isalnum() or c == "_")
    for r in p.collect():
        n, titles, out = r.doc % 3, dict((key(t), (t, lv)) for t, lv in marks.get((r.doc, r.page), [])), []
        for line in (r.text + "\n-").splitlines()[:-1]:
            t = titles.pop(key(line), None) if key(line) else None
            out.append("#" * t[1] + " " + t[0] if t else line.rstrip())
        out += [f"- Point[^{r.page}]", *([f"![Figure {r.page}: shape](image://page-{r.page}/1)"] if n else []), f"Figure {r.page}: shape", "| a | b |", "| --- | --- |", f"| 1 | {r.doc} |"]
        out += [f"![image 2](image://page-{r.page}/2)"] if n == 2 else []
        text = "\n".join(out).strip() + f"\n\n[^{r.page}]: note {r.doc}"
        yield r.doc, r.page, hashlib.md5(text.encode()).hexdigest(), len(text)


def _calls(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("user_id", "event_id").collect()
    open_, calls = {}, {}
    for r in rows:
        key = (r.user_id, r.event_type)
        if r.value < 40:
            calls[r.user_id, r.event_id] = [r.event_type, r.event_type, r.props, None, None]
            open_.setdefault(key, []).append(r.event_id)
        elif open_.get(key):
            calls[r.user_id, open_[key].pop()][3:] = [r.event_id, r.props]
    from tessella.plans import QUERIES

    names = QUERIES["tool_call_log"](spark, SF).columns
    nth = {}
    for (session, started), (call, tool, text, ended, out) in sorted(calls.items()):
        nth[session] = nth.get(session, 0) + 1
        row = {"nth": nth[session], "session": session, "call_id": call, "tool": tool, "started": started, "ended": ended, "input": text, "output": out}
        yield tuple(row[c] for c in names)


def _six(spark):
    """Trees of the six-page documents, by plain recursion over their headings."""
    from tessella.operators import catalog, trees
    from tessella.plans.documents import paged

    p = paged(spark, SF)
    pages, marks = {}, {}
    for r in p.orderBy("doc", "page").collect():
        pages.setdefault(r.doc, []).append((r.page, r.text))
    for r in catalog.ranges(trees.text_markers(p).drop("kind"), F.lit(6)).orderBy("doc", "ord").collect():
        marks.setdefault(r.doc, []).append((r.start, r.ord, r.level, r.end, r.title))
    contents = {(r.doc, r.page) for r in p.withColumn("c", trees.page_category(F.col("text"), F.lit(""))).where("c = 'catalogue'").collect()}
    assert not contents
    for d in pages:
        nodes = [{"title": t, "level": lv, "start": s, "end": e, "ord": o, "kids": [], "pages": []} for s, o, lv, e, t in sorted(marks.get(d, []))]
        roots = []
        for i, x in enumerate(nodes):
            up = next((y for y in reversed(nodes[:i]) if y["level"] < x["level"] and all(z["level"] > y["level"] for z in nodes[nodes.index(y) + 1 : i])), None)
            (up["kids"] if up else roots).append(x)
        alone = []
        for page, text in pages[d]:
            held = [x for x in nodes if x["start"] <= page <= x["end"]]
            home = min(held, key=lambda x: (-x["level"], x["end"] - x["start"], x["start"], x["ord"])) if held else None
            (home["pages"] if home else alone).append((page, text))

        def grown(x, path):
            path = f"{path}/{x['title']}" if path else x["title"]
            below = [k for k in (grown(y, path) for y in x["kids"]) if k]
            leaves = [("page", n, n, "", path, [], t, 0) for n, t in x["pages"]]
            kids = sorted(leaves + below, key=lambda k: (k[1], k[0] == "chapter", k[7], k[3]))
            if not kids:
                return None
            return ("chapter", min(k[1] for k in kids), max(k[2] for k in kids), x["title"], path, kids, None, x["ord"])

        top = [k for k in (grown(x, "") for x in roots) if k] + [("page", n, n, "", "", [], t, 0) for n, t in alone]
        yield d, sorted(top, key=lambda k: (k[1], k[0] == "chapter", k[7], k[3]))


def _payload(spark):
    from tessella.plans import QUERIES

    names = QUERIES["catalog_payload"](spark, SF).columns
    for d, top in _six(spark):
        rows = []

        def walk(nodes, depth, parent):
            for k in nodes:
                if k[0] == "chapter":
                    rows.append({"title": k[3], "page": k[1], "end_page": k[2], "level": depth, "parent_title": parent})
                    walk(k[5], depth + 1, k[3])

        walk(top, 1, None)
        rows = rows or [{"title": f"Page {i}", "page": k[1], "end_page": k[2], "level": 1, "parent_title": None} for i, k in enumerate(top, 1)]
        for i, r in enumerate(rows, 1):
            yield tuple((r | {"doc": d, "ord": i})[c] for c in names)


def _markdown(spark):
    import hashlib

    for d, top in _six(spark):
        out = []

        def walk(nodes, depth, inside):
            seen = None
            for k in nodes:
                span = str(k[1]) if k[1] == k[2] else f"{k[1]}-{k[2]}"
                head = "#" * min(depth + 1, 6) + " "
                if k[0] == "chapter":
                    out.append(f"{head}{k[3]}\n\n页码范围: {span}")
                    walk(k[5], depth + 1, True)
                    continue
                name = k[4].split("/")[-1] or "Untitled Page"
                again = inside and k[4] and seen == k[4]
                seen = k[4] or seen
                out.append("\n\n".join(([] if again else [head + name]) + [f"页码: {span}"] + ([f"正文:\n\n{k[6].strip()}"] if k[6].strip() else [])))

        walk(top, 1, False)
        text = "\n\n".join(out)
        yield d, hashlib.md5(text.encode()).hexdigest(), len(text)


BRUTE = {"transition_segments": _transitions, "anchored_phrases": _anchored, "block_slots": _slots, "figure_captions": _figures, "rendered_pages": _rendered, "phrase_segments": _segments, "tool_call_log": _calls, "catalog_payload": _payload, "markdown_export": _markdown}
