"""Phrases from token sequences: classes of tokens, merging of neighbours by positive PMI, filtering of terms.

A segmenter takes a document's tokens and their probabilities and gives phrases, their probabilities,
and the phrase of each token (-1 for none). Segmenters are registered by name.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessella.operators.keywords import in_blocks
from tessella.session import ship_package

#: Signs that may join words, signs that words may be merged across, stop words, and limits.
CONNECTORS = ["·", "・", "･", "-", "'", "’", "."]
BRIDGES = [" ", "\n", "\t", "\r", "<br>"]
STOP_WORDS = "的 了 和 是 在 及 与 或 为 对 将 可 而 就 the and for with that this from are was were".split()
FLOOR, LEAST_PAIRS = 1e-300, 10
CHAIN_BITS, CHAIN_TOKENS, UNMATCHED = 0.4, 24, 1e-300

_BRIDGE = re.compile("(?:" + "|".join(map(re.escape, BRIDGES)) + ")+")
_KNOWN = re.compile("|".join(map(re.escape, sorted(BRIDGES + CONNECTORS, key=len, reverse=True))))
_NUMBER = re.compile(r"[,._\-+:/\\，。．、：；]+")

Segments = tuple[list[str], list[float], list[int]]
Segmenter = Callable[[list[str], list[float]], Segments]
SEGMENTERS: dict[str, Segmenter] = {}
DEFAULT = "positive-pmi"


def register(name: str, segmenter: Segmenter) -> None:
    key = (name or "").strip().lower()
    if not key:
        raise ValueError("a segmenter needs a name")
    SEGMENTERS[key] = segmenter


def segmenter(name: str | None = None) -> Segmenter:
    """The one of that name; the default where there's no such one."""
    return SEGMENTERS.get((name or "").strip().lower(), SEGMENTERS[DEFAULT])


#: Characters of a token whose class a worker keeps, as nearly all tokens come again, and how many of these.
KNOWN_CHARS, KNOWN_TOKENS = 32, 1 << 16


def token_class(token: str) -> str:
    """exception: white space and line breaks, which are passed over; break: other punctuation, or nothing; else content."""
    return _known_class(token) if len(token) <= KNOWN_CHARS else _class(token)


def _class(token: str) -> str:
    if not token:
        return "break"
    if _BRIDGE.fullmatch(token):
        return "exception"
    rest = _KNOWN.sub("", token)
    return "break" if any(unicodedata.category(c).startswith("P") for c in rest) else "content"


_known_class = lru_cache(KNOWN_TOKENS)(_class)


def is_noise(term: str) -> bool:
    """Empty, a number, a single sign that isn't Chinese, or punctuation alone; connectors are none."""
    t = (term or "").strip()
    if t in CONNECTORS:
        return False
    if not t or re.fullmatch(r"\d+", _NUMBER.sub("", t) or "x"):
        return True
    if len(t) == 1 and not "一" <= t <= "鿿":
        return True
    signs = [c for c in t if not c.isspace()]
    return all(unicodedata.category(c).startswith("P") and c not in CONNECTORS for c in signs)


def noise_count(terms: Column) -> Column:
    """How many of an array of terms are noise."""

    @pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        known: dict[str, bool] = {}
        return pd.Series([sum(n for t, n in Counter(v).items() if (known[t] if t in known else known.setdefault(t, is_noise(t)))) for v in values], dtype="int64")

    ship_package(SparkSession.active())
    return run(terms)


def filter_terms(terms: list[str], top_k: int = 0, least: int = 1, stop: frozenset[str] = frozenset(STOP_WORDS)) -> list[str]:
    """Stripped terms without noise, stop words, short and repeated ones, in order; top_k of them if that is above 0."""
    out: dict[str, None] = {}
    for x in terms:
        t = (x or "").strip()
        if len(t) >= max(1, least) and t not in out and not is_noise(t) and t.lower() not in stop:
            out[t] = None
            if 0 < top_k <= len(out):
                break
    return list(out)


class _Unit:
    """Neighbouring tokens: their text, positions, and the sum of 1 / probability."""

    __slots__ = ("text", "at", "inverse")

    def __init__(self, text: str, at: tuple[int, ...], inverse: float):
        self.text, self.at, self.inverse = text, at, inverse

    def probability(self) -> float:
        """Harmonic mean of the tokens'."""
        return max(len(self.at) / self.inverse, FLOOR)


def pair_counts(segments: list[list[str]]) -> tuple[Counter, Counter]:
    """How often each text and each pair of neighbours is there."""
    units, pairs = Counter(), Counter()
    for s in segments:
        units.update(s)
        pairs.update(zip(s, s[1:]))
    return units, pairs


def pair_scores(segments: list[list[_Unit]], least: int) -> dict[tuple[str, str], tuple]:
    """Pairs of neighbours of positive PMI that occur at least max(2, least) times, with what they are compared by.

    The score weighs PMI by ln(1 + n) and by the mean of the pairs' geometric probability.
    """
    units, pairs = pair_counts([[u.text for u in s] for s in segments])
    mass, often = Counter(), {p for p, n in pairs.items() if n >= max(2, least)}
    for s in segments if often else ():
        for a, b in zip(s, s[1:]):
            if (a.text, b.text) in often:
                mass[a.text, b.text] += math.sqrt(a.probability() * b.probability())
    tokens, bigrams, out = sum(units.values()), sum(pairs.values()), {}
    for (a, b), n in pairs.items():
        if n >= max(2, least):
            pmi = math.log(n / bigrams / (units[a] / tokens * (units[b] / tokens)))
            if pmi > 0:
                rarity = max(-math.log2(max(mass[a, b] / n, FLOOR)), 0.0)
                out[a, b] = (pmi * math.log1p(n) / (1 + rarity), pmi, n, len(a) + len(b), a, b)
    return out


def merge_pairs(segment: list[_Unit], scores: dict) -> tuple[list[_Unit], int]:
    """One pass from the left: a pair is merged unless the pair that begins with its second unit scores higher."""
    out, i, merged = [], 0, 0
    at = lambda j: scores.get((segment[j].text, segment[j + 1].text)) if j + 1 < len(segment) else None
    while i < len(segment):
        here, after = at(i), at(i + 1)
        if here is not None and not (after is not None and after > here):
            a, b = segment[i], segment[i + 1]
            out.append(_Unit(a.text + b.text, a.at + b.at, a.inverse + b.inverse))
            merged, i = merged + 1, i + 2
        else:
            out.append(segment[i])
            i += 1
    return out, merged


def merged_units(segments: list[list[_Unit]], least: int) -> list[list[_Unit]]:
    """segments after pass upon pass of merge_pairs, until nothing is merged."""
    while scores := pair_scores(segments, least):
        merged = 0
        for i, s in enumerate(segments):
            segments[i], m = merge_pairs(s, scores)
            merged += m
        if not merged:
            break
    return segments


def positive_pmi(tokens: list[str], probabilities: list[float], least: int = LEAST_PAIRS) -> Segments:
    """Merges all pairs of positive PMI, batch after batch, until none is left. A phrase's probability is its tokens' product."""
    runs: list[list[int]] = [[]]
    n = min(len(tokens), len(probabilities))
    for i in range(n):
        kind = token_class(tokens[i])
        if kind == "break":
            runs.append([])
        elif kind == "content":
            runs[-1].append(i)
    most = max(pair_counts([[tokens[i] for i in r] for r in runs])[1].values(), default=0)
    if most < max(2, least):  # nothing can be merged, so each token is its own phrase
        parts = [(tokens[i], (i,)) for r in runs for i in r]
    else:
        parts = [(u.text, u.at) for s in merged_units([[_Unit(tokens[i], (i,), 1 / max(probabilities[i], FLOOR)) for i in r] for r in runs], least) for u in s]
    phrases, probs, owner = [], [], [-1] * n
    for text, at in parts:
        if name := text.strip():
            for i in at:
                owner[i] = len(phrases)
            phrases.append(name)
            probs.append(max(math.exp(sum([math.log(max(probabilities[i], FLOOR)) for i in at])), FLOOR))
    return phrases, probs, owner


class Patterns:
    """Token sequences as a trie: the longest one that begins at a place is found by one walk."""

    END = object()

    def __init__(self, patterns=()):
        self.root: dict = {}
        for p in patterns:
            node = self.root
            for token in p:
                node = node.setdefault(token, {})
            node[self.END] = True

    def longest(self, tokens: list[str], at: int, end: int) -> int:
        """How many tokens from `at`, before `end`, the longest pattern there takes; 0 for none."""
        node, best = self.root, 0
        for i in range(at, end):
            node = node.get(tokens[i])
            if node is None:
                break
            if self.END in node:
                best = i + 1 - at
        return best


def chain_patterns(tokens: list[str], probabilities: list[float], bits: float = CHAIN_BITS, most: int = CHAIN_TOKENS) -> list[tuple[str, ...]]:
    """Per distinct token the chain of its likeliest successors.

    A pair's probability is the second token's where the pair occurs last; a successor is likely if -log2 of it is below
    `bits`, the likeliest goes on, of equal ones that which occurs last, and no pair twice. Tokens that break are in no chain.
    """
    last: dict[str, dict[str, int]] = {}
    for i, (a, b) in enumerate(zip(tokens, tokens[1:], strict=False), 1):
        last.setdefault(a, {})[b] = i
    ranked: dict[str, list[str]] = {}
    for a, after in last.items():
        likely = [(probabilities[i], i, b) for b, i in after.items() if math.isfinite(probabilities[i]) and probabilities[i] > 2.0**-bits and token_class(b) != "break"]
        ranked[a] = [b for _, _, b in sorted(likely, reverse=True)]
    out = []
    for token in dict.fromkeys(t for t in tokens if token_class(t) != "break"):
        chain, used = [token], {}
        while len(chain) < most:
            nth = used.get(chain[-1], 0)  # a token met again goes on by its next best successor
            options = ranked.get(chain[-1], [])
            if nth >= len(options):
                break
            used[chain[-1]] = nth + 1
            chain.append(options[nth])
        out.append(tuple(chain))
    return out


def transition_chain(tokens: list[str], probabilities: list[float], bits: float = CHAIN_BITS, most: int = CHAIN_TOKENS, harmonic: bool = False) -> Segments:
    """The longest chain pattern (or one token) at each place, from the left. A phrase's probability is the product, or the harmonic mean, of its tokens'."""
    n = min(len(tokens), len(probabilities))
    tokens, known = list(tokens[:n]), Patterns(chain_patterns(tokens[:n], probabilities[:n], bits, most))
    phrases, probs, owner, i = [], [], [-1] * n, 0
    while i < n:
        if token_class(tokens[i]) == "break":
            i += 1
            continue
        size = max(1, known.longest(tokens, i, n))
        p = [max(x, FLOOR) for x in probabilities[i : i + size]]
        owner[i : i + size] = [len(phrases)] * size
        phrases.append("".join(tokens[i : i + size]).strip() or tokens[i])
        probs.append(max(size / math.fsum(1 / x for x in p), FLOOR) if harmonic else max(math.exp(math.fsum(map(math.log, p))), FLOOR))
        i += size
    return phrases, probs, owner


#: Tokens of an anchored run, and signs that end one.
RUN_TOKENS, RUN_ENDS = 24, re.compile("[。！？.!?]")


def anchored_runs(tokens: list[str], probabilities: list[float], anchor: float, follower: float, k: int = 100) -> list[tuple[int, float, str]]:
    """(place, probability, phrase) of the k (1 to 100) least likely anchors: a token of at most `anchor`, and likely ones (`follower` at least) after it.

    A run ends before a line end and an unlikely token, and with a token that ends a sentence. Blank ones are named by what they are.
    """
    n, found = min(len(tokens), len(probabilities)), []
    for i in range(n):
        if not math.isfinite(probabilities[i]) or probabilities[i] > anchor:
            continue
        j = i + 1
        while j < min(n, i + RUN_TOKENS) and probabilities[j] >= follower and "\n" not in tokens[j]:
            j += 1
            if RUN_ENDS.search(tokens[j - 1]):
                break
        phrase = " ".join("".join(tokens[i:j]).split())
        shown = "".join({"\n": "\\n", "\t": "\\t", "\r": "\\r"}.get(c, c) for c in tokens[i]).strip()
        found.append((probabilities[i], i, phrase or shown or f"<WS@{i}>"))
    return [(i, p, phrase) for p, i, phrase in sorted(found, key=lambda x: x[:2])[: max(1, min(k, 100))]]


def dictionary_words(tokens: list[str], probabilities: list[float], words: list[str]) -> Segments:
    """Words laid over the tokens by their places in the joined text: a word's probability is the product over the tokens that it
    overlaps, UNMATCHED for one that isn't found; a token belongs to the first word that overlaps it."""
    n = min(len(tokens), len(probabilities))
    ends, at = [], 0
    for t in tokens[:n]:
        at += len(t)
        ends.append(at)
    text, cursor, probs, owner, first = "".join(tokens[:n]), 0, [], [-1] * n, 0
    for w, word in enumerate(words):
        a = text.find(word, cursor) if word else -1
        if a < 0:
            probs.append(UNMATCHED)
            continue
        cursor = a + len(word)
        while first < n and ends[first] <= a:
            first += 1
        p, k = 1.0, first
        while k < n and ends[k] - len(tokens[k]) < cursor:
            p *= max(probabilities[k], FLOOR)
            owner[k] = w if owner[k] < 0 else owner[k]
            k += 1
        probs.append(max(p, FLOOR))
    return list(words), probs, owner


register(DEFAULT, positive_pmi)
register("transition-chain", transition_chain)
register("transition-chain-hmean", lambda tokens, p: transition_chain(tokens, p, harmonic=True))


def _listed(x: pa.ListScalar) -> list:
    """A list's elements, or none of a null, by one conversion; as_py makes an object for each first."""
    return [] if x.values is None else x.values.to_numpy(zero_copy_only=False).tolist()


def segment(docs: DataFrame, name: str | None = None) -> DataFrame:
    """(doc_id, pos, phrase, p, tokens) of docs (doc_id, tokens, probabilities: arrays). tokens: how many the phrase has.

    A document's merges depend on its own counts, round after round, so this is an Arrow function; a task
    holds a batch of documents and no document meets another.
    """
    ship_package(docs.sparkSession)
    cut = segmenter(name)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, pos, names, ps, sizes = [], [], [], [], []
            for i, (tokens, p) in enumerate(zip(b.column(1), b.column(2), strict=True)):
                phrases, probs, owner = cut(_listed(tokens), _listed(p))
                size = Counter(owner)
                at += [i] * len(phrases)
                pos += range(len(phrases))
                names += phrases
                ps += probs
                sizes += [size[k] for k in range(len(phrases))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(names, pa.string()), pa.array(ps, pa.float64()), pa.array(sizes, pa.int32())],
                names=["doc_id", "pos", "phrase", "p", "tokens"],
            )

    return docs.select("doc_id", "tokens", "probabilities").mapInArrow(run, f"doc_id {kind}, pos int, phrase string, p double, tokens int")


def anchored_phrases(docs: DataFrame, anchor: float, follower: float, k: int = 100) -> DataFrame:
    """(doc_id, rank, pos, p, phrase) of docs (doc_id, tokens, probabilities: arrays): each document's anchored runs, the least likely first."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [(i, n, *x) for i, (t, p) in enumerate(zip(b.column(1), b.column(2), strict=True)) for n, x in enumerate(anchored_runs(_listed(t), _listed(p), anchor, follower, k), 1)]
            at, *rest = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int32(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(rest, types, strict=True))], names=["doc_id", "rank", "pos", "p", "phrase"])

    return docs.select("doc_id", "tokens", "probabilities").mapInArrow(run, f"doc_id {kind}, rank int, pos int, p double, phrase string")


def followed(tokens: list[str], shares: list[float]) -> list[float]:
    """Probabilities of a document's tokens by what came before: (n of the token after its context + its share) / (n of the context + 1).

    Counted are the earlier places of the document; a token's context is the one before it. In a new context the shares hold; over all
    tokens the probabilities add up to 1 as these do.
    """
    contexts, pairs, before, out = {}, {}, "", []
    for t, share in zip(tokens, shares):
        n, k = contexts.get(before, 0), pairs.get((before, t), 0)
        out.append((k + share) / (n + 1))
        contexts[before], pairs[before, t] = n + 1, k + 1
        before = t
    return out


def corpus_tokens(docs: DataFrame, follow: bool = False) -> DataFrame:
    """docs (doc_id, text) as tokens (words, runs of white space, single other signs) and their shares in the corpus, or those `followed`.

    They stand for a language model's probabilities, which need weights that aren't here. No share is as high as a likely
    successor's probability, so chains need follow.
    """
    t = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?U)(\w+|\s+|[^\w\s])"), 1)
    # tokens are all of a text, so their lengths tell where it is cut
    sized = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.transform(t, F.length).alias("sizes"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def tokens(b: pa.Table):
        for text, sizes in zip(b.column("text"), b.column("sizes"), strict=True):
            text, at, out = text.as_py(), 0, []
            for n in _listed(sizes):
                out.append(text[at : at + n])
                at += n
            yield out

    def count(b: pa.Table) -> Counter:
        found: Counter = Counter()
        for t in tokens(b):
            found.update(t)
        found[None] = found.total()
        return found

    def use(b: pa.Table, found: dict) -> pa.Table:
        # a list of all tokens, and where each text's begin
        names, shares, ends, kept = [], [], [0], []
        for i, t in enumerate(tokens(b)):
            if t:
                kept.append(i)
                names += t
                own = [found[x] / found[None] for x in t]
                shares += followed(t, own) if follow else own
                ends.append(len(names))
        at, p = pa.array(ends, pa.int32()), pa.array(shares, pa.float64())
        return pa.table([b.column("doc_id").take(pa.array(kept, pa.int64())), pa.ListArray.from_arrays(at, pa.array(names, pa.string())), pa.ListArray.from_arrays(at, p)], names=["doc_id", "tokens", "probabilities"])

    return in_blocks(sized, count, use, f"doc_id {kind}, tokens array<string>, probabilities array<double>")


def fill_phrases(tokens: DataFrame) -> DataFrame:
    """tokens (doc_id, pos, token, phrase or -1) with the phrase of the nearest earlier token, else of the next, else 0.

    Nothing is carried over a token that breaks.
    """
    breaks = F.col("token").rlike(r"^\p{P}+$") & ~F.col("token").isin(CONNECTORS)
    order = Window.partitionBy("doc_id").orderBy("pos")
    part = F.sum(breaks.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    known = F.when(F.col("phrase") >= 0, F.col("phrase"))
    t = tokens.withColumns({"part": part, "known": known})
    before = F.last("known", ignorenulls=True).over(Window.partitionBy("doc_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("known", ignorenulls=True).over(Window.partitionBy("doc_id", "part").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("phrase", F.coalesce(before, after, F.lit(0))).drop("part", "known")


def valley_thresholds(values: Column, bins: int = 20, default: tuple[float, float] = (0.2, 0.6), least: int = 20) -> Column:
    """struct(low, high) around the valley between the two highest peaks of a smoothed histogram of an array of numbers.

    Fewer than `least` numbers, or equal ones, give the default; without two peaks the quartiles are taken.
    """
    lo, hi = F.array_min(values), F.array_max(values)
    width = (hi - lo) / bins
    place = lambda x: F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("int")
    places = F.transform(values, place)
    raw = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)))
    at = lambda a, i: F.coalesce(F.get(a, i), F.lit(0))
    smooth = F.transform(raw, lambda x, i: (at(raw, i - 1) + x + at(raw, i + 1)) / 3)
    peaks = F.filter(
        F.transform(smooth, lambda x, i: F.struct(x.alias("h"), (-i).alias("back"), ((x > 0) & (x >= at(smooth, i - 1)) & (x > at(smooth, i + 1))).alias("ok"))), lambda p: p["ok"]
    )
    best = F.reverse(F.array_sort(peaks))
    a, b = F.least(-F.get(best, F.lit(0))["back"], -F.get(best, F.lit(1))["back"]), F.greatest(-F.get(best, F.lit(0))["back"], -F.get(best, F.lit(1))["back"])
    between = F.transform(F.sequence(a, b), lambda i: F.struct(at(smooth, i).alias("h"), i.alias("i")))
    valley = lo + (F.array_min(between)["i"] + 0.5) * width
    ordered = F.array_sort(values)
    quartile = lambda q: F.element_at(ordered, F.greatest(F.lit(1), F.ceil(F.size(ordered) * q)).cast("int"))
    pair = lambda x, y: F.struct(x.cast("double").alias("low"), y.cast("double").alias("high"))
    return (
        F.when((F.size(values) < least) | (lo == hi), pair(F.lit(default[0]), F.lit(default[1])))
        .when(F.size(peaks) >= 2, pair(F.least(valley, quartile(0.5)), F.greatest(valley, quartile(0.5))))
        .otherwise(pair(quartile(0.25), quartile(0.75)))
    )
