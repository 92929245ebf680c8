"""JSON values: pruning, parsing with a fallback, references to earlier outputs; lists of assets and entries."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from tessella.functions.access import steps
from tessella.functions.text import strip

CALL = re.compile(r"tool\[(-?\d+)\]")


def pruned(value):
    """Without nulls, empty strings, and lists and objects that become empty; None if nothing is left."""
    if isinstance(value, dict):
        value = {k: p for k, v in value.items() if (p := pruned(v)) is not None}
    elif isinstance(value, list):
        value = [p for v in value if (p := pruned(v)) is not None]
    return None if value is None or value in ("", [], {}) and not isinstance(value, (bool, int, float)) else value


def prune(c: Column) -> Column:
    """A JSON string without empty fields, bottom up; null for one that is all empty, the string itself for other text.

    The depth of a value is its own, which no built-in function follows.
    """

    @pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            try:
                left = pruned(json.loads(x))
            except ValueError:
                return x
            return None if left is None else json.dumps(left, ensure_ascii=False, separators=(",", ":"))

        return values.map(one)

    return run(c)


def json_or_text(c: Column) -> Column:
    """struct(kind, json): a JSON value's kind and its compact form, else kind text and the stripped text as a JSON string."""
    t = strip(F.coalesce(c, F.lit("")))
    v = F.when(t != "", F.try_parse_json(t))
    kind = F.schema_of_variant(v)
    name = F.when(v.isNull(), F.lit("text")).when(kind.startswith("OBJECT"), F.lit("object")).when(kind.startswith("ARRAY"), F.lit("array")).otherwise(F.lower(kind))
    return F.struct(name.alias("kind"), F.coalesce(F.to_json(v), F.to_json(F.array(t)).substr(F.lit(2), F.length(F.to_json(F.array(t))) - 2)).alias("json"))


def take(value, chain: str):
    """The value at an accessor chain: positions from 1 or from the end, keys by name; KeyError where there is none."""
    for s in steps(chain):
        if isinstance(value, list):
            if not isinstance(s, int):
                raise KeyError("a list's position is a number")
            i = len(value) + s if s < 0 else s - 1
            if not 0 <= i < len(value):
                raise KeyError("no such position")
            value = value[i]
        elif isinstance(value, dict):
            key = str(s)
            key = "_url" if key == "link" and "_url" in value else key
            if key not in value:
                raise KeyError(key)
            value = value[key]
        else:
            raise KeyError("the value has no parts")
    return value


def piped(value, spec: str) -> str:
    """`regex PATTERN [TEMPLATE]`: the first match put into a template of $0, $1, ...; an empty string without a match."""
    parts = shlex.split(spec)
    if len(parts) < 2 or parts[0].lower() != "regex":
        raise ValueError(f"not a pipe: {spec}")
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    m = re.search(parts[1], text, re.S)
    if not m:
        return ""
    out = " ".join(parts[2:]) or "$0"
    for i, g in reversed([*enumerate((m[0], *m.groups()))]):
        out = out.replace(f"${i}", g or "")
    return out


def resolve(value, outputs: list):
    """References `tool[n]CHAIN | regex ...` inside a value, resolved against the outputs of completed calls, the oldest first.

    n counts from the oldest, or with a minus from the newest; lists and objects are resolved inside.
    """
    if isinstance(value, dict):
        return {k: resolve(v, outputs) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve(v, outputs) for v in value]
    if not isinstance(value, str) or not (m := CALL.match(value.strip())):
        return value
    head, *pipes = [p.strip() for p in value.strip().split("|")]
    got = take(outputs, f"[{m[1]}]")
    chain = head[m.end() :].strip()
    if chain:
        got = take(got, chain)
    for p in filter(None, pipes):
        got = piped(got, p)
    return got


def resolve_inputs(inputs: DataFrame, calls: DataFrame) -> DataFrame:
    """inputs (session, id, input: JSON or text) with resolved (JSON or text) and error.

    calls: session, ord, output, ended. A session's completed outputs meet its inputs in one row each, as
    any of them can be named.
    """
    done = calls.where("ended").groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "output"))), lambda x: x["output"]).alias("outputs"))

    def load(x):
        try:
            return json.loads(x)
        except (ValueError, TypeError):
            return x

    @pandas_udf("resolved string, error string")
    def run(values: pd.Series, lists: pd.Series) -> pd.DataFrame:
        out = []
        for v, earlier in zip(values, lists, strict=True):
            try:
                got = resolve(load(v), [load(x) for x in (earlier if earlier is not None else [])])
                out.append((got if isinstance(got, str) or got is None else json.dumps(got, ensure_ascii=False, separators=(",", ":")), None))
            except (KeyError, ValueError, re.error) as e:
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["resolved", "error"])

    both = inputs.join(done, "session", "left")
    return both.withColumn("r", run("input", "outputs")).select("session", "id", "r.resolved", "r.error")


def front_matter(c: Column) -> Column:
    """Map of the `key: value` lines between two lines of --- at the start of a text; empty without them."""
    block = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\A\s*---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    rows = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    key = lambda x: strip(F.regexp_extract(x, r"^([^:]*):", 1))
    value = lambda x: F.regexp_replace(strip(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), r"""^(['"])(.*)\1$""", "$2")
    pairs = F.transform(rows, lambda x: F.struct(key(x).alias("key"), value(x).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def asset_key(asset: Column) -> Column:
    """Identity of an image asset struct(data, name, caption, source): sha1 of the first of these that isn't empty."""
    first = F.coalesce(*[F.nullif(strip(asset[f]), F.lit("")) for f in ("data", "name", "caption", "source")])
    return F.when(first.isNotNull(), F.sha1(first))


def distinct_assets(assets: Column) -> Column:
    """An array of image assets without repeated ones (and without empty ones), the first of each kept."""
    known = F.filter(F.transform(assets, lambda a: F.struct(asset_key(a).alias("k"), a.alias("a"))), lambda x: x["k"].isNotNull())
    first = F.filter(known, lambda x, i: ~F.exists(F.slice(known, F.lit(1), i), lambda y: y["k"] == x["k"]))
    return F.transform(first, lambda x: x["a"])


def encode_image(data: bytes) -> dict:
    """Bytes as base64 with their sha1."""
    return {"id": hashlib.sha1(data).hexdigest(), "data": base64.b64encode(data).decode()}


def decode_image(asset: dict) -> bytes:
    """The bytes of encode_image; empty for what isn't base64."""
    try:
        return base64.b64decode(asset.get("data") or "", validate=True)
    except binascii.Error:
        return b""


def image_tokens(markdown: Column) -> Column:
    """array of struct(page, index) of the `image://page-p/i` tokens, in order."""
    pages = F.regexp_extract_all(F.coalesce(markdown, F.lit("")), F.lit(r"image://page-(\d+)/(\d+)"), 1)
    index = F.regexp_extract_all(F.coalesce(markdown, F.lit("")), F.lit(r"image://page-(\d+)/(\d+)"), 2)
    both = F.arrays_zip(pages.alias("page"), index.alias("index"))
    return F.transform(both, lambda x: F.struct(x["page"].cast("int").alias("page"), x["index"].cast("int").alias("index")))


def resolve_images(texts: DataFrame, images: DataFrame) -> DataFrame:
    """(doc, at, page, index, image) of the tokens in texts (doc, text) that images (doc, page, index, ord, image) have, the first of a pair."""
    first = images.groupBy("doc", "page", "index").agg(F.min_by("image", "ord").alias("image"))
    t = texts.select("doc", F.posexplode(image_tokens(F.col("text"))).alias("at", "t")).select("doc", "at", "t.*")
    return t.join(first, ["doc", "page", "index"]).select("doc", "at", "page", "index", "image")


def flatten_todos(items: DataFrame) -> DataFrame:
    """(list, id from 1, text) of items (list, ord, text, children: array of strings): a row, then its children marked ↳."""
    rows = items.select("list", "ord", F.posexplode(F.concat(F.array("text"), F.transform(F.coalesce("children", F.array().cast("array<string>")), lambda x: F.concat(F.lit("↳ "), x)))).alias("at", "text"))
    from pyspark.sql import Window

    return rows.select("list", F.row_number().over(Window.partitionBy("list").orderBy("ord", "at")).alias("id"), "text")


def allowed_tools(tools: DataFrame, allowed: list[str]) -> DataFrame:
    """Distinct tools (name) in order: those that begin with rag_, or are allowed; all for an empty list."""
    ok = F.lit(not allowed) | F.col("name").startswith("rag_") | F.col("name").isin(allowed or [""])
    return tools.where(ok).select("name").distinct().orderBy("name")


def summary(entries: DataFrame, most: int = 12) -> DataFrame:
    """entries without catalog and search rows, with catalog_count and the first keywords."""
    return entries.select(
        "doc_name", "title", "page_count", "chunk_count", F.size(F.coalesce("catalog", F.array())).alias("catalog_count"), F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, most).alias("keywords")
    )
