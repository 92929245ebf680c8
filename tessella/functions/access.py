"""References into nested values: accessor chains on JSON, and regex pipes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = re.compile(r"""\[(-?\d+)\]|\[['"]([^'"]+)['"]\]|\.?([A-Za-z_]\w*)""")


def steps(chain: str) -> list[int | str]:
    """`items[1].name` as a list; positions count from 1, or from the end when negative, and 0 is an error."""
    out, at = [], 0
    while at < len(chain):
        m = STEP.match(chain, at)
        if not m:
            raise ValueError(f"bad reference: {chain!r}")
        n, quoted, bare = m.groups()
        if n == "0":
            raise ValueError("positions count from 1")
        out.append(int(n) if n else quoted or bare)
        at = m.end()
    return out


def access(json: Column, chain: str) -> Column:
    """The value at a chain inside a JSON string, as a string; null where there is none.

    A position takes an element of a list; `link` also finds `_url`.
    """
    for s in steps(chain):
        if isinstance(s, int):
            items = F.from_json(json, "array<string>")
            json = F.try_element_at(items, F.lit(s))
        else:
            found = F.get_json_object(json, f"$['{s}']")
            json = F.coalesce(found, F.get_json_object(json, "$['_url']")) if s == "link" else found
    return json


def regex_pipe(c: Column, pattern: str, template: str = "$0") -> Column:
    """The first match put into a template of $0, $1, ...; an empty string without a match."""
    p = f"(?s){pattern}"
    parts = [
        F.regexp_extract(c, p, int(x[1:])) if re.fullmatch(r"\$\d+", x) else F.lit(x) for x in re.split(r"(\$\d+)", template) if x
    ]
    return F.when(c.rlike(p), F.concat(*parts)).otherwise(F.lit(""))
