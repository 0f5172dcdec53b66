"""What built-in functions can't express: display width, a seeded generator, diffs, JSON shapes.  Arrow batches only.

Types are objects, not strings, as executors import this module without a session.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = (1 << 64) - 1


#: Printable Latin characters, one column each.
_NARROW = re.compile("[\x20-\x7e\xa1-\xac\xae-\u02ff]*")


def width(text: str, tab: int = 4) -> int:
    """Columns of the last line of text, by grapheme cluster: tabs go to the next stop, marks and joiners alone take none, wide ones and pairs that make a flag two."""
    if _NARROW.fullmatch(text):
        return len(text)
    import regex

    at = 0
    for cluster in regex.findall(r"\X", text):
        if cluster in ("\n", "\r\n"):
            at = 0
        elif cluster == "\t":
            at += tab - at % tab
        elif any(unicodedata.category(c) not in ("Mn", "Me", "Cf", "Cc") for c in cluster):
            flag = len(cluster) == 2 and all("\U0001f1e6" <= c <= "\U0001f1ff" for c in cluster)
            at += 2 if flag or any(unicodedata.east_asian_width(c) in "WF" for c in cluster) else 1
    return at


@F.pandas_udf(T.IntegerType())
def display_width(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else width(t)).astype("Int32")


class SplitMix64:
    """A seeded generator whose streams don't depend on the machine."""

    def __init__(self, seed: int):
        self.state = seed & MASK

    def next(self) -> int:
        self.state = self.state + 0x9E3779B97F4A7C15 & MASK
        z = self.state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & MASK
        z = (z ^ z >> 27) * 0x94D049BB133111EB & MASK
        return z ^ z >> 31

    def below(self, n: int) -> int:
        """Even over 0 .. n - 1, by rejection."""
        limit = (1 << 64) - (1 << 64) % n
        while (x := self.next()) >= limit:
            pass
        return x % n

    def double(self) -> float:
        return (self.next() >> 11) / (1 << 53)

    def pick(self, weights: list[float]) -> int:
        x = self.double() * sum(weights)
        for i, w in enumerate(weights):
            x -= w
            if x < 0:
                return i
        return len(weights) - 1

    def shuffle(self, items: list) -> list:
        out = list(items)
        for i in range(len(out) - 1, 0, -1):
            j = self.below(i + 1)
            out[i], out[j] = out[j], out[i]
        return out


def shape(value: object, path: str = "") -> list[str]:
    """`path : kind` of every leaf, array steps as [], empty objects and arrays kept; worked off a stack, so depth doesn't matter."""
    out, todo = [], [(path, value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict) and v:
            todo += [(f"{at}.{k}" if at else k, x) for k, x in v.items()]
        elif isinstance(v, list) and v:
            todo += [(f"{at}[]", x) for x in v]
        else:
            kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "boolean" if isinstance(v, bool) else "null" if v is None else "string" if isinstance(v, str) else "number"
            out.append(f"{at} : {kind}")
    return sorted(set(out))


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_shape(text: pd.Series) -> pd.Series:
    """Null for what isn't JSON."""

    def of(t):
        try:
            return None if t is None else shape(json.loads(t))
        except ValueError:
            return None

    return text.map(of)


def keys(value: object) -> list[str]:
    """All keys of all objects, at any depth, each once, in order of name."""
    found, todo = set(), [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            found |= v.keys()
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return sorted(found)


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_keys(text: pd.Series) -> pd.Series:
    """Null for what isn't JSON."""

    def of(t):
        try:
            return None if t is None else keys(json.loads(t))
        except ValueError:
            return None

    return text.map(of)


def well_formed(comment: str) -> bool:
    """Is the content of a documentation comment XML, its leading marks aside?"""
    from xml.etree import ElementTree

    body = "\n".join(x.lstrip().removeprefix("///") for x in comment.split("\n"))
    try:
        ElementTree.fromstring(f"<doc>{body}</doc>")
    except ElementTree.ParseError:
        return False
    return True


@F.pandas_udf(T.BooleanType())
def is_well_formed(comment: pd.Series) -> pd.Series:
    return comment.map(lambda t: None if t is None else well_formed(t)).astype("boolean")
