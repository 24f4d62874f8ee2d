"""The plain spelling of words: one script, composed letters, ordinary hyphens and spaces, nothing invisible.

The tables here are also the dimension tables of the distributed normaliser.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that look the same in several scripts, one group to a line.
LOOK_ALIKE_GROUPS = """
h հ һ
n ո
u ս
g ց
o օ о ο
q զ ԛ
j յ ј ϳ
a а α
e е
c с ϲ
p р ρ
y у
x х
i і ι
s ѕ
v ν
"""
# Signs that stand for the hyphen U+002D.
HYPHENS = "֊‐‑‒–—―−﹘﹣－"
#: The pair of letters that is written as one.
ECH_YIWN, EW = "եւ", "և"
SCRIPT_RANGES = (
    ("armenian", 0x0530, 0x058F), ("armenian", 0xFB13, 0xFB17), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("cyrillic", 0x1C80, 0x1C8F), ("cyrillic", 0x2DE0, 0x2DFF), ("cyrillic", 0xA640, 0xA69F),
    ("latin", 0x0041, 0x005A), ("latin", 0x0061, 0x007A), ("latin", 0x00AA, 0x00AA), ("latin", 0x00BA, 0x00BA),
    ("latin", 0x00C0, 0x00D6), ("latin", 0x00D8, 0x00F6), ("latin", 0x00F8, 0x024F), ("latin", 0x0250, 0x02AF), ("latin", 0x1E00, 0x1EFF),
)
#: Where two scripts have equally many letters, the earlier one here wins.
SCRIPT_ORDER = ("armenian", "latin", "cyrillic", "greek")
#: Strings of this form without ech-yiwn are in plain spelling already.
PLAIN_FORM = "[ա-և]+(?:[- ][ա-և]+)*"

_PLAIN = re.compile(PLAIN_FORM)
_SPACES = re.compile(r"\s+")


def script_of(ch: str) -> str | None:
    o = ord(ch)
    return next((name for name, a, b in SCRIPT_RANGES if a <= o <= b), None)


def is_invisible(ch: str) -> bool:
    """Formats, controls that are no white space, and variation selectors."""
    o = ord(ch)
    return 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or (unicodedata.category(ch) in ("Cf", "Cc") and not ch.isspace())


def look_alikes() -> dict[tuple[str, str], str]:
    """(letter, wanted script) -> the letter of that script that looks the same."""
    out = {}
    for line in LOOK_ALIKE_GROUPS.split("\n"):
        group = line.split()
        cased = [group, [x.upper() for x in group if len(x.upper()) == 1 and x in "oaecpyxisj"]]
        for letters in cased:
            for x in letters:
                for y in letters:
                    if script_of(x) != script_of(y):
                        out.setdefault((x, script_of(y)), y)
    return out


LOOK_ALIKES = look_alikes()


def to_plain(text: str) -> str:
    """The plain spelling of one word or entry; ``''`` stays ``''``."""
    if _PLAIN.fullmatch(text) and ECH_YIWN not in text:
        return text
    t = "".join("-" if c in HYPHENS else c for c in unicodedata.normalize("NFKD", text) if not is_invisible(c))
    t = "".join("-" if c in HYPHENS else c for c in t)
    t = _SPACES.sub(" ", t).strip(" ")
    seen: dict[str, int] = {}
    for c in t:
        s = script_of(c)
        if s:
            seen[s] = seen.get(s, 0) + 1
    if len(seen) > 1:
        main = min(seen, key=lambda s: (-seen[s], SCRIPT_ORDER.index(s)))
        t = "".join(c if (s := script_of(c)) in (None, main) else LOOK_ALIKES.get((c, main), c) for c in t)
    return unicodedata.normalize("NFC", t).replace(ECH_YIWN, EW)


@F.pandas_udf(T.StringType())
def _plain_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        seen: dict[str, str] = {}
        out = []
        for x in s:
            if x is None:
                out.append(None)
                continue
            y = seen.get(x)
            if y is None:
                y = seen[x] = to_plain(x)
            out.append(y)
        yield pd.Series(out, dtype=object)


def plain_spelling(col: str | Column) -> Column:
    """The plain spelling as a column; null stays null.

    Words whose form alone shows them plain stay in the JVM; only the others go
    through the Arrow batches.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(_plain_udf(F.when(~known_plain(c), c)), c)


def known_plain(c: Column) -> Column:
    """The form alone shows the word plain (to the very end: a line break after it is no part of the form)."""
    return c.rlike(rf"\A(?:{PLAIN_FORM})\z") & ~c.contains(ECH_YIWN)


def filled(*cols: str) -> Column:
    """None of the columns is empty (null or ``''``)."""
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull() & (F.col(c) != "")
    return out
