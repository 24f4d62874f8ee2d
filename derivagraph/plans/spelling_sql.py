"""The plain spelling as DuckDB SQL, for oracles."""

from __future__ import annotations

from ..functions.spelling import LOOK_ALIKES, SCRIPT_ORDER

_CLASS = {"armenian": r"\x{0531}-\x{0587}", "latin": r"A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}", "cyrillic": r"\x{0400}-\x{052F}", "greek": r"\x{0370}-\x{03FF}"}


def plain_ctes(words: str) -> str:
    """CTEs ending in ``plain(w, p)`` for the distinct words of the query ``words`` (one column, ``w``)."""
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    narrow = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
    invisible = r"[\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{FE00}-\x{FE0F}]"
    k = f"translate(regexp_replace(w, '{invisible}', '', 'g'), '{wide}', '{narrow}')"
    for a, b in (("ﬓ", "մն"), ("ﬔ", "մե"), ("ﬕ", "մի"), ("ﬖ", "վն"), ("ﬗ", "մխ")):
        k = f"replace({k}, '{a}', '{b}')"
    k = f"translate({k}, '֊‐‑‒–—―−﹘﹣', '----------')"
    k = rf"nfc_normalize(trim(regexp_replace({k}, '[\s\p{{Z}}]+', ' ', 'g')))"
    counts = ", ".join(rf"length(regexp_replace(k, '[^{_CLASS[s]}]', '', 'g')) AS n_{s}" for s in SCRIPT_ORDER)
    cases = []
    for i, s in enumerate(SCRIPT_ORDER):
        pairs = sorted((a, b) for (a, want), b in LOOK_ALIKES.items() if want == s)
        most = " AND ".join(f"n_{s} >= n_{o}" for o in SCRIPT_ORDER if o != s)
        tr = f"translate(k, '{''.join(a for a, _ in pairs)}', '{''.join(b for _, b in pairs)}')"
        cases.append(f"WHEN {most} THEN {tr}" if i < len(SCRIPT_ORDER) - 1 else f"ELSE {tr}")
    one = " + ".join(f"(n_{s} > 0)::INT" for s in SCRIPT_ORDER)
    return f"""_k AS (SELECT w, {k} AS k FROM (SELECT DISTINCT w FROM ({words}) WHERE w IS NOT NULL)),
_n AS (SELECT w, k, {counts} FROM _k),
plain AS (SELECT w, replace(nfc_normalize(CASE WHEN {one} < 2 THEN k {' '.join(cases)} END), 'եւ', 'և') AS p FROM _n)"""


REL = r"lower(regexp_replace(relation, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))"
