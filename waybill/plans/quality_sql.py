"""SQL of the text quality points, from the same fixed values as the operator.

RE2 has no look-around, so a bounded pattern takes its neighbours in where only its
presence counts, and ASCII word boundaries where its matches are counted.
"""

from __future__ import annotations

from waybill.functions.lines import SUFFIX
from waybill.functions.scoring import MARKERS, TO_LINE, UPSIDE_DOWN

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_NO_WORD = r"[^\p{L}\p{N}_]"


def bounded(pattern: str) -> str:
    return rf"(?:^|{_NO_WORD})(?:{pattern})(?:{_NO_WORD}|$)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _has(x: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({x}, '{flags}{pattern}')"


def _left(x: str, pattern: str) -> str:
    """How many characters stay when the pattern's are taken out."""
    return f"len(regexp_replace({x}, '{pattern}', '', 'g'))"


def _hits(pattern: str) -> str:
    return f"len(regexp_extract_all(u, '{pattern}'))"


_LAYOUT = ((r"\b[A-Z]{2}\s+\d{5}(?:[-–— ]?\d{4})?\b", 5), (r"(?:^|\n)\s*[A-Z][A-Z .''-]+,?\s+[A-Z]{2}\s+\d{5}", 3), (r"\b\d{5}[-–— ]\d{4}\b", 2))
_PLACE = bounded(rf"{SUFFIX}|BUILDING|BLDG|CENTER|HUB")
_BOX = bounded(r"P\.?\s*O\.?\s+BOX\s+\d+")

_POINTS = " + ".join(
    [f"case when {_has('u', bounded(pattern) if pattern else TO_LINE)} then {weight} else 0 end" for pattern, weight in MARKERS]
    + [f"least({_hits(pattern)}, 2) * {weight}" for pattern, weight in _LAYOUT]
    + [
        rf"least(len(list_filter(ls, lambda x: (regexp_matches(x, '\d') and {_has('x', _PLACE, '(?i)')}) or {_has('x', _BOX, '(?i)')})), 3) * 4",
        "least(len(list_filter(range(1, len(ls) + 1), lambda i: v[i] >= 3 and l[i] >= 3 and 2 * l[i] >= v[i])), 6)",
    ]
)
_DAMAGE = " - ".join([
    "case when letters < 0.15 * visible then 8 when letters < 0.3 * visible then 4 else 0 end",
    "case when visible - signs > 0.35 * visible then 5 when visible - signs > 0.2 * visible then 2 else 0 end",
    "case when one > 0.4 * len(ls) then 5 when one > 0.25 * len(ls) then 2 else 0 end",
    rf"least(2 * {_hits(rf'\b(?:{UPSIDE_DOWN})\b')}, 8)",
])

#: Points of each document.
QUALITY = rf"""with b as (select doc_id, coalesce(text, '') as t from documents),
 c as (select *, upper(t) as u, list_filter(list_transform(string_split_regex(t, '{_LINE_END}'), lambda x: {strip("x")}), lambda x: x <> '') as ls from b),
 d as (select *, {_left("t", _SPACE)} as visible, {_left("t", r"\P{L}")} as letters, {_left("t", r"[^\p{L}\p{N}]")} as signs,
  list_transform(ls, lambda x: {_left("x", _SPACE)}) as v, list_transform(ls, lambda x: {_left("x", r"\P{L}")}) as l from c),
 e as (select *, len(list_filter(v, lambda n: n = 1)) as one from d)
 select doc_id, (case when len(ls) = 0 then -20 else {_POINTS} - {_DAMAGE} end)::int as score from e"""

