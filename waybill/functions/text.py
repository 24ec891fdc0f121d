"""Text primitives with the meaning they have for Unicode text, as Column functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space and line ends of Unicode text; Java's own classes are narrower.  The first part passes over plain characters by one comparison.
SPACE = r"[\x00- \x7f-\uffff&&[\s\x1c-\x1f\x85\xa0  -     　]]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
WORD = r"[\p{L}\p{N}_]"
#: What is no white space, and what is no line end; again plain characters are passed over by one comparison.
VISIBLE = r"[!-~[^ \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
IN_LINE = r"[ -~[^\n\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029]]"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once a row, however often it is named; Catalyst repeats it otherwise.

    The value is what an aggregate over no elements starts from and ends with: unlike an element of an array it is neither copied nor typed again.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, then)


def staged(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` with the columns, each computed once a row: Catalyst copies no expression across a generator.

    They stand in a lambda over one element: code that is generated for a whole stage is one method,
    and beyond 8,000 bytes the JVM never compiles it; what a lambda holds runs as compiled pieces of any number.
    """
    struct = F.struct(*[c.alias(name) for name, c in columns.items()])
    return rows.select(*[c for c in rows.columns if c not in columns], F.inline(F.transform(F.array(F.lit(0)), lambda _: struct)))


def first_of(array: Column) -> Column:
    """The first element or null; the array is bound, as its type would else be put together again at every call."""
    return let(array, lambda a: F.get(a, 0))


def together(rows: DataFrame, struct: Column, names: Sequence[str]) -> DataFrame:
    """``rows`` with the fields ``names`` of a struct, which is computed once a row, as ``staged`` does for columns apart."""
    return rows.select(*[c for c in rows.columns if c not in names], F.inline(F.array(struct)))


def bounded(pattern: str) -> str:
    """The pattern between word boundaries of Unicode text; it must start and end with word characters."""
    return rf"(?<!{WORD})(?:{pattern})(?!{WORD})"


def has(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(("(?iu)" if ignore_case else "") + pattern)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether one of the words is in the text; bound, as it stands for many tests."""
    return let(text, lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words]))


def full(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether the whole text matches; ``$`` alone would accept a last line end."""
    return text.rlike(("(?iu)" if ignore_case else "") + rf"\A(?:{pattern})\z")


def sub(text: Column, pattern: str, by: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(text, ("(?iu)" if ignore_case else "") + pattern, by)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def lines(text: Column) -> Column:
    """Non-blank lines, stripped, in order."""
    return extract_all(F.coalesce(text, F.lit("")), rf"{VISIBLE}(?:{IN_LINE}*{VISIBLE})?")


def words(text: Column) -> Column:
    return extract_all(F.coalesce(text, F.lit("")), f"{VISIBLE}+")


def title(text: Column) -> Column:
    """Every run of letters with a capital first; ``initcap`` only looks at blanks."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.concat_ws("", F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))))


def digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")


def letters_of(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}", ""))


def visible_of(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, ""))


def extract_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
