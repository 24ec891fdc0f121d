"""When a value counts as correct: normal forms and comparisons for each field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybill.functions.text import blank, bounded, extract_all, has, let, squeeze, strip, sub

# Typographic quotes and dashes, and what they stand for.
QUOTES = "‘’“”‐‑‒–—−"
PLAIN = "''\"\"------"
# The street words that have a short form.
SHORT = {"STREET": "ST", "AVENUE": "AVE", "ROAD": "RD", "BUILDING": "BLDG"}
SENDER = ("BILL SENDER", "RETURN ADDRESS", "SHIP FROM", "SENDER ADDRESS")


def normal(value: Column) -> Column:
    plain = strip(F.upper(F.translate(F.coalesce(value, F.lit("")), QUOTES, PLAIN)))
    plain = F.replace(F.replace(plain, F.lit("."), F.lit("")), F.lit(","), F.lit(" "))
    return squeeze(sub(plain, r"\s*-\s*", "-"))


def alphanumeric(value: Column) -> Column:
    return sub(normal(value), "[^A-Z0-9]", "")


def street(value: Column) -> Column:
    """From the first house number on, without hubs, boxes, the campus and departments; empty without a number."""
    return _street(normal(value))


def _street(out: Column) -> Column:
    for word, short in SHORT.items():
        out = sub(out, bounded(word), short)
    for part in (r"HUB(?:\s+BOX)?\s*#?\s*\d+", r"PO\s+BOX\s+\d+", r"DICKINSON\s+COLLEGE"):
        out = sub(out, bounded(part), " ")
    out = squeeze(sub(out, bounded(r"(?:DEPT|DEPARTMENT)(?:\s+OF)?") + ".*$", " "))
    return F.regexp_extract(out, r"(?s)(?<![A-Z0-9])((?:\d+[A-Z]*(?:-[A-Z0-9]+)?|[A-Z]\d+[A-Z0-9-]*)(?=\s|\z).*)", 1)


def name_tokens(value: Column) -> Column:
    """Words of a name in the order first to last; one comma means that the last name came first."""
    text = F.replace(strip(F.upper(F.translate(F.coalesce(value, F.lit("")), QUOTES, PLAIN))), F.lit("."), F.lit(" "))
    swapped = lambda x: (F.size(x) == 2) & ~blank(F.get(x, 0)) & ~blank(F.get(x, 1))
    ordered = let(F.split(text, ","), lambda x: F.when(swapped(x), F.concat(F.get(x, 1), F.lit(" "), F.get(x, 0))).otherwise(F.array_join(x, ",")))
    return extract_all(ordered, r"[A-Z0-9]+(?:['-][A-Z0-9]+)*")


def same_street(actual: Column, expected: Column) -> Column:
    def judged(x: Column) -> Column:
        sender = F.exists(F.array(*[F.lit(m) for m in SENDER]), lambda m: F.contains(x["mine"], m) & ~F.contains(x["truth"], m))
        streets = F.struct(_street(x["mine"]).alias("a"), _street(x["truth"]).alias("e"))
        return ~sender & let(streets, lambda s: (s["a"] != "") & (s["a"] == s["e"]))

    return let(F.struct(normal(actual).alias("mine"), normal(expected).alias("truth")), judged)


def same_name(actual: Column, expected: Column) -> Column:
    return let(F.struct(name_tokens(actual).alias("a"), name_tokens(expected).alias("e")), lambda x: _same_tokens(x["a"], x["e"]))


def _same_tokens(a: Column, e: Column) -> Column:
    first, last = (lambda x: F.get(x, 0)), (lambda x: F.get(x, F.size(x) - 1))
    inner = lambda x: F.slice(x, 2, F.greatest(F.size(x) - 2, F.lit(0)))
    joined = lambda one, many: (first(one) == F.concat(first(many), last(many))) | (first(one) == F.concat(last(many), first(many)))
    covered = F.forall(inner(e), lambda x: F.exists(inner(a), lambda y: (y == x) | ((F.length(x) == 1) & F.startswith(y, x))))
    many_a, many_e = F.size(a) >= 2, F.size(e) >= 2
    test = (
        F.when((F.size(a) == 0) | (F.size(e) == 0), False)
        .when(a == e, True)
        .when(~many_a & many_e, joined(a, e))
        .when(many_a & ~many_e, joined(e, a))
        .when(~many_a, False)
        .otherwise((first(a) == first(e)) & (last(a) == last(e)) & covered)
    )
    return F.coalesce(test, F.lit(False))


def same_zip(actual: Column, expected: Column) -> Column:
    a, e = (F.regexp_replace(F.coalesce(x, F.lit("")), r"\D", "") for x in (actual, expected))
    return (a != "") & (a == e)


def same_tracking(actual: Column, expected: Column) -> Column:
    a, e = alphanumeric(actual), alphanumeric(expected)
    return (a != "") & (a == e)


def same(field: Column, actual: Column, expected: Column) -> Column:
    """The comparison that belongs to ``field``."""
    return (
        F.when(field == "recipient_name", same_name(actual, expected))
        .when(field == "street_address", same_street(actual, expected))
        .when(field == "zip_code", same_zip(actual, expected))
        .when(field == "tracking_number", same_tracking(actual, expected))
        .otherwise(normal(actual) == normal(expected))
    )


def same_strict(actual: Column, expected: Column) -> Column:
    a, e = (F.lower(strip(F.coalesce(x, F.lit("")))) for x in (actual, expected))
    return a == e


def scorable(field: Column, expected: Column) -> Column:
    """Whether there is a truth to compare with; a street needs a house number."""
    return ~blank(expected) & ((field != "street_address") | (street(expected) != ""))


def plausible_name(value: Column) -> Column:
    """Two words or more and no digit."""
    text = F.coalesce(value, F.lit(""))
    return ~has(text, r"\p{Nd}") & has(text, r"\S\s+\S")
