"""Tracking numbers: carriers, check digits, cleaning and search in lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybill.functions.text import bounded, first_of, full, has, let

# Look-alike letters of digits; prefixes of the carriers.
LETTERS, DIGITS = "OILSBG", "011586"
USPS_PREFIX = r"(?:9[1-5]|56)"
UPS_FORM = r"1Z[A-Z0-9]{16}"
DIGIT_RUN = r"(?i)(?:[0-9OILSBG][\s_\-]*){18,34}"
SCAN_RUN = r"(?i)(?:[0-9OILSBG][\s_\-]*){22}"  # the least of a USPS number
OPEN_PREFIXES = ("TBA", "YWNJC", "UUS", "DDIYS", "1LSD")
#: What every number begins with or is made of, once it is clean.
NUMBER_START = rf"\A(?:{'|'.join(OPEN_PREFIXES)}|1Z|[0-9{LETTERS}]+\z)"
CARRIER_OF_PREFIX = {"SPX": "SpeedX", "TBA": "Amazon", "YWNJC": "YunExpress", "UUS": "UniUni", "DDIYS": "TikTok", "1LSD": "TikTok"}


def carrier_of(number: Column) -> Column:
    return let(F.upper(F.coalesce(number, F.lit(""))), _carrier_of)


def _carrier_of(upper: Column) -> Column:
    found = F.when(full(upper, r"\d{12}|\d{15}|\d{20}|\d{22}|" + USPS_PREFIX + r"\d{18,}"), F.when(full(upper, USPS_PREFIX + r"\d{18,}"), "USPS").otherwise("FEDEX"))
    for prefix, carrier in CARRIER_OF_PREFIX.items():
        found = found.when(upper.startswith(prefix), carrier)
    return found.when(full(upper, UPS_FORM), "UPS").otherwise("Unknown")


def carrier_in_context(number: Column, text: Column) -> Column:
    """The carrier, corrected and completed by what the label says."""
    seen = F.struct(F.upper(F.coalesce(text, F.lit(""))).alias("upper"), carrier_of(number).alias("own"))
    return let(seen, lambda x: _in_context(x["upper"], x["own"]))


def _in_context(upper: Column, own: Column) -> Column:
    final_mile = has(upper, bounded(r"SUREPOST|GROUND\s+SAVER"))
    ups_number = has(upper, bounded(r"1Z(?:[\s_-]*[A-Z0-9]){16}"))
    ups_line = has(upper, r"(?:\A|\n)\s*UPS\s*(?:\n|\z)")
    usps = has(upper, bounded("USPS")) | has(upper, bounded(r"U\.?\s*S\.?\s+POSTAGE\s+PAID"))
    fedex = has(upper, bounded(r"FED\s*EX"))
    return (
        F.when((own == "USPS") & final_mile & ups_number & ups_line, "UPS")
        .when((own == "FEDEX") & usps & ~fedex, "USPS")
        .when(own != "Unknown", own)
        .when(has(upper, bounded(r"SPEEDX|SPX[A-Z0-9]*")), "SpeedX")
        .when(usps, "USPS")
        .when(has(upper, bounded("UPS")) & ups_number, "UPS")
        .when(fedex, "FEDEX")
        .otherwise(own)
    )


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _weighted(values: Column, even: int, odd: int) -> Column:
    parts = F.transform(values, lambda v, i: v * F.when(i % 2 == 0, even).otherwise(odd))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def usps_checksum(number: Column) -> Column:
    """Mod-10 test with weights 3, 1 from the right; null for other forms."""
    body = F.transform(F.reverse(_characters(F.regexp_replace(number, r"\d\z", ""))), lambda c: F.ascii(c) - 48)  # a digit, where the form fits
    total = _weighted(body, 3, 1)
    return F.when(full(number, r"9\d{19,21}"), (10 - total % 10) % 10 == F.right(number, F.lit(1)).cast("int"))


def ups_check_digit(number: Column) -> Column:
    """Whether the number has the 1Z form and its last character is the right check digit."""
    value = lambda c: let(F.ascii(c), lambda a: F.when(a.between(48, 57), a - 48).otherwise((a - 63) % 10))
    total = _weighted(F.transform(_characters(F.substring(number, 3, 15)), value), 1, 2)
    last = F.when(full(F.right(number, F.lit(1)), r"\d"), F.ascii(F.right(number, F.lit(1))) - 48)
    return F.coalesce(full(number, UPS_FORM) & ((10 - total % 10) % 10 == last), F.lit(False))


def ups_checksum(number: Column) -> Column:
    return F.when(full(number, UPS_FORM), ups_check_digit(number))


def checksum(number: Column, carrier: Column) -> Column:
    """True, false, or null where the carrier or form has no check digit."""
    return F.when(carrier == "USPS", usps_checksum(number)).when(carrier == "UPS", ups_checksum(number))


def clean(candidate: Column) -> Column:
    text = F.regexp_replace(F.upper(F.coalesce(candidate, F.lit(""))), "[^A-Z0-9]+", "")
    opened = lambda x, read, right: F.when(x.startswith(read), F.concat(F.lit(right), F.substring(x, len(read) + 1, 1_000_000_000)))
    return let(text, lambda x: F.coalesce(opened(x, "1BA", "TBA"), opened(x, "1LSDO", "1LSD0"), x))


def clean_ups(candidate: Column) -> Column:
    """Look-alike letters read as digits, if that makes the check digit right."""
    return let(clean(candidate), _repaired_ups)


def _repaired_ups(text: Column) -> Column:
    fixed = F.concat(F.substring(text, 1, 2), F.translate(F.substring(text, 3, 1_000), LETTERS, DIGITS))
    return F.when(full(text, UPS_FORM) & ~ups_check_digit(text), let(fixed, lambda x: F.when(ups_check_digit(x), x).otherwise(text))).otherwise(text)


def clean_usps(candidate: Column) -> Column:
    return let(clean(candidate), _repaired_usps)


def _repaired_usps(text: Column) -> Column:
    return let(F.translate(text, LETTERS, DIGITS), lambda fixed: F.when(full(fixed, USPS_PREFIX + r"\d*"), fixed).otherwise(text))


def valid(candidate: Column) -> Column:
    """Whether the cleaned candidate is a tracking number that can be extracted."""
    return let(clean(candidate), _valid)


def _valid(text: Column) -> Column:
    """The same of a clean candidate; what begins like an address on the web has none of these beginnings and forms."""
    return (F.length(text) >= 12) & has(text, rf"\A(?:{'|'.join(OPEN_PREFIXES)}|(?:{UPS_FORM}|{USPS_PREFIX}\d{{18,}}|\d{{12}}|\d{{15}}|\d{{20}}|\d{{22}})\z)")


def valid_usps(candidate: Column) -> Column:
    return full(clean(candidate), USPS_PREFIX + r"\d{18,}")


def valid_usps_scan(candidate: Column) -> Column:
    return _valid_usps_scan(clean(candidate))


def _valid_usps_scan(text: Column) -> Column:
    return full(text, USPS_PREFIX + r"(?:\d{20}|\d{24}|\d{32})")


def usps_candidates(text: Column) -> Column:
    """USPS numbers among the digit runs of a text, in order."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DIGIT_RUN), F.lit(0)), clean_usps)
    return F.filter(found, _valid_usps_scan)  # clean already


def tracking_in_lines(lines: Column) -> Column:
    """The first tracking number by three passes: USPS headings, tracking headings, whole lines; else empty."""
    headings = F.filter(F.transform(lines, lambda x, i: F.when(F.upper(x).contains("TRACKING"), i)), lambda i: i.isNotNull())
    not_fedex = lambda c: _valid(c) & (carrier_of(c) != "FEDEX")
    some = lambda found: F.filter(found, lambda x: x.isNotNull())

    def usps_heading(i: Column) -> Column:
        """The first number in a line of the next five, else in the heading and what follows it, one line more at a time."""
        near = F.slice(lines, i + 2, 5)
        candidate = lambda x: F.when(F.length(x) >= 22, first_of(usps_candidates(x)))
        alone = some(F.transform(near, candidate))
        grown = some(F.transform(near, lambda _, k: let(F.array_join(F.slice(lines, i + 1, k + 2), " "), candidate)))
        there = F.upper(F.get(lines, i)).contains("USPS") & has(F.array_join(F.slice(lines, i + 1, 6), " "), SCAN_RUN)
        return F.when(there, F.coalesce(first_of(alone), first_of(grown)))

    def heading(i: Column) -> Column:
        return let(F.array_join(F.slice(lines, i + 1, 3), " "), near_heading)

    def near_heading(text: Column) -> Column:
        ups = let(F.regexp_extract(text, r"(?i)1Z(?:[\s_-]*[A-Z0-9]){16}", 0), lambda x: F.when(x != "", let(clean_ups(x), lambda c: F.when(_valid(c), c))))
        runs = F.transform(F.regexp_extract_all(text, F.lit(DIGIT_RUN), F.lit(0)), clean_usps)
        return F.coalesce(ups, first_of(F.filter(runs, not_fedex)))

    repaired = lambda x: F.when(x.startswith("1Z"), _repaired_ups(x)).otherwise(_repaired_usps(x))
    whole = lambda x: F.when(has(x, NUMBER_START), let(repaired(x), lambda c: F.when(not_fedex(c), c)))
    alone = some(F.transform(lines, lambda x: F.when(F.octet_length(x) >= 12, let(clean(x), whole))))  # shorter ones are no number
    return let(headings, lambda at: F.coalesce(*[first_of(some(F.transform(at, f))) for f in (usps_heading, heading)], first_of(alone), F.lit("")))


def from_barcodes(raw: Column) -> Column:
    """The tracking number among decoded barcodes: a valid one, else the last 12 of a code of more than 22 digits."""
    codes = F.array_distinct(F.filter(F.coalesce(raw, F.array().cast("array<string>")), lambda x: x.isNotNull()))

    def candidates(code: Column) -> Column:
        parts = F.split(code, "\x1d")
        text = clean(F.coalesce(F.get(parts, 1), code))
        tail = let(F.regexp_replace(code, r"\D", ""), lambda d: F.when(F.length(d) > 22, F.right(d, F.lit(12))))
        ending = let(tail, lambda t: F.when(t.isNotNull() & _valid(t), F.array(t)).otherwise(F.array().cast("array<string>")))
        return let(text, lambda t: F.when(_valid(t), F.array(t)).otherwise(ending))

    return F.coalesce(first_of(F.flatten(F.transform(codes, candidates))), F.lit(""))


def arbitrate(barcode: Column, ocr: Column, rule: Column, lines: Column) -> tuple[Column, Column]:
    """The tracking number and its source: the barcode's, unless the text has a better one."""
    upper = F.upper(F.array_join(lines, "\n"))
    usps_line = F.exists(lines, lambda x: F.upper(x).contains("USPS") & F.upper(x).contains("TRACKING"))

    def better(carrier: Column) -> Column:
        trusted = (carrier == "USPS") & (carrier_of(ocr) == "UPS") & usps_line
        return ((barcode == "") | (carrier == "Unknown") | upper.contains("TRACKING")) & ~trusted

    replaced = (ocr != "") & let(carrier_of(barcode), better)
    number = F.when(replaced, ocr).when(barcode != "", barcode).otherwise(F.coalesce(rule, F.lit("")))
    return number, let(number, lambda n: origin(n, barcode, ocr))


def origin(number: Column, barcode: Column, ocr: Column) -> Column:
    """Where an arbitrated number is from."""
    return F.when(number == "", "blank").when((barcode != "") & (number == barcode), "barcode").when((ocr != "") & (number == ocr), "ocr").otherwise("rule")
