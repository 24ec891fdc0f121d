"""Lines of a label: cleaning, classes, and names, as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybill.functions.text import bounded, contains_any, full, has, let, letters_of, squeeze, strip, sub, title, visible_of

# The words by which label lines are told apart; so are the patterns of damage, markers and forms in the
# functions clean_street, clean_address, _delivers, _receives, _noisy, _street, _city and normal_street below.
SUFFIX = "STREET|ST|ROAD|RD|AVENUE|AVE|BOULEVARD|BLVD|DRIVE|DR|LANE|LN|COURT|CT|WAY"
FURNITURE = ("SHIP", "TO", "PREMIUM", "USPS", "USA", "PARCEL SELECT", "PRIORITY MAIL", "MEDIA MAIL", "OR CURRENT OCCUPANT")
SERVICE = "EXPECTED DELIVERY|POSTAGE|ORIGIN|MAILED FROM|TRACKING|AMAZON|FULFILLMENT|SERVICES|PRIORITY MAIL|PARCEL SELECT"
NOT_A_NAME = (
    "AMAZON|CARRIER|DELIVERY|DEPARTMENT|DEPT|DHL|FEDEX|GROUND|INSTAGRAM|LIGHTWEIGHT|MAIL|POSTAGE|PRIORITY|PROMO|QR|RETURN|SCAN|SERVICE|SERVICES|"
    "SOCIAL|SPEEDX|TRACKING|UNITED STATES|UPS|USPS|VISIT|COLLEGE|UNIVERSITY|FULFILLMENT|CURRENT OCCUPANT"
)
SERVICE_TAIL = r"CARRIER\s*[—-]\s*LEAVE IF NO RESPONSE|RETURN SERVICE REQUESTED|ADDRESS SERVICE REQUESTED|SERVICE REQUESTED"
STREET_REJECT = "CARRIER|LEAVE|RESPONSE|USPS|UPS|PARCEL|SELECT|TRACKING|POSTAGE|DELIVERED|DELIVER"
NAME_STREET = "Dr|St|Ave|Blvd|Ct|Court|Rd|Ln|Way|Pl|Ter|Cir|Lane|Road|Drive|Street|Avenue|Boulevard|Place|Circle|Terrace|Pkwy|Parkway|Hwy|Highway|Sq|Square"
NAME_ORG = (
    "Associates|Group|Corp|Inc|LLC|LLP|LP|Dept|Department|Processing|Unit|Claims|Services|Solutions|Division|Partners|Foundation|Bureau|Office|"
    "Center|Centre|Agency|Systems|Industries|Enterprises|Plan|Pension"
)
_TITLE = r"(?:MR|MRS|MS|MISS|DR)\."
_NAME_WORD = r"[A-Za-z][A-Za-z'’-]*"
COMMA_NAME = rf"(?:{_TITLE}\s+)?{_NAME_WORD},\s*{_NAME_WORD}(?:\s+[A-Za-z])?"
PLAIN_NAME = rf"(?:{_TITLE}\s+)?{_NAME_WORD}(?:\s+{_NAME_WORD}){{1,3}}"


def clean_service(line: Column) -> Column:
    cut = F.when(has(line, "RESPONSE|REQUESTED", True), sub(line, f"(?s){bounded(SERVICE_TAIL)}.*", "", True)).otherwise(line)
    return squeeze(cut)


Bind = Callable[[Column, Callable[[Column], Column]], Column]


def repeated(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` as it stands; code that is generated for a column shares what is repeated, a lambda does not and binds by ``let``."""
    return then(value)


def clean_street(line: Column, bind: Bind = repeated) -> Column:
    """Noise cut from a line that starts like an address; other lines stay as they are."""
    out = sub(line, r"\A\s*[^A-Za-z0-9]+", "")
    out = sub(out, r"\A(\d+[A-Z]?)\s*[.,:]\s+", "$1 ")
    out = sub(out, r"\A([NSEW])\s+(\d{2,4})\b", "$1$2", True)
    out = sub(out, r"\s+§\s*\z", " ST")
    starts = has(line, r"\A\s*[^A-Za-z0-9]*?(?:\d+[A-Z]?(?:-[A-Z0-9]+)?|[NSEW]\s*\d{2,4})\b", True)

    def cut(parts: Column) -> Column:
        kept, rest = parts["kept"], parts["rest"]
        detail = has(rest, r"\A(?:(?:APT|APARTMENT|UNIT|SUITE|STE|HUB)\b|P\.?\s*O\.?\s+BOX\b|#)", True)
        short = has(rest, "[A-Za-z]") & ~has(rest, "[A-Za-z]{3}")
        return F.when((kept != "") & (rest != "") & ~detail & (has(rest, r"[;|%={}~]") | short), kept).otherwise(parts["out"])

    def split(x: Column) -> Column:
        kept, rest = (F.regexp_extract(x, rf"(?is)\A(.*{bounded(SUFFIX)})(.*)\z", i) for i in (1, 2))
        return bind(F.struct(x.alias("out"), kept.alias("kept"), strip(rest).alias("rest")), cut)

    return F.when(starts, bind(out, split)).otherwise(line)


#: Signs of what cleaning repairs or cuts, in upper case.
DAMAGE = ("@", "NL", "AUB", "PRRLISLE", "IVERSITY", "RESPONSE", "REQUESTED", "  ")
#: Lines that cleaning leaves as they are, if they have none of these: plain words that start unlike an address, a number and words up to a suffix, one word.
_PLAIN = rf"(?! )(?:(?![^A-Za-z0-9]*(?:\d|[NSEWnsew] ?\d\d))[ -~]+|\d+ (?:[A-Za-z ]* )?(?i:{SUFFIX})|[0-9A-Za-z]+)(?<! )\z"
AS_IT_IS = rf"\A(?!.*(?=[@ NAPIRnapir])(?i:{'|'.join(DAMAGE)})){_PLAIN}"


def clean_address(line: Column, bind: Bind = repeated) -> Column:
    def repaired(x: Column) -> Column:
        out = sub(x, r"(?<=\d)@(?=\d)", "0")
        for damaged, right in (("1@5", "105"), ("NL", "L"), ("AUB", "HUB"), ("PRRLISLE", "CARLISLE")):
            out = sub(out, bounded(damaged), right, True)
        out = sub(out, r"(?<![A-Za-z])\\?IVERSITY\b", "UNIVERSITY", True)
        return F.when(has(x, "@|NL|AUB|PRRLISLE|IVERSITY", True), out).otherwise(x)  # few lines have any of these

    cleaned = lambda x: squeeze(bind(bind(clean_service(x), lambda y: clean_street(y, bind)), repaired))
    return bind(F.coalesce(line, F.lit("")), lambda x: F.when(has(x, AS_IT_IS), x).otherwise(cleaned(x)))


def clean_lines(lines: Column) -> Column:
    """All lines of a label cleaned; damage is looked for once in all of them."""
    def each(damaged: Column) -> Column:
        return F.transform(lines, lambda x: F.when(~damaged & has(x, rf"\A{_PLAIN}"), x).otherwise(clean_address(x, let)))

    return let(contains_any(F.upper(F.array_join(lines, "\n")), DAMAGE), each)


def clean_name(line: Column) -> Column:
    out = squeeze(sub(F.coalesce(line, F.lit("")), r"\A\s*(?:TO|SHIP)\s*:?\s*", "", True))
    return sub(out, r"\A[ |]+|[ |]+\z", "")


def _delivers(upper: Column) -> Column:
    marked = lambda letters: has(letters, bounded(r"DELIVER\s+TO")) | has(letters, bounded(r"VER\s+TO")) | has(letters, bounded(r"USPS\b.*\bTO"))
    # Each of these has a TO that stands apart from other plain letters.
    return F.contains(upper, F.lit("TO")) & has(upper, "(?<![A-Z])TO(?![A-Z])") & let(squeeze(sub(upper, r"[^A-Z\s]+", " ")), marked)


def deliver_to(line: Column) -> Column:
    """A marker that the recipient's block follows."""
    return delivers(clean_address(line))


def delivers(clean: Column) -> Column:
    """The same of a clean line."""
    return let(F.upper(clean), _delivers)


def _receives(upper: Column) -> Column:
    return full(upper, r"\s*(?:TO|SHIP\s+TO)\s*:?[\s|]*")


def recipient_marker(line: Column) -> Column:
    return deliver_to(line) | _receives(F.upper(clean_address(line)))


def _noisy(text: Column) -> Column:
    return (
        (F.length(text) <= 2)
        | text.isin(*FURNITURE)
        | (has(text, r"\d") & (has(text, bounded(r"[A-Z]{2}\s+\d{5}(?:-\d{4})?")) | has(text, bounded(r"HUB\s*#?\s*\d+")) | has(text, bounded("STREET|ST|ROAD|RD|AVE|AVENUE|BLVD|DR|LANE|LN|WAY"))))
        | has(text, bounded(SERVICE))
        | (F.contains(text, F.lit("DICKINSON")) & has(text, bounded(r"DICKINSON\s*COLLEGE")))
        | full(text, r"[\d\s./#-]+")
        | full(text, r"[|.=_\-— ]+")
    )


def noise(line: Column) -> Column:
    """Lines that are never a recipient: furniture, services, places, numbers, scraps."""
    return let(F.upper(clean_name(line)), _noisy)


def _street(text: Column) -> Column:
    return has(text, r"\d") & has(text, bounded(rf"{SUFFIX}|BUILDING|BLDG|CENTER|HUB|P\.?\s*O\.?\s+BOX"))


def street_line(line: Column) -> Column:
    return _street(F.upper(clean_address(line)))


def _city(text: Column) -> Column:
    return has(text, r"\d{5}") & (has(text, bounded(r"[A-Z]{2}\s+\d{5}(?:-\d{4})?")) | has(text, bounded(r"ZIP\s*\d{5}")))


def city_line(line: Column) -> Column:
    return _city(F.upper(clean_address(line)))


def features(line: Column) -> Column:
    """What parsers ask of a line, each thing once: a struct, for use in a lambda over lines."""
    cleaned = F.struct(clean_address(line, let).alias("clean"), clean_name(line).alias("name"))
    # A clean name changes by being cleaned again only where it begins like a marker.
    again = lambda name, n: F.when(n.startswith("TO") | n.startswith("SHIP"), F.upper(clean_name(name))).otherwise(n)
    loud = lambda a: F.struct(a["clean"].alias("clean"), a["name"].alias("name"), F.upper(a["clean"]).alias("u"), let(F.upper(a["name"]), lambda n: again(a["name"], n)).alias("n"))

    def asked(b: Column) -> Column:
        return F.struct(
            b["clean"].alias("clean"), b["name"].alias("name"), _delivers(b["u"]).alias("marker"), _receives(b["u"]).alias("receives"),
            _street(b["u"]).alias("street"), _city(b["u"]).alias("city"), _noisy(b["n"]).alias("noise"), comma_name(b["name"]).alias("comma"),
        )

    return let(let(cleaned, loud), asked)


def recipient(line: Column) -> Column:
    """A line as a name, and whether it is noise: a struct, for use in a lambda over lines."""
    return let(clean_name(line), lambda name: F.struct(name.alias("name"), noise(name).alias("noise")))


def comma_name(name: Column) -> Column:
    return F.contains(name, F.lit(",")) & full(name, COMMA_NAME, True)


def person_name(line: Column) -> Column:
    """A clean name: not noise, without digits, mostly letters, in the form of a name."""
    return let(clean_name(line), lambda name: ~noise(name) & ~has(name, r"\d") & (letters_of(name) >= 0.75 * visible_of(name)) & (comma_name(name) | full(name, PLAIN_NAME, True)))


def normal_street(street: Column, bind: Bind = repeated) -> Column:
    out = sub(clean_address(strip(street), bind), r"\b(?:BE|8T|5T)\z", "ST", True)

    def ended(x: Column) -> Column:
        end = F.regexp_extract(x, r"(?i)\b(st|rd|ave|blvd|dr|ln|ct)\z", 1)
        return F.when(end != "", F.concat(F.left(x, F.length(x) - F.length(end)), F.upper(end))).otherwise(x)

    return bind(out, ended)


def rejects(normal: Column) -> Column:
    """Whether a street in normal form is one of a service line's."""
    return has(normal, bounded(STREET_REJECT), True)


def street_rejected(street: Column) -> Column:
    return rejects(normal_street(street))


def normal_name(name: Column) -> Column:
    return title(squeeze(name))


def normal_city(city: Column, bind: Bind = repeated) -> Column:
    return title(clean_address(strip(city), bind))


def normal_number(number: Column) -> Column:
    out = F.replace(strip(number), F.lit(" "), F.lit(""))
    return F.when(out.startswith("1LSDO"), F.replace(out, F.lit("O"), F.lit("0"))).otherwise(out)


def name_flags(name: Column) -> dict[str, Column]:
    """Signs that a value is no person's name."""
    known = name != ""
    return {
        "name_looks_like_street": known & has(name, bounded(NAME_STREET), True),
        "name_is_sender_artifact": known & has(name, bounded("SENDER"), True),
        "name_single_word": known & ~has(name, r"\s") & (F.length(name) > 3),
        "name_looks_like_org": known & has(name, bounded(NAME_ORG), True),
    }
