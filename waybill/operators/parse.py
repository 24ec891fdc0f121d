"""Recipient and address from a label's lines.

Every parser proposes, for each line, what it would write there; the proposals of
a label are one ordered array, and the rules by which later writers replace
earlier ones select from it.  All of it is expressions over one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions import lines as L
from waybill.functions.text import bounded, contains_any, first_of, full, has, let, letters_of, squeeze, sub, together, visible_of, words

# Names of the parsers.  The patterns of places, streets and blocks in the functions below are fixed values too.
PARSERS = ("uniuni_deliver_to", "deliver_to", "city_first_to_address", "zip_first_spaced", "zip_first_combined", "city_state_country_zip", "college_mailroom_parser", "generic_city_state_zip")
ADDRESS = ("recipient_name", "street_address", "city", "state", "zip_code")
# Words of a mailroom's address block.
MAILROOM = "COLLEGE|HUB|UNIVERSITY|PENN STATER|ALUMNI CENTER"
CAMPUSES = ("CARLISLE", "UNIVERSITY PARK")
# Parts of these words, one of which stands in a line of every label with such a block.
MAILROOM_SIGNS = ("COLLEGE", "HUB", "UNIVERSITY", "STATER", "ALUMNI", "CARLISLE")
DASH = r"\s*[-–—]\s*"
_CITY_LINE = r"([A-Za-z][A-Za-z .'-]*?),?\s+([A-Z]{2})\s+(\d{5}(?:\s*[-–—]\s*\d{4})?)"


def _at(array: Column, i: Column) -> Column:
    """Element ``i`` from 0, or null outside."""
    return F.when(i >= 0, F.get(array, i))


def _group(text: Column, pattern: str, n: int, ignore_case: bool = False) -> Column:
    return F.regexp_extract(text, ("(?i)" if ignore_case else "") + rf"\A(?:{pattern})\z", n)


def _bare(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(",")), sub(text, r"\A,+|,+\z", "")).otherwise(text)


def _propose(i: Column, rank: int, test: Column, name: Column | None, street: Column, city: Column, state: Column, zip_code: Column) -> Column:
    fields = [i.cast("int").alias("at"), F.lit(rank).alias("rank"), F.lit(PARSERS[rank - 1]).alias("parser"), (F.lit(None).cast("string") if name is None else name).alias("recipient_name"), street.alias("street_address"), city.alias("city"), state.alias("state"), zip_code.alias("zip_code")]
    return F.when(F.coalesce(test, F.lit(False)), F.struct(*fields))


def _join_zip(text: Column) -> Column:
    return sub(text, DASH, "-")


def _deliver_blocks(c: dict[str, Column], i: Column) -> list[Column]:
    """The blocks below a marker."""
    lines, clean = c["lines"], c["clean"]
    place, street, code = (_at(lines, i + k) for k in (2, 3, 4))
    pattern = r"([A-Za-z]+),?\s+([A-Z]{2}),?"
    first = _propose(
        i, 1, ~F.upper(_at(lines, i)).contains("USPS") & (i + 4 < F.size(lines)) & has(place, pattern) & has(street, r"\A\d") & has(code, r"\d{5}"),
        None, street, F.regexp_extract(place, pattern, 1), F.regexp_extract(place, pattern, 2), F.regexp_extract(code, r"\d{5}", 0),
    )

    def named(parts: Column) -> Column:
        last, before = _at(parts, F.size(parts) - 1), _at(parts, F.size(parts) - 2)
        shipped = F.filter(F.transform(F.slice(lines, F.greatest(i - 7, F.lit(1)), F.least(i, F.lit(8))), lambda x: F.regexp_extract(x, "(?i)" + bounded(r"SHIP\s+USPS\s+(\d{5})"), 1)), lambda x: x != "")
        own = F.struct(before.alias("state"), last.alias("code"))
        return let(F.when(full(before, "[A-Z]{2}") & full(last, r"\d{5}"), own).otherwise(F.struct(last.alias("state"), first_of(shipped).alias("code"))), lambda x: placed(parts, x["state"], x["code"]))

    def placed(parts: Column, state: Column, code: Column) -> Column:
        city = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - F.when(_at(parts, F.size(parts) - 1) == code, 2).otherwise(1), F.lit(0))), " ")
        return _propose(
            i, 2, (F.size(parts) >= 2) & full(state, "[A-Z]{2}") & full(code, r"\d{5}"),
            L.clean_name(_at(lines, i + 1)), _at(clean, i + 2), _bare(city), state, code,
        )

    second = F.when(i + 3 < F.size(lines), let(F.filter(F.transform(words(_at(clean, i + 3)), _bare), lambda x: x != ""), named))
    return [first, second]


def _line_blocks(c: dict[str, Column], i: Column, parts: Column) -> list[Column]:
    """``parts`` are the words of the line."""
    lines, clean = c["lines"], c["clean"]
    line = _at(lines, i)
    tracking = bounded(r"(?:USPS\s+)?TRACKING")
    # City first: the street follows a TO line, which must come before any tracking line.
    near = F.slice(lines, i + 2, 11)
    stop = F.coalesce(F.get(F.filter(F.transform(near, lambda x, k: F.when(has(x, tracking, True), k)), lambda k: k.isNotNull()), 0), F.lit(99))
    street_at = lambda k: _at(clean, i + 2 + k)
    good = lambda x: has(x, r"\d") & ~has(x, tracking, True)
    hits = F.filter(F.transform(near, lambda x, k: F.when((k < stop) & has(x, r"\A\s*TO\b", True) & good(street_at(k)), street_at(k))), lambda x: x.isNotNull())
    own = _at(clean, i)
    city_first = _propose(i, 3, (i == 0) & full(own, _CITY_LINE) & (F.size(hits) > 0), F.lit(""), F.get(hits, 0), _bare(_group(own, _CITY_LINE, 1)), _group(own, _CITY_LINE, 2), _join_zip(_group(own, _CITY_LINE, 3)))

    p = [F.coalesce(F.get(parts, k), F.lit("")) for k in range(6)]
    spaced = _propose(i, 4, (F.size(parts) >= 6) & full(p[0], r"\d{5}") & full(p[2], r"\d{4}") & full(p[5], "[A-Z]{2}") & (i >= 3), _at(lines, i - 3), _at(lines, i - 1), p[3], p[5], F.concat(p[0], F.lit("-"), p[2]))
    combined = _propose(i, 5, (F.size(parts) >= 4) & full(p[0], r"\d{5}[-–—]\d{4}") & full(p[3], "[A-Z]{2}") & (i >= 2), _at(lines, i - 2), _at(lines, i - 1), p[1], p[3], sub(p[0], "[–—]", "-"))
    country = r"(.+?),\s*([A-Z]{2}),\s*(?:US|USA),?\s*(\d{5})"
    abroad = _propose(i, 6, (i >= 2) & line.contains(",") & full(line, country, True), _at(lines, i - 2), _at(lines, i - 1), F.trim(_group(line, country, 1, True)), F.upper(_group(line, country, 2, True)), _group(line, country, 3, True))
    return [city_first, spaced, combined, abroad]


def _recipient_above(lines: Column, start: Column, least: Column) -> Column:
    """The first line upwards that is no noise; above an organisation, a person if there is one."""
    up = F.when(start >= least, F.sequence(start, least)).otherwise(F.array().cast("array<int>"))
    names = F.filter(F.transform(up, lambda k: L.recipient(F.get(lines, k))), lambda x: ~x["noise"])
    return let(names, _addressee)


def _addressee(names: Column) -> Column:
    first = F.get(names, 0)
    org = has(first["name"], bounded("ALUMNI ASSOCIATIO|DEPT OF|DEPARTMENT OF|CURRENT OCCUPANT"), True)
    people = F.filter(F.slice(names, 2, 100), lambda x: ~has(x["name"], r"\d") & ~has(x["name"], bounded("MAILED FROM|POSTAGE|SERVICE|REQUESTED"), True))
    return F.coalesce(F.when(org, F.get(people, 0)["name"]), first["name"], F.lit(""))


def _mailroom_block(c: dict[str, Column], i: Column) -> Column:
    lines, line = c["lines"], _at(c["lines"], i)
    pattern = _CITY_LINE + r"(?:\s+UNITED STATES)?\W*"
    city = _bare(F.trim(_group(line, pattern, 1)))
    above = F.upper(F.array_join(F.slice(lines, 1, i), " "))
    end = i - F.when(full(_at(lines, i - 1), r"\d{2,5}"), 2).otherwise(1)
    inside = lambda x: has(F.upper(x), MAILROOM) | has(F.upper(x), bounded(r"P\.?\s*O\.?\s+BOX"))
    outside = F.filter(F.when(end >= 1, F.sequence(F.lit(0), end - 1)).otherwise(F.array().cast("array<int>")), lambda k: ~inside(F.get(lines, k)))
    start = F.coalesce(F.get(F.reverse(outside), 0) + 1, F.lit(0))
    block = F.slice(lines, start + 1, F.greatest(end - start + 1, F.lit(0)))
    ship = r"\s*SHIP\s+(.+?)\s+(HUB\b.*)"
    head = F.coalesce(F.get(block, 0), F.lit(""))
    shipped, rest = full(head, ship, True), F.slice(block, 2, F.greatest(F.size(block) - 1, F.lit(0)))
    dropped = shipped & F.exists(rest, lambda x: has(x, bounded(r"DICKINSON\s+COLLEGE\b.*\bN\s+COLLEGE"), True))
    address = F.when(dropped, F.filter(rest, lambda x: ~full(x, r"\s*TO\s*:\s*ST\s*", True))).when(shipped, F.concat(F.array(_group(head, ship, 2, True)), rest)).otherwise(block)

    def cleaned(x: Column) -> Column:
        x = sub(x, r"\A\s*(?:TO|SHIP)\s*:\s*", "", True)
        x = sub(x, r"\A\s*IP\s+UB\b", "HUB", True)
        return L.clean_address(sub(x, r"\A(\d+)\s*N,\s+", "$1 N. ", True), let)

    name = F.when(shipped, F.trim(_group(head, ship, 1, True))).otherwise(_recipient_above(lines, start - 1, F.greatest(start - 4, F.lit(0))))
    name = L.clean_name(name)
    street = F.array_join(F.filter(F.transform(address, cleaned), lambda x: x != ""), " ")
    known = F.upper(city).isin(*CAMPUSES) | has(above, MAILROOM)
    return _propose(i, 7, (i >= 2) & has(line, r"\d{5}") & full(line, pattern) & known, F.when(L.noise(name), F.lit("")).otherwise(name), street, city, _group(line, pattern, 2), _join_zip(_group(line, pattern, 3)))


def _generic_block(c: dict[str, Column], i: Column, parts: Column) -> Column:
    lines = c["lines"]
    zip_form = r"(\d{5})[-–—]?(\d{4})?"
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda k: (F.length(F.get(parts, k)) == 2) & full(F.get(parts, k), "[A-Z]{2}") & full(F.coalesce(F.get(parts, k + 1), F.lit("")), zip_form))

    def found(k: Column) -> Column:
        code = _at(parts, k + 1)
        apart = lambda plus: F.when((plus == "") & full(F.get(parts, k + 2), "[-–—]") & full(F.get(parts, k + 3), r"\d{4}"), F.get(parts, k + 3)).otherwise(plus)
        plus = let(_group(code, zip_form, 2), lambda plus: F.coalesce(apart(plus), plus))
        city = _bare(F.array_join(F.filter(F.slice(parts, 1, k), lambda x: has(x, r"[\p{L}\p{N}]")), " "))
        around = F.struct(squeeze(_at(lines, i - 1)).alias("street"), _at(lines, i - 2).alias("name"), _group(code, zip_form, 1).alias("base"), plus.alias("plus"))
        return F.when(k.isNotNull(), let(around, lambda x: placed(k, x["base"], x["plus"], city, x["street"], x["name"])))

    def placed(k: Column, base: Column, plus: Column, city: Column, street: Column, name: Column) -> Column:
        house = F.regexp_extract(street, r"(?s)(?:\A|(?<= ))\d+(?= |\z).*", 0)  # from the first word that is a number
        lettered = F.array_join(F.filter(words(name), lambda x: full(x, r"\p{L}+")), " ")
        return _propose(
            i, 8, k.isNotNull(), F.when(full(name, r"[A-Za-z]+(?: [A-Za-z]+){0,3}"), name).otherwise(lettered),
            let(house, lambda h: F.when(h != "", h).otherwise(street)), city, _at(parts, k), F.when(plus != "", F.concat(base, F.lit("-"), plus)).otherwise(base),
        )

    return F.when((i >= 2) & has(_at(lines, i), r"\d{5}"), let(first_of(F.reverse(at)), found))


def _allowed(proposals: Column) -> Column:
    """The proposals that are written: none but delivery blocks once one was, no generic one while a mailroom's is in force."""
    delivery = F.filter(proposals, lambda p: p["rank"] <= 2)
    latch = F.coalesce(F.get(F.transform(delivery, lambda p: p["at"]), 0), F.lit(2**31 - 1))

    def open_(p: Column) -> Column:
        others = F.filter(proposals, lambda q: q["rank"].between(3, 7) & (q["at"] <= p["at"]))
        return (p["rank"] <= 2) | ((p["at"] < latch) & ((p["rank"] < 8) | ~F.coalesce(F.get(F.reverse(others), 0)["rank"] == 7, F.lit(False))))

    return F.filter(proposals, open_)


def explicit_name(lines: Column) -> Column:
    """The best person after a TO marker; later lines win."""

    def scored(i: Column) -> Column:
        x = F.get(lines, i)
        same = full(x, r"\s*TO\s*:\s*(.+)", True)
        name = L.clean_name(F.when(same, F.regexp_extract(x, r"(?i)\A\s*TO\s*:\s*(.+)\z", 1)).otherwise(F.get(lines, i + 1)))
        marked = same | (full(x, r"\s*TO\s*:?\s*", True) & (i + 1 < F.size(lines)))
        return F.when(marked & L.person_name(name), F.struct((F.when(same, 5000).otherwise(4000) + F.when(L.comma_name(name), 3000).otherwise(0) + i).alias("score"), name.alias("name")))

    marks = F.filter(F.transform(lines, lambda x, i: F.when(has(x, r"\A\s*TO", True), i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(F.transform(marks, scored))["name"], F.lit(""))


def ranked_names(lines: Column) -> Column:
    """Likely names with a score of 4 or more, best first, then in order: (score, at, name)."""
    return let(F.transform(lines, L.features), lambda seen: _ranked(lines, seen))


def _ranked(lines: Column, seen: Column) -> Column:
    any_of = lambda test, start, n: F.exists(F.slice(seen, F.greatest(start + 1, F.lit(1)), F.greatest(n, F.lit(0))), test)

    def scored(own: Column, i: Column) -> Column:
        name, line = own["name"], F.get(lines, i)
        fits = ~own["noise"] & ~has(name, bounded(L.NOT_A_NAME), True) & ~has(name, r"\d") & (letters_of(name) >= 0.75 * visible_of(name))
        fits = fits & (own["comma"] | full(name, L.PLAIN_NAME, True))
        score = F.lit(1) + F.when(own["comma"], 3).otherwise(0) + F.when(has(name, r"\A(?:MR|MRS|MS|MISS|DR)\.", True), 2).otherwise(0)
        score = score + F.when(has(line, r"\A\s*(?:TO|SHIP\s+TO)\s*:", True), 4).otherwise(0)
        score = score + F.when(any_of(lambda x: x["marker"] | x["receives"], i - 2, F.least(i, F.lit(2))), 4).otherwise(0)
        score = score + F.when(any_of(lambda x: x["street"], i + 1, F.lit(2)), 3).otherwise(0) + F.when(any_of(lambda x: x["city"], i + 1, F.lit(3)), 2).otherwise(0)
        found = F.struct((-score).alias("minus"), i.alias("at"), name.alias("name"))
        return F.when(fits, let(found, lambda x: F.when(x["minus"] <= -4, x)))

    found = F.array_sort(F.filter(F.transform(seen, scored), lambda x: x.isNotNull()))
    return F.transform(found, lambda x: F.struct((-x["minus"]).alias("score"), x["at"].alias("at"), x["name"].alias("name")))


def mailroom_street(clean: Column, street: Column) -> Column:
    """A damaged street line of the one known mailroom, put right when the rest of the label shows the place."""
    return let(F.upper(F.array_join(clean, "\n")), lambda text: _mailroom_street(clean, street, text))


def _mailroom_street(clean: Column, street: Column, text: Column) -> Column:
    """The same; ``text`` is all clean lines in upper case."""
    upper = F.transform(clean, F.upper)
    hub = has(text, bounded(r"HUB\s*#?\s*\d{2,5}")) | has(text, r"(?:\A|\n)\s*UB\s*#?\s*\d{2,5}\b")
    context = text.contains("COLLEGE") & has(text, bounded(r"COLLEGE\s+(?:ST|STREET)")) & (text.contains("DICKINSON COLLEGE") | has(text, bounded(r"P\.?\s*O\.?\s+BOX\s+1773")) | (has(text, bounded(r"CARLISLE\s*,?\s+PA\s+17013")) & hub))
    made = lambda mark, number: F.concat(F.lit("28 N COLLEGE ST HUB"), F.when(mark != "", " # ").otherwise(" "), number)
    hub_line, damaged = r"H?UB\s*(#?)\s*(\d{2,5})", r"[^\d\s]{1,4}\s+COLLEGE\s+(?:ST|STREET)\s+HUB\s*(#?)\s*(\d{2,5})"

    def fixed(x: Column, i: Column) -> Column:
        following = F.coalesce(F.get(upper, i + 1), F.lit(""))
        split = full(x, r"8\s+N\s+COLLEGE\s+(?:ST|STREET)") & full(following, hub_line)
        return F.when(split, made(_group(following, hub_line, 1), _group(following, hub_line, 2))).when(full(x, damaged), made(_group(x, damaged, 1), _group(x, damaged, 2)))

    found = F.get(F.filter(F.transform(upper, fixed), lambda x: x.isNotNull()), 0)
    right = has(F.upper(L.clean_address(street, let)), r"\A28\s+N\s+COLLEGE\s+(?:ST|STREET)\b")
    return F.when(context & ~right, F.coalesce(found, street)).otherwise(street)


def campus_address(clean: Column) -> Column:
    """(zip_code, street_address) of a University Park block, or null; the street is a building up to four lines above."""
    pattern = r"(?i)\bUNIVERSITY\s+PARK\b[\s,]*PA\W*(16802)(?:\s*[-–—]\s*(\d{4}))?\b"
    building = r"(?:\d+[A-Z]?(?:-[A-Z0-9]+)?|[NSEW]\d{2,4})\s+.+?\b(?:BLDG|BUILDING|CENTER|COMPLEX|PARK)"

    def block(x: Column, i: Column) -> Column:
        plus = F.regexp_extract(x, pattern, 2)
        above = F.reverse(F.slice(clean, F.greatest(i - 3, F.lit(1)), F.least(i, F.lit(4))))
        street = F.get(F.filter(above, lambda y: full(F.trim(y), building, True)), 0)
        return F.when(x.rlike(pattern), F.struct(F.when(plus != "", F.concat(F.lit("16802-"), plus)).otherwise("16802").alias("zip_code"), F.trim(street).alias("street_address")))

    return F.get(F.filter(F.transform(clean, block), lambda x: x.isNotNull()), 0)


def _proposals(lines: Column, clean: Column) -> Column:
    return let(contains_any(F.upper(F.array_join(lines, "\n")), MAILROOM_SIGNS), lambda mailroom: _proposed(lines, clean, mailroom))


def _proposed(lines: Column, clean: Column, mailroom: Column) -> Column:
    """What every parser would write, in the order of the lines; most lines are no marker and hold no code, so that no block can end or begin at them."""
    c = {"lines": lines, "clean": clean}

    def point(x: Column, i: Column) -> Column:
        line, code = F.get(lines, i), r"\d{5}"
        # A block that begins at a code has blanks or commas in its line: a word alone, such as a number, is none.
        coded = (has(line, code) | ((x != line) & has(x, code))) & has(line, r"[\x00- ,\x7f-\uffff]")
        return F.struct(i.alias("at"), L.delivers(x).alias("marker"), coded.alias("coded"))

    points = F.filter(F.transform(clean, point), lambda p: p["marker"] | p["coded"])

    def at_line(p: Column) -> Column:
        i = p["at"]
        placed = lambda parts: [*_line_blocks(c, i, parts), F.when(mailroom, _mailroom_block(c, i)), _generic_block(c, i, parts)]
        each = lambda parts: F.array(*[F.when(p["marker"], b) for b in _deliver_blocks(c, i)], *[F.when(p["coded"], b) for b in placed(parts)])
        return let(F.when(p["coded"], words(F.get(lines, i))), each)

    return F.filter(F.flatten(F.transform(points, at_line)), lambda p: p.isNotNull())


def _written(allowed: Column) -> Column:
    """The fields as the last of the allowed proposals leave them, and the parsers' names."""
    ends = F.struct(F.get(allowed, F.size(allowed) - 1).alias("last"), F.get(F.reverse(F.filter(allowed, lambda p: p["rank"] > 1)), 0).alias("named"))
    matches = F.array_distinct(F.transform(allowed, lambda p: p["parser"]))

    def fields(x: Column) -> Column:
        found = [F.coalesce(x["named" if f == "recipient_name" else "last"][f], F.lit("")).alias(f) for f in ADDRESS]
        return F.struct(*found, F.coalesce(x["last"]["parser"], F.lit("")).alias("parser_used"), matches.alias("parser_matches"))

    return let(ends, fields)


def _final_name(lines: Column, name: Column) -> Column:
    """The parsers' name, unless a line says it better or, where there is none, looks like one."""
    weak = lambda: (name == "") | L.noise(name) | has(F.upper(name), bounded(r"HUB|DICKINSON\s*COLLEGE")) | (F.regexp_count(name, F.lit("[A-Za-z]+")) < 2)
    ranked = F.coalesce(F.get(ranked_names(lines), 0)["name"], F.lit(""))
    better = let(explicit_name(lines), lambda to: F.when((to != "") & weak(), to).otherwise(name))
    return let(better, lambda x: F.when(x == "", ranked).otherwise(x))


def parse(labels: DataFrame) -> DataFrame:
    """``labels`` (with ``lines``) and their five address fields, ``parser_used`` and ``parser_matches``, made in one pass over the row."""
    lines = F.col("lines")

    def repaired(x: Column, clean: Column, text: Column) -> Column:
        campus = F.when(text.contains("UNIVERSITY"), campus_address(clean))
        more = F.struct(campus.alias("campus"), _mailroom_street(clean, x["street_address"], text).alias("street"), _final_name(lines, x["recipient_name"]).alias("name"))
        return let(more, lambda m: final(x, m["campus"], m["street"], m["name"]))

    def final(x: Column, campus: Column, street: Column, name: Column) -> Column:
        at_campus = lambda f, value: F.when(campus.isNotNull(), value).otherwise(x[f]).alias(f)
        return F.struct(
            name.alias("recipient_name"), F.coalesce(campus["street_address"], street).alias("street_address"), at_campus("city", "University Park"), at_campus("state", "PA"),
            F.coalesce(campus["zip_code"], x["zip_code"]).alias("zip_code"), x["parser_used"].alias("parser_used"), x["parser_matches"].alias("parser_matches"),
        )

    def found(clean: Column) -> Column:
        written = let(let(_proposals(lines, clean), _allowed), _written)
        text = F.upper(F.array_join(clean, "\n"))
        return let(F.struct(written.alias("x"), text.alias("text")), lambda y: repaired(y["x"], clean, y["text"]))

    return together(labels, let(L.clean_lines(lines), found), (*ADDRESS, "parser_used", "parser_matches"))


def normalise(rows: DataFrame) -> DataFrame:
    """Parsed fields in their final form, with ``street_rejected`` and the name's flags."""
    street, name, city = F.col("street_address"), F.col("recipient_name"), F.col("city")

    def final(x: Column) -> Column:
        normal, rejected = x["street"], x["rejected"]
        return F.struct(
            rejected.alias("street_rejected"), F.when((street == "") | rejected, "").otherwise(normal).alias("street_address"),
            F.when(name == "", "").otherwise(L.normal_name(name)).alias("recipient_name"), F.when(city == "", "").otherwise(L.normal_city(city, let)).alias("city"),
        )

    judged = let(L.normal_street(street, let), lambda normal: F.struct(normal.alias("street"), ((street != "") & L.rejects(normal)).alias("rejected")))
    out = together(rows, let(judged, final), ("street_rejected", "street_address", "recipient_name", "city"))
    if "tracking_number" in rows.columns:
        out = out.withColumn("tracking_number", L.normal_number(F.col("tracking_number")))
    return out.withColumns(L.name_flags(F.col("recipient_name")))
