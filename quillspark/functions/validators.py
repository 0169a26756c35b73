"""Format, checksum and date rules: each takes a value and returns struct(normalized, passed, notes, coerced).

``passed`` is null where no rule applies.  A validator never changes the
observed value.  What depends on today takes ``as_of``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let
from .privacy import coerce_pattern, coercion_notes, compact, to_digits

# The dihedral group's products and the positional permutations of the Verhoeff scheme.
VERHOEFF_D = ((0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 2, 3, 4, 0, 6, 7, 8, 9, 5), (2, 3, 4, 0, 1, 7, 8, 9, 5, 6), (3, 4, 0, 1, 2, 8, 9, 5, 6, 7), (4, 0, 1, 2, 3, 9, 5, 6, 7, 8), (5, 9, 8, 7, 6, 0, 4, 3, 2, 1), (6, 5, 9, 8, 7, 1, 0, 4, 3, 2), (7, 6, 5, 9, 8, 2, 1, 0, 4, 3), (8, 7, 6, 5, 9, 3, 2, 1, 0, 4), (9, 8, 7, 6, 5, 4, 3, 2, 1, 0))
VERHOEFF_P = ((0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 5, 7, 6, 2, 8, 3, 0, 9, 4), (5, 8, 0, 3, 7, 9, 6, 1, 4, 2), (8, 9, 1, 6, 0, 4, 3, 5, 2, 7), (9, 4, 5, 3, 1, 2, 6, 8, 7, 0), (4, 2, 8, 6, 5, 7, 3, 9, 0, 1), (2, 7, 9, 3, 8, 0, 6, 4, 1, 5), (7, 0, 4, 6, 9, 1, 3, 2, 5, 8))
# Holder types of a tax number, and state codes of a driving licence.
PAN_HOLDERS = "ABCFGHLJPTK"
STATE_CODES = "AN AP AR AS BR CH CG DD DL DN GA GJ HP HR JH JK KA KL LA LD MH ML MN MP MZ NL OD OR PB PY RJ SK TN TR TS UK UP WB"
# Number words, scales and fillers of amounts in words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
TENS = "twenty thirty forty fifty sixty seventy eighty ninety"
SCALES = {"thousand": 1_000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "crore": 10_000_000}
FILLERS = ("only", "and", "rupees", "rupee", "rs")

def _none() -> Column:
    return F.array().cast("array<string>")


def _verdict(normalized: Column, passed: Column, notes: Column | None = None, coerced: Column | None = None) -> Column:
    return F.struct(normalized.cast("string").alias("normalized"), passed.cast("boolean").alias("passed"), (notes if notes is not None else _none()).alias("notes"), (coerced if coerced is not None else F.lit(False)).alias("coerced"))


def _note(when: Column, text: Column | str) -> Column:
    """A list of one note, or of none."""
    return F.when(when, F.array(text if isinstance(text, Column) else F.lit(text))).otherwise(_none())


def _by_pattern(value: Column, pattern: str | None, rule: Callable[[Column], tuple[Column, Column, Column]]) -> Column:
    """Compact, put look-alikes right, then judge: ``rule`` gives (normalized, passed, notes)."""
    start = compact(value)

    def judge(pair: Column) -> Column:
        normalized, passed, notes = rule(pair["after"])
        return _verdict(normalized, passed, F.concat(coercion_notes(pair["before"], pair["after"]), notes), pair["before"] != pair["after"])

    after = to_digits(start) if pattern is None else coerce_pattern(start, pattern)
    return let(F.struct(start.alias("before"), after.alias("after")), judge)


def verhoeff_valid(digits: Column) -> Column:
    """Whether a string of digits has a right Verhoeff check digit at its end."""
    d = F.array(*[F.array(*map(F.lit, row)) for row in VERHOEFF_D])
    p = F.array(*[F.array(*map(F.lit, row)) for row in VERHOEFF_P])
    last = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.struct(c.cast("int").alias("c"), i.alias("i")))
    return F.aggregate(last, F.lit(0), lambda acc, x: F.get(F.get(d, acc), F.get(F.get(p, x["i"] % 8), x["c"]))) == 0


def aadhaar(value: Column) -> Column:
    def rule(v: Column):
        whole = v.rlike("^[0-9]{12}$")
        starts = whole & v.rlike("^[01]")
        fails = whole & ~F.coalesce(verhoeff_valid(F.when(whole, v)), F.lit(False))
        shown = F.when(whole, F.concat_ws(" ", F.substring(v, 1, 4), F.substring(v, 5, 4), F.substring(v, 9, 4))).otherwise(v)
        return shown, whole & ~starts & ~fails, F.concat(_note(~whole, "Aadhaar must be exactly 12 digits"), _note(starts, "Aadhaar numbers never start with 0 or 1"), _note(fails, "Verhoeff checksum failed"))

    return _by_pattern(value, "9" * 12, rule)


def pan(value: Column) -> Column:
    def rule(v: Column):
        whole = v.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$")
        holder = F.substring(v, 4, 1).isin(*PAN_HOLDERS)
        return v, whole & holder, F.concat(_note(~whole, "PAN must match AAAAA9999A"), _note(whole & ~holder, F.concat(F.lit("4th character '"), F.substring(v, 4, 1), F.lit("' is not a valid PAN holder-type code"))))

    return _by_pattern(value, "AAAAA9999A", rule)


def _matches(pattern: str, regex: str, note: str) -> Callable[[Column], Column]:
    def check(value: Column) -> Column:
        return _by_pattern(value, pattern, lambda v: (v, v.rlike(regex), _note(~v.rlike(regex), note)))

    return check


ifsc = _matches("AAAA0XXXXXX", "^[A-Z]{4}0[A-Z0-9]{6}$", "IFSC must be 4 letters, '0', then 6 alphanumerics (11 chars)")
passport = _matches("A9999999", "^[A-Z][0-9]{7}$", "Indian passport number must be 1 letter + 7 digits")


def account(value: Column) -> Column:
    def rule(v: Column):
        digits, fits = v.rlike("^[0-9]+$"), F.length(v).between(9, 18)
        return v, digits & fits, F.concat(_note(~digits, "account number must contain digits only"), _note(digits & ~fits, F.concat(F.lit("account number length "), F.length(v).cast("string"), F.lit(" outside 9-18"))))

    return _by_pattern(value, None, rule)


def digits(value: Column) -> Column:
    return _by_pattern(value, None, lambda v: (v, v.rlike("^[0-9]+$"), _note(~v.rlike("^[0-9]+$"), "expected digits only")))


def amount(value: Column) -> Column:
    plain = F.trim(F.regexp_replace(value, r"₹|Rs\.|Rs|INR", ""))
    v = F.regexp_replace(F.trim(F.regexp_replace(plain, r"[/\-=]+$", "")), "[, ]", "")
    good = v.rlike(r"^[0-9]+(\.[0-9]{1,2})?$")
    return _verdict(v, good, _note(~good, "amount is not a valid number"))


def words_to_number(text: Column) -> Column:
    """Amount words as a whole number: hundred multiplies, larger scales add up; an unknown word or none at all gives null."""
    values = {w: i for i, w in enumerate(UNITS.split())} | {w: 10 * i for i, w in enumerate(TENS.split(), 2)}
    number = F.create_map(*[x for w, n in values.items() for x in (F.lit(w), F.lit(n).cast("bigint"))])
    scale = F.create_map(*[x for w, n in SCALES.items() for x in (F.lit(w), F.lit(n).cast("bigint"))])
    tokens = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda t: ~t.isin(*FILLERS))
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("total"), zero.alias("now"), F.lit(True).alias("good"))
    one = F.lit(1).cast("bigint")

    def step(a: Column, t: Column) -> Column:
        unit, big = number[t], scale[t]
        total = F.when(big.isNotNull(), a["total"] + F.greatest(a["now"], one) * big).otherwise(a["total"])
        now = F.when(unit.isNotNull(), a["now"] + unit).when(t == "hundred", F.greatest(a["now"], one) * 100).when(big.isNotNull(), zero).otherwise(a["now"])
        known = unit.isNotNull() | big.isNotNull() | (t == "hundred")
        return F.struct(total.alias("total"), now.alias("now"), (a["good"] & known).alias("good"))

    return F.aggregate(tokens, start, step, lambda a: F.when(a["good"] & (F.size(tokens) > 0), a["total"] + a["now"]))


# Month names that a date may be written with.
MONTHS = "january february march april may june july august september october november december"


def parse_date(value: Column, prefer_past: bool, as_of: Column) -> Column:
    """A date of day, month and year in figures or with a month's name, or eight bare digits; null for anything else.

    Years of two digits are 1969 to 2068; ``prefer_past`` puts those after ``as_of`` a century back.
    """
    text = F.regexp_replace(F.regexp_replace(F.trim(value), r"\s*([/\-.])\s*", "$1"), r"\s+", " ")
    names = F.create_map(*[x for i, m in enumerate(MONTHS.split(), 1) for n in {m, m[:3]} for x in (F.lit(n), F.lit(i))])

    def year(raw: Column) -> Column:
        y = raw.try_cast("int")
        return F.when(F.length(raw) == 4, y).when(F.length(raw) == 2, y + F.when(y >= 69, 1900).otherwise(2000))

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m.try_cast("int"), d.try_cast("int")), F.lit("yyyy-MM-dd")).cast("date")

    figures = r"^([0-9]{1,2})([/\-.])([0-9]{1,2})\2([0-9]{4}|[0-9]{2})$"
    part = lambda i: F.regexp_extract(text, figures, i)
    plain = made(year(part(4)), part(3), part(1))
    moved = F.when((F.length(part(4)) == 2) & (plain > as_of), F.add_months(plain, -1200)).otherwise(plain) if prefer_past else plain
    named = r"^([0-9]{1,2})([ /])([A-Za-z]+)\2([0-9]{4})$"
    word = lambda i: F.regexp_extract(text, named, i)
    spelled = made(year(word(4)), names[F.lower(word(3))], word(1))
    bare = F.regexp_replace(value, "[^0-9]", "")
    boxes = made(F.substring(bare, 5, 4).try_cast("int"), F.substring(bare, 3, 2), F.substring(bare, 1, 2))
    return F.when(text.rlike(figures), moved).when(text.rlike(named) & names[F.lower(word(3))].isNotNull(), spelled).when(F.length(bare) == 8, boxes)


def date_value(value: Column, kind: str, as_of: Column) -> Column:
    """``date``, ``date_past`` (not after ``as_of``) or ``date_form`` (2000 to a year after ``as_of``); ISO text.

    Look-alike letters become digits only where no month name of letters is
    written, so that ``12 April 1990`` stays what it says.
    """
    upper = F.upper(value)
    cleaned = F.when(upper.rlike("[A-HJ-KM-NP-Z]"), upper).otherwise(F.translate(upper, "OIL", "011"))

    def judge(x: Column) -> Column:
        d = parse_date(x["clean"], kind in ("date_past", "date_form"), as_of)
        return let(F.struct(d.alias("d"), (x["clean"] != x["upper"]).alias("c")), verdict)

    def verdict(x: Column) -> Column:
        d = x["d"]
        future = d > as_of if kind == "date_past" else F.lit(False)
        odd = ~d.between(F.lit("2000-01-01").cast("date"), F.add_months(as_of, 12)) if kind == "date_form" else F.lit(False)
        old = (F.year(d) < 1900) & ~future & ~odd
        notes = F.concat(
            _note(x["c"], "confusable characters in date coerced to digits"),
            _note(d.isNull(), "not a valid calendar date (expected DD/MM/YYYY)"),
            _note(F.coalesce(future, F.lit(False)), "date is in the future but should be in the past"),
            _note(F.coalesce(odd, F.lit(False)), "form date outside the plausible range"),
            _note(F.coalesce(old, F.lit(False)), "year before 1900"),
        )
        return _verdict(F.date_format(d, "yyyy-MM-dd"), d.isNotNull() & ~F.coalesce(future | odd | old, F.lit(False)), notes, x["c"])

    return let(F.struct(cleaned.alias("clean"), upper.alias("upper")), judge)


def driving_licence(value: Column, as_of: Column) -> Column:
    shape = "^([A-Z]{2})([0-9]{2})([0-9]{4})([0-9]{7})$"

    def rule(v: Column):
        part = lambda i: F.regexp_extract(v, shape, i)
        whole, year = v.rlike(shape), part(3).try_cast("int")
        state = part(1).isin(*STATE_CODES.split())
        timely = year.between(1950, F.year(as_of))
        shown = F.when(whole, F.concat(part(1), part(2), F.lit(" "), part(3), F.lit(" "), part(4))).otherwise(v)
        return shown, whole & state & F.coalesce(timely, F.lit(False)), F.concat(_note(~whole, "DL number must be SS RR YYYY NNNNNNN (15 chars)"), _note(whole & ~state, F.concat(F.lit("unknown state code "), part(1))), _note(F.coalesce(whole & ~timely, F.lit(False)), F.concat(F.lit("implausible issue year "), year.cast("string"))))

    return _by_pattern(value, "AA99" + "9" * 11, rule)


def mrz_check_digit(data: Column) -> Column:
    """Weights 7, 3, 1 over digits (their value), letters (A is 10) and fillers (0), modulo ten."""
    order = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    value = lambda c: F.greatest(F.instr(F.lit(order), F.upper(c)) - 1, F.lit(0))
    weights = F.array(F.lit(7), F.lit(3), F.lit(1))
    return F.aggregate(F.transform(F.split(data, ""), lambda c, i: value(c) * F.get(weights, i % 3)), F.lit(0), lambda a, x: a + x) % 10


# Where the parts of the second line begin (from 1) and how long they are.
MRZ_PARTS = {"document_number": (1, 9), "document_number_check": (10, 1), "nationality": (11, 3), "birth_date": (14, 6), "birth_date_check": (20, 1), "sex": (21, 1), "expiry_date": (22, 6), "expiry_date_check": (28, 1), "personal_number": (29, 14), "personal_number_check": (43, 1), "composite_check": (44, 1)}


def mrz_part(line: Column, name: str) -> Column:
    return F.substring(line, *MRZ_PARTS[name])


def mrz_line(value: Column) -> Column:
    """The second line of a passport's machine readable zone: 44 characters and five check digits."""
    line = F.translate(F.regexp_replace(F.upper(value), r"\s", ""), "«‹", "<<")

    def judge(v: Column) -> Column:
        whole = F.length(v) == 44

        def wrong(name: str, data: Column, check: Column, blank: Column | None = None) -> Column:
            expected = mrz_check_digit(data).cast("string")
            off = whole & (check != expected)
            off = off & ~blank if blank is not None else off
            return _note(off, F.concat(F.lit(f"MRZ {name} check digit mismatch (expected "), expected, F.lit(", found '"), check, F.lit("')")))

        p = lambda n: mrz_part(v, n)
        blank = (p("personal_number_check") == "<") & p("personal_number").rlike("^<*$")
        fails = F.concat(
            wrong("document number", p("document_number"), p("document_number_check")),
            wrong("birth date", p("birth_date"), p("birth_date_check")),
            wrong("expiry date", p("expiry_date"), p("expiry_date_check")),
            wrong("personal number", p("personal_number"), p("personal_number_check"), blank),
            wrong("composite", F.concat(F.substring(v, 1, 10), F.substring(v, 14, 7), F.substring(v, 22, 22)), p("composite_check")),
        )
        short = _note(~whole, F.concat(F.lit("MRZ line 2 must be 44 characters, got "), F.length(v).cast("string")))
        return let(F.concat(short, fails), lambda notes: _verdict(v, whole & (F.size(notes) == 0), notes))

    return let(line, judge)


def mrz_date(yymmdd: Column, prefer_past: bool, as_of: Column) -> Column:
    """ISO text of a date of six digits; births lie in the past, expiries not more than twenty years back in the last century."""
    y = F.substring(yymmdd, 1, 2).try_cast("int")
    full = F.concat((y + F.when(y >= 69, 1900).otherwise(2000)).cast("string"), F.substring(yymmdd, 3, 4))
    d = F.when(yymmdd.rlike("^[0-9]{6}$"), F.try_to_timestamp(full, F.lit("yyyyMMdd")).cast("date"))
    moved = F.when(d > as_of, F.add_months(d, -1200)) if prefer_past else F.when((F.year(d) < 2000) & (d < F.add_months(as_of, -240)), F.add_months(d, 1200))
    return F.date_format(F.coalesce(moved, d), "yyyy-MM-dd")


def _tidy(value: Column) -> Column:
    """Single spaces, and no dots or commas at the ends."""
    return F.regexp_replace(F.trim(F.regexp_replace(value, r"\s+", " ")), "^[.,]+|[.,]+$", "")


def name(value: Column) -> Column:
    def judge(v: Column) -> Column:
        letters, figures = v.rlike("[A-Za-z]"), v.rlike(r"\p{Nd}")
        return _verdict(v, letters & ~figures, F.concat(_note(~letters, "name contains no letters"), _note(letters & figures, "name contains digits")))

    return let(_tidy(value), judge)


def place(value: Column) -> Column:
    good = lambda v: v.rlike(r"^[A-Za-z][A-Za-z .,'\-]*$")
    return let(_tidy(value), lambda v: _verdict(v, good(v), _note(~good(v), "place name contains unexpected characters")))


def text(value: Column) -> Column:
    return _verdict(_tidy(value), F.lit(None))


def address(value: Column) -> Column:
    v = F.trim(F.regexp_replace(F.replace(value, F.lit("\n"), F.lit(", ")), r"\s+", " "))
    good = v.rlike(r"(?:^|[^A-Za-z0-9_])[0-9]{6}(?:[^A-Za-z0-9_]|$)")
    return _verdict(v, good, _note(~good, "address has no 6-digit PIN code"))


def checkbox(value: Column, options: Column) -> Column:
    """The ticked options by the printed list; exactly one must be ticked.

    An option that is written out wins over one that only shares its first twelve letters.
    """
    parts = F.filter(F.transform(F.split(value, r"[;|]"), lambda p: F.trim(p)), lambda p: p != "")

    def option(p: Column) -> Column:
        same = F.filter(options, lambda o: F.lower(o) == F.lower(p))
        like = F.filter(options, lambda o: F.contains(F.lower(p), F.substring(F.lower(o), 1, 12)) | F.contains(F.lower(o), F.substring(F.lower(p), 1, 12)))
        return F.coalesce(F.get(same, F.lit(0)), F.get(like, F.lit(0)))

    def judge(m: Column) -> Column:
        n = F.size(m)
        return _verdict(
            F.when(n == 0, F.trim(value)).otherwise(F.array_join(m, "; ")),
            n == 1,
            F.concat(_note(n == 0, "selected option does not match any printed option"), _note(n > 1, F.concat(n.cast("string"), F.lit(" options appear selected; exactly one expected")))),
        )

    return let(F.array_distinct(F.filter(F.transform(parts, option), lambda o: o.isNotNull())), judge)


def registry(as_of: Column) -> dict[str, Callable[[Column], Column]]:
    """Rules by name, with what they need to know about today."""
    return {
        "aadhaar": aadhaar,
        "pan": pan,
        "ifsc": ifsc,
        "account": account,
        "digits": digits,
        "amount": amount,
        "date": lambda v: date_value(v, "date", as_of),
        "date_past": lambda v: date_value(v, "date_past", as_of),
        "date_form": lambda v: date_value(v, "date_form", as_of),
        "dl": lambda v: driving_licence(v, as_of),
        "passport": passport,
        "mrz2": mrz_line,
        "name": name,
        "place": place,
        "text": text,
        "address": address,
    }


def validate(validator: Column, value: Column, options: Column, as_of: Column) -> Column:
    """The verdict of the rule that ``validator`` names; unknown and null names have none."""
    out = F.when(validator == "checkbox", checkbox(value, options))
    for rule, check in registry(as_of).items():
        out = out.when(validator == rule, check(value))
    return out.otherwise(text(value))


def comparison_key(normalized: Column, value: Column) -> Column:
    """What two reads of a value must share to agree; null for blank values."""
    base = F.upper(F.regexp_replace(F.coalesce(normalized, value), r"[\s.,]", ""))
    return F.when(value.isNotNull() & (F.trim(value) != ""), base)
