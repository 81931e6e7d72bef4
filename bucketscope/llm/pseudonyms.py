"""Format-preserving pseudonyms for personal data (operator 8), in DataFrame operations only.

Card, phone and bank account numbers (IBAN), social security numbers, network addresses, dates and e-mail names are found
by pattern and validated. A Feistel network keyed by a secret permutes each within its format: digits stay digits, a card number keeps
a right check digit and an account number right check digits, an address has octets up to 255, a date is a date. The permutation has no state, so equal values
become equal pseudonyms in every document, and different ones stay different. Everything else is left as it is.

The round function is SHA-256 over the key, the kind of value, the round and the other half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscope.llm.common import free_name

ROUNDS = 8

# What each kind looks like. Quantifiers are possessive where a long run could be read again and again.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}"
    r"|[1-9][0-9]?(?:\.[1-9][0-9]?\.|/[1-9][0-9]?/)[0-9]{4}|[0-9]{2}(?:\.[0-9]{2}\.|/[0-9]{2}/)[0-9]{2}(?!\.[0-9]))(?![0-9/-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ -]?)?(?:\([0-9]{2,4}\)[ -]?[0-9]{3,4}|[0-9]{3}[-. ][0-9]{3})[-. ][0-9]{4}(?![0-9])"
    r"|(?<![0-9+])\+[0-9]{1,3}(?:[ -]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z+.,/_=-])[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9A-Za-z/_=-]|[.,][0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
#: A whole run of at least 13 digits, up to what begins another kind: cards in it can stand next to other numbers.
_NEXT = "|".join(f"(?:{PATTERNS[kind]})" for kind in ("ip", "date", "ssn"))
RUN = rf"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:[ -](?!{_NEXT})[0-9]++)*+"
ANY = "|".join(f"(?:{p})" for p in [*(p for kind, p in PATTERNS.items() if kind != "card"), RUN])

# The days that dates are permuted among, 252 x 290 of them from this one.
FIRST_DAY = "1900-01-01"
DAYS = (252, 290)

# The days of dates with years of two digits, 75 x 487 of them from this one.
SHORT_FIRST_DAY = "2000-01-01"
SHORT_DAYS = (75, 487)

# Area codes and exchanges of ten-digit phone numbers begin with 2 to 9. The numbers are 80,000 x 80,000.
TEN_DIGITS = (80_000, 80_000)

# Groups are 01 to 99, serial numbers 0001 to 9999.
GROUPS, SERIALS = 99, 9999

# In a marked text, MARK begins each piece and the next character says what it is.
MARK, LITERAL, FOUND, PLAIN = "\ue000", "\x01", "\x02", "\x03"


def _hash(key: str, kind: str, turn: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other), 256)


def _shifted(part: Column, hashed: Column) -> Column:
    """Each letter or digit moved within its class, by the hash byte at its place."""

    def move(char: Column, at: Column) -> Column:
        by = F.conv(F.substring(hashed, (at % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(char)
        within = lambda first, size: F.char((F.lit(first) + (code - first + by) % size).cast("bigint"))
        return (
            F.when(char.between("0", "9"), within(48, 10))
            .when(char.between("a", "z"), within(97, 26))
            .when(char.between("A", "Z"), within(65, 26))
            .otherwise(char)
        )

    return F.array_join(F.transform(F.split(part, ""), move), "")


def permuted_text(value: Column, key: str, kind: str) -> Column:
    """A permutation of the texts that have the same format as ``value``: its ASCII letters and digits change."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))
    step = lambda s, turn: F.struct(s["r"].alias("l"), _shifted(s["l"], _hash(key, kind, turn, s["r"])).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["l"], s["r"]))


def permuted_number(value: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """A permutation of the whole numbers below the product of ``sizes``."""
    start = F.struct(F.floor(value / sizes[1]).cast("bigint").alias("l"), (value % sizes[1]).cast("bigint").alias("r"))

    def step(s: Column, turn: Column) -> Column:
        draw = lambda other: F.conv(F.substring(_hash(key, kind, turn, other.cast("string")), 1, 12), 16, 10).cast("bigint")
        left = (s["l"] + draw(s["r"])) % sizes[0]
        right = (s["r"] + draw(s["l"])) % sizes[1]
        return F.struct(F.when(turn % 2 == 1, left).otherwise(s["l"]).alias("l"), F.when(turn % 2 == 0, right).otherwise(s["r"]).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["l"] * sizes[1] + s["r"])


def _luhn(digits: Column) -> Column:
    """The sum that is a multiple of ten for a right check digit."""

    def worth(char: Column, at: Column) -> Column:
        n = char.cast("int") * F.when(at % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda s, n: s + F.coalesce(n, F.lit(0)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(value: Column, key: str) -> Column:
    body = F.regexp_extract(value, r"^(.*)[0-9]$", 1)
    changed = permuted_text(body, key, "card")
    check = (10 - _luhn(F.concat(_digits(changed), F.lit("0"))) % 10) % 10
    return F.when(_luhn(_digits(value)) % 10 == 0, F.concat(changed, check.cast("string")))


def _ip(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("bigint"))
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda s, o: s * 256 + o)
    changed = permuted_number(number, (1 << 16, 1 << 16), key, "ip")
    parts = [F.pmod(F.shiftright(changed, 24 - 8 * i), F.lit(256)).cast("string") for i in range(4)]
    return F.when(F.forall(octets, lambda o: o < 256), F.concat_ws(".", *parts))


def _iban(value: Column, key: str) -> Column:
    """The country stays, the account number is permuted, and the check digits are made anew."""

    def rest(text: Column) -> Column:
        """The remainder by 97 that the check digits make 1."""
        turned = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))
        codes = F.transform(F.split(F.replace(turned, F.lit(" "), F.lit("")), ""), F.ascii)
        step = lambda r, c: (F.when(c > 64, r * 100 + c - 55).when(c > 47, r * 10 + c - 48).otherwise(r)) % 97
        return F.aggregate(codes, F.lit(0), step)

    country, account = F.substring(value, 1, 2), F.substring(value, F.lit(5), F.length(value))
    changed = permuted_text(account, key, "iban")
    check = F.lpad((98 - rest(F.concat(country, F.lit("00"), changed))).cast("string"), 2, "0")
    size = F.length(F.replace(value, F.lit(" "), F.lit("")))
    right = size.between(15, 34) & ~F.substring(value, 3, 2).isin("00", "01", "99") & (rest(value) == 1)
    return F.when(right, F.concat(country, check, changed))


def _date(value: Column, key: str) -> Column:
    def walked(day: Column, sizes: tuple[int, int], kind: str, first: str, fits) -> Column:
        """The permutation, repeated until it comes back to a day that the form can have, which it does within few turns."""
        moved = lambda at: permuted_number(at, sizes, key, kind)
        able = lambda at: fits(F.date_add(F.lit(first).cast("date"), at.cast("int")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(100)), moved(day), lambda at, turn: F.when(able(at), at).otherwise(moved(at)))

    # Slash dates have the month first where that is a date; the others, whose first number is above 12, are permuted
    # among themselves. So are dates written without leading zeros, among those that would have one.
    past_12 = lambda date: F.dayofmonth(date) > 12
    one_digit = lambda date: (F.dayofmonth(date) < 10) | (F.month(date) < 10)
    one_past_12 = lambda date: (F.dayofmonth(date) > 12) & (F.month(date) < 10)
    bare = r"^(?!\d\d[./]\d\d[./])"
    forms = [
        ("yyyy-MM-dd", r"^\d{4}-", None), ("dd.MM.yyyy", r"^\d\d\.\d\d\.\d{4}$", None),
        ("dd/MM/yyyy", r"^(?:1[3-9]|[23]\d)/\d\d/\d{4}$", past_12), ("MM/dd/yyyy", r"^(?:0\d|1[0-2])/\d\d/\d{4}$", None),
        ("d.M.yyyy", bare + r"[1-9]\d?\.", one_digit),
        ("d/M/yyyy", bare + r"(?:1[3-9]|[23]\d)/", one_past_12), ("M/d/yyyy", bare + r"(?:[1-9]|1[0-2])/", one_digit),
        ("dd.MM.yy", r"^\d\d\.\d\d\.\d\d$", None),
        ("dd/MM/yy", r"^(?:1[3-9]|[23]\d)/\d\d/\d\d$", past_12), ("MM/dd/yy", r"^(?:0\d|1[0-2])/\d\d/\d\d$", None),
    ]
    out = F.lit(None).cast("string")
    for form, looks, fits in forms:
        short = not form.endswith("yyyy") and form.endswith("yy")
        sizes, kind, first = (SHORT_DAYS, "short date", SHORT_FIRST_DAY) if short else (DAYS, "date", FIRST_DAY)
        day = F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), F.lit(first).cast("date")).cast("bigint")
        turned = permuted_number(day, sizes, key, kind) if fits is None else walked(day, sizes, kind, first, fits)
        changed = F.date_add(F.lit(first).cast("date"), turned.cast("int"))
        out = F.when(value.rlike(looks) & day.between(0, sizes[0] * sizes[1] - 1), F.date_format(changed, form)).otherwise(out)
    return out


def _ssn(value: Column, key: str) -> Column:
    """The area stays; group and serial number are permuted among those that a valid number can have."""
    valid = value.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")
    group, serial = (F.substring(value, at, n).cast("bigint") for at, n in ((5, 2), (8, 4)))
    changed = permuted_number((group - 1) * SERIALS + serial - 1, (GROUPS, SERIALS), key, "ssn")
    spelt = lambda n, width: F.lpad((n + 1).cast("string"), width, "0")
    parts = spelt(F.floor(changed / SERIALS), 2), F.lit("-"), spelt(changed % SERIALS, 4)
    return F.when(valid, F.concat(F.substring(value, 1, 4), *parts))


def _phone(value: Column, key: str) -> Column:
    # ten digits alone stay such a number
    digits = lambda at, n: F.substring(value, at, n).cast("bigint")
    place = ((digits(1, 3) - 200) * 800 + digits(4, 3) - 200) * 10_000 + digits(7, 4)
    moved = permuted_number(place, TEN_DIGITS, key, "ten digits")
    head = F.floor(moved / 10_000)
    spelt = [F.floor(head / 800) + 200, head % 800 + 200, F.lpad((moved % 10_000).cast("string"), 4, "0")]
    alone = F.when(value.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$"), F.concat(*[c.cast("string") for c in spelt]))
    # the country code stays
    code = F.regexp_extract(value, r"^(\+[0-9]{1,3}(?=[ (-]))?", 1)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    return F.coalesce(alone, F.when(F.length(_digits(value)).between(7, 15), F.concat(code, permuted_text(rest, key, "phone"))))


def _email(value: Column, key: str) -> Column:
    at = F.instr(value, "@")
    return F.concat(permuted_text(F.substring(value, F.lit(1), at - 1), key, "email"), F.substring(value, at, F.length(value)))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a matched value, or null where it is not valid as any kind; the first that fits decides."""
    makers = {"email": _email, "ip": _ip, "date": _date, "iban": _iban, "ssn": _ssn, "phone": _phone, "card": _card}
    tried = [F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), makers[kind](value, key)) for kind in PATTERNS]
    return F.coalesce(*tried)


def _within(value: Column, key: str) -> Column:
    """``text, n`` of a value that is not valid as a whole: the phone and card numbers between group boundaries changed.

    Groups of digits are gone through from the left. At each, a phone number of three groups is taken, else the longest
    run of groups that is a card number with a right check digit, else the group stays.
    """
    groups = F.regexp_extract_all(value, F.lit(r"([0-9]+[^0-9]*|[^0-9]+)"), F.lit(1))
    phone = r"^[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}$"

    def over(groups: Column) -> Column:
        def tried(at: Column) -> Column:
            """``size, text`` of the number that begins at a group, or null."""
            run = lambda n: F.regexp_replace(F.array_join(F.slice(groups, at, n), ""), "[^0-9]+$", "")
            runs = F.transform(F.sequence(F.least(F.lit(19), F.size(groups) - at + 1), F.lit(1), F.lit(-1)), lambda n: F.struct(n.alias("size"), run(n).alias("text")))
            cards = F.filter(runs, lambda r: r["text"].rlike(f"^(?:{PATTERNS['card']})$"))
            cards = F.filter(cards, lambda r: _luhn(_digits(r["text"])) % 10 == 0)
            phones = F.filter(runs, lambda r: (r["size"] == 3) & r["text"].rlike(phone))
            return F.get(F.concat(phones, cards), F.lit(0))

        def step(s: Column, at: Column) -> Column:
            def going_on(found: Column) -> Column:
                new = F.when(found["text"].rlike(phone), _phone(found["text"], key)).otherwise(_card(found["text"], key))
                last = F.element_at(groups, (at + found["size"] - 1).cast("int"))
                after = F.regexp_extract(last, "([^0-9]*)$", 1)
                return F.when(
                    found.isNotNull(),
                    F.struct(F.concat(s["text"], new, after).alias("text"), (s["n"] + 1).alias("n"), (at + found["size"]).cast("int").alias("next")),
                ).otherwise(F.struct(F.concat(s["text"], F.element_at(groups, at)).alias("text"), s["n"].alias("n"), (at + 1).cast("int").alias("next")))

            # an array of one binds what is found, which is used several times
            return F.when(at < s["next"], s).otherwise(F.get(F.transform(F.array(tried(at)), going_on), F.lit(0)))

        none = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("next"))
        return F.aggregate(F.sequence(F.lit(1), F.size(groups)), none, step)

    return F.get(F.transform(F.array(groups), over), F.lit(0))


def pseudonymise(docs: DataFrame, key: str, text_column: str = "text", count_column: str = "n_replaced") -> DataFrame:
    """The rows with pseudonyms in their texts, and the number of values replaced in a new last column.

    A null text stays null and an empty one empty, with 0. Texts are read whole and can be of any length; every
    character outside the values stays. Rows repeated whole stay equal. An empty table gives no rows.
    """
    if count_column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the input has a column {count_column}")
    text = F.col(text_column)
    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(MARK + LITERAL)), F.lit(ANY), F.lit(f"{MARK}{FOUND}$0{MARK}{PLAIN}"))
    pieces = F.split(F.concat(F.lit(PLAIN), marked), MARK)

    def changed(piece: Column) -> Column:
        kind, rest = F.substring(piece, 1, 1), F.substring(piece, F.lit(2), F.length(piece))
        whole = lambda text, n: F.struct(text.alias("text"), F.lit(n).cast("bigint").alias("n"))
        plain = F.when(kind == LITERAL, F.concat(F.lit(MARK), rest)).otherwise(rest)

        def of(new: Column) -> Column:
            inner = lambda p: F.struct(p["text"].alias("text"), p["n"].alias("n"))
            within = F.get(F.transform(F.array(_within(rest, key)), inner), F.lit(0))
            return F.when(new.isNotNull(), whole(new, 1)).when(F.length(_digits(rest)) >= 13, within).otherwise(whole(rest, 0))

        found = F.get(F.transform(F.array(pseudonym(rest, key)), of), F.lit(0))
        return F.when(kind == FOUND, found).otherwise(whole(plain, 0))

    done = F.when(text.rlike("[0-9@]"), F.transform(pieces, changed))
    name = free_name(docs.columns, "_pieces")
    rows = docs.withColumn(name, done)
    whole = F.array_join(F.transform(F.col(name), lambda p: p["text"]), "")
    total = F.aggregate(F.col(name), F.lit(0).cast("bigint"), lambda s, p: s + p["n"])
    out = [F.coalesce(whole, text).alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*out, F.coalesce(total, F.lit(0)).cast("bigint").alias(count_column))
