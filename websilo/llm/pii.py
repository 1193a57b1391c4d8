"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame functions only.

One pattern finds candidates; each is validated (Luhn sum, octets, calendar,
number ranges) and a keyed Feistel network permutes it within its own format.
Equal values get equal pseudonyms in all documents, whatever their separators,
and ``reveal`` undoes it with the same key.

The network works on a pair (left, right) of residues modulo a and b:
in odd rounds left moves by a keyed hash of right modulo a, in even rounds right
moves by a keyed hash of left modulo b.  That is a permutation of a * b values,
so no cycle walking is needed:

====== =============================== ============================================
kind   valid if                        permuted values
====== =============================== ============================================
card   13-19 digits, Luhn sum          all digits but the last, which is set anew
phone  + and country code, or (ddd)    the last ten digits
ssn    ddd-dd-dddd in issued ranges    area 1-899 but 666, group 1-99, serial 1-9999
ip     four octets                     the 2**32 addresses
date   a day of 1800-2199              the 146,097 = 189 * 773 days of that cycle
email  local@domain                    the local part becomes a keyed hash (one way)
====== =============================== ============================================

Dates: yyyy-mm-dd, dd.mm.yyyy, and mm/dd/yyyy (day first where the first number
is over 12).  What fails validation stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import quoted, spare

ROUNDS = 10
KINDS = ("email", "ip", "date", "phone", "ssn", "card")
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9]|[/.-][0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)|[0-9]{3})|(?<![0-9])\([0-9]{3}\))[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\g[0-9]{4}\g[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])".replace(r"\g", "[ -]").replace("([ -])", "[ -]"),
}
ANY = "|".join(PATTERNS[k] for k in KINDS)
_EPOCH, _DAYS = "1800-01-01", 146_097


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, key: str, tweak: Column | str, undo: bool = False) -> Column:
    """A struct (l, r): the permutation of Z_a x Z_b for a key and a tweak."""
    lit = lambda x: F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")
    a, b, tweak = lit(a), lit(b), F.lit(tweak) if isinstance(tweak, str) else tweak

    def moved(by: Column, i: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), by.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")

    def turn(state: Column, i: Column) -> Column:
        odd = i % 2 == 1
        by_right, by_left = moved(state["r"], i) % a, moved(state["l"], i) % b
        if undo:
            by_right, by_left = a - by_right, b - by_left
        return F.struct(
            F.when(odd, (state["l"] + by_right) % a).otherwise(state["l"]).alias("l"),
            F.when(odd, state["r"]).otherwise((state["r"] + by_left) % b).alias("r"),
        )

    order = range(ROUNDS, 0, -1) if undo else range(1, ROUNDS + 1)
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in order]), start, turn)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(text: Column, digits: Column) -> Column:
    """text with its digits replaced in turn."""
    def one(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        seen = F.length(_digits(F.substring(text, F.lit(1), i)))
        return F.when(c.rlike("^[0-9]$"), F.substring(digits, seen, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")


def permute_digits(digits: Column, key: str, tweak: str, undo: bool = False) -> Column:
    """A permutation of the digit strings of each length from 2 to 18."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    power = lambda x: F.rpad(F.lit("1"), x + 1, "0").cast("long")
    left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n - half)
    out = feistel(left.try_cast("long"), right.try_cast("long"), power(half), power(n - half), key,
                  F.concat(F.lit(tweak), n.cast("string")), undo)
    return _let(out, lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), n - half, "0")))


def luhn_sum(digits: Column, shift: int) -> Column:
    """Sum with every other digit doubled; the last digit is doubled if shift is 1."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).try_cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((i + shift) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _card(m: Column, key: str, undo: bool) -> Column:
    def changed(d: Column) -> Column:
        body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", undo)
        done = _let(body, lambda b: F.concat(b, ((10 - luhn_sum(b, 1) % 10) % 10).cast("string")))
        return F.when(luhn_sum(d, 0) % 10 == 0, _refill(m, done))

    return _let(_digits(m), changed)


def _phone(m: Column, key: str, undo: bool) -> Column:
    def changed(d: Column) -> Column:
        country = F.substring(d, F.lit(1), F.length(d) - 10)
        return _refill(m, F.concat(country, permute_digits(F.substring(d, F.length(d) - 9, F.lit(10)), key, "phone", undo)))

    return _let(_digits(m), changed)


def _ssn(m: Column, key: str, undo: bool) -> Column:
    area, group, serial = (F.substring(m, *at).try_cast("int") for at in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    left = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1

    def shown(s: Column) -> Column:
        a = F.floor(s["l"] / 99)
        a = a + F.when(a + 1 >= 666, 2).otherwise(1)
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat(pad(a, 3), F.lit("-"), pad(s["l"] % 99 + 1, 2), F.lit("-"), pad(s["r"] + 1, 4))

    return F.when(valid, _let(feistel(left, serial - 1, 898 * 99, 9999, key, "ssn", undo), shown))


def _ip(m: Column, key: str, undo: bool) -> Column:
    o = [F.split_part(m, F.lit("."), F.lit(i)).try_cast("int") for i in (1, 2, 3, 4)]
    out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip", undo)
    parts = lambda s: [F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256]
    return _let(out, lambda s: F.concat_ws(".", *[x.cast("string") for x in parts(s)]))


def _date(m: Column, key: str, undo: bool) -> Column:
    iso, dot = m.rlike("^[0-9]{4}-"), m.contains(".")
    sep = F.when(iso, "-").when(dot, ".").otherwise("/")
    p = [F.split_part(m, sep, F.lit(i)) for i in (1, 2, 3)]
    month_first = ~iso & ~dot & (p[0].try_cast("int") <= 12)
    y = F.when(iso, p[0]).otherwise(p[2])
    mo = F.when(iso | ~month_first, p[1]).otherwise(p[0])
    d = F.when(iso, p[2]).when(month_first, p[1]).otherwise(p[0])
    pad = lambda x: F.lpad(x, 2, "0")
    day = F.concat_ws("-", y, pad(mo), pad(d)).try_cast("date")
    index = F.date_diff(day, F.lit(_EPOCH).cast("date"))

    def shown(s: Column) -> Column:
        new = F.date_add(F.lit(_EPOCH).cast("date"), (s["l"] * 773 + s["r"]).cast("int"))
        fmt = lambda f: F.date_format(new, f)
        return F.when(iso, fmt("yyyy-MM-dd")).when(dot, fmt("dd.MM.yyyy")).when(month_first, fmt("MM/dd/yyyy")).otherwise(fmt("dd/MM/yyyy"))

    inside = day.isNotNull() & (index >= 0) & (index < _DAYS)
    return F.when(inside, _let(feistel(F.floor(index / 773), index % 773, 189, 773, key, "date", undo), shown))


def _email(m: Column, key: str, undo: bool) -> Column:
    if undo:
        return F.lit(None).cast("string")
    local = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 12)
    return F.concat(F.lit("u"), local, F.lit("@"), F.split_part(m, F.lit("@"), F.lit(2)))


_CHANGE = {"email": _email, "ip": _ip, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}


def _kind(m: Column) -> Column:
    out = F.when(m.contains("@"), "email")
    for k in KINDS[1:]:
        out = out.when(m.rlike(f"^(?:{PATTERNS[k]})$"), k)
    return out


def _found(text: Column, key: str, undo: bool) -> Column:
    """array<struct<old, kind, new>>: the candidates of a text in turn; new is null where validation fails."""
    def one(m: Column) -> Column:
        def done(kind: Column) -> Column:
            new = F.lit(None).cast("string")
            for k in reversed(KINDS):
                new = F.when(kind == k, _CHANGE[k](m, key, undo)).otherwise(new)
            return F.struct(m.alias("old"), kind.alias("kind"), new.alias("new"))

        return _let(_kind(m), done)

    return F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), one)


def _of_kind(kind: str):
    return lambda f: (f["kind"] == kind) & f["new"].isNotNull()


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", undo: bool = False, counts: bool = False) -> DataFrame:
    """docs with the text's numbers, dates and mail addresses replaced; with ``counts``, a column n_<kind> for each kind.

    The key is a secret of the caller's; a text without digits and @ isn't
    searched.  A null text stays null (counts 0), an empty one empty; texts are
    treated whole, however long, rows one by one, without a shuffle; repeated rows
    alike.  Columns of docs named n_<kind> are replaced if counts are asked for; other
    columns stay as they are, whatever their names.  An empty table gives no rows.
    """
    text = F.col(text_col)
    hunted = text.rlike("[0-9@]")
    found = spare(docs, "found")
    out = docs.withColumn(found, F.when(hunted, _found(text, key, undo)))
    gaps = F.split(text, ANY, -1)
    new = F.zip_with(gaps, F.col(found), lambda gap, f: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(f["new"], f["old"], F.lit(""))))
    out = out.withColumn(text_col, F.when(F.size(F.col(found)) > 0, F.array_join(new, "")).otherwise(text))
    if counts:
        for k in KINDS:
            n = F.size(F.filter(found, _of_kind(k)))
            out = out.withColumn(f"n_{k}", F.when(F.col(found).isNull(), 0).otherwise(n).cast("long"))
    extra = [f"n_{k}" for k in KINDS if counts and f"n_{k}" not in docs.columns]
    return out.select(*quoted(docs), *extra)


def reveal(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Undo pseudonymise with its key; mail addresses stay as they are."""
    return pseudonymise(docs, key, text_col, undo=True)
