"""Values of header fields as column functions: forms, dates, digests, media types.

Byte strings are searched as ISO-8859-1 text, in which a character is a byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters of a token (RFC 2616), as a class.
TOKEN = r"[!#$%&'*+\-.0-9A-Z^_`a-z|~]"
#: Java's matcher goes one call deeper for each turn of a repeated group, so only classes of characters are repeated
#: here, without backtracking: values may be a megabyte long.
_CONTROL = r"\x00-\x08\x0A-\x1F\x7F"
_QUOTED = rf'"[^"\\{_CONTROL}]*+"'
_PARAMETER = rf"(?<![ \t])[ \t]*+;[ \t]*+{TOKEN}++=(?:{TOKEN}++|{_QUOTED})"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H16 = r"[0-9A-Fa-f]{1,4}"
_LS32 = rf"(?:{_H16}:{_H16}|{_IPV4})"
_IPV6 = "|".join(
    [rf"(?:{_H16}:){{6}}{_LS32}", rf"::(?:{_H16}:){{5}}{_LS32}"]
    + [rf"(?:(?:{_H16}:){{0,{n}}}{_H16})?::(?:{_H16}:){{{4 - n}}}{_LS32}" for n in range(5)]
    + [rf"(?:(?:{_H16}:){{0,5}}{_H16})?::{_H16}", rf"(?:(?:{_H16}:){{0,6}}{_H16})?::"]
)
_NAME = r"A-Za-z0-9\-._~!$&'()*+,;=%"
#: An RFC 3986 URI with a scheme, once its percent signs are known to be in order.
URI = (rf"[A-Za-z][A-Za-z0-9+\-.]*+:(?://(?:[{_NAME}:]*+@)?(?:\[[0-9A-Fa-fvV:.]++\]|[{_NAME}]*+)(?::[0-9]*+)?(?:/[{_NAME}:@/]*+)?"
       rf"|/(?:[{_NAME}:@][{_NAME}:@/]*+)?|[{_NAME}:@][{_NAME}:@/]*+|)(?:\?[{_NAME}:@/?]*+)?(?:#[{_NAME}:@/?]*+)?")


def latin(b: Column) -> Column:
    return F.decode(b, "ISO-8859-1")


def full(text: Column, pattern: str) -> Column:
    return text.rlike(rf"\A(?:{pattern})\z")


def trim_space(text: Column, chars: str = " \t\r\n") -> Column:
    return F.btrim(text, F.lit(chars))


def unfold(value: Column) -> Column:
    """Bytes without white space around them and with each fold as one blank, as ISO-8859-1 text."""
    return F.regexp_replace(trim_space(latin(value)), "\r\n[ \t]+", " ")


def utf8(text: Column) -> Column:
    """ISO-8859-1 text read again as UTF-8; null if it isn't valid."""
    return F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string"))


def is_token(text: Column) -> Column:
    return full(text, TOKEN + "++")


def bare_uri(text: Column) -> Column:
    """A URI without the angle brackets around it; null if it isn't one."""
    inner = F.when(text.startswith("<") & text.endswith(">") & (F.length(text) > 1), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    return F.when(full(inner, URI) & ~inner.rlike("%(?![0-9A-Fa-f]{2})"), inner)


def is_ip(text: Column) -> Column:
    return full(text, f"{_IPV4}|{_IPV6}")


def digits(text: Column) -> Column:
    """A count up to 2**64 - 1; null if it isn't one."""
    t = trim_space(text, " \t")
    n = F.when(t.rlike(r"\A[0-9]{1,38}\z"), t).try_cast("decimal(38,0)")
    return F.when(n < F.lit(str(1 << 64)).cast("decimal(38,0)"), n.cast("decimal(20,0)"))


_ANY_DATE = r"[0-9]{4}(?:-[0-9]{2}(?:-[0-9]{2}(?:T[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?Z)?)?)?"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that filters stay above: pushed below them, they'd spell out again all that the columns are made of."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _instant(text: Column) -> Column:
    """The timestamp of a date in any layout, in whole seconds; null if it isn't one."""
    bare = F.regexp_replace(text, r"(?:\.[0-9]+)?Z\z", "")
    whole = F.concat(bare, F.substring(F.lit("0000-01-01T00:00:00"), F.length(bare) + 1, F.lit(19)))
    good = full(text, _ANY_DATE) & whole.rlike(r"T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\z") & ~whole.startswith("0000")
    return F.when(good, F.concat(whole, F.lit("Z"))).try_cast("timestamp")


def is_date(text: Column) -> Column:
    return _instant(text).isNotNull()


def date(text: Column, version: Column | str = "1.1") -> Column:
    """struct(ts, nanos, precision, digits, text), or null: 1.0 has seconds only, 1.1 all precisions; no leap second."""
    version = F.lit(version) if isinstance(version, str) else version

    def read(t: Column) -> Column:
        part = F.regexp_extract(t, r"\.([0-9]+)Z\z", 1)
        precision = F.when(part != "", "fraction").otherwise(
            F.try_element_at(F.create_map(*[F.lit(x) for x in (4, "year", 7, "month", 10, "day", 17, "minute", 20, "second")]), F.length(t)))
        made = F.struct(_instant(t).alias("ts"), F.coalesce(F.rpad(part, 9, "0").try_cast("int"), F.lit(0)).alias("nanos"),
                        precision.alias("precision"), F.length(part).alias("digits"), t.alias("text"))
        return F.when(is_date(t) & ((version != "1.0") | (F.length(t) == 20) & (part == "")), made)

    return let(text, read)


def show_date(d: Column, version: Column | str = "1.1") -> Column:
    """A date struct as a version writes it: 1.0 always in seconds, 1.1 in its own precision."""
    version = F.lit(version) if isinstance(version, str) else version
    fmt = lambda f: F.date_format(d["ts"], f)
    second = fmt("yyyy-MM-dd'T'HH:mm:ss'Z'")
    p = d["precision"]
    own = F.when(p == "year", fmt("yyyy")).when(p == "month", fmt("yyyy-MM")).when(p == "day", fmt("yyyy-MM-dd"))
    own = own.when(p == "minute", fmt("yyyy-MM-dd'T'HH:mm'Z'")).when(p == "fraction", F.concat(
        fmt("yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.substring(F.lpad(d["nanos"].cast("string"), 9, "0"), F.lit(1), d["digits"]), F.lit("Z")))
    return F.when(version == "1.0", second).otherwise(own.otherwise(second))


def made_date(ts: Column, precision: Column | str, nanos: Column | None = None, digits: Column | int = 0) -> Column:
    """A date struct of a timestamp and a precision: what is finer is cut off, and a fraction has one to nine digits.

    ``nanos``: of the second; by default those of the timestamp.  Null outside the years 1 to 9999.
    """
    precision = F.lit(precision) if isinstance(precision, str) else precision
    nanos = nanos if nanos is not None else F.pmod(F.unix_micros(ts), F.lit(1_000_000)) * 1000
    n = F.when(precision == "fraction", F.least(F.greatest(F.lit(digits) if isinstance(digits, int) else digits, F.lit(1)), F.lit(9))).otherwise(0)
    unit = F.when(precision == "fraction", "second").otherwise(precision)
    whole = F.date_trunc("second", ts)
    for name in ("minute", "day", "month", "year"):
        whole = F.when(unit == name, F.date_trunc(name, ts)).otherwise(whole)
    step = F.pow(F.lit(10), 9 - n).cast("long")
    kept = F.when(precision == "fraction", nanos - F.pmod(nanos, step)).otherwise(0).cast("int")
    bare = F.struct(whole.alias("ts"), kept.alias("nanos"), precision.alias("precision"), n.cast("int").alias("digits"))
    known = precision.isin("year", "month", "day", "minute", "second", "fraction") & F.year(ts).between(1, 9999)
    return F.when(known, let(bare, lambda d: F.struct(*[d[c].alias(c) for c in ("ts", "nanos", "precision", "digits")], show_date(d).alias("text"))))


def date_of(ts: Column) -> Column:
    """A date struct of a timestamp in the shortest form that keeps the instant: seconds, or as many digits as it needs."""
    nanos = F.pmod(F.unix_micros(ts), F.lit(1_000_000)) * 1000
    text = F.lpad(nanos.cast("string"), 9, "0")
    digits = F.length(F.rtrim(text, F.lit("0")))
    return made_date(ts, F.when(nanos == 0, "second").otherwise("fraction"), nanos, digits)


_ALGORITHMS = {"md5": "md5", "sha1": "sha1", "sha-1": "sha1", "sha256": "sha256", "sha-256": "sha256"}
_SIZES = {"md5": 16, "sha1": 20, "sha256": 32}


def algorithm_of(label: Column) -> Column:
    """The algorithm of a label: md5, sha1, sha256, or the label in lower case."""
    out = F.lower(label)
    for name, algorithm in _ALGORITHMS.items():
        out = F.when(F.lower(label) == name, algorithm).otherwise(out)
    return out


def recommended_encoding(algorithm: Column) -> Column:
    """base32 for sha1, base16 for others."""
    return F.when(algorithm == "sha1", "base32").otherwise("base16")


def digest(text: Column) -> Column:
    """struct(algorithm, label, value) of ``label:value``; null if it isn't a labelled digest."""
    label, value = F.substring_index(text, ":", 1), F.regexp_replace(text, r"\A[^:]*:", "")
    good = text.contains(":") & is_token(label) & full(value, TOKEN[:-1] + "=/]++")
    return F.when(good, F.struct(algorithm_of(label).alias("algorithm"), label.alias("label"), value.alias("value")))


def digest_error(text: Column) -> Column:
    label, value = F.substring_index(text, ":", 1), F.regexp_replace(text, r"\A[^:]*:", "")
    q = lambda a, c, b: F.concat(F.lit(a), c, F.lit(b))
    return (
        F.when(~text.contains(":"), q("no labelled digest: `:` is missing in `", text, "`"))
        .when(~is_token(label), q("no labelled digest: `", label, "` can't be a label"))
        .when(~full(value, TOKEN[:-1] + "=/]++"), q("no labelled digest: `", value, "` can't be a value"))
    )


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


#: Digits of conv to base 32, five bytes of which are eight digits.
_DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def _by_groups(text: Column, size: int, one) -> Column:
    """one() of each ``size`` characters of text, joined; text is computed once."""
    return let(text, lambda t: F.array_join(F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.length(t) / size).cast("int") - 1, F.lit(0))), lambda i: one(F.substring(t, i * size + 1, F.lit(size)))), ""))


def base32(b: Column) -> Column:
    """Upper-case Base32 of bytes, padded to eight characters."""
    def shown(h: Column) -> Column:
        n = F.ceil(F.length(h) * 4 / 5).cast("int")
        text = _by_groups(h, 10, lambda g: F.translate(F.lpad(F.conv(F.rpad(g, 10, "0"), 16, 32), 8, "0"), _DIGITS32, _BASE32))
        return F.when(h == "", "").otherwise(F.rpad(F.substring(text, F.lit(1), n), (F.ceil(n / 8) * 8).cast("int"), "="))

    return let(F.hex(b), shown)


def _unbase32(text: Column) -> Column:
    def read(t: Column) -> Column:
        n = F.floor(F.length(t) * 5 / 8).cast("int")
        return F.substring(_by_groups(t, 8, lambda g: F.lpad(F.conv(F.translate(F.rpad(g, 8, "A"), _BASE32, _DIGITS32), 32, 16), 10, "0")), F.lit(1), n * 2)

    return F.unhex(let(F.upper(F.rtrim(text, F.lit("="))), read))


def decoded(d: Column) -> Column:
    """Bytes of a digest struct: the one encoding (hex, Base32, Base64) that fits its length; null if none does."""
    size = F.lit(None).cast("int")
    for name, n in _SIZES.items():
        size = F.when(d["algorithm"] == name, n).otherwise(size)
    v = d["value"]
    bare = F.rtrim(v, F.lit("="))
    pads = F.length(v) - F.length(bare)
    n32, n64 = F.ceil(size * 8 / 5).cast("int"), F.ceil(size * 8 / 6).cast("int")
    fits = lambda n, block: (pads == 0) | ((n + pads) % block == 0) & (pads < block)
    as_hex = (F.length(v) == size * 2) & v.rlike("^[0-9A-Fa-f]+$")
    as_32 = (F.length(bare) == n32) & bare.rlike("^[A-Za-z2-7]+$") & fits(n32, 8)
    as_64 = (F.length(bare) == n64) & bare.rlike("^(?:[A-Za-z0-9+/]+|[A-Za-z0-9_-]+)$") & fits(n64, 4)
    std = F.translate(bare, "-_", "+/")
    return (F.when(as_hex, F.unhex(v)).when(as_32, _unbase32(v))
            .when(as_64, F.try_to_binary(F.rpad(std, (F.ceil(n64 / 4) * 4).cast("int"), "="), F.lit("base64"))))


def computed(algorithm: Column, body: Column) -> Column:
    """Digest bytes of a block under md5, sha1 or sha256; null for others."""
    return (F.when(algorithm == "md5", F.unhex(F.md5(body))).when(algorithm == "sha1", F.unhex(F.sha1(body)))
            .when(algorithm == "sha256", F.unhex(F.sha2(body, 256))))


def labelled(algorithm: Column | str, value: Column) -> Column:
    """A digest's text in the recommended encoding: Base32 for sha1, lower-case hex for others."""
    algorithm = F.lit(algorithm) if isinstance(algorithm, str) else algorithm
    return F.concat(algorithm, F.lit(":"), F.when(algorithm == "sha1", base32(value)).otherwise(F.lower(F.hex(value))))


def digest_key(d: Column) -> Column:
    """Equal for equal digests, whatever their encoding: algorithm and bytes, else the text."""
    return F.concat(d["algorithm"], F.lit(":"), F.coalesce(F.lower(F.hex(decoded(d))), F.concat(F.lit("="), d["value"])))


#: Characters of private use that stand for an escaped backslash, an escaped quote, and the backslash before another character.
_SLASH, _QUOTE, _ESCAPE = "\uE002", "\uE001", "\uE000"


def _masked(text: Column) -> Column:
    """text with its escapes as characters of private use, so that quoted strings are runs of a class."""
    text = F.regexp_replace(F.regexp_replace(text, r"\\\\", _SLASH), r'\\"', _QUOTE)
    return F.regexp_replace(text, rf"\\([^{_CONTROL}])", _ESCAPE + "$1")


def _unmasked(text: Column) -> Column:
    return F.translate(text, _SLASH + _QUOTE + _ESCAPE, '\\"')


def _shown(text: Column) -> Column:
    """Masked text as it was."""
    for c, was in ((_SLASH, "\\\\"), (_QUOTE, '\\"'), (_ESCAPE, "\\")):
        text = F.replace(text, F.lit(c), F.lit(was))
    return text


_ESSENCE = rf"\A({TOKEN}++)/({TOKEN}++)"


def _leftover(text: Column) -> Column:
    """What stands in masked text behind type and subtype and isn't a parameter."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(text, _ESSENCE, ""), _PARAMETER, ""), F.lit(" \t"))


def media_type(text: Column) -> Column:
    """struct(type, subtype, parameters array<struct<name, value, quoted, separator>>); null if it isn't a media type."""
    def read(t: Column) -> Column:
        good = t.rlike(_ESSENCE) & (_leftover(t) == "")
        raw = F.regexp_extract_all(t, F.lit(_PARAMETER), F.lit(0))

        def one(p: Column) -> Column:
            name = F.regexp_replace(F.substring_index(p, "=", 1), r"\A[ \t]*+;[ \t]*+", "")
            value = F.regexp_replace(p, r"\A[^=]*+=", "")
            plain = _unmasked(F.regexp_replace(value, r'\A"|"\z', ""))
            return F.struct(name.alias("name"), F.when(value.startswith('"'), plain).otherwise(value).alias("value"),
                            value.startswith('"').alias("quoted"), F.regexp_extract(p, r"\A([ \t]*+;[ \t]*+)", 1).alias("separator"))

        return F.when(good, F.struct(F.regexp_extract(t, _ESSENCE, 1).alias("type"), F.regexp_extract(t, _ESSENCE, 2).alias("subtype"),
                                     F.transform(raw, one).alias("parameters")))

    return let(_masked(text), read)


def media_type_error(text: Column) -> Column:
    q = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    essence = F.regexp_extract(text, r"\A([^;]*)", 1)
    rest = _leftover(_masked(text))
    return (
        F.when(~essence.contains("/"), q("no media type: `/` is missing in `", text, "`"))
        .when(~full(trim_space(essence), rf"{TOKEN}++/{TOKEN}++"), q("no media type: in `", text, "` type or subtype is no token"))
        .when(rest != "", q("no media type: `", trim_space(_shown(F.regexp_replace(rest, r"\A[ \t]*;", ""))), "` is no parameter, in `", text, "`"))
    )


def quoted(text: Column) -> Column:
    """text as a quoted string."""
    return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))


def show_media_type(m: Column) -> Column:
    """A media type struct as text: parameters as they were read, or behind ``; `` and quoted where they are no token."""
    def one(p: Column) -> Column:
        bare = ~F.coalesce(p["quoted"], F.lit(False)) & is_token(p["value"])
        return F.concat(F.coalesce(p["separator"], F.lit("; ")), p["name"], F.lit("="), F.when(bare, p["value"]).otherwise(quoted(p["value"])))

    parameters = F.coalesce(F.array_join(F.transform(m["parameters"], one), ""), F.lit(""))
    return F.concat(m["type"], F.lit("/"), m["subtype"], parameters)


def show_text(t: Column) -> Column:
    """A text struct as it stands in a field."""
    return F.when(t["quoted"], quoted(t["content"])).otherwise(t["content"])


def is_media_type(m: Column, type_: str, subtype: str) -> Column:
    return (F.lower(m["type"]) == type_) & (F.lower(m["subtype"]) == subtype)


def parameter(m: Column, name: str) -> Column:
    """The first parameter of a name, in any case."""
    return F.try_element_at(F.filter(m["parameters"], lambda p: F.lower(p["name"]) == name.lower()), F.lit(1))["value"]


def text_value(text: Column) -> Column:
    """struct(content, quoted) of TEXT or a quoted string; null if it has control characters or ends badly."""
    quoted = text.startswith('"')

    def read(t: Column) -> Column:
        good = F.when(quoted, full(t, _QUOTED)).otherwise(~text.rlike(f"[{_CONTROL}]"))
        content = F.when(quoted, _unmasked(F.regexp_replace(t, r'\A"|"\z', ""))).otherwise(text)
        return F.when(good, F.struct(content.alias("content"), quoted.alias("quoted")))

    return let(_masked(text), read)


def unquoted(text: Column) -> Column:
    """struct(content, error, at) of a quoted string: its content without quotes and escapes, or what is wrong and at which byte."""
    def read(t: Column) -> Column:
        inner = F.regexp_extract(t, rf'\A"([^"\\{_CONTROL}]*+)', 1)
        before = F.octet_length(_shown(inner)) + 1  # with the opening quote
        after = F.substring(t, F.length(inner) + 2, F.length(t))
        kind = (F.when(~t.startswith('"'), "no opening quote").when(after == "", "no closing quote")
                .when(after.startswith("\\"), F.when(F.length(after) == 1, "no character behind a backslash").otherwise("control character"))
                .when(~after.startswith('"'), "control character").when(F.length(after) > 1, "text behind the closing quote"))
        at = F.when(kind == "no opening quote", 0).when(kind == "text behind the closing quote", before + 1).otherwise(before)
        return F.struct(F.when(kind.isNull(), _unmasked(inner)).alias("content"), kind.alias("error"), F.when(kind.isNotNull(), at).cast("long").alias("at"))

    return let(_masked(text), read)


def record_type(token: Column) -> Column:
    return F.lower(token)


def truncation(token: Column) -> Column:
    return F.lower(token)


def truncation_kind(token: Column, further: tuple[str, ...] = ()) -> Column:
    """standard, extension (one of ``further``) or unknown."""
    from ..schema import TRUNCATIONS

    t = F.lower(token)
    return F.when(t.isin(*TRUNCATIONS), "standard").when(t.isin(*[x.lower() for x in further]), "extension").when(t.isNotNull(), "unknown")


def revisit_profile(uri: Column) -> Column:
    """identical-payload-digest, server-not-modified or other."""
    from ..schema import IDENTICAL, NOT_MODIFIED

    return F.when(uri.isin(*IDENTICAL), "identical-payload-digest").when(uri.isin(*NOT_MODIFIED), "server-not-modified").when(uri.isNotNull(), "other")


#: The letters of hops from a seed.
HOPS = "LEXRPIMS"


def hops(text: Column) -> Column:
    """struct(hops array<string>, is_seed, error): an empty path is a seed; a letter that names no hop is an error."""
    bad = F.regexp_extract(text, f"[^{HOPS}]", 0)
    at = F.octet_length(F.regexp_extract(text, f"\\A([{HOPS}]*)", 1))
    return F.struct(
        F.when(bad == "", F.filter(F.split(text, ""), lambda c: c != "")).alias("hops"), (text == "").alias("is_seed"),
        F.when(bad != "", F.concat(F.lit("`"), bad, F.lit("` at byte "), at.cast("string"), F.lit(" is the letter of no hop."))).alias("error"))
