"""Private numbers, dates and names of accounts replaced by keyed pseudonyms, in DataFrame functions.

Each value found is checked (Luhn digit, octets, calendar) and goes through a Feistel network over
its own domain: two halves take turns, each adding a keyed hash of the other modulo its own size. So the
result is a permutation that keeps the format: a card number stays a valid card number, a date a date.
Equal values have equal pseudonyms in all documents, whichever way an IPv6 address or a French or German number is written. E-mail addresses and
secrets (pass words told in four languages, tokens of known heads, key blocks), which have no number format, become keyed digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: What is looked for, in order of precedence.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "block": r"-----BEGIN (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=:,\s-]{1,32768}?-----END (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY-----",
    "token": r"\b(?:gh[opsru]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|\b(?i:token|secret|api[_-]?key|password|passwd|pwd)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}"
    r"|(?<![\p{L}\p{N}])(?i:passwort|kennwort|contraseña|contrasena|clave|mot de passe|mdp)\s{0,3}[=:]\s{0,3}[\"']?(?=[A-Za-z+/_-]*\d)[A-Za-z0-9+/_-]{8,}",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{0,39}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{4}:(?:[0-9A-Fa-f]{1,4}:){0,5}(?:(?::[0-9A-Fa-f]{1,4}){1,6}|:))(?![0-9A-Za-z:]|\.\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "date": r"(?<![\d-])[12]\d{3}-[01]\d-[0-3]\d(?![\d-])|(?<![\d./])[12]\d{3}(?:/[01]?\d/[0-3]?\d|\.[01]?\d\.[0-3]?\d)(?![\d/]|\.\d)"
    r"|(?<![\d./-])(?:[0-3]?\d/[0-3]?\d/|[0-3]?\d\.[0-3]?\d\.|[0-3]?\d-[0-3]?\d-)[12]\d{3}(?![\d-]|[./]\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "card": r"(?<![\d])[1-9]\d{3}(?:(?:[ -]?\d{4}){2}[ -]?\d{1,7}|[ -]\d{6}[ -]\d{4,5})(?![\d])",
    "phone": r"(?<![\d])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "abroad": r"(?<![\d+])\+[2-9](?:[ ./()-]{0,2}\d){6,13}(?!\d)|(?<![\d.,])00 ?[2-9]\d{0,2}[ ./-](?:[ ./()-]{0,2}\d){5,12}(?!\d)"
    r"|(?<![\d.,+])0[1-9](?:[ .-]\d{2}){4}(?![\d.-])|(?<![\d.,+-])0[1-9]\d{1,3}[ /-]\d{5,8}(?![\d-])",
}
ROUNDS = 10
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Dates are permuted within 200 years, counted from this one: 280 x 261 cells hold their days.
FIRST_YEAR, HALVES = 1900, (280, 261)


def _hash(key: str, *parts: Column) -> Column:
    """A keyed 60-bit number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts), 256), 1, 15), 16, 10).cast("bigint")


def feistel(key: str, kind: str | Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """The struct (l, r) that the network makes of left (below a) and right (below b)."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        l_new = F.pmod(s["l"] + F.pmod(_hash(key, kind, i.cast("string"), a.cast("string"), b.cast("string"), s["r"].cast("string")), a), a)
        r_new = F.pmod(s["r"] + F.pmod(_hash(key, kind, i.cast("string"), a.cast("string"), b.cast("string"), s["l"].cast("string")), b), b)
        return F.when(i % 2 == 1, F.struct(l_new.cast("bigint").alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), r_new.cast("bigint").alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _pad(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), F.lit(n) if isinstance(n, int) else n, F.lit("0"))


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("bigint")


def _sum_luhn(payload: Column) -> Column:
    """Digit sum with every second digit doubled, from the last."""
    back = F.split(F.reverse(payload), "")
    one = lambda d, i: F.when(i % 2 == 1, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int"))
    return F.aggregate(F.transform(F.filter(back, lambda d: d != ""), one), F.lit(0), lambda s, x: s + x)


def _check_digit(payload: Column) -> Column:
    return ((10 - _sum_luhn(payload) % 10) % 10).cast("string")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order."""
    step = lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(digits, s["i"], F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i")))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), step)["out"]


def _card(hit: Column, key: str) -> Column:
    def go(d: Column) -> Column:
        payload = F.substring(d, F.lit(1), F.length(d) - 1)
        half = F.floor(F.length(payload) / 2).cast("int")
        size = (F.length(payload) - half).cast("int")
        new = feistel(key, "card", F.substring(payload, F.lit(1), half).cast("bigint"), F.substring(payload, half + 1, size).cast("bigint"), _power(half), _power(size))
        out = _let(new, lambda s: F.concat(_pad(s["l"], half), _pad(s["r"], size)))
        full = _let(out, lambda p: F.concat(p, _check_digit(p)))
        return F.when(_check_digit(payload) == F.substring(d, -1, 1), _refill(hit, full)).otherwise(hit)

    return _let(_digits(hit), go)


def _phone(hit: Column, key: str) -> Column:
    """Area and exchange stay within 200 to 999, as the numbering plan has them; numbers outside it stay outside the plan's rule."""

    def go(d: Column) -> Column:
        head, own = F.substring(d, F.lit(1), F.length(d) - 10), F.substring(d, -10, 10)
        area, rest = F.substring(own, 1, 3).cast("bigint"), F.substring(own, 4, 7).cast("bigint")
        plan = (area >= 200) & (rest >= 2_000_000)
        inside = feistel(key, "phone", area - 200, rest - 2_000_000, F.lit(800), F.lit(8_000_000))
        outside = feistel(key, "line", area, rest, F.lit(1000), F.lit(10_000_000))
        put = lambda a, r: _refill(hit, F.concat(head, _pad(a, 3), _pad(r, 7)))
        return F.when(plan, _let(inside, lambda s: put(s["l"] + 200, s["r"] + 2_000_000))).otherwise(_let(outside, lambda s: put(s["l"], s["r"])))

    return _let(_digits(hit), go)


def _abroad(hit: Column, key: str) -> Column:
    """The first two digits (four after 00) stay, so the country mostly does; French and German numbers keep theirs, with or without the national 0.

    Of these two the digits behind country and 0 are permuted, the first of them never 0, so one number has one pseudonym in its
    national and its international form. National numbers in pairs are French, those of an area and a line German.
    """
    pairs = hit.rlike(r"^0[1-9](?:[ .-]\d{2}){4}$")

    def go(d: Column) -> Column:
        head = F.when(d.startswith("00"), 4).otherwise(2)
        half = F.floor((F.length(d) - head) / 2).cast("int")
        size = (F.length(d) - head - half).cast("int")
        new = feistel(key, "abroad", F.substring(d, head + 1, half).cast("bigint"), F.substring(d, head + half + 1, size).cast("bigint"), _power(half), _power(size))
        return _let(new, lambda s: _refill(hit, F.concat(F.substring(d, F.lit(1), head), _pad(s["l"], half), _pad(s["r"], size))))

    def known(d: Column) -> Column:
        national = d.rlike("^0[1-9]")
        head = F.when(national, F.lit("0")).otherwise(F.regexp_extract(d, "^(?:00)?(?:33|49)0?", 0))
        own = F.substring(d, F.length(head) + 1, F.length(d))
        land = F.when(F.when(national, pairs).otherwise(head.rlike("^(?:00)?33")), F.lit("33")).otherwise(F.lit("49"))

        def put(x: Column) -> Column:
            half = F.floor(F.length(x["own"]) / 2).cast("int")
            size = (F.length(x["own"]) - half).cast("int")
            low = _power(half - 1)
            new = feistel(key, F.concat(F.lit("land"), x["land"]), F.substring(x["own"], F.lit(1), half).cast("bigint") - low, F.substring(x["own"], half + 1, size).cast("bigint"), 9 * low, _power(size))
            return _let(new, lambda s: _refill(hit, F.concat(x["head"], (s["l"] + low).cast("string"), _pad(s["r"], size))))

        return _let(F.struct(head.alias("head"), own.alias("own"), land.alias("land")), put)

    return _let(_digits(hit), lambda d: F.when(d.rlike(r"^(?:0|(?:00)?(?:33|49)0?)[1-9]\d{3,}$"), known(d)).otherwise(go(d)))


def _ipv6(hit: Column, key: str) -> Column:
    """All 128 bits are permuted: the low half under the high one's name, then the high half under the new low one's. Shown in full, so all forms of an address are one.

    Texts that are no address (more than eight groups, or none left out of fewer) stay.
    """
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    number = lambda g: F.conv(g, 16, 10).cast("bigint")
    before, after = groups(F.substring_index(hit, "::", 1)), groups(F.when(hit.contains("::"), F.substring_index(hit, "::", -1)).otherwise(F.lit("")))
    left_out = 8 - F.size(before) - F.size(after)
    valid = (hit.contains("::") & (left_out > 0)) | (~hit.contains("::") & (left_out == 0))
    valid &= ~hit.rlike("::.*::|:::|^:[^:]|[^:]:$")
    words = F.transform(F.concat(before, F.array_repeat(F.lit("0"), F.greatest(left_out, F.lit(0))), after), number)
    quarter = lambda w, i: F.get(w, i) * 65536 + F.get(w, i + 1)
    name = lambda kind, l, r: F.concat_ws("|", F.lit(kind), l.cast("string"), r.cast("string"))
    side = F.lit(1 << 32)

    def put(w: Column) -> Column:
        high = lambda low: feistel(key, name("ipv6 high", low["l"], low["r"]), quarter(w, 0), quarter(w, 2), side, side)
        low = feistel(key, name("ipv6 low", F.concat_ws(":", *[F.get(w, i).cast("string") for i in range(2)]), F.concat_ws(":", *[F.get(w, i).cast("string") for i in range(2, 4)])), quarter(w, 4), quarter(w, 6), side, side)
        text = lambda h, o: F.lower(F.concat_ws(":", *[F.hex(x) for v in (h["l"], h["r"], o["l"], o["r"]) for x in (F.shiftright(v, 16), v % 65536)]))
        return _let(low, lambda o: _let(high(o), lambda h: text(h, o)))

    return F.when(valid, _let(words, put)).otherwise(hit)


def _digest_of(kind: str, body: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), body), 256)


def _token(hit: Column, key: str) -> Column:
    """The head that tells the kind of token stays."""
    head = F.regexp_extract(hit, "^(?:gh[opsru]_|github_pat_|glpat-|xox[abprs]-|sk-|AIza)", 0)
    body = F.substring(hit, F.length(head) + 1, F.length(hit))
    return F.concat(head, F.rpad(_digest_of("token", body, key), F.length(body), F.lit("0")))


def _block(hit: Column, key: str) -> Column:
    """A key block keeps its first and last line around a digest of its key; line breaks don't count. Blocks of over 32,768 characters are none."""
    ends = lambda at: F.regexp_extract(hit, at, 0)
    return F.concat(ends("^-----BEGIN [A-Z0-9 ]*-----"), F.lit("\n"), _digest_of("block", F.regexp_replace(hit, r"\s", ""), key), F.lit("\n"), ends("-----END [A-Z0-9 ]*-----$"))


def _rest_97(x: Column) -> Column:
    """Remainder by 97 of a text of digits and letters, A being 10."""
    step = lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97).cast("int")
    return F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(0), step)


def _iban(hit: Column, key: str) -> Column:
    """The digits after the check digits are permuted, the check digits follow."""

    def go(x: Column) -> Column:
        country, own = F.substring(x, 1, 2), F.substring(x, F.lit(5), F.length(x))
        valid = _rest_97(F.concat(own, F.substring(x, 1, 4))) == 1

        def new(d: Column) -> Column:
            half = F.floor(F.length(d) / 2).cast("int")
            size = (F.length(d) - half).cast("int")
            mixed = feistel(key, "iban", F.substring(d, F.lit(1), half).cast("bigint"), F.substring(d, half + 1, size).cast("bigint"), _power(half), _power(size))
            out = _let(mixed, lambda s: F.concat(_pad(s["l"], half), _pad(s["r"], size)))
            full = _let(out, lambda o: F.concat(_pad(98 - _rest_97(F.concat(_refill(own, o), country, F.lit("00"))), 2), o))
            return F.when(valid & (F.length(d) > 1), _refill(hit, full)).otherwise(hit)

        return _let(_digits(own), new)

    return _let(F.replace(hit, F.lit(" "), F.lit("")), go)


def _ssn(hit: Column, key: str) -> Column:
    part = lambda i: F.get(F.split(hit, "-"), i).cast("bigint")
    area, group, serial = part(0), part(1), part(2)
    index = area - F.when(area > 666, 2).otherwise(1)
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    new = feistel(key, "ssn", index, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))

    def text(s: Column) -> Column:
        a = s["l"] + F.when(s["l"] >= 665, 2).otherwise(1)
        return F.concat_ws("-", _pad(a, 3), _pad(F.floor(s["r"] / 9999) + 1, 2), _pad(s["r"] % 9999 + 1, 4))

    return F.when(valid, _let(new, text)).otherwise(hit)


def _ip(hit: Column, key: str) -> Column:
    part = lambda i: F.get(F.split(hit, r"\."), i).cast("bigint")
    new = feistel(key, "ip", part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536))
    return _let(new, lambda s: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256)]))


def _date(hit: Column, key: str) -> Column:
    """Year first, or day first, or month first if only that is in the calendar; the order stays.

    Walks on while the network leads outside the calendar; at most 32 cells lie there.
    """
    a, b = HALVES
    part = F.transform(F.split(hit, "[./-]"), lambda x: x.cast("int"))
    mark = F.regexp_extract(hit, "[./-]", 0)
    padded = F.length(hit) == 10

    def go(p: Column) -> Column:
        year_first, month_first = p[0] > 999, p[1] > 12
        year, month, day = F.when(year_first, p[0]).otherwise(p[2]), F.when(~year_first & month_first, p[0]).otherwise(p[1]), F.when(year_first, p[2]).when(month_first, p[1]).otherwise(p[0])
        start = (F.lit(FIRST_YEAR) + 200 * F.floor((year - FIRST_YEAR) / 200)).cast("int")
        first = F.make_date(start, F.lit(1), F.lit(1))
        days = F.datediff(F.make_date(start + 200, F.lit(1), F.lit(1)), first)
        at = F.try_to_timestamp(F.concat_ws("-", _pad(year, 4), _pad(month, 2), _pad(day, 2)), F.lit("yyyy-MM-dd")).cast("date")
        era = F.when(start == FIRST_YEAR, F.lit("date")).otherwise(F.concat(F.lit("date"), start.cast("string")))

        def walk(s: Column) -> Column:
            once = lambda d: _let(feistel(key, s["era"], F.floor(d / b), d % b, F.lit(a), F.lit(b)), lambda x: x["l"] * b + x["r"])
            return F.aggregate(F.sequence(F.lit(1), F.lit(32)), once(s["at"].cast("bigint")), lambda d, _: F.when(d < s["days"], d).otherwise(once(d)))

        def put(new: Column) -> Column:
            show = lambda form: F.date_format(new, form)
            m, d = F.when(padded, show("MM")).otherwise(show("M")), F.when(padded, show("dd")).otherwise(show("d"))
            return F.when(year_first, F.concat(show("yyyy"), mark, m, mark, d)).when(month_first, F.concat(m, mark, d, mark, show("yyyy"))).otherwise(F.concat(d, mark, m, mark, show("yyyy")))

        walked = _let(F.struct(F.datediff(at, first).alias("at"), days.alias("days"), era.alias("era")), walk)
        return F.when(at.isNotNull(), _let(F.date_add(first, walked.cast("int")), put)).otherwise(hit)

    return _let(part, go)


def _email(hit: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(hit)), 256), 1, 32), F.lit("@example.invalid"))


def _secret(hit: Column, key: str) -> Column:
    head = F.regexp_extract(hit, r"^(AKIA|[\p{L}_ -]+\s*[=:]\s*[\"']?)", 1)
    body = F.substring(hit, F.length(head) + 1, F.length(hit))
    new = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), body), 256)
    new = F.rpad(new, F.length(body), F.lit("0"))
    return F.concat(head, F.when(head == "AKIA", F.upper(new)).otherwise(new))


KINDS = {"email": _email, "block": _block, "token": _token, "secret": _secret, "ipv6": _ipv6, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card, "phone": _phone, "abroad": _abroad}


def pseudonym(hit: Column, key: str) -> Column:
    """What takes a match's place."""
    out = F.lit(None).cast("string")
    for kind, make in reversed(KINDS.items()):
        out = F.when(hit.rlike(f"^(?:{PATTERNS[kind]})$"), make(hit, key)).otherwise(out)
    return F.coalesce(out, hit)


def _masked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(row, masked)``: each row as a struct, and its new text with the number of values replaced (null: none)."""
    may = F.col(f"`{text}`").rlike(r"[0-9@]|AKIA|PRIVATE KEY-----|(?i:token|secret|key|password|passwd|pwd)\s{0,3}[=:]|gh[opsru]_|glpat-|xox[abprs]-|sk-|AIza")
    parts = F.when(may, F.struct(F.split(F.col(f"`{text}`"), ANY, -1).alias("gaps"), F.regexp_extract_all(F.col(f"`{text}`"), F.lit(ANY), F.lit(0)).alias("hits")))

    def put(p: Column) -> Column:
        def one(new: Column) -> Column:
            joined = F.concat_ws("", F.flatten(F.zip_with(p["gaps"], new, lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))))
            changed = F.size(F.filter(F.zip_with(p["hits"], new, lambda h, n: h != n), lambda c: c))
            return F.struct(joined.alias("text"), changed.alias("n"))

        return _let(F.transform(p["hits"], lambda h: pseudonym(h, key)), one)

    done = F.when(may, F.when(F.size(parts["hits"]) > 0, _let(parts, put)))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), done.alias("masked"))


def mask(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in its texts, and ``n_pii``, the number of values replaced.

    A null text stays null with ``n_pii`` zero; texts without private values stay as they are. All other columns
    pass through, and a column named ``n_pii`` of the input is replaced. Values that fail their check stay. Rows do not meet, so
    null and repeated ids change nothing; a long text takes a few times its own size.
    """
    new = {text: F.coalesce(F.col("masked.text"), F.col(f"row.`{text}`"))}
    own = [c for c in docs.columns if c != "n_pii" or c == text]
    return _masked(docs, key, text).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in own], F.coalesce(F.col("masked.n"), F.lit(0)).alias("n_pii"))


#: The key of the registered query; a deployment passes its own secret.
QUERY_KEY = "quire-demo-key"


def op10(spark, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for private values; nulls, repeated rows and long texts as ``mask`` states."""
    return mask(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)


def without_private(docs: DataFrame, key: str = QUERY_KEY) -> DataFrame:
    """The documents with pseudonyms in their texts; n_chars follows, all other columns stay."""
    new = {"text": F.coalesce(F.col("masked.text"), F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("masked.n") > 0, F.length("masked.text")).otherwise(F.col("row.n_chars"))
    return _masked(docs, key, "text").select(*[new.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
