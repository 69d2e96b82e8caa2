"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates that pass their format's own test are replaced by a keyed
permutation of the same format: card numbers keep a valid check digit, account
numbers their check digits, phone numbers their country's code, addresses their
octets and dates the calendar. The permutation is a Feistel network over the
digits, so a value always gets the same pseudonym, in whatever document and
with whatever separators it stands, and two values never share one. Numbers
that fail their test stay as they are.

The local part of a mail address is permuted in the same way, letter for letter
and digit for digit; its domain stays.

The secret reaches the plan as the value of a subquery over a table of one row,
never as a literal, so neither ``explain`` nor the UI nor an event log shows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_GAP = r"[^\w\n]{0,6}"
#: Fixed value: countries by the length of their account numbers (IBAN).
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: What is looked for, by kind, in the order in which a place in the text is tried.
PATTERNS = {
    # Possessive throughout: an address is read in one go, however long, and the reader's stack doesn't grow with it.
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:(?:\.(?![A-Za-z]{2})[A-Za-z0-9-]++)*+\.[A-Za-z]{2}[A-Za-z0-9-]*+)++",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "date": r"(?<!\d)(?:(?:19|20)\d\d-\d\d-\d\d|\d\d/\d\d/(?:19|20)\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])",
    "phone": rf"(?:(?<!\d)\+\d{{1,3}}{_GAP})?(?:\(\d{{3}}\){_GAP}|(?<!\d)\d{{3}}[-. ])\d{{3}}[-. ]\d{{4}}(?!\d)|(?<!\d)\+\d{{1,3}}(?:[ .-]?\d{{2,4}}){{2,4}}(?!\d)",
    "card": r"(?<![A-Za-z0-9])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![A-Za-z0-9])",
}
#: Fixed value: country codes of telephone numbers; all others have three digits.
CALLING_CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98"
#: Dates are 1900-01-01 to 2099-12-31, in two classes. Those up to the 12th of a month are EARLY[0] * EARLY[1];
#: the LATE others are fewer than LATE_SIDES[0] * LATE_SIDES[1], which a Feistel network covers.
FIRST_DAY = "DATE'1900-01-01'"
EARLY, LATE, LATE_SIDES = (160, 180), 44_249, (211, 210)


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(values: str, radix: str, tweak: str, key: str) -> str:
    """SQL: the array of values, each below its radix, permuted under a key among all such arrays.

    Halves take turns: each value of one half is shifted, modulo its radix, by a
    digest of the other half; 16 values for each digest. ``radix`` is SQL for
    the radix of place ``i``, ``key`` and ``tweak`` SQL for texts.
    """
    other = "array_join(filter(acc, (x, j) -> (j < size(acc) div 2) <> (r % 2 = 1)), ',')"
    digest = f"sha2(concat_ws('|', {key}, {tweak}, size(acc), r, {other}), 256)"
    digests = f"transform(array({digest}), h -> transform(sequence(0, (size(acc) - 1) div 16), b -> IF(b = 0, h, sha2(concat_ws('|', h, b), 256))))[0]"
    shift = "cast(conv(substring(ds[i div 16], 1 + 4 * (i % 16), 4), 16, 10) AS int)"
    turn = f"transform(array({digests}), ds -> transform(acc, (v, i) -> IF((i < size(acc) div 2) = (r % 2 = 1), pmod(v + {shift}, {radix}), v)))[0]"
    return f"aggregate(sequence(1, {ROUNDS}), {values}, (acc, r) -> {turn})"


def let(**named: str):
    """SQL ``body`` with names for parts that it uses more than once."""

    def within(body: str) -> str:
        for name, part in reversed(named.items()):
            body = f"transform(array({part}), {name} -> {body})[0]"
        return body

    return within


_CHARS = "filter(split({0}, ''), c -> c <> '')"
_IS_DIGIT = "c BETWEEN '0' AND '9'"


def _refill(text: str, news: str, kind: str = "0-9") -> str:
    """SQL: a text with its characters of a kind replaced one by one by those of an array."""
    return f"array_join(zip_with(split({text}, '[{kind}]', -1), {news}, (p, c) -> concat(p, coalesce(cast(c AS string), ''))), '')"


def _numbers(text: str) -> str:
    return f"transform(filter(split({text}, ''), c -> {_IS_DIGIT}), c -> cast(c AS int))"


def _luhn(digits: str, first: int) -> str:
    """SQL: the Luhn sum modulo 10, where ``first`` is 1 if the last digit is doubled."""
    return f"aggregate(transform(reverse({digits}), (x, p) -> IF(p % 2 = {1 - first}, IF(x > 4, 2 * x - 9, 2 * x), x)), 0, (a, x) -> a + x) % 10"


def _mod97(text: str) -> str:
    """SQL: a text of digits and capitals, read as a number with A as 10, modulo 97."""
    return f"aggregate(filter(split({text}, ''), c -> c <> ''), 0, (a, c) -> (IF({_IS_DIGIT}, a * 10 + cast(c AS int), a * 100 + ascii(c) - 55)) % 97)"


def _mail(key: str) -> str:
    name = "substring_index(m, '@', 1)"
    base = "IF(c BETWEEN '0' AND '9', 48, IF(c BETWEEN 'A' AND 'Z', 65, 97))"
    named = let(
        ls=f"filter(split({name}, ''), c -> c RLIKE '[A-Za-z0-9]')", bs=f"transform(ls, c -> {base})",
        vs="transform(ls, (c, i) -> ascii(c) - bs[i])", ps=feistel("vs", "IF(bs[i] = 48, 10, 26)", "'mail'", key),
    )
    return f"concat({named(_refill(name, 'transform(ps, (v, i) -> chr(v + bs[i]))', 'A-Za-z0-9'))}, substring(m, instr(m, '@')))"


def _iban_valid() -> str:
    plain = "replace(m, ' ', '')"
    return f"length({plain}) >= 15 AND " + _mod97(f"concat(substring({plain}, 5), substring({plain}, 1, 4))") + " = 1"


def _accounts() -> Column:
    """The valid account numbers of a text: those of their country's length first, then those of any length.

    They are looked for from every place, since the longest match may run on into
    the next word, and one that fails its test may hold another number.
    """
    kinds = []
    for n, countries in IBAN_COUNTRIES.items():
        groups, rest = divmod(n - 4, 4)
        kinds.append(rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    shapes = (rf"\b(?=((?:{'|'.join(kinds)})\b))", rf"\b(?=({PATTERNS['iban']}))")
    each = F.array_distinct(F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in shapes]))
    return F.when(F.col("text").rlike(r"\b[A-Z]{2}\d{2}"), each)


def _iban(key: str) -> str:
    base = f"IF({_IS_DIGIT}, 48, 65)"
    named = let(
        s="replace(m, ' ', '')", cs=_CHARS.format("substring(s, 5)"), bs=f"transform(cs, c -> {base})", vs="transform(cs, (c, i) -> ascii(c) - bs[i])",
        ps="transform(" + feistel("vs", "IF(bs[i] = 48, 10, 26)", "concat('iban', substring(s, 1, 2))", key) + ", (v, i) -> chr(v + bs[i]))",
        q="array_join(ps, '')", check="lpad(cast(98 - " + _mod97("concat(q, substring(s, 1, 2), '00')") + " AS string), 2, '0')", ws="filter(split(concat(substring(s, 1, 2), check, q), ''), c -> c <> '')",
    )
    return f"IF({_iban_valid()}, {named(_refill('m', 'ws', 'A-Z0-9'))}, m)"


def _ip(key: str) -> str:
    values = "transform(split(m, '[.]'), x -> cast(x AS int))"
    return f"array_join(transform({feistel(values, '256', _text('ip'), key)}, x -> cast(x AS string)), '.')"


def _pair(n: str, sides: tuple[int, int], key: str) -> str:
    """SQL: a number below the product of two sides, permuted."""
    values = f"array(cast({n} div {sides[1]} AS int), cast({n} % {sides[1]} AS int))"
    return let(ps=feistel(values, f"IF(i = 0, {sides[0]}, {sides[1]})", "'date'", key))(f"ps[0] * {sides[1]} + ps[1]")


def _date(key: str) -> str:
    """A date stays within its class, so one that only reads month first still does, and a date has one pseudonym in all formats."""
    part = lambda a, b, c: f"concat_ws('-', substring(m, {a}, 4), substring(m, {b}, 2), substring(m, {c}, 2))"
    day_first, month_first = (f"try_cast({part(7, *x)} AS date)" for x in ((4, 1), (1, 4)))
    shape = f"IF(m LIKE '%-%', 'yyyy-MM-dd', concat_ws(IF(m LIKE '%/%', '/', '.'), IF({day_first} IS NULL, 'MM', 'dd'), IF({day_first} IS NULL, 'dd', 'MM'), 'yyyy'))"
    date = f"IF(m LIKE '%-%', try_cast(m AS date), coalesce({day_first}, {month_first}))"
    early = let(p=_pair("n", EARLY, key), o="p div 12")("make_date(1900 + o div 12, o % 12 + 1, p % 12 + 1)")
    early = let(n="((year(d) - 1900) * 12 + month(d) - 1) * 12 + day(d) - 1")(early)
    # The late days of all months before this one, and of this one. A walk out of the class is back in it after as many steps as there are numbers outside.
    outside = LATE_SIDES[0] * LATE_SIDES[1] - LATE
    walk = f"aggregate(sequence(1, {outside}), {_pair('n', LATE_SIDES, key)}, (p, step) -> IF(p < {LATE}, p, {_pair('p', LATE_SIDES, key)}))"
    guess = f"cast(p / {LATE / 2400} AS int)"
    month = f"array_max(filter(sequence(greatest(0, {guess} - 2), {guess} + 2), o -> datediff(add_months({FIRST_DAY}, o), {FIRST_DAY}) - 12 * o <= p))"
    late = let(n=f"datediff(d, {FIRST_DAY}) - 12 * ((year(d) - 1900) * 12 + month(d))", p=walk, o=month)(f"date_add({FIRST_DAY}, cast(p + 12 * (o + 1) AS int))")
    return let(d=date)(f"IF(d IS NULL, m, date_format(IF(day(d) <= 12, {early}, {late}), {shape}))")


def _ssn(key: str) -> str:
    valid = "m NOT LIKE '000%' AND m NOT LIKE '666%' AND m NOT LIKE '9%' AND substring(m, 5, 2) <> '00' AND substring(m, 8) <> '0000'"
    values = "transform(split(m, '-'), (x, k) -> cast(x AS int) - 1 - IF(k = 0 AND x > '666', 1, 0))"  # the numbers that can be issued, without a hole
    area = "lpad(cast(ps[0] + 1 + IF(ps[0] >= 665, 1, 0) AS string), 3, '0')"
    moved = let(ps=feistel(values, "IF(i = 0, 898, IF(i = 1, 99, 9999))", "'ssn'", key))(f"concat_ws('-', {area}, lpad(cast(ps[1] + 1 AS string), 2, '0'), lpad(cast(ps[2] + 1 AS string), 4, '0'))")
    return f"IF({valid}, {moved}, m)"


def _phone(key: str) -> str:
    """The digits after the country's code are permuted, whatever separators stand between any of them."""
    code = f"IF(m LIKE '+%', length(regexp_extract(s, '^(?:{CALLING_CODES}|[0-9]{{3}})', 0)), 0)"
    named = let(s="regexp_replace(m, '[^0-9]', '')", n=code, vs=_numbers("substring(s, n + 1)"), ps=feistel("vs", "10", "'phone'", key))
    return named(_refill("m", f"concat({_numbers('substring(s, 1, n)')}, ps)"))


def _card(key: str) -> str:
    named = let(hs="slice(vs, 1, size(vs) - 1)", ps=feistel("hs", "10", "'card'", key), ws=f"concat(ps, array(pmod(10 - {_luhn('ps', 1)}, 10)))")
    return let(vs=_numbers("m"))(f"IF({_luhn('vs', 0)} = 0, {named(_refill('m', 'ws'))}, m)")


def _kind() -> str:
    """SQL: which pattern a match ``m`` comes from; by shape, since what stands around it is no longer there."""
    return r"""CASE WHEN m LIKE '%@%' THEN 'mail' WHEN m RLIKE '^[A-Z]' THEN 'iban' WHEN m RLIKE '^([0-9]{1,3}[.]){3}[0-9]{1,3}$' THEN 'ip'
        WHEN m RLIKE '^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})$' THEN 'date' WHEN m RLIKE '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' THEN 'ssn'
        WHEN m RLIKE '^[+(]' OR m RLIKE '^[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}$' THEN 'phone' ELSE 'card' END"""


def pseudonym(key: str) -> str:
    """SQL: the replacement of a match ``m``; ``key`` is SQL for the secret."""
    made = {"mail": _mail, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
    cases = " ".join(f"WHEN {_text(kind)} THEN {sql(key)}" for kind, sql in made.items())
    return f"CASE {_kind()} {cases} END"


def pseudonymise(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, n_replaced (values that were replaced).

    Null text stays null with nothing replaced; empty text stays empty. Values
    that fail their format's test, and all other text, stay as they are. A date
    in figures is read day first where it can be. Rows without an id and
    repeated rows stay; other columns are ignored.
    """
    mail, *others = [f"(?:{p})" for kind, p in PATTERNS.items() if kind != "iban"]
    secret = docs.sparkSession.createDataFrame([(key,)], "key string").scalar()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    some = F.col("text").rlike("[0-9@]")
    rows = rows.withColumn("__lv_accounts", F.when(some, _accounts())).withColumn("__lv_accounts", F.expr(f"filter(__lv_accounts, m -> {_iban_valid()})"))
    rest = "|".join(others)
    # A text's valid accounts are part of its pattern; an invalid one is left to the other kinds.
    accounts = F.concat(F.lit(rf"{mail}|\b(?=[A-Z]{{2}}\d{{2}})(?:"), F.array_join("__lv_accounts", "|"), F.lit(rf")\b|{rest}"))
    rows = rows.withColumn("__lv_pattern", F.when(F.size("__lv_accounts") > 0, accounts).otherwise(F.lit(f"{mail}|{rest}")))
    rows = rows.withColumn("__lv_found", F.when(some, F.regexp_extract_all("text", F.col("__lv_pattern"), F.lit(0)))).withColumn("__lv_secret", secret)
    has = F.size("__lv_found") > 0
    rows = rows.withColumn("__lv_new", F.when(has, F.expr(f"transform(__lv_found, m -> {pseudonym('__lv_secret')})")))
    parts: Column = F.split("text", F.col("__lv_pattern"), -1)
    whole = F.array_join(F.zip_with(parts, F.col("__lv_new"), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    changed = F.expr("size(filter(zip_with(__lv_found, __lv_new, (a, b) -> a <> b), x -> x))")
    return rows.select("doc_id", F.when(has, whole).otherwise(F.col("text")).alias("text"), F.when(has, changed).otherwise(0).cast("long").alias("n_replaced"))
