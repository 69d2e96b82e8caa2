import datetime
import re

import pytest

from latticevec.llm import pii
from latticevec.llm.queries import PII_KEY, QUERIES


@pytest.fixture(scope="module")
def changed(docs_of):
    def run(texts, key="k1"):
        out = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in pii.pseudonymise(docs_of(texts), key).collect()}
        return [out[i] for i in range(len(texts))]

    return run


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def test_cards_stay_valid_and_linked(changed):
    (a, n), (b, _), (c, _) = changed(["pay 4111 1111 1111 1111 or 4111-1111-1111-1111 now", "4111111111111111", "bad 4111111111111112 stays"])
    one, two = re.findall(r"\d{4}.\d{4}.\d{4}.\d{4}", a)
    assert n == 2 and one.replace(" ", "") == two.replace("-", "") == b and b != "4111111111111111" and luhn(b)
    assert c == "bad 4111111111111112 stays"


def test_other_keys_give_other_pseudonyms(changed):
    assert changed(["4111111111111111"], "k1") != changed(["4111111111111111"], "k2")


def test_it_is_a_permutation(changed):
    numbers = [f"555-{i:02d}-{j:04d}" for i in range(1, 10) for j in range(1, 40)]
    out = [t for t, _ in changed(numbers)]
    assert len(set(out)) == len(numbers)
    assert all(re.fullmatch(r"\d{3}-\d\d-\d{4}", t) and t[:3] not in ("000", "666") and t[0] != "9" and t[4:6] != "00" and t[7:] != "0000" for t in out)


def test_dates_stay_dates(changed):
    days = [datetime.date(1999, 1, 1) + datetime.timedelta(k) for k in range(500)]
    out = [t for t, _ in changed([str(d) for d in days])]
    assert len({datetime.date.fromisoformat(t) for t in out}) == 500
    (a, n), (b, m) = changed(["1999-12-31 31/12/1999 31.12.1999 12/31/1999", "1999-02-31 and 31/31/2000 and 2099-12-31"])
    iso, slash, dot, month_first = a.split()
    assert n == 4 and slash == "/".join(iso.split("-")[::-1]) and dot == ".".join(iso.split("-")[::-1])
    assert month_first == "{1}/{2}/{0}".format(*iso.split("-")) and int(iso[-2:]) > 12
    assert b.startswith("1999-02-31 and 31/31/2000 and ") and not b.endswith("2099-12-31") and m == 1


def test_all_dates_are_permuted_within_their_class(spark):
    days = spark.sql("SELECT explode(sequence(DATE'1900-01-01', DATE'2099-12-31', INTERVAL 3 DAYS)) AS d")
    days = days.union(spark.sql("SELECT explode(sequence(DATE'2098-01-01', DATE'2099-12-31')) AS d")).distinct()
    rows = pii.pseudonymise(days.selectExpr("bigint(day(d)) AS doc_id", "string(d) AS text"), "k").collect()
    out = [datetime.date.fromisoformat(r["text"]) for r in rows]
    assert len(set(out)) == len(out) > 24_000 and all((d.day <= 12) == (r["doc_id"] <= 12) for d, r in zip(out, rows, strict=True))
    assert pii.EARLY[0] * pii.EARLY[1] == 200 * 12 * 12 and pii.LATE == (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days - 200 * 144


def test_one_number_whatever_its_separators(changed):
    texts = ["+15551234567", "+1 555 123 4567", "+1 (555) 123-4567", "555-123-4567", "+442079460958", "+44 20 7946 0958", "+35312345678"]
    out = [t for t, _ in changed(texts)]
    digits = [re.sub(r"\D", "", t) for t in out]
    assert digits[0] == digits[1] == digits[2] == "1" + digits[3] and digits[0] != "15551234567"
    assert digits[4] == digits[5] and out[4].startswith("+44") and out[6].startswith("+353")
    assert [re.sub(r"\d", "0", t) for t in out] == [re.sub(r"\d", "0", t) for t in texts]


def test_very_long_values(changed):
    texts = ["x@" + "a." * 100_000 + "com", "b" * 50_000 + "@x.com", "b" * 200_000 + "@", "1" * 200_000, "+1" + " 555" * 50_000, "1.2.3.4." * 40_000, "AB12 " * 40_000, "2000-01-01-" * 20_000, "(" * 100_000]
    out = changed(texts)
    assert out[0][0].endswith(texts[0][1:]) and out[0][0] != texts[0] and out[0][1] == 1
    assert re.fullmatch(r"[a-z]{50000}@x\.com", out[1][0]) and len({out[1][0][k : k + 16] for k in range(0, 50_000 - 16, 16)}) > 3000
    assert [len(t) for t, _ in out] == [len(t) for t in texts] and out[2][0] == texts[2] and out[3][0] == texts[3] and out[8] == (texts[8], 0)


def test_mail_hosts(changed):
    out = changed(["bob@example.com1 a1@b.co.9x q@x1 bob@site.org.", "bob@x.y bob@x.yz-a.b"])
    assert [n for _, n in out] == [3, 1]
    assert re.fullmatch(r"[a-z]{3}@example\.com1 [a-z]\d@b\.co\.9x q@x1 [a-z]{3}@site\.org\.", out[0][0])


def test_the_key_is_not_in_the_plan(spark, docs_of):
    out = pii.pseudonymise(docs_of(["4111111111111111"]), "topsecretvalue")
    out.collect()
    execution = out._jdf.queryExecution()
    plans = execution.toString() + execution.optimizedPlan().toString() + execution.executedPlan().toString()
    assert "topsecretvalue" not in plans and "Python" not in plans


def test_accounts_addresses_phones_mail(changed):
    (iban, _), (ip, _), (bad, k), (tel, n), (mail, _) = changed(["DE89 3704 0044 0532 0130 00", "at 10.20.30.40.", "300.1.1.1 v1.2.3.4 1.2.3.4.5 DE00370400440532013000", "+1 (017) 555-7713 (017) 555-7713 +1%%% (017)&&& 555-7713%%%", "Bob.Smith99@example.com bob.smith99@EXAMPLE.com"])
    s = iban.replace(" ", "")
    assert re.fullmatch(r"DE\d{2}( \d{4}){4} \d\d", iban) and iban != "DE89 3704 0044 0532 0130 00"
    assert int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    assert re.fullmatch(r"at (\d{1,3}\.){4}", ip) and all(int(x) < 256 for x in re.findall(r"\d+", ip)) and ip != "at 10.20.30.40."
    assert k == 0 and bad.startswith("300.1.1.1 v1.2.3.4 1.2.3.4.5")
    numbers = re.findall(r"\((\d{3})\)\D+(\d{3}-\d{4})", tel)
    assert n == 3 and len(set(numbers)) == 1 and numbers[0] != ("017", "555-7713") and tel.startswith("+1 (") and tel.endswith("%%%")
    names = re.findall(r"\S+(?=@)", mail)
    assert names[0].lower() == names[1].lower() or names[0] != names[1]
    assert re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{4}\d\d@example.com [a-z]{3}\.[a-z]{5}\d\d@EXAMPLE.com", mail)


def valid_iban(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_accounts_before_other_words(changed):
    at, es, de = "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00"
    texts = [f"{at} BIC BKAUATWW", f"pay {es} AND go", f"NR12 {at}", f"{de} {at} {es}", "NO9386011117947 X", "LC55HEMM000100010012001200023015 AB"]
    out = changed(texts)
    assert [n for _, n in out] == [1, 1, 1, 3, 1, 1]
    (a, _), (b, _), (c, _), (d, _), (e, _), (f, _) = out
    assert re.fullmatch(r"AT(?:\d\d)(?: \d{4}){4} BIC BKAUATWW", a) and at not in a and valid_iban(a[:24])
    assert re.fullmatch(r"pay ES\d\d(?: \d{4}){5} AND go", b) and es not in b and valid_iban(b[4:-7])
    assert c == "NR12 " + a[:24] and d.endswith(f" {a[:24]} {b[4:-7]}") and valid_iban(d[:27])
    assert valid_iban(e[:-2]) and valid_iban(f[:-3]) and e[:-2] not in texts[4] and f[:-3] not in texts[5]


def test_cards_within_invalid_accounts(changed):
    (a, n), (b, m), (c, k) = changed(["NR12 4111 1111 1111 1111", "AB12 1111 2222 3333 4445 4111 1111 1111 1111 end", "4111 1111 1111 1111"])
    assert (n, m, k) == (1, 1, 1) and a == "NR12 " + c and luhn(c)
    assert b == f"AB12 1111 2222 3333 4445 {c} end"


def slow_feistel(values, radices, tweak, key):
    import hashlib

    acc, half = list(values), len(values) // 2
    for r in range(1, pii.ROUNDS + 1):
        first = r % 2 == 1
        other = ",".join(str(x) for j, x in enumerate(acc) if (j < half) != first)
        d = hashlib.sha256(f"{key}|{tweak}|{len(acc)}|{r}|{other}".encode()).hexdigest()
        ds = [d if b == 0 else hashlib.sha256(f"{d}|{b}".encode()).hexdigest() for b in range(-(-len(acc) // 16))]
        acc = [(v + int(ds[i // 16][4 * (i % 16) :][:4], 16)) % radices[i] if (i < half) == first else v for i, v in enumerate(acc)]
    return acc


def test_feistel_equals_another_implementation(spark):
    key = "it's \\ a key"
    for values in ([3, 1, 4, 1, 5, 9, 2, 6, 5], [7], list(range(10)) * 5):
        sql = pii.feistel("digits", "10", "'t'", "k")
        assert spark.createDataFrame([(values, key)], "digits array<int>, k string").selectExpr(f"{sql} AS o").first()["o"] == slow_feistel(values, [10] * len(values), "t", key)


def slow_refill(text, news, kind):
    it = iter(news)
    return re.sub(f"[{kind}]", lambda _: str(next(it)), text)


def slow_letters(text, tweak, key):
    bases = [48 if c.isdigit() else 65 if c.isupper() else 97 for c in text]
    moved = slow_feistel([ord(c) - b for c, b in zip(text, bases, strict=True)], [10 if b == 48 else 26 for b in bases], tweak, key)
    return "".join(chr(v + b) for v, b in zip(moved, bases, strict=True))


def slow_pair(n, sides, key):
    a, b = slow_feistel([n // sides[1], n % sides[1]], sides, "date", key)
    return a * sides[1] + b


def slow_date(m, key):
    forms = ["%Y-%m-%d"] if "-" in m else ["%d/%m/%Y", "%m/%d/%Y"] if "/" in m else ["%d.%m.%Y", "%m.%d.%Y"]
    for form in forms:
        try:
            day = datetime.datetime.strptime(m, form).date()
        except ValueError:
            continue
        span = [datetime.date(1900, 1, 1) + datetime.timedelta(k) for k in range(73049)]
        early = [d for d in span if d.day <= 12]
        if day.day <= 12:
            return early[slow_pair(early.index(day), pii.EARLY, key)].strftime(form)
        late = [d for d in span if d.day > 12]
        n = slow_pair(late.index(day), pii.LATE_SIDES, key)
        while n >= len(late):
            n = slow_pair(n, pii.LATE_SIDES, key)
        return late[n].strftime(form)
    return m


def slow_pseudonym(m, key):
    digits = [int(c) for c in m if c.isdigit()]
    if "@" in m:
        name, host = m.split("@")
        return slow_refill(name, slow_letters(re.sub("[^A-Za-z0-9]", "", name), "mail", key), "A-Za-z0-9") + "@" + host
    if re.match("[A-Z]", m):
        s = m.replace(" ", "")
        body = slow_letters(s[4:], "iban" + s[:2], key)
        check = 98 - int("".join(str(int(c, 36)) for c in body + s[:2] + "00")) % 97
        return slow_refill(m, f"{s[:2]}{check:02d}{body}", "A-Z0-9")
    if re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", m):
        return ".".join(map(str, slow_feistel([int(x) for x in m.split(".")], [256] * 4, "ip", key)))
    if re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d[/.]\d\d[/.]\d{4}", m):
        return slow_date(m, key)
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        area, group, serial = m.split("-")
        if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
            return m
        areas = [x for x in range(1, 900) if x != 666]
        a, g, n = slow_feistel([areas.index(int(area)), int(group) - 1, int(serial) - 1], [898, 99, 9999], "ssn", key)
        return f"{areas[a]:03d}-{g + 1:02d}-{n + 1:04d}"
    if m[0] in "+(" or re.fullmatch(r"\d{3}[-. ]\d{3}[-. ]\d{4}", m):
        code = len(re.match(pii.CALLING_CODES + "|[0-9]{3}", "".join(map(str, digits)))[0]) if m[0] == "+" else 0
        return slow_refill(m, digits[:code] + slow_feistel(digits[code:], [10] * len(digits), "phone", key), "0-9")
    if not luhn(m):
        return m
    moved = slow_feistel(digits[:-1], [10] * len(digits), "card", key)
    check = next(c for c in range(10) if luhn("".join(map(str, [*moved, c]))))
    return slow_refill(m, [*moved, check], "0-9")


def slow(text, key):
    """The whole query for one text, in plain Python."""
    shapes = [rf"\b(?=({c}\d\d(?: ?[A-Z0-9]){{{n - 4}}}\b))" for n, cs in pii.IBAN_COUNTRIES.items() for c in cs.split()] + [rf"\b(?=({pii.PATTERNS['iban']}))"]
    accounts = []
    for shape in shapes if re.search(r"\b[A-Z]{2}\d{2}", text) else []:
        for found in re.finditer(shape, text):
            if re.fullmatch(pii.PATTERNS["iban"], found[1]) and valid_iban(found[1]) and len(found[1].replace(" ", "")) >= 15 and found[1] not in accounts:
                accounts.append(found[1])
    kinds = dict(pii.PATTERNS, iban=rf"\b(?:{'|'.join(accounts)})\b" if accounts else "(?!)")
    pattern = "|".join(f"(?:{p})" for p in kinds.values()).replace(r"([ -])\d{4}\1\d{4}\1", r"(?P<a>[ -])\d{4}(?P=a)\d{4}(?P=a)").replace(r"([ -])\d{6}\2", r"(?P<b>[ -])\d{6}(?P=b)")
    n = 0

    def put(m):
        nonlocal n
        new = slow_pseudonym(m[0], key)
        n += new != m[0]
        return new

    return re.sub(pattern, put, text, flags=re.ASCII), n


def test_query_equals_plain_python(spark, sf_dir, docs_of):
    extra = ["Pay 4111 1111 1111 1111 or DE89 3704 0044 0532 0130 00, 12/31/1990, 31.12.1990, 2099-12-31", "+44 20 7946 0958 123-45-6789 10.20.30.40 Bob.Smith9@example.com (555) 123-4567"]
    assert {r["doc_id"]: (r["text"], r["n_replaced"]) for r in pii.pseudonymise(docs_of(extra), "k").collect()} == {i: slow(t, "k") for i, t in enumerate(extra)}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id").text
    got = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in QUERIES["op6_pii"](spark, sf_dir).collect()}
    assert got == {i: slow(t, PII_KEY) for i, t in docs.items()} and sum(n for _, n in got.values()) > 20


def test_tables_hold_no_original(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id").text
    for r in QUERIES["op6_pii"](spark, sf_dir).collect():
        before, after = docs[r["doc_id"]], r["text"]
        assert len(re.findall(r"\S+@\S+", before)) == len(re.findall(r"\S+@\S+", after))
        for m in re.findall(r"[\w.]+@[\w.]+|\(\d{3}\) \d{3}-\d{4}", before):
            assert m not in after
        for m in re.findall(r"(?<![\w])\d{16}(?!\d)", before):
            assert (m in after) != luhn(m)
        if not re.search(r"[0-9@]", before):
            assert before == after and r["n_replaced"] == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op6_pii"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows(odd_docs, no_docs):
    out = pii.pseudonymise(odd_docs, "k")
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    assert pii.pseudonymise(no_docs, "k").count() == 0
