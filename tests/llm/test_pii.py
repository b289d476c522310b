import re

from pyspark.sql import functions as F

from ordwell.llm import pii as p

TEXT = 'Mail Bob.Ross@Corp.example.com, BOB.ROSS@CORP.EXAMPLE.COM; call +1 (017) 555-7713 at 97.51.17.173. Card 4485 2757 4230 8327. token = "04DBEBAB91". Mr Ivan Smith met Mrs Smith and Господин Иванов.'


def test_detect():
    kinds = [e[2] for e in p.detect(TEXT)]
    assert kinds == ["email", "email", "phone", "ipv4", "card", "secret", "given_m", "family", "family", "family"]
    for clean in ("1234567812345678", "1.2.3", "999.1.1.1", "a@b", "3.14159", "version 10.0.0", "Mr. nobody", "5551234", "1.2.3.4.5"):
        assert p.detect(clean) == [], clean


def test_replace_keeps_form_and_coreference():
    out, n = p.replace(TEXT, {}, "k")
    assert n == 10
    found = p.detect(out)
    assert [e[2] for e in found] == [e[2] for e in p.detect(TEXT)]
    assert found[0][3] == found[1][3] and out[found[1][0] : found[1][1]].isupper()
    card = next(e for e in found if e[2] == "card")
    assert p.luhn(card[3]) and out[card[0] : card[1]].count(" ") == 3
    assert next(e for e in found if e[2] == "ipv4")[3].startswith("10.")
    family = [e[3] for e in found if e[2] == "family"]
    assert family[0] == family[1] != family[2]
    assert not set("abcdefghijklmnopqrstuvwxyz") & set(family[2])
    for _, _, _, norm in p.detect(TEXT):
        assert norm not in out.lower()
    assert p.replace(TEXT, {}, "k")[0] == out and p.replace(TEXT, {}, "other")[0] != out


def test_search_is_linear():
    for text in ("a" * 200000, "1" * 200000, "1 " * 100000, "a." * 100000 + "@", "@" * 100000, "(12) " * 40000, 'token="' * 20000):
        p.detect(text)


def narrow(kind, norm, attempt, key):
    """First draws that collide: with each other, and with a real entity."""
    first = F.when(norm.isin("a", "b", "c"), "same").when(norm == "d", "e").otherwise(F.concat(norm, F.lit("-0")))
    return F.when(attempt == 0, first).otherwise(F.concat(norm, F.lit("-"), attempt.cast("string")))


def test_collisions_are_drawn_anew(spark):
    every = spark.createDataFrame([("k", x) for x in "abcdef"] + [("k", "f-0")], "kind string, norm string")
    got = {(r.norm, r.attempt) for r in p.drawn_anew(spark, every, "key", first=narrow)[0].collect()}
    assert got == {("b", 1), ("c", 1), ("d", 1), ("f", 1)}


def test_distinct_entities_stay_distinct(spark):
    rows = [(k, f"Mr Ann{chr(97 + k % 26)}x Lee{chr(97 + k // 26)}q wrote") for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = p.pseudonymise(spark, df, mentions="n").collect()
    assert {r.n for r in out} == {2}
    given, family = {}, {}
    for (_, before), r in zip(sorted(rows), sorted(out), strict=True):
        a, b = before.split()[1:3]
        x, y = r.text.split()[1:3]
        assert given.setdefault(a, x) == x and family.setdefault(b, y) == y
    assert len(set(given.values())) == len(given) and len(set(family.values())) == len(family)


def test_edges(spark):
    rows = [(None, None, 1), (1, "", 1), (2, TEXT, 1), (2, TEXT, 1), (3, "plain", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, anew int")
    out = p.pseudonymise(spark, df, mentions="n")
    assert out.columns == ["doc_id", "text", "anew", "n"]
    got = sorted(((r.doc_id or 0), r.text, r.n) for r in out.collect() if r.text is not None)
    assert got[0][1:] == ("", 0) and got[1] == got[2] and got[1][2] == 10 and got[3][1:] == ("plain", 0)
    assert p.pseudonymise(spark, df.limit(0)).count() == 0


def test_more_forms():
    kinds = lambda t: [e[2:] for e in p.detect(t)]
    assert kinds("call 555-123-4567 or 555.123.4568, not 555-1234-567") == [("phone", "5551234567"), ("phone", "5551234568")]
    assert kinds("jürgen.müller@bücher.example.de") == [("email", "jürgen.müller@bücher.example.de")]
    assert kinds("at 2001:DB8::1 and fe80:0:0:0:1:2:3:4 but 12:30:45, std::vector, a :: b") == [("ipv6", "2001:0db8:0000:0000:0000:0000:0000:0001"), ("ipv6", "fe80:0000:0000:0000:0001:0002:0003:0004")]
    assert kinds("My name is Anna Weber. Dr. Lee, Κυρία Παπαδοπούλου") == [("given_n", "anna"), ("family", "weber"), ("family", "lee"), ("family", "παπαδοπούλου")]
    assert kinds("password = '" + "s3cret" * 5000 + "'")[0][1] == "s3cret" * 5000
    assert kinds('password = "      "') == []


def test_secrets_are_exact():
    out = p.replace('token = "AbCdEf99" secret = "abcdef99" password: "******" password: "p@ss word!"', {}, "k")[0]
    a, b, c, d = (e[3] for e in p.detect(out))
    assert len({a, b, c, d}) == 4 and a.lower() != b
    assert [x.isupper() for x in a[:6]] == [True, False] * 3 and a[6:].isdigit()
    assert len(c) == 6 and set(c) <= set(p.SIGNS) and c != "******"
    assert d[4] == " " and d[1] in p.SIGNS


def brute(rows):
    """Texts cut at their entities: (literal parts, [(kind, normal form)])."""
    out = []
    for t in rows:
        found, at, parts = p.detect(t or ""), 0, []
        for a, z, _, _ in found:
            parts.append(t[at:a])
            at = z
        out.append(([*parts, (t or "")[at:]], [e[2:] for e in found]))
    return out


def test_corpus_against_brute_force(spark):
    """Every mention replaced, the same entity alike everywhere, two never alike, and no surrogate an entity of the corpus."""
    rnd = __import__("random").Random(5)
    make = [
        lambda: f'password = "{"".join(rnd.choice("*!") for _ in range(6))}"',
        lambda: f'secret = "{rnd.choice("0123456789")}*****"',
        lambda: f'token = "{rnd.choice(["abcdef", "ABCDEF", "aBcDeF"])}{rnd.randint(0, 9)}"',
        lambda: f"+1 23 {rnd.randint(10, 99)}",
        lambda: f"10.0.{rnd.randint(0, 3)}.{rnd.randint(0, 255)}",
        lambda: f"u{rnd.randint(0, 9)}@h.example.com",
        lambda: f"Mr {rnd.choice(['Bo', 'Al', 'Cy'])} {rnd.choice(['Belcorson', 'Dan', 'Corbelson'])}",
    ]
    rows = [(k, " and ".join(rnd.choice(make)() for _ in range(rnd.randint(0, 6)))) for k in range(600)]
    got = {r.doc_id: r.text for r in p.pseudonymise(spark, spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()}
    seen, real = {}, set()
    for (doc, _), (parts, own) in zip(rows, brute([t for _, t in rows]), strict=True):
        real |= set(own)
        rest = got[doc]
        for k, e in enumerate(own):
            assert rest.startswith(parts[k])
            rest = rest[len(parts[k]) :]
            end = rest.index(parts[k + 1]) if parts[k + 1] else len(rest)
            drawn = re.sub(r"\D", "", rest[:end]) if e[0] == "phone" else rest[:end].lower() if e[0] != "secret" else rest[:end]
            assert seen.setdefault(e, drawn) == drawn
            rest = rest[end:]
        assert rest == parts[-1]
    assert len(real) > 80 and len({(k, x) for (k, _), x in seen.items()}) == len(seen)
    assert not {(k, x) for (k, _), x in seen.items()} & real


def test_rounds_end_where_a_form_is_used_up(spark):
    rows = [(k, f'secret = "{k % 10}{s}****"') for k, s in enumerate("*" * 10)] + [(99, "+1 23 45")] + [(100 + k, f"+{k // 100000 % 10} {k // 1000 % 100:02d} {k // 10 % 100:02d}") for k in range(0, 1000000, 1000)]
    out = p.pseudonymise(spark, spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()
    assert len(out) == len(rows) and len({r.text for r in out if r.doc_id < 10}) == 10


def test_key(spark):
    df = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    texts = {p.pseudonymise(spark, df).first().text for _ in range(2)}
    assert len(texts) == 2  # a key for each run
    spark.conf.set(p.KEY, "mine")
    try:
        assert p.pseudonymise(spark, df).first().text == p.replace(TEXT, {}, "mine")[0]
    finally:
        spark.conf.unset(p.KEY)


def test_one_surrogate_a_person_under_any_title(spark):
    """The same name under titles of different gender, in one text and over texts; mentions without a title."""
    rows = [
        (0, "Mr John Smith met Dr John Smith. My name is John Smith."),
        (1, "Herr Peter Braun, Prof Peter Braun"),
        (2, "John Smith said hello; Mr John Smith left. A John Smithson stayed."),
        (3, "Mrs Kim Lang wrote"),
        (4, "Mr Kim Lang wrote; KIM LANG signed"),
        (5, "Dr Peter Braun alone"),
    ]
    got = {r.doc_id: (r.text, r.n) for r in p.pseudonymise(spark, spark.createDataFrame(rows, "doc_id long, text string"), key="k", mentions="n").collect()}
    names = lambda doc, pattern: re.fullmatch(pattern, got[doc][0])
    a = names(0, r"Mr (\w+ \w+) met Dr (\w+ \w+)\. My name is (\w+ \w+)\.")
    b = names(1, r"Herr (\w+ \w+), Prof (\w+ \w+)")
    c = names(2, r"(\w+ \w+) said hello; Mr (\w+ \w+) left\. A John Smithson stayed\.")
    d, e = names(3, r"Mrs (\w+ \w+) wrote"), names(4, r"Mr (\w+ \w+) wrote; (\w+ \w+) signed")
    assert {*a.groups(), *c.groups()} == {a[1]} and a[1] != "John Smith"
    assert b[1] == b[2] == names(5, r"Dr (\w+ \w+) alone")[1]
    assert d[1] == e[1] and e[2] == d[1].upper()
    assert a[1].split()[0].endswith(("o", "us", "in")) and [got[k][1] for k in range(6)] == [6, 4, 4, 2, 4, 2]


def test_names_of_all_kinds_stay_distinct(spark):
    """No two names, given (with or without a gender) or family, share a surrogate; none is a name of the corpus."""
    short = [a + b + c for a in "BDGHKLMN" for b in "aeiou" for c in "rlmn"]
    rows = [(k, f"{t} {x} {y} came") for k, (t, x, y) in enumerate((("Mr", "Mrs", "Dr")[k % 3], x, short[(7 * k + 3) % len(short)]) for k, x in enumerate(short))]
    rows += [(1000 + k, f"Prof Xy {chr(65 + k)}{'belcor'[k % 6]}son") for k in range(26)]
    got = {r.doc_id: r.text for r in p.pseudonymise(spark, spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()}
    seen = {}
    for doc, before in rows:
        for kind, x, y in zip(("given", "family"), before.split()[1:3], got[doc].split()[1:3], strict=True):
            assert seen.setdefault((kind, x), y) == y
    assert len(set(seen.values())) == len(seen) > 300
    assert not {y.lower() for y in seen.values()} & {x.lower() for _, x in seen}


def test_compound_names_and_plain_numbers():
    kinds = lambda t: [e[2:] for e in p.detect(t)]
    assert kinds("Ms. Anne-Marie Dupont") == [("given_f", "anne-marie"), ("family", "dupont")]
    assert kinds("Mr. O'Brien's hat, Mr Smith's, Mr Smith-led") == [("family", "o'brien"), ("family", "smith"), ("family", "smith")]
    assert kinds("+49 30 1234567, 5551234567") == [("phone", "49301234567"), ("phone", "5551234567")]
    assert kinds("123-45-6789 but not 2024-01-15, 1700000000, x5551234567 or 1123-45-6789") == [("ssn", "123456789")]
    out = p.replace("Ms. Anne-Marie O'Brien, 123-45-6789, +49 30 1234567, 5552234567", {}, "k")[0]
    assert re.fullmatch(r"Ms\. [A-Z][a-z]+-[A-Z][a-z]+ [A-Z]'[A-Z][a-z]+, 9\d\d-\d\d-\d{4}, \+\d\d \d\d \d{7}, \d{10}", out)
    assert [e[2] for e in p.detect(out)] == ["given_f", "family", "ssn", "phone", "phone"]


def test_mentions_replace_a_column_of_any_case(spark):
    out = p.pseudonymise(spark, spark.createDataFrame([(1, TEXT, 0)], "doc_id long, text string, N int"), mentions="n")
    assert out.columns == ["doc_id", "text", "n"] and out.first().n == 10
