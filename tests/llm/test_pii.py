import hashlib
import ipaddress
import re

import pytest
import regex
from tests.llm.conftest import HARD, make

from folioforge.llm import pii

TEXTS = [
    "Mr. Smith met John Smith and Mary Jones-Brown at 10.1.2.3; mail jo.hn_2@mail5.Example.com, +1 (743) 555-3824.",
    "call 212-555-1234 card 4111 1111 1111 1111 or 4785380592391139, ssn 123-45-6789",
    "г-жа Иванова и Иван Петров",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" iban DE89 3704 0044 0532 0130 00.',
    "again 10.1.2.3 and jo.hn_2@mail5.Example.com",
    "versions 4.0. and 3.5 of 2024-01-01 are no entities, nor is 12345",
]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


@pytest.fixture(scope="module")
def replaced(spark):
    got = pii.replace_entities(make(spark, [(i, t, "en", "a") for i, t in enumerate(TEXTS)]), key="k").collect()
    return {r.doc_id: r for r in got}


def test_formats_stay(replaced):
    assert re.fullmatch(
        r"Mr\. \w+ met \w+ \w+ and \w+ \w+-\w+ at \d+\.\d+\.\d+\.\d+; mail [a-z]{2}\.[a-z]{2}_\d@[a-z]{4}\d\.[A-Z][a-z]{6}\.com, \+1 \(\d{3}\) \d{3}-\d{4}\.", replaced[0].text
    )
    assert re.fullmatch(r"call \d{3}-\d{3}-\d{4} card 4\d{3} \d{4} \d{4} \d{4} or 4\d{15}, ssn \d{3}-\d{2}-\d{4}", replaced[1].text)
    assert luhn(re.search(r"card ([\d ]+) or", replaced[1].text)[1])
    assert re.fullmatch(r'token = "[0-9a-f]{40}" iban DE\d{2} \d{4} \d{4} \d{4} \d{4} \d{2}\.', replaced[3].text)
    assert (replaced[5].text, replaced[5].n_entities) == (TEXTS[5], 0)
    assert [replaced[i].n_entities for i in range(5)] == [8, 4, 3, 2, 2]


def test_names_match_gender_and_script(replaced):
    _, smith, john, smith_again, mary = re.search(r"(Mr)\. (\w+) met (\w+) (\w+) and (\w+)", replaced[0].text).groups()
    assert smith == smith_again != "Smith"
    assert john in pii.GIVEN["latin_m"] and john != "John"
    assert mary in pii.GIVEN["latin_f"] and mary != "Mary"
    madame, ivan, petrov = re.fullmatch(r"г-жа (\w+) и (\w+) (\w+)", replaced[2].text).groups()
    assert madame.endswith("ова") and ivan in pii.GIVEN["cyrillic_m"] and petrov.endswith("ов")


def test_coreference(replaced):
    ip, mail = re.fullmatch(r"again (\S+) and (\S+)", replaced[4].text).groups()
    assert ip in replaced[0].text and mail in replaced[0].text


def test_nothing_is_left(replaced):
    found = set(re.findall(r"[\w.]+@[\w.]+\w|\d+\.\d+\.\d+\.\d+|\d{16}|[0-9a-f]{40}|\d{3}-\d{4}", " ".join(TEXTS[:5])))
    assert not any(x in r.text for x in found for r in replaced.values())


def test_another_key_gives_other_surrogates(spark, replaced):
    other = pii.replace_entities(make(spark, [(0, TEXTS[0], "en", "a")]), key="other").first()
    assert other.text != replaced[0].text


ALPHABETS = {
    "latin": "abdefgiklmnoprstuvz",
    "cyrillic": "абвгдежзиклмнопрст",
    "greek": "αβγδεζηθικλμνξοπρστ",
    "arabic": "ابتثجحدرسشصطعفقكلم",
    "hebrew": "אבגדהוזחטיכלמנסעפצ",
    "devanagari": "कखगघचछजझटठडढतथदधनप",
    "han": "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林",
    "hangul": "김이박최정강조윤장임한오서신권황안송",
}


def surnames(n):
    """n short surnames of each script."""
    for letters in ALPHABETS.values():
        for i in range(n):
            name, i = letters[i % len(letters)], i // len(letters)
            while i or len(name) < 3:
                name, i = name + letters[i % len(letters)], i // len(letters)
            yield name.title()


def test_ten_thousand_surnames_of_each_script_get_distinct_surrogates(spark):
    names = set(surnames(10_000))
    assert len(names) == 10_000 * len(ALPHABETS)
    known = pii.assign_surrogates(spark.createDataFrame([("name", n) for n in names], "kind string, entity string"), "k").collect()
    assert {r.entity for r in known} == names
    made = {r.surrogate for r in known}
    assert len(made) == len(known) and not made & names
    script = lambda x: next((s for s, own in ALPHABETS.items() if x[0].lower() in own), "latin")
    assert all(regex.match(rf"\p{{{script(r.entity)}}}", r.surrogate) for r in known)


def test_small_spaces_are_widened(spark):
    """All 676 addresses of this form are in the corpus, so none of them is free."""
    az = "abcdefghijklmnopqrstuvwxyz"
    real = {f"{a}@{b}.co" for a in az for b in az} | {f"192.168.{i}.{j}" for i in range(1, 255, 2) for j in range(1, 255, 2)}
    rows = [("email" if "@" in x else "ip", x) for x in real]
    known = pii.assign_surrogates(spark.createDataFrame(rows, "kind string, entity string"), "k").collect()
    made = {r.surrogate for r in known}
    assert len(known) == len(real) == len(made) and not made & real
    assert all(ipaddress.ip_address(r.surrogate).is_private for r in known if r.kind == "ip")


def test_names_by_context_and_their_later_mentions(spark):
    rows = [
        "Mr. John Smith lives here. John met Smith.",
        "Priya Sharma called Wei Chen. Later Chen said that Priya left.",
        "My name is Aylin Demir and Demir is on the list; The Guardian said so.",
        "Dr. J. R. McDonald's house; McDonald moved. However Tom said no.",
        "王小明先生来了。 김철수 씨는 갔다. السيد محمود هنا ثم محمود غادر",
        "Dear Diary nothing to see. The Times said nothing.",
    ]
    got = {r.doc_id: r.text for r in pii.replace_entities(make(spark, [(i, t, "en", "a") for i, t in enumerate(rows)])).collect()}
    for i, names in enumerate([["John", "Smith"], ["Priya", "Sharma", "Wei", "Chen"], ["Aylin", "Demir"], ["McDonald"], ["小明", "김철수", "محمود"], []]):
        assert not [n for n in names if n in got[i]], (names, got[i])
    john, smith, again, last = re.fullmatch(r"Mr\. (\w+) (\w+) lives here\. (\w+) met (\w+)\.", got[0]).groups()
    assert (john, smith) == (again, last)
    assert "The Guardian said" in got[2] and "'s house" in got[3] and got[5].endswith("The Times said nothing.")


def test_spellings_of_one_entity_share_a_surrogate(spark):
    rows = [
        "John.Smith@acme.com john.smith@acme.com JOHN.SMITH@ACME.COM",
        "+1 555 123 4567 and 555-123-4567 and (555) 123-4567 and +44 20 7946 0958 and +442079460958",
        "DE89 3704 0044 0532 0130 00 and DE89370400440532013000 and GB82 WEST 1234 5698 7654 32",
        "4111 1111 1111 1111, 4111111111111111",
        "at 192.168.7.9 and 10.0.0.1 and 172.20.1.1 and 8.8.8.8 and 2001:db8::1 but not 12:30:45",
    ]
    got = {r.doc_id: r.text for r in pii.replace_entities(make(spark, [(i, t, "en", "a") for i, t in enumerate(rows)])).collect()}
    mails = got[0].split()
    assert mails[0].lower() == mails[1] == mails[2].lower() and mails[2].isupper() and mails[1].endswith(".com") and "smith" not in mails[1]
    phones = [re.sub(r"\D", "", x) for x in got[1].split(" and ")]
    assert phones[0] == "1" + phones[1] and phones[1] == phones[2] != "5551234567" and phones[3] == phones[4] and phones[3].startswith("44")
    ibans = [x.replace(" ", "") for x in got[2].split(" and ")]
    assert ibans[0] == ibans[1] != "DE89370400440532013000" and [x[:2] for x in ibans] == ["DE", "DE", "GB"] and re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", ibans[2])
    for x in ibans:
        assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    cards = got[3].split(", ")
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111" and luhn(cards[1])
    a, b, c, d, e = re.fullmatch(r"at (\S+) and (\S+) and (\S+) and (\S+) and (\S+) but not 12:30:45", got[4]).groups()
    assert a.startswith("192.168.") and b.startswith("10.") and ipaddress.ip_address(c).is_private and ipaddress.ip_address(d).is_global
    assert e.startswith("2001:") and ipaddress.ip_address(e).version == 6 and e != "2001:db8::1"


def test_numbers_that_are_no_cards_stay(spark):
    rows = ["ids 4111111111111112 and 9111 1111 1111 1111 but card 4111111111111111", "no 5105 1051 0510 5101 here", "+1 (843) 555-7672 170.106.47.9 end"]
    got = {r.doc_id: r for r in pii.replace_entities(make(spark, [(i, t, "en", "a") for i, t in enumerate(rows)])).collect()}
    assert re.fullmatch(r"ids 4111111111111112 and 9111 1111 1111 1111 but card 4\d{15}", got[0].text) and "4111111111111111" not in got[0].text
    assert (got[0].n_entities, got[1].n_entities, got[1].text) == (1, 0, rows[1])
    phone, ip = re.fullmatch(r"(\+1 \(\d{3}\) \d{3}-\d{4}) (\d+\.\d+\.\d+\.\d+) end", got[2].text).groups()
    assert got[2].n_entities == 2 and not ip.startswith("170.106.") and phone != "+1 (843) 555-7672"


def test_very_long_text_with_entities(spark):
    text = " ".join(f"w{i} Mr. {'Abcdefgh'[: 3 + i % 5]}{'xyzuv'[i % 5]} x{i % 50}@mail{i % 7}.com" for i in range(20_000))
    row = pii.replace_entities(make(spark, [(1, text, "en", "a")])).first()
    assert row.n_entities >= 40_000 and len(row.text.split()) == len(text.split())
    before, after = text.split(), row.text.split()
    pairs = {}
    for x, y in zip(before, after):
        assert pairs.setdefault(x, y) == y
    assert len(set(pairs.values())) == len(pairs)


def test_against_a_brute_force_over_all_documents(spark):
    """Entities one after the other in plain Python: the same pattern, the same draws, other code."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    pattern = regex.compile(pii.PATTERN.replace("Is", ""))
    kind = lambda e: next(("none" if k == "card" and not luhn(e) else k for k, p in pii.KINDS.items() if regex.fullmatch(p, e)), "name")

    def canonical(k, e):
        digits = re.sub(r"\D", "", e)
        if k == "phone":
            return digits[1:] if e[0] == "+" and len(digits) == 11 and digits[0] == "1" else digits
        return digits if k in ("card", "ssn") else e.lower() if k == "email" else e

    def draw(k, e, attempt):
        digest = hashlib.sha512(f"folioforge/{k}/{e}/{attempt}".encode()).hexdigest()
        number = lambda at, size=2: int(digest[at : at + size], 16)
        if k == "ip":
            octets = [str(number(4 * i, 4) % 254 + 1) for i in range(4)]
            assert not re.match(r"192\.168|169\.254|172\.(1[6-9]|2\d|3[01])\.", e)
            if e.startswith(("10.", "127.")):
                return ".".join([e.partition(".")[0], *octets[1:]])
            return ".".join([str(pii.PUBLIC[number(0, 4) % len(pii.PUBLIC)]), *octets[1:]])
        out, stop = "", len(e) - (len(e.rpartition(".")[2]) + 1 if k == "email" else 0)
        for i, c in enumerate(e):
            v = number(i * 2 % 126)
            if not c.isalnum() or i >= stop or k == "card" and i < 1:
                out += c
            elif c.isdigit():
                out += str(v % 8 + 2 if k == "phone" else v % 10)
            else:
                out += "abcdef"[v % 6] if k == "secret" else "abcdefghijklmnopqrstuvwxyz"[v % 26]
        return next(out[:-1] + d for d in "0123456789" if luhn(out[:-1] + d)) if k == "card" and luhn(e) else out

    found = {d: [m.group() for m in pattern.finditer(t or "")] for d, t in texts.items()}
    found = {d: [e for e in own if kind(e) != "none"] for d, own in found.items()}
    entities = {(kind(e), canonical(kind(e), e)) for own in found.values() for e in own}
    assert len(entities) > 5 and not [e for k, e in entities if k not in ("ip", "phone", "card", "email", "secret")]
    real, known, attempt = {e for _, e in entities}, {}, 0
    while pending := sorted(entities - known.keys()):
        for k, e in pending:
            new = draw(k, e, attempt)
            if new not in real and new not in known.values():
                known[k, e] = new
        attempt += 1

    def put(m):
        e = m.group()
        if kind(e) == "none":
            return e
        new = list(known[kind(e), canonical(kind(e), e)])
        if kind(e) == "ip":
            return "".join(new)
        slots = [c for c in new if c.isalnum()]
        drop = sum(map(str.isalnum, e)) - len(slots)
        out = ""
        for c in e:
            if c.isalnum():
                drop -= 1
            out += c if not c.isalnum() or drop >= 0 else (x := slots.pop(0)) and (x.upper() if c.isupper() else x)
        return out

    got = {r.doc_id: (r.text, r.n_entities) for r in pii.replace_entities(docs).collect()}
    assert got == {d: (t and pattern.sub(put, t), len(found[d])) for d, t in texts.items()}


@pytest.mark.parametrize("name", ["hard", "clashing"])
def test_hard_rows(name, request):
    got = pii.replace_entities(request.getfixturevalue(name)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t, *_ in HARD)


def test_repeated_rows(spark):
    rows = [(1, "at 10.1.2.3", "en", "a"), (1, "at 10.1.2.3", "en", "a"), (1, "10.9.9.9 and 10.1.2.3", "en", "a"), (None, "10.9.9.9", "en", "a")]
    got = sorted(r.text for r in pii.replace_entities(make(spark, rows)).collect())
    assert len(got) == 4
    nine, one = got[0].split(" and ") if " and " in got[0] else got[1].split(" and ")
    assert sorted(got) == sorted([f"at {one}", f"at {one}", f"{nine} and {one}", nine])


def test_empty(empty):
    assert pii.replace_entities(empty).count() == 0


def test_bare_surnames_and_cards_of_4_6_5(spark):
    rows = [(0, "John Smith came. Smith said Smithson and Dr. Smith-Jones left; Smith-Jones too.", "en", "a"), (1, "card 3782 822463 10005.", "en", "a"), (2, "Smith alone", "en", "a")]
    got = {r.doc_id: r for r in pii.replace_entities(make(spark, rows)).collect()}
    first, again, double, double_again = re.fullmatch(r"\w+ (\w+) came\. (\w+) said Smithson and Dr\. (\w+-\w+) left; (\w+-\w+) too\.", got[0].text).groups()
    assert first == again != "Smith" and double == double_again != "Smith-Jones" and got[0].n_entities == 5
    assert re.fullmatch(r"card 3\d{3} \d{6} \d{5}\.", got[1].text) and "822463" not in got[1].text and luhn(got[1].text)
    assert got[2].text == "Smith alone"
