"""Personal data against a second finder: tokens split by spaces, validated by other arithmetic."""

import ipaddress
import random
import string
from collections import Counter
from datetime import datetime

from trelliq.llm.pii import Feistel, pseudonymise

STEP = Feistel(b"a key of the tests only").forward
DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def card(t):
    d = [int(c) for c in t if c.isdigit()]
    if set(t) - set("0123456789-") or not 13 <= len(d) <= 19 or len(set(d)) < 2:
        return False
    return (sum(d[-1::-2]) + sum(DOUBLED[v] for v in d[-2::-2])) % 10 == 0


def iban(t):
    if not (15 <= len(t) <= 34 and t.isalnum() and t[:2].isalpha() and t[2:4].isdigit() and t.upper() == t):
        return False
    rest = 0
    for c in t[4:] + t[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def ssn(t):
    p = t.split("-")
    return [len(x) for x in p] == [3, 2, 4] and all(x.isdigit() for x in p) and p[0] not in ("000", "666") and p[0][0] != "9" and p[1] != "00" and p[2] != "0000"


def ip(t):
    try:
        return "." in t and bool(ipaddress.IPv4Address(t))
    except ValueError:
        return False


def date(t):
    for form in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y"):
        try:
            return 1900 <= datetime.strptime(t, form).year <= 2099 and len(t) == 10
        except ValueError:
            pass
    return False


def email(t):
    name, at, host = t.partition("@")
    return bool(at and name and "." in host and host.rpartition(".")[2].isalpha())


KINDS = {"card": card, "iban": iban, "ssn": ssn, "ip": ip, "date": date, "email": email}


def digits(rng, n):
    return "".join(rng.choice(string.digits) for _ in range(n))


def token(rng):
    kind = rng.choice([*KINDS, "word"])
    if kind == "card":
        n, t = rng.choice([13, 15, 16, 19]), None
        t = digits(rng, n)
        while rng.random() < 0.5 and not card(t):  # about half of them valid
            t = next((x for c in string.digits if card(x := t[:-1] + c)), digits(rng, n))
        return "-".join([t[:4], t[4:8], t[8:12], t[12:]]) if n == 16 and rng.random() < 0.3 else t
    if kind == "iban":
        body = digits(rng, rng.choice([12, 16, 20]))
        t = next(x for c in range(98) if iban(x := f"DE{c:02d}{body}"))
        return t if rng.random() < 0.5 else t[:-1] + str((int(t[-1]) + 1) % 10)
    if kind == "ssn":
        return f"{rng.choice(['000', '666', '9' + digits(rng, 2), digits(rng, 3)])}-{rng.choice(['00', digits(rng, 2)])}-{rng.choice(['0000', digits(rng, 4)])}"
    if kind == "ip":
        return ".".join(str(rng.choice([0, 7, 99, 255, 256, 300])) for _ in range(4))
    if kind == "date":
        y, m, d = rng.choice([1899, 1900, 1999, 2024, 2099, 2100]), rng.randint(1, 14), rng.randint(1, 32)
        return rng.choice([f"{y}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{m:02d}/{d:02d}/{y}"])
    if kind == "email":
        name = "".join(rng.choice("abcxyz019_") for _ in range(rng.randint(1, 8)))
        return rng.choice([f"{name}@ex{name.replace('_', '')}.org", f"{name}@nowhere", f"{name}.at.org"])
    return "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(1, 9)))


def shape(t):
    return "".join("d" if c.isdigit() else "a" if c.isalpha() else c for c in t)


def test_finder_and_validator_against_a_second_one():
    rng, seen, spared = random.Random(8), Counter(), Counter()
    for _ in range(1600):
        tokens = [token(rng) for _ in range(rng.randint(1, 12))]
        new, found = pseudonymise(" and ".join(tokens), STEP)
        changed = new.split(" and ")
        assert len(changed) == len(tokens)
        want = Counter()
        for a, b in zip(tokens, changed, strict=True):
            kinds = [k for k, valid in KINDS.items() if valid(a)]
            assert len(kinds) <= 1
            if not kinds:
                assert a == b, (a, b)
                spared[shape(a)] += 1
                continue
            want[kinds[0]] += 1
            assert KINDS[kinds[0]](b) and (kinds[0] == "ip" or shape(a) == shape(b)), (a, b)
        assert found == want
        seen += want
    assert min(seen[k] for k in KINDS) > 50 and spared.total() > 500


def test_written_dates_national_phones_and_versions():
    back = Feistel(b"a key of the tests only").backward
    for text, kind in (("on 4 March 1999 and", "date"), ("On March 4, 1999.", "date"), ("31 DECEMBER 2024", "date"), ("may 12, 2001", "date"), ("tel: 0171-1234567", "phone"), ("030/12345678", "phone")):
        new, found = pseudonymise(text, STEP)
        assert found == {kind: 1} and new != text and pseudonymise(new, back)[0] == text, (text, new)
    assert pseudonymise("31 DECEMBER 2024", STEP)[0].isupper() and len(pseudonymise("4 March 1999", STEP)[0].split(" ")[0]) == 1
    for text in ("31 February 1999", "March 4 1999", "version 2.10.0.1", "Version 2.10.0.1 of", "44 March 1999", "4 March 1899", "0171-123", "a0171-1234567"):
        assert pseudonymise(text, STEP) == (text, {}), text
    rng = random.Random(2)
    months = "January February March April May June July August September October November December".split()
    seen = {}
    for _ in range(3000):
        text = f"{rng.randint(1, 28)} {rng.choice(months)} {rng.randint(1900, 2099)}"
        new = pseudonymise(text, STEP)[0]
        assert seen.setdefault(new, text) == text and pseudonymise(new, back)[0] == text
