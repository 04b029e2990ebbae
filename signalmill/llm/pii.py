"""Operator 2: personal data by candidate gradient boosting.

Fixed patterns give the base spans, which always stay. Beside them high-recall
generators propose overlapping spans (disguised e-mail addresses, IPv6, phone
numbers without a plus, 13 to 15 digit cards, IBANs, social security numbers).
Boosted trees score each from features of its format and its context; the
scores are calibrated on a held-out part, each kind's threshold is the least
probability that keeps the wanted precision there (or, where that would lose more
than the wanted recall allows, the highest that keeps the recall), and of
overlapping spans the likeliest is selected.

The trees are trained here, on the candidates of texts that
:func:`training_spans` invents from a seed: the corpus has no labels of personal
data. A text holds a personal span, a near miss whose format is wrong (checksums,
dates, hardware addresses) or a look-alike of a right format that its context
gives away (part, order and serial numbers). Candidates that cover a personal span
only in part count as wrong. Scores are calibrated on templates that the trees
which score them never saw, but whose twins they did.

Defined results: a null text counts as empty and has no spans; texts of any
length are scanned whole in linear time; repeated rows give a row each; an
empty table gives an empty result; other columns are ignored by
:func:`find_pii`, and a null key stays null.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from ipaddress import IPv6Address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.boosting import BoostedTrees, Calibration
from signalmill.llm.common import table, text_or_empty, tune

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
ORDER = {k: i for i, k in enumerate(KINDS)}

# The patterns of the base spans. An e-mail address is found from
# its @, which takes linear time on long runs without one; possessive repeats
# and the look-behind don't change what matches.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the order of BASE_KINDS, then of start."""
    spans, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            spans.append(("email", start, found.end()))
        # a failed local part is left behind at once: its run ends at this @
        done = found.end() if found else at + 1
        at = text.find("@", done)
    if any(c in text for c in "0123456789"):
        for m in IP.finditer(text):
            if all(len(part := p.lstrip("0")) < 4 and int(part or "0") <= 255 for p in m.group().split(".")):
                spans.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                spans.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= len(_digits(m.group())) <= 15:
                    spans.append(("phone", *m.span()))
    return spans


#: Candidate generators, wide on purpose; repeats are bounded, so a scan is linear.
GENERATORS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at |＠) ?[A-Za-z0-9-]{1,63}(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?|\.)[A-Za-z0-9-]{2,63}){1,4}(?![A-Za-z0-9-])", re.I),
    "ip": re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}[ -]?[0-9]{4,6}[ -]?[0-9]{4,5}(?:[ -]?[0-9]{1,3})?(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ .-]{1,2}(?:\([0-9]{2,4}\)|[0-9]{2,5})){1,4}(?![0-9A-Za-z])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"),
}
#: Context words that speak for or against a kind.
CONTEXT = {
    "mail": ("mail", "email", "contact", "write", "reach", "courriel", "correo"),
    "call": ("phone", "telephone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "handy"),
    "pay": ("card", "visa", "mastercard", "amex", "credit", "payment", "carte", "karte", "tarjeta", "diners"),
    "net": ("ip", "ipv6", "host", "server", "address", "ping", "addr", "gateway", "router", "dns"),
    "bank": ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer"),
    "person": ("ssn", "social", "security", "taxpayer", "tax id"),
    "other": ("imei", "version", "order", "invoice", "isbn", "page", "http", "sku", "serial", "part", "date", "time", "score", "ratio", "build", "ticket", "release", "id", "tracking", "model", "mac", "catalogue"),
}
#: A context word stands as a word, in singular or plural.
SAID = {name: re.compile(rf"(?<![a-z])(?:{'|'.join(words)})s?(?![a-z])") for name, words in CONTEXT.items()}
#: Context words that stand beside a span of a kind, and beside its look-alikes.
HELPS = {"email": ("mail", "other"), "ip": ("net", "other"), "card": ("pay", "other"), "phone": ("call", "other"), "iban": ("bank", "other"), "ssn": ("person", "other")}
#: Last labels of host names, and words that stand before " at " in plain prose.
ENDINGS = frozenset("com org net edu gov info io co uk de fr es it nl eu ch be us ca au ie se no jp in br".split())
#: Countries with account numbers of this kind (fixed values).
NATIONS = frozenset("AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM TN TR UA VA VG XK".split())
PROSE = frozenset("look sold open met stay stop is was are were me us it him her live arrive available starts held priced works".split())
WINDOW = 32


def candidates(text: str) -> list[tuple[str, int, int]]:
    spans = []
    if any(c in text for c in "0123456789"):
        for kind in ("card", "phone", "iban", "ssn"):
            spans += [(kind, *m.span()) for m in GENERATORS[kind].finditer(text)]
        # a word in capitals may follow an account number: each beginning is proposed too
        spans += [("iban", s, s + k) for kind, s, e in spans if kind == "iban" for k in range(15, e - s) if text[s + k] == " "]
        if "::" in text or text.count(":") > 4:
            spans += [("ip", *m.span()) for m in GENERATORS["ip"].finditer(text) if m.group().strip(":")]
    lowered = text.lower()
    if any(s in lowered for s in ("(at)", "[at]", "{at}", "＠")) or (" at " in lowered and " dot " in lowered):
        spans += [("email", *m.span()) for m in GENERATORS["email"].finditer(text)]
    return spans


def _mod97(s: str) -> bool:
    s = s.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _real_address(span: str) -> bool:
    try:
        return bool(IPv6Address(span))
    except ValueError:
        return False


def _real_card(digits: str) -> bool:
    """Issuers' first digits and lengths."""
    n = len(digits)
    return luhn(digits) and ((n == 15 and digits[:2] in ("34", "37")) or (n == 14 and digits[:2] in ("30", "36", "38", "39")) or (n == 13 and digits[0] == "4"))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span = text[start:end]
    digits = _digits(span)
    groups = re.findall(r"[0-9]+", span)
    parts = span.split(":") if kind == "ip" else []
    labels = re.split(r"[^a-z0-9-]+", span.lower()) if kind == "email" else []
    before, after = text[max(0, start - WINDOW) : start].lower(), text[end : end + WINDOW].lower()
    near = [float(bool(said.search(before))) for said in SAID.values()]
    beyond = [float(bool(said.search(after))) for said in SAID.values()]
    for_it = list(CONTEXT).index(HELPS[kind][0])
    years = sum(len(g) == 4 and g[:2] in ("19", "20") for g in groups)
    days = sum(len(g) <= 2 and 1 <= int(g) <= 31 for g in groups)
    sound = {"iban": lambda: span[:2] in NATIONS and _mod97(span), "card": lambda: _real_card(digits), "ip": lambda: _real_address(span), "email": lambda: labels[-1] in ENDINGS, "ssn": lambda: digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000", "phone": lambda: 9 <= len(digits) <= 11 and not years}[kind]()
    return [
        *(float(kind == k) for k in KINDS), len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(luhn(digits)) if digits else 0.0, float(sound), span.count("-"), span.count("."), span.count(" "), span.count("("), span.count(":"),
        float(digits[:1] in "3456" and bool(digits)), float(digits[:1] == "0"), years, days, len(set(digits)),
        len(parts), max(map(len, parts), default=0), min(map(len, parts), default=0), float("::" in span), sum(map(str.isalpha, span)),
        float(" dot " in span.lower()), float(any(c in span for c in "([{\uff20")), len(labels), float(bool(labels) and labels[0] in PROSE),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "$€#/=") if before else 0.0, float(after[:1] in "%/=") if after else 0.0,
        float(before[-5:-1].isalnum() and before[-4:-2].isdigit()), *near, near[for_it], near[-1], beyond[for_it], beyond[-1],
    ]


def templates(draw: random.Random) -> dict[str, tuple[list, list, list]]:
    """Makers of personal spans, of look-alikes that only the context tells apart,
    and of near misses, by kind; a maker gives a span or (glued before, span, glued after).
    Twins stand beside each other, so that they fall into different folds."""
    some = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    capital = lambda n: "".join(draw.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))
    word = lambda: invented(draw)
    end = lambda: draw.choice(["com", "org", "net", "fr", "de", "edu", "io"])
    odd = lambda: draw.choice(["js", "py", "exe", "noon", "night", "house", "work", "three", "five", "txt"])
    prose = lambda: draw.choice(sorted(PROSE))
    pick = draw.randint

    def card(n: int, *heads: str) -> str:
        head = draw.choice(heads or ("3", "4", "5", "6"))
        body = head + some(n - 1 - len(head))
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    amex, diners, visa = lambda: card(15, "34", "37"), lambda: card(14, "30", "36", "38", "39"), lambda: card(13, "4")

    def fails(s: str) -> str:
        return s[:-1] + str((int(s[-1]) + pick(1, 9)) % 10)

    def cut(s: str, *sizes: int, mark: str = " ") -> str:
        at, out = 0, []
        for n in sizes:
            out.append(s[at : at + n])
            at += n
        return mark.join(out)

    def iban(country: str, body: str) -> str:
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{check:02d}{body}"

    fours = lambda s: " ".join(s[i : i + 4] for i in range(0, len(s), 4))
    swapped = lambda s: s[:2] + f"{(int(s[2:4]) + pick(1, 95)) % 97 + 2:02d}" + s[4:]
    nation = lambda: draw.choice([iban("DE", some(18)), iban("FR", some(10) + capital(1) + some(12)), iban("FR", some(23)), iban("NL", capital(4) + some(10)), iban("ES", some(20)), iban("GB", capital(4) + some(14)), iban("IT", capital(1) + some(22)), iban("BE", some(12)), iban("CH", some(17))])
    ssn = lambda mark="-": f"{pick(1, 665):03d}{mark}{pick(1, 99):02d}{mark}{pick(1, 9999):04d}"
    ten = lambda mark: cut(str(pick(2, 9)) + some(9), 3, 3, 4, mark=mark)
    pairs = lambda mark: f"0{pick(1, 9)}{mark}" + mark.join(some(2) for _ in range(4))
    date = lambda: (pick(1950, 2039), pick(1, 12), pick(1, 28))
    glue = lambda: draw.choice(["std", "this", "Foo", "mod", "vector"])
    return {
        "email": (
            [lambda: f"{word()} at {word()} dot {end()}", lambda: f"{word()}.{word()} at {word()} dot {end()}", lambda: f"{word()}_{word()} at {word()} dot {word()} dot {end()}", lambda: f"{word()}(at){word()}.{end()}", lambda: f"{word()}[at]{word()}.{end()}", lambda: f"{word()}\uff20{word()}.{end()}", lambda: f"{word()} [at] {word()} [dot] {end()}", lambda: f"{word()} (at) {word()} (dot) {end()}", lambda: f"{word()} {{at}} {word()} {{dot}} {end()}", lambda: f"{word()}{pick(1, 99)}(at){word()}.co.uk", lambda: f"{word()}{pick(1, 99)} at {word()}-{word()} dot {end()}", lambda: f"{word()}.{word()} [at] {word()}.{end()}"],
            [lambda: f"{prose()} at {word()} dot {end()}", lambda: f"{prose()} at {word()} dot {word()} dot {end()}", lambda: f"{prose()} at the dot {end()}"],
            [lambda: f"{prose()} at {word()} dot {odd()}", lambda: f"{word()} at {word()} dot {odd()}", lambda: f"sold at {pick(1, 99)} dot {some(2)}", lambda: f"{word()} (at) {pick(1, 99)}.{some(2)}", lambda: f"{word()} at {pick(1, 12)}.{some(2)} dot", lambda: f"{word()} [at] {word()}.{odd()}"],
        ),
        "ip": (
            [lambda: ":".join(f"{draw.randrange(65536):x}" for _ in range(8)), lambda: ":".join(hexa(4) for _ in range(8)), lambda: ":".join(hexa(4).upper() for _ in range(8)), lambda: f"fe80::{hexa(pick(1, 4))}:{hexa(4)}", lambda: f"fe80::{hexa(4)}:{hexa(4)}:{hexa(4)}:{hexa(4)}", lambda: f"fd{hexa(2)}:{hexa(4)}::{hexa(4)}:{hexa(4)}", lambda: f"2001:db8::{hexa(pick(1, 4))}", lambda: f"2001:{hexa(4)}:{hexa(4)}::{pick(1, 99)}", lambda: f"2a0{pick(0, 9)}:{hexa(4)}:{hexa(4)}::{pick(1, 99)}", lambda: f"2{hexa(3)}:{hexa(3)}::{hexa(1)}", lambda: f"2{hexa(3)}:{hexa(4)}:{hexa(1)}:{hexa(1)}::{hexa(3)}", lambda: f"2{hexa(3)}:{hexa(3)}:{hexa(4)}:{hexa(3)}::"],
            [lambda: f"{pick(1, 9)}::{pick(1, 9)}", lambda: ":".join(hexa(4) for _ in range(8)), lambda: f"{pick(10, 99)}::{pick(10, 99)}"],
            [lambda: f"{pick(0, 23):02d}:{pick(0, 59):02d}:{pick(0, 59):02d}::", lambda: ":".join(hexa(2) for _ in range(6)), lambda: ":".join(hexa(2) for _ in range(8)) + ":00", lambda: ":".join(f"{pick(0, 59):02d}" for _ in range(6)), lambda: (glue(), f"::{draw.choice(['be', 'ba', 'fa', 'ad'])}", "rin"), lambda: (glue(), "::", "move"), lambda: f"{pick(1, 21)}:{pick(1, 9)}:{pick(1, 9)}::{pick(1, 9)}::{pick(1, 9)}"],
        ),
        "card": (
            [amex, lambda: cut(amex(), 4, 6, 5), lambda: cut(amex(), 4, 6, 5, mark="-"), diners, lambda: cut(diners(), 4, 6, 4), lambda: cut(diners(), 4, 6, 4, mark="-"), visa, amex, diners],
            [amex, lambda: card(15, "35", "86", "01"), lambda: card(14, "1", "2", "8"), diners, lambda: card(13, "9", "1"), visa],
            [lambda: fails(amex()), lambda: fails(diners()), lambda: some(pick(13, 15)), lambda: cut(some(14), 4, 5, 5), lambda: card(15, "0", "1", "8", "9"), lambda: fails(visa()), lambda: cut(fails(amex()), 4, 6, 5)],
        ),
        "phone": (
            [lambda: ten("-"), lambda: ten("."), lambda: ten(" "), lambda: f"({pick(2, 9)}{some(2)}) {some(3)}-{some(4)}", lambda: f"({pick(2, 9)}{some(2)}) {some(3)} {some(4)}", lambda: f"({pick(2, 9)}{some(2)}) {some(3)}.{some(4)}", lambda: pairs(" "), lambda: pairs("."), lambda: pairs("-"), lambda: f"0{some(3)} {some(3)} {some(4)}", lambda: f"0{some(2)} {some(4)} {some(4)}", lambda: f"0{some(2)}-{some(4)}-{some(4)}", lambda: f"0{some(3)} {some(5)}", lambda: f"0{some(4)} {some(5)}", lambda: f"0{some(2)} {some(3)} {some(4)}"],
            [lambda: ten("-"), lambda: ten("."), lambda: ten(" "), lambda: f"0{some(2)}-{some(4)}-{some(4)}", lambda: f"0{some(3)} {some(5)}", lambda: f"0{some(2)} {some(3)} {some(4)}"],
            [lambda: "{}-{:02d}-{:02d}".format(*date()), lambda: "{2:02d}.{1:02d}.{0}".format(*date()), lambda: "{2:02d} {1:02d} {0}".format(*date()), lambda: f"{pick(1990, 2010)}-{pick(2011, 2030)}", lambda: f"{some(2)} {some(2)}", lambda: f"97{pick(8, 9)}-{some(2)}-{some(5)}-{some(2)}", lambda: f"97{pick(8, 9)} {some(2)} {some(4)} {some(3)}", lambda: f"{some(5)}-{some(4)}", lambda: f"{pick(1, 99):02d} {some(3)} {some(3)}", lambda: f"{some(2)}.{some(2)}", lambda: f"{some(3)}-{some(5)}-{some(3)}", lambda: "{2:02d}-{1:02d}-{0}".format(*date()), lambda: f"{some(2)}-{some(2)}-{some(2)}", lambda: f"{some(3)} {some(3)}"],
        ),
        "iban": (
            [nation, lambda: fours(nation()), nation, lambda: fours(nation()), nation, lambda: fours(nation())],
            [lambda: iban(draw.choice(["XA", "QZ", "ZZ", "UU"]), some(14)), lambda: fours(iban(draw.choice(["XA", "QZ", "ZZ", "UU"]), some(16)))],
            [lambda: swapped(nation()), lambda: fours(swapped(nation())), lambda: fours(f"{capital(2)}{some(2)}{capital(4)}{some(pick(8, 12))}"), lambda: f"{capital(2)}{some(14)}", lambda: fours(swapped(nation())), lambda: swapped(nation())],
        ),
        "ssn": (
            [ssn, ssn, ssn, lambda: ssn(" "), lambda: ssn(" "), lambda: ssn(" ")],
            [ssn, ssn, ssn, lambda: ssn(" "), lambda: ssn(" "), lambda: ssn(" ")],
            [lambda: f"{draw.choice(['000', '666', '900', '987'])}-{some(2)}-{some(4)}", lambda: f"{draw.choice(['000', '666', '900', '987'])} {some(2)} {some(4)}", lambda: f"{pick(100, 599)}-{some(2)}-0000", lambda: f"{pick(100, 599)}-00-{some(4)}", lambda: f"{pick(100, 599)} 00 {some(4)}", lambda: f"9{some(2)}-{some(2)}-{some(4)}"],
        ),
    }


#: Parts into which the templates are dealt.
FOLDS = 3


def invented(draw: random.Random) -> str:
    return "".join(draw.choice(["ba", "ton", "ri", "mel", "so", "ker", "an", "lu", "est", "vi"]) for _ in range(draw.randint(1, 3)))


#: Shares of the texts: with a personal span, with a look-alike (the others hold a
#: near miss); of personal spans and look-alikes without a context word.
PERSONAL, ALIKE, SILENT = 0.5, 0.15, 0.5


def training_spans(size: int = 3000, seed: int = 7) -> list[tuple[str, str, int, int, int, int]]:
    """(text, kind, start, end, personal, fold of its template) of all candidates of
    ``size`` invented texts, the same for a seed. A personal span stands beside a
    word that helps it or alone, a look-alike beside one that speaks against it or,
    less often, alone, a near miss beside any."""
    draw = random.Random(seed)
    makers, made = templates(draw), []
    filler = lambda: draw.choice([invented(draw), invented(draw), "the", "please", "and", "for", "with", "our"])
    for n in range(size):
        kind, luck = KINDS[n % len(KINDS)], draw.random()
        sort = 0 if luck < PERSONAL else 1 if luck < PERSONAL + ALIKE else 2
        place = draw.randrange(len(makers[kind][sort]))
        given = makers[kind][sort][place]()
        pre, span, post = given if isinstance(given, tuple) else ("", given, "")
        word = draw.choice(CONTEXT[HELPS[kind][draw.random() < 0.5 if sort == 2 else sort]])
        silent = draw.random() < SILENT
        said = "" if silent else draw.choice([word, word, word.capitalize(), word.upper()])
        trailing = not silent and draw.random() < 0.15  # the word follows instead
        left = f"{filler()} {filler()} " + ("" if silent or trailing else said + draw.choice([": ", " ", " is ", " no. ", " ", " number "])) + pre
        text = f"{left}{span}{post}{draw.choice([' ', ', ', '. ', ' '])}{draw.choice(['is my ', '']) + said + ' ' if trailing else ''}{filler()} {filler()}."
        true, taken = (kind, len(left), len(left) + len(span)), base_spans(text)
        for k, s, e in candidates(text):
            if all(e <= a or b <= s for _, a, b in taken):
                made.append((text, k, s, e, int(sort == 0 and (k, s, e) == true), place % FOLDS))
    return made


class Model:
    """Trees of all kinds, and each kind's calibration and threshold.

    Scores for the calibration come from trees that never saw the span's
    template: the templates are dealt into ``FOLDS`` parts, each is scored by trees
    of the others. The threshold is the least probability beyond which the share
    ``precision`` of those spans is personal; where fewer than ``recall`` of the
    personal ones lie beyond it, the highest beyond which so many do.
    """

    def __init__(self, size: int = 6000, seed: int = 7, precision: float = 0.9, recall: float = 0.8):
        made = training_spans(size, seed)
        x = np.array([features(t, k, a, b) for t, k, a, b, *_ in made], float)
        y = np.array([m[4] for m in made], float)
        kinds = np.array([m[1] for m in made])
        fold = np.array([m[5] for m in made])
        score = np.zeros(len(made))
        for f in range(FOLDS):
            score[fold == f] = BoostedTrees().fit(x[fold != f], y[fold != f]).score(x[fold == f])
        self.trees = BoostedTrees().fit(x, y)
        self.calibration, self.threshold = {}, {}
        for kind in KINDS:
            own = kinds == kind
            self.calibration[kind] = Calibration().fit(score[own], y[own])
            p, true = self.calibration[kind].probability(score[own]), y[own]
            levels = np.unique(p)
            good = [t for t in levels if true[p >= t].mean() >= precision]
            wide = [t for t in levels if true[p >= t].sum() >= recall * true.sum()]
            self.threshold[kind] = float(min(min(good, default=2.0), max(wide)))

    def probabilities(self, rows: list[list[float]], kinds: list[str]) -> np.ndarray:
        score, named = self.trees.score(np.array(rows, float)), np.array(kinds)
        out = np.zeros(len(rows))
        for kind in set(kinds):
            out[named == kind] = self.calibration[kind].probability(score[named == kind])
        return out


@lru_cache(maxsize=2)
def trained(size: int = 6000, seed: int = 7, precision: float = 0.9, recall: float = 0.8) -> Model:
    return Model(size, seed, precision, recall)


def added_spans(model: Model, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
    """Selected candidates that overlap no base span and no likelier candidate;
    of equally likely ones the first stays, then the one of the later kind."""
    proposed = candidates(text)
    if not proposed:
        return []
    p = model.probabilities([features(text, *c) for c in proposed], [c[0] for c in proposed])
    ranked = sorted((-float(q), c[1], -ORDER[c[0]], c) for q, c in zip(p, proposed, strict=True) if q >= model.threshold[c[0]])
    picked, chosen = _merged(sorted((s, e) for _, s, e in base)), []  # disjoint and sorted throughout
    for q, _, _, (kind, s, e) in ranked:
        i = bisect_left(picked, (e, -1))
        if not i or picked[i - 1][1] <= s:
            picked.insert(i, (s, e))
            chosen.append((kind, s, e, -q))
    return chosen


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("probability", pa.float64())])


def find_pii(df: DataFrame, key: str = "doc_id", text_column: str = "text", model: Model | None = None) -> DataFrame:
    """(key, spans): all spans of each whole text, as structs of kind, start, end
    (code points, end exclusive), base and calibrated probability (1 for base).

    One pass over the rows without a shuffle. The model, a few kB, goes with the task.
    """
    model = model or trained()

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(1):
                text = value.as_py()
                base = base_spans(text)
                spans = [(k, s, e, True, 1.0) for k, s, e in base] + [(k, s, e, False, p) for k, s, e, p in added_spans(model, text, base)]
                spans.sort(key=lambda x: (ORDER[x[0]], x[1], x[2]))
                found.append([dict(zip(("kind", "start", "end", "base", "probability"), x, strict=True)) for x in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(SPAN))], names=[key, "spans"])

    rows = df.select(F.col(key).cast("long").alias(key), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(of_batch, f"`{key}` long, spans array<struct<kind: string, start: int, end: int, base: boolean, probability: double>>")


def redact(df: DataFrame, key: str = "doc_id", text_column: str = "text", model: Model | None = None) -> DataFrame:
    """(key, text) with every span replaced by its kind in brackets."""
    model = model or trained()

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                text = value.as_py()
                base = base_spans(text)
                spans = [*added_spans(model, text, base), *reversed(base)]
                kinds = {s: k for k, s, *_ in spans}
                pieces, at = [], 0
                for s, e in _merged(sorted((s, e) for _, s, e, *_ in spans)):
                    pieces += [text[at:s], f"[{kinds[s]}]"]
                    at = e
                out.append("".join([*pieces, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "text"])

    rows = df.select(F.col(key).cast("long").alias(key), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(of_batch, f"`{key}` long, text string")


def spelled(spans):
    """Spans as kind:start:end, joined by commas in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.filter("spans", lambda s: s["base"] & (s["kind"] == k))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
