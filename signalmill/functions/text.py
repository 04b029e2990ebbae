"""Text functions over columns, all of them built from Spark's own."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of legal forms, dropped from the end of a name.
LEGAL_FORMS = ("inc", "ltee", "ltd", "limitee", "limited", "senc", "sencrl", "srl", "cie", "co", "corp", "corporation", "sec", "snc", "enr", "reg", "association", "cooperative", "coop", "societe", "sa", "sas")
# Fixed value: legal forms as they stand in a detected name, and what parts two companies in one.
FORM_IN_NAME = r"(?iu)\b(?:inc|ltee|ltée|ltd|llc|l\.?l\.?c|s\.?e\.?n\.?c(?:\.?r\.?l)?|srl|enr|corp|corporation|cie|limitee|limitée|limited|incorporated|cooperative|coopérative|coop)\b\.?"
BETWEEN_COMPANIES = r"(?i)\s+et\s+|\s*&\s*|\s*,\s*(?=\S)"
# Codes of provinces and territories.
PROVINCES = ("QC", "ON", "AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "PE", "SK", "YT")
# Keywords of organisational change, beside a profile's own.
CHANGE_KEYWORDS = ("implantation", "transformation", "amelioration continue", "transition numerique", "modernisation", "deploiement", "reorganisation", "restructuration", "mise en place", "directeur de la transformation", "gestionnaire amelioration continue", "responsable de la transition", "conduite du changement", "optimisation des processus", "chef de projet")
# Words of activities, which no person's name holds.
COMPANY_WORDS = (
    "construction", "transport", "services", "service", "entreprises", "entreprise", "groupe", "group", "consultants", "consultant", "conseil", "immobilier", "immobiliers", "gestion",
    "technologies", "technologie", "solutions", "solution", "systemes", "systèmes", "systems", "industries", "industrie", "distribution", "equipements", "équipements", "mecanique", "mécanique",
    "electrique", "électrique", "plomberie", "excavation", "renovation", "rénovation", "developpement", "développement", "holding", "investissements", "placements", "assurances", "courtage",
    "clinique", "restaurant", "boutique", "atelier", "garage", "ferme", "fils", "freres", "frères", "associes", "associés", "partners", "canada", "quebec", "québec", "international", "inter",
    "national", "agence", "studio", "laboratoire",
)
# What a company's pages say when it closed, and when it grows.
CLOSED = ("ferme definitivement", "fermeture definitive", "permanently closed", "cette entreprise a ferme", "domain for sale", "domaine a vendre", "site en construction", "coming soon", "cette entreprise est en liquidation", "avis de dissolution")
GROWING = ("nouvelle usine", "nouveau bureau", "expansion", "agrandissement", "nouvelle succursale", "croissance rapide", "ouverture d une nouvelle", "nous recrutons", "grande nouvelle")
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")


@lru_cache(maxsize=1)
def compatible() -> tuple[str, str, dict[str, str]]:
    """What Unicode's compatibility decomposition (NFKD) leaves of a character in
    ASCII: characters that become one, what they become, and those that become
    several. The table follows from Python's, a character at a time: whatever a
    decomposition reorders isn't ASCII."""
    one, plain, several = [], [], {}
    for code in chain(range(0x80, 0xD800), range(0xE000, 0x110000)):
        c = chr(code)
        left = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(left) == 1:
            one.append(c)
            plain.append(left)
        elif left:
            several[c] = left
    return "".join(one), "".join(plain), several


def normalise(text: Column) -> Column:
    """Lower-case ASCII letters, digits and single spaces, of the text's
    compatibility decomposition: accents go, ligatures and wide forms become
    letters, what has no ASCII form is deleted, the rest of the punctuation
    becomes a space. Null stays null."""
    one, plain, several = compatible()
    spelled = F.translate(text, one, plain)
    # few texts hold a character that becomes several
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    each = F.transform(F.regexp_extract_all(spelled, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(table, c), c))
    spelled = F.when(spelled.rlike("[^\\x00-\\x7F]"), F.array_join(each, "")).otherwise(spelled)
    ascii_ = F.lower(F.regexp_replace(spelled, r"[^\x00-\x7F]", ""))
    return F.trim(F.regexp_replace(ascii_, "[^a-z0-9]+", " "))


def normalised(text: str) -> str:
    """The same of one string, for names of columns and parameters."""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return " ".join("".join(c if c.isalnum() else " " for c in plain).split())


def words(normalised: Column, least: int = 1) -> Column:
    """Distinct words of at least ``least`` letters, in their order."""
    return F.array_distinct(F.filter(F.split(normalised, " "), lambda w: F.length(w) >= least))


def first_word(normalised: Column) -> Column:
    return F.substring_index(normalised, " ", 1)


def company_number(normalised: Column) -> Column:
    """Two groups of four digits at the start of a numbered company's name; null if none."""
    return F.nullif(F.regexp_extract(normalised, r"^(\d{4} \d{4})\b", 1), F.lit(""))


def without_legal_form(normalised: Column) -> Column:
    """Without trailing words of legal forms, as long as a word is left."""
    forms = "|".join(LEGAL_FORMS)
    return F.regexp_replace(normalised, rf"(?<=\w)(?: (?:{forms}))+$", "")


def without_parentheses(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\([^()]*\)", " "), r"\s+", " "))


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether a phrase stands in the text as whole words, in any case."""
    quoted = "".join("\\" + c if not (c.isalnum() or c == " ") else c for c in phrase)
    return F.coalesce(text.rlike(rf"(?iuU)(?<!\w){quoted}(?!\w)"), F.lit(False))


def keyword_hits(title: Column, keywords: list[str], change: tuple[str, ...] = CHANGE_KEYWORDS) -> Column:
    """Keywords whose normalised form is part of the normalised title, each once:
    the profile's in their order, then those of change."""
    wanted = [(k, normalised(k)) for k in dict.fromkeys([*keywords, *change])]
    plain = F.coalesce(normalise(title), F.lit(""))
    return F.array_compact(F.array(*[F.when(F.contains(plain, F.lit(form)), F.lit(k)) for k, form in wanted if form]))


def postal_codes(text: Column) -> Column:
    """Canadian postal codes of a text, whole (six characters, with their three-
    character area) and cut short (the area alone), sorted and each once."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    whole = F.regexp_extract_all(upper, F.lit(r"(?<![A-Z0-9])([A-Z]\d[A-Z])[^A-Z0-9]*(\d[A-Z]\d)(?![A-Z0-9])"), F.lit(0))
    whole = F.transform(whole, lambda c: F.regexp_replace(c, "[^A-Z0-9]", ""))
    areas = F.regexp_extract_all(upper, F.lit(r"(?<![A-Z0-9])([A-Z]\d[A-Z])(?![A-Z0-9])"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(whole, F.transform(whole, lambda c: F.substring(c, 1, 3)), areas)))


def city_of_address(address: Column) -> Column:
    """What stands before the first comma; null without one."""
    return F.when(F.contains(address, F.lit(",")), F.nullif(F.trim(F.substring_index(address, ",", 1)), F.lit("")))


def city_and_province(text: Column) -> Column:
    """Split at the last comma: struct of city and province; the whole text is
    the city where there is none."""
    cut = F.regexp_extract(text, r"^(.*),([^,]*)$", 1)
    last = F.regexp_extract(text, r"^(.*),([^,]*)$", 2)
    there = F.contains(text, F.lit(","))
    return F.struct(F.trim(F.when(there, cut).otherwise(text)).alias("city"), F.nullif(F.trim(F.when(there, last)), F.lit("")).alias("province"))


def city_in_parentheses(text: Column) -> Column:
    """``City (Province)`` as a struct of city and province."""
    pattern = r"^\s*(.*?)\s*\(([^()]*)\)\s*$"
    there = text.rlike(pattern)
    return F.struct(F.when(there, F.regexp_extract(text, pattern, 1)).otherwise(F.trim(text)).alias("city"), F.when(there, F.trim(F.regexp_extract(text, pattern, 2))).alias("province"))


def composed_address(line1: Column, line2: Column, line3: Column, line4: Column) -> Column:
    """Address, city, province and postal code of a registry's four lines: street,
    ``City (Province)``, a rest that is mostly empty, and the code."""
    clean = [F.trim(F.coalesce(x, F.lit(""))) for x in (line1, line2, line3, line4)]
    none = F.lit("")
    place = city_in_parentheses(clean[1])
    street = F.array_join(F.filter(F.array(clean[0], clean[2]), lambda x: x != ""), ", ")
    return F.struct(F.nullif(street, none).alias("address"), F.nullif(place["city"], none).alias("city"), place["province"].alias("province"), F.nullif(clean[3], none).alias("postal_code"))


def activity_words(label: Column, stop_words: list[str]) -> Column:
    """The words of a label that say something: over two letters, no stop word."""
    stop = F.array(*[F.lit(w) for w in stop_words]) if stop_words else F.array().cast("array<string>")
    return F.array_sort(F.array_except(F.coalesce(words(normalise(label), 3), F.array().cast("array<string>")), stop))


def name_forms(name: Column) -> Column:
    """Traits of a name: number at its head, parenthesis, conjunction."""
    plain = normalise(name)
    return F.array_compact(F.array(F.when(plain.rlike(r"^\d"), F.lit("number")), F.when(F.contains(name, F.lit("(")), F.lit("parenthesis")), F.when(plain.rlike(r"\b(et|and)\b"), F.lit("conjunction"))))


#: Why a name isn't a person's, in the order in which the rules are asked.
NOT_A_PERSON = ("kept", "not the form of a person's name", "holds a legal form", "holds a word of an activity")


def person_reason(name: Column, loose: bool = False) -> Column:
    """``kept`` for a person's name, or the first reason against it (see
    NOT_A_PERSON). The strict rule asks for "Last, First": one comma, one or two
    words of letters on each side; the loose one for two words and no comma."""
    kept, form, legal, activity = map(F.lit, NOT_A_PERSON)
    bare = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", " "))
    word = r"[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ'’.-]*"
    shaped = bare.rlike(rf"^{word} {word}$" if loose else rf"^{word}(?: {word})? ?, ?{word}(?: {word})?$")
    own = F.transform(F.split(bare, " "), lambda w: F.lower(F.regexp_replace(w, r"^[.,'’-]+|[.,'’-]+$", "")))
    busy = F.arrays_overlap(own, F.array(*[F.lit(w) for w in COMPANY_WORDS]))
    return F.when(~shaped, form).when(bare.rlike(FORM_IN_NAME), legal).when(busy, activity).otherwise(kept)


def person_name(name: Column) -> Column:
    """``strict`` or ``loose`` by the rule that keeps the name, else null."""
    kept = NOT_A_PERSON[0]
    return F.when(person_reason(name) == kept, F.lit("strict")).when(person_reason(name, True) == kept, F.lit("loose"))


def amount(value: Column) -> Column:
    """``1 234 567,50 $`` with no-break spaces; without cents if there are none."""
    whole = value == F.floor(value)
    shown = F.translate(F.when(whole, F.format_number(value, 0)).otherwise(F.format_number(value, 2)), ",.", "\u00a0,")
    return F.concat(shown, F.lit("\u00a0$"))


def french_date(day: Column) -> Column:
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(day))
    number = F.when(F.dayofmonth(day) == 1, F.lit("1er")).otherwise(F.dayofmonth(day).cast("string"))
    return F.concat_ws(" ", number, month, F.year(day).cast("string"))


def visible_text(html: Column) -> Column:
    """A page's text without scripts, styles, comments and tags; the five named
    entities and no-break spaces are decoded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    for name, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(character))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def links(html: Column) -> Column:
    """Addresses that the page's anchors point to, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"'#]+)"""), F.lit(1)))


def contacts(text: Column) -> Column:
    """Struct of the first e-mail address, phone number and staff count."""
    first = lambda pattern, group=0: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    # The patterns of what is found.
    return F.struct(
        first(r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+").alias("email"),
        first(r"(\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}").alias("phone"),
        first(r"(?iu)(\d{1,5})\s*(\+)?\s*(employ[ée]s|employees)", 1).cast("int").alias("staff"),
    )


def closed(text: Column) -> Column:
    """Whether a company's pages say that it is closed or not open yet."""
    plain = F.coalesce(normalise(text), F.lit(""))
    return F.exists(F.array(*[F.lit(w) for w in CLOSED]), lambda w: F.contains(plain, w))


def growing(text: Column) -> Column:
    """Phrases of growth on a company's pages, in the order of GROWING."""
    plain = F.coalesce(normalise(text), F.lit(""))
    return F.filter(F.array(*[F.lit(w) for w in GROWING]), lambda w: F.contains(plain, w))


def provinces(name: Column) -> Column:
    """Codes of provinces that stand in a text as words of their own, sorted; a
    province's name isn't its code."""
    found = F.regexp_extract_all(F.upper(F.coalesce(name, F.lit(""))), F.lit("[A-Za-z]+"), F.lit(0))
    return F.array_sort(F.array_intersect(found, F.array(*[F.lit(c) for c in PROVINCES])))


def entities(name: Column) -> Column:
    """How many companies a text names: its parts between conjunctions, ampersands
    and commas that hold a legal form."""
    parts = F.split(F.coalesce(name, F.lit("")), BETWEEN_COMPANIES, -1)
    return F.size(F.filter(parts, lambda p: p.rlike(FORM_IN_NAME)))


def values_of_keys(document: Column, keys: list[str]) -> Column:
    """The text values of some keys at any depth of a JSON document, in order,
    joined by spaces; null if there are none."""
    names = "|".join(keys)
    found = F.regexp_extract_all(document, F.lit(rf'"(?:{names})"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.nullif(F.array_join(F.filter(F.transform(found, lambda v: F.trim(v)), lambda v: v != ""), " "), F.lit(""))


def stored_form(source: Column, stored: Column, expected: Column) -> Column:
    """How a stored normal form differs from the one expected of its source."""
    return (
        F.when(F.coalesce(F.trim(source), F.lit("")) == "", "source empty").when(stored.isNull(), "null").when(stored == "", "empty").when(stored == expected, "equal")
        .when(F.startswith(expected, stored), "truncated").when(F.startswith(stored, expected), "longer").otherwise("divergent")
    )
