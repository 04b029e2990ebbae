"""Text functions over names, addresses, pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalmill.functions import numbers, text
from signalmill.operators import resolution
from signalmill.plans.views import Query, table

_ODD = "concat(' ', replace(p_name, ' ', '  -'), ' L''ÉTÉ & Fils (', p_brand, ') inc ltee')"


def _odd_name():
    return F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  -")), F.lit(" L'ÉTÉ & Fils ("), "p_brand", F.lit(") inc ltee"))


def normalised_names(spark, sf_dir):
    """Names without accents, case and punctuation, and without legal forms."""
    p = table(spark, sf_dir, "part").select("p_partkey", _odd_name().alias("name"))
    plain = text.normalise(F.col("name"))
    return p.select("p_partkey", plain.alias("plain"), text.first_word(plain).alias("first"), text.without_legal_form(plain).alias("short"), F.size(text.words(plain, 3)).alias("words"))


def name_traits(spark, sf_dir):
    """Forms of names, and names without their parentheses."""
    form = F.col("p_partkey") % 4
    name = F.when(form == 0, F.concat(F.lit("12 Ferme et "), "p_name")).when(form == 1, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") "))).when(form == 2, F.concat("p_name", F.lit(" and Co"))).otherwise(F.col("p_name"))
    p = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return p.select("p_partkey", text.without_parentheses(F.col("name")).alias("outside"), F.array_join(text.name_forms(F.col("name")), ",").alias("forms"))


#: Names beyond Latin-1 and their normal forms by Unicode's decomposition.
_FOREIGN = (("Dvořák & Søn", "dvorak sn"), ("Nguyễn Ő", "nguyen o"), ("Łódź Ｆｕｌｌ", "odz full"), ("ﬁnance №5 ½", "finance no5 12"), ("Ǆ ㎏ Ⅷ ①", "dz kg viii 1"))


def foreign_names(spark, sf_dir):
    """Names with letters from all of Unicode, in normal form."""
    name = F.element_at(F.array(*[F.lit(n) for n, _ in _FOREIGN]), (F.col("s_suppkey") % len(_FOREIGN) + 1).cast("int"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(name, F.lit(" "), "s_name").alias("name"))
    return s.select("s_suppkey", text.normalise(F.col("name")).alias("plain"))


_PERSONS = ("Lessard, Martin", "Martin Lessard", "Bell Canada", "Gagnon inc., Luc", "Transport, Jean", "Saint-Jean, Marie Ève", "O'Brien", "9528-9393 Québec inc.")


def person_names(spark, sf_dir):
    """Why names are a person's or not, by the strict and the loose rule."""
    name = F.element_at(F.array(*[F.lit(n) for n in _PERSONS]), (F.col("c_custkey") % len(_PERSONS) + 1).cast("int"))
    c = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))
    return c.select("c_custkey", text.person_reason(F.col("name")).alias("strict"), text.person_reason(F.col("name"), True).alias("loose"), text.person_name(F.col("name")).alias("kind"))


def composed_addresses(spark, sf_dir):
    """Addresses of a registry's four lines."""
    k = F.col("c_custkey")
    lines = [F.concat(k.cast("string"), F.lit(" rue A ")), F.when(k % 3 == 0, F.concat(F.lit("City"), F.col("c_nationkey").cast("string"), F.lit(" (Québec)"))).when(k % 3 == 1, F.lit("Laval ")), F.when(k % 5 == 0, F.lit("bureau 2")), F.when(k % 2 == 0, F.lit("H1J1Z1"))]
    c = table(spark, sf_dir, "customer").select("c_custkey", text.composed_address(*lines).alias("a"))
    return c.select("c_custkey", "a.address", "a.city", "a.province", "a.postal_code")


def activity_labels(spark, sf_dir):
    """The words of an activity's label that say something."""
    label = F.concat(F.lit("Services de "), F.replace("p_type", F.lit(" "), F.lit(", ")), F.lit(" à ÉTÉ (autres)"))
    p = table(spark, sf_dir, "part").select("p_partkey", label.alias("label"))
    return p.select("p_partkey", F.array_join(text.activity_words(F.col("label"), ["services", "autres"]), ",").alias("words"))


_PAGES = ("Nous recrutons! Nouvelle usine, tél. 514 555 1234", "Cette entreprise a fermé", "+1 (418)555-1234, 25+ employés, a.b@c.qc.ca", "Expansion et croissance rapide 4185551234", "Coming  soon")


def company_pages(spark, sf_dir):
    """Contacts, closing and growth that companies' pages tell."""
    said = F.element_at(F.array(*[F.lit(n) for n in _PAGES]), (F.col("c_custkey") % len(_PAGES) + 1).cast("int"))
    c = table(spark, sf_dir, "customer").select("c_custkey", said.alias("said"))
    found = text.contacts(F.col("said"))
    return c.select("c_custkey", found["email"].alias("email"), found["phone"].alias("phone"), found["staff"].alias("staff"), text.closed(F.col("said")).alias("closed"), F.array_join(text.growing(F.col("said")), ",").alias("growing"))


def durations(spark, sf_dir):
    """Durations as service managers write them, in seconds."""
    k = F.col("o_orderkey")
    said = F.when(k % 6 == 0, F.concat((k % 24).cast("string"), F.lit("h "), (k % 60).cast("string"), F.lit("min"))).when(k % 6 == 1, F.lit("infinity")).when(k % 6 == 2, F.lit("1.5 hours")).when(k % 6 == 3, F.lit("3 parsecs")).when(k % 6 == 4, F.lit(" ")).otherwise(F.concat((k % 9).cast("string"), F.lit("w 2d")))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.duration(said).alias("seconds"))


_ADDRESS = "concat('City', c_nationkey, ', QC J', c_custkey % 10, CASE c_custkey % 3 WHEN 0 THEN 'L 2A4' WHEN 1 THEN 'L' ELSE 'K3B7' END)"


def _address():
    code = F.when(F.col("c_custkey") % 3 == 0, "L 2A4").when(F.col("c_custkey") % 3 == 1, "L").otherwise("K3B7")
    return F.concat(F.lit("City"), F.col("c_nationkey").cast("string"), F.lit(", QC J"), (F.col("c_custkey") % 10).cast("string"), code)


def postal_codes(spark, sf_dir):
    """Whole and cut postal codes of addresses, with their cities."""
    c = table(spark, sf_dir, "customer").select("c_custkey", _address().alias("address"))
    place = text.city_and_province(F.col("address"))
    return c.select("c_custkey", F.array_join(text.postal_codes(F.col("address")), ",").alias("codes"), text.city_of_address(F.col("address")).alias("city"), place["province"].alias("rest"))


def company_numbers(spark, sf_dir):
    """Numbered companies told by their names' heads."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lpad((F.col("c_custkey") * 7 % 10000).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.col("c_custkey") * 13 % 10000).cast("string"), 4, "0"), F.lit(" Québec inc."))).otherwise(F.col("c_name")).alias("name"))
    number = text.company_number(text.normalise(F.col("name")))
    return c.select("c_custkey", number.alias("number"), resolution.name_class(text.normalise(F.col("name")), F.lit(False), F.lit(False)).alias("class"))


def whole_phrases(spark, sf_dir):
    """Documents that hold phrases as whole words, by language."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count_if(text.has_phrase(F.col("text"), "the")).alias("the"), F.count_if(text.has_phrase(F.col("text"), "of the")).alias("of_the"), F.count_if(text.has_phrase(F.col("text"), "zzz")).alias("none"))


def keyword_hits(spark, sf_dir):
    """Keywords in titles (here first lines), each once."""
    more = F.when(F.col("doc_id") % 3 == 0, " Chef de projet, amélioration continue").when(F.col("doc_id") % 3 == 1, " TRANSFORMATION").otherwise("")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.split("text", "\n")[0], more).alias("title"))
    return d.select("doc_id", F.array_join(text.keyword_hits(F.col("title"), ["The", "ion", "été", "the"]), ",").alias("hits"))


def page_contacts(spark, sf_dir):
    """Contacts of pages and the number of their links."""
    p = table(spark, sf_dir, "pages").select("page_id", "html", text.visible_text(F.col("html")).alias("seen"))
    c = text.contacts(F.col("seen"))
    return p.select("page_id", c["email"].alias("email"), c["phone"].alias("phone"), c["staff"].alias("staff"), F.size(text.links(F.col("html"))).alias("links"), F.length("seen").alias("length"))


def amounts(spark, sf_dir):
    """Amounts and dates as they are read in French."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", text.amount(F.col("o_totalprice")).alias("amount"), text.french_date(F.col("o_orderdate")).alias("day"))


def parsed_numbers(spark, sf_dir):
    """Numbers, dates and quarters read from text; bad ones are null."""
    o = table(spark, sf_dir, "orders")
    shown = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.concat(F.format_number("o_totalprice", 2), F.lit(" $")))
    day = F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    file = F.concat(F.lit("list_"), F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(".csv"))
    return o.select("o_orderkey", numbers.parse_number(shown).alias("value"), F.to_date(numbers.parse_date(day)).alias("day"), numbers.quarter_date(file).alias("quarter"))


def percentages(spark, sf_dir):
    """A part of nothing counts as all of it."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 4).alias("part"), (F.col("c_custkey") % 3 * 10).alias("whole"))
    return c.select("c_custkey", F.round(numbers.percentage(F.col("part"), F.col("whole")), 4).alias("percent"))


def named_provinces(spark, sf_dir):
    """Provinces and entities that texts about customers name."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, " inc. (Québec) et Nova Scotia Ltd").when(F.col("c_custkey") % 3 == 1, ", ON").otherwise("")).alias("said"))
    return c.select("c_custkey", F.array_join(text.provinces(F.col("said")), ",").alias("provinces"), text.entities(F.col("said")).alias("entities"))


def nested_values(spark, sf_dir):
    """Values of some keys of nested documents."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("city"), F.array(F.struct(F.col("o_orderpriority").alias("street"), F.lit("x").alias("other"))).alias("more"))).alias("document"))
    return o.select("o_orderkey", text.values_of_keys(F.col("document"), ["city", "street"]).alias("said"))


def stored_forms(spark, sf_dir):
    """How stored normal forms differ from those expected."""
    p = table(spark, sf_dir, "part")
    stored = F.when(F.col("p_partkey") % 6 == 0, F.lit(None)).when(F.col("p_partkey") % 6 == 1, "").when(F.col("p_partkey") % 6 == 2, F.substring("p_name", 1, 4)).when(F.col("p_partkey") % 6 == 3, F.concat("p_name", F.lit("s"))).when(F.col("p_partkey") % 6 == 4, F.lit("zzz")).otherwise(F.col("p_name"))
    source = F.when(F.col("p_partkey") % 10 == 0, " ").otherwise(F.col("p_name"))
    return p.groupBy(text.stored_form(source, stored, text.normalise(F.col("p_name"))).alias("class")).agg(F.count("*").alias("n"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (foreign_names, person_names, composed_addresses, activity_labels, company_pages, durations, named_provinces, nested_values, stored_forms, normalised_names, name_traits, postal_codes, company_numbers, whole_phrases, keyword_hits, page_contacts, amounts, parsed_numbers, percentages)}

_PLAIN = "trim(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_MONTHS = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(text.MONTHS, 1))
_DAY = f"concat(CASE WHEN day(o_orderdate) = 1 THEN '1er' ELSE CAST(day(o_orderdate) AS VARCHAR) END, ' ', CASE month(o_orderdate) {_MONTHS} END, ' ', year(o_orderdate))"
_FIRST_LINE = _PLAIN.format(x="concat(split_part(text, chr(10), 1), CASE doc_id % 3 WHEN 0 THEN ' Chef de projet, amélioration continue' WHEN 1 THEN ' TRANSFORMATION' ELSE '' END)")
_CHANGE = ", ".join(f"CASE WHEN contains(t, '{k}') THEN '{k}' END" for k in text.CHANGE_KEYWORDS)
_TRAITS = "CASE p_partkey % 4 WHEN 0 THEN concat('12 Ferme et ', p_name) WHEN 1 THEN concat(p_name, ' (', p_brand, ') ') WHEN 2 THEN concat(p_name, ' and Co') ELSE p_name END"


def _cases(key: str, values: tuple) -> str:
    """SQL that picks the value at the key's remainder."""
    shown = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {shown(v)}" for i, v in enumerate(values)) + " END"


_FORM, _LEGAL, _BUSY = text.NOT_A_PERSON[1:]

SQL = {
    "foreign_names": f"SELECT s_suppkey, concat({_cases('s_suppkey', tuple(w for _, w in _FOREIGN))}, ' ', trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g'))) AS plain FROM supplier",
    "person_names": f"SELECT c_custkey, {_cases('c_custkey', ('kept', _FORM, _FORM, _LEGAL, _BUSY, 'kept', _FORM, _FORM))} AS strict, {_cases('c_custkey', (_FORM, 'kept', _BUSY, _FORM, _FORM, _FORM, _FORM, _FORM))} AS loose, {_cases('c_custkey', ('strict', 'loose', None, None, None, 'strict', None, None))} AS kind FROM customer",
    "composed_addresses": "SELECT c_custkey, concat(c_custkey, ' rue A', CASE WHEN c_custkey % 5 = 0 THEN ', bureau 2' ELSE '' END) AS address, CASE c_custkey % 3 WHEN 0 THEN concat('City', c_nationkey) WHEN 1 THEN 'Laval' END AS city, CASE WHEN c_custkey % 3 = 0 THEN 'Québec' END AS province, CASE WHEN c_custkey % 2 = 0 THEN 'H1J1Z1' END AS postal_code FROM customer",
    "activity_labels": "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_concat(string_split(lower(p_type), ' '), ['ete']), lambda w: length(w) > 2))), ',') AS words FROM part",
    "company_pages": f"SELECT c_custkey, {_cases('c_custkey', (None, None, 'a.b@c.qc.ca', None, None))} AS email, {_cases('c_custkey', ('514 555 1234', None, '+1 (418)555-1234', '4185551234', None))} AS phone, {_cases('c_custkey', (None, None, 25, None, None))} AS staff, {_cases('c_custkey', (False, True, False, False, True))} AS closed, {_cases('c_custkey', ('nouvelle usine,nous recrutons', '', '', 'expansion,croissance rapide', ''))} AS growing FROM customer",
    "durations": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN (o_orderkey % 24) * 3600.0 + (o_orderkey % 60) * 60.0 WHEN 2 THEN 5400.0 WHEN 5 THEN (o_orderkey % 9) * 604800.0 + 172800.0 END AS seconds FROM orders",
    "named_provinces": "SELECT c_custkey, CASE c_custkey % 3 WHEN 1 THEN 'ON' ELSE '' END AS provinces, CASE c_custkey % 3 WHEN 0 THEN 2 ELSE 0 END AS entities FROM customer",
    "nested_values": "SELECT o_orderkey, concat(o_orderstatus, ' ', o_orderpriority) AS said FROM orders",
    "stored_forms": "SELECT CASE WHEN p_partkey % 10 = 0 THEN 'source empty' WHEN p_partkey % 6 = 0 THEN 'null' WHEN p_partkey % 6 = 1 THEN 'empty' WHEN p_partkey % 6 = 2 THEN CASE WHEN length(p_name) > 4 THEN 'truncated' ELSE 'equal' END WHEN p_partkey % 6 = 3 THEN 'longer' WHEN p_partkey % 6 = 4 THEN 'divergent' ELSE 'equal' END AS class, count(*) AS n FROM part GROUP BY 1",
    "normalised_names": f"WITH n AS (SELECT p_partkey, {_PLAIN.format(x=_ODD)} AS plain FROM part) SELECT p_partkey, plain, split_part(plain, ' ', 1) AS first, regexp_replace(plain, ' inc ltee$', '') AS short, len(list_distinct(list_filter(string_split(plain, ' '), lambda w: length(w) >= 3))) AS words FROM n",
    "name_traits": f"SELECT p_partkey, trim(regexp_replace(regexp_replace({_TRAITS}, '\\([^()]*\\)', ' '), '\\s+', ' ', 'g')) AS outside, {_cases('p_partkey', ('number,conjunction', 'parenthesis', 'conjunction', ''))} AS forms FROM part",
    "postal_codes": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat('J', d, 'L,J', d, 'L2A4') WHEN 1 THEN concat('J', d, 'L') ELSE concat('J', d, 'K,J', d, 'K3B7') END AS codes, concat('City', c_nationkey) AS city, concat('QC J', d, CASE c_custkey % 3 WHEN 0 THEN 'L 2A4' WHEN 1 THEN 'L' ELSE 'K3B7' END) AS rest FROM (SELECT *, c_custkey % 10 AS d FROM customer)",
    "company_numbers": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat(lpad(CAST(c_custkey * 7 % 10000 AS VARCHAR), 4, '0'), ' ', lpad(CAST(c_custkey * 13 % 10000 AS VARCHAR), 4, '0')) END AS number, CASE WHEN c_custkey % 2 = 0 THEN 'numbered' ELSE 'no neighbour' END AS class FROM customer",
    "whole_phrases": "SELECT lang, count(CASE WHEN regexp_matches(t, '(^|[^\\p{L}\\p{N}_])the($|[^\\p{L}\\p{N}_])') THEN 1 END) AS the, count(CASE WHEN regexp_matches(t, '(^|[^\\p{L}\\p{N}_])of the($|[^\\p{L}\\p{N}_])') THEN 1 END) AS of_the, count(CASE WHEN regexp_matches(t, '(^|[^\\p{L}\\p{N}_])zzz($|[^\\p{L}\\p{N}_])') THEN 1 END) AS none FROM (SELECT lang, lower(text) AS t FROM documents) GROUP BY lang",
    "keyword_hits": f"SELECT doc_id, concat_ws(',', CASE WHEN contains(t, 'the') THEN 'The' END, CASE WHEN contains(t, 'ion') THEN 'ion' END, CASE WHEN contains(t, 'ete') THEN 'été' END, CASE WHEN contains(t, 'the') THEN 'the' END, {_CHANGE}) AS hits FROM (SELECT doc_id, {_FIRST_LINE} AS t FROM documents)",
    "page_contacts": r"""WITH b AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
s AS (SELECT page_id, html, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS seen FROM b)
SELECT page_id, nullif(regexp_extract(seen, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+'), '') AS email, nullif(regexp_extract(seen, '(\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}'), '') AS phone,
CAST(nullif(regexp_extract(seen, '(?i)(\d{1,5})\s*(\+)?\s*(employ[ée]s|employees)', 1), '') AS INTEGER) AS staff, CAST(len(list_distinct(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["\x27]([^"\x27#]+)', 1))) AS INTEGER) AS links, length(seen) AS length FROM s""",
    "parsed_numbers": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS value, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter FROM orders",
    "amounts": f"SELECT o_orderkey, concat(replace(replace(CASE WHEN o_totalprice = floor(o_totalprice) THEN format('{{:,}}', CAST(o_totalprice AS BIGINT)) ELSE format('{{:,.2f}}', o_totalprice) END, ',', '\u00a0'), '.', ','), '\u00a0$') AS amount, {_DAY} AS day FROM orders",
    "percentages": "SELECT c_custkey, round(CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 4 > 0 THEN 100.0 ELSE 0.0 END ELSE 100.0 * (c_custkey % 4) / (c_custkey % 3 * 10) END, 4) AS percent FROM customer",
}
