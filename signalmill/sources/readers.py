"""One reader for each kind of public record.

Each takes files by a path that Spark reads and returns rows of the signal
schema (or, for registries, of the registry). Nothing is fetched from a network
and nothing passes through the driver.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.functions.numbers import parse_date, quarter_date
from signalmill.functions.text import city_and_province, composed_address, normalise
from signalmill.operators.relational import latest
from signalmill.sources import large_json
from signalmill.sources.signals import date, fields, header_aliases, not_in_the_future, number, reference, signals, since, text


def csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header, all columns strings; quotes may hold line breaks."""
    return spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=True, escape='"', mode="PERMISSIVE")


def covers(file_name: Column, start: datetime | None) -> Column:
    """Whether a file named ``..._YYYYMMDD_YYYYMMDD...`` reaches ``start``; a name
    without dates is kept."""
    if start is None:
        return F.lit(True)
    end = F.regexp_extract(file_name, r"(\d{8})_(\d{8})", 2)
    return (end == "") | (end >= start.strftime("%Y%m%d"))


RELEASE = {
    "ocid": "string",
    "date": "string",
    "buyer": "struct<id:string,name:string>",
    "parties": "array<struct<id:string,name:string,roles:array<string>,address:struct<streetAddress:string,locality:string,region:string,postalCode:string>>>",
    "tender": "struct<title:string,items:array<struct<description:string,classification:struct<scheme:string,id:string,description:string>>>>",
    "awards": "array<struct<id:string,date:string,status:string,value:struct<amount:double,currency:string>,suppliers:array<struct<id:string,name:string>>>>",
}


def contract_awards(spark: SparkSession, path: str, start: datetime | None = None, part_bytes: int | None = None) -> DataFrame:
    """Open-contracting releases (an object with ``releases``, or a list of them):
    a signal for each supplier of each award. The reference names the supplier
    too, so suppliers of one award don't hide each other. With ``part_bytes`` a file
    is read by many tasks, in ranges of so many bytes; else by one."""
    inner = ",".join(f"{k}:{v}" for k, v in RELEASE.items())
    outer = ", ".join(f"{k} {v}" for k, v in RELEASE.items())
    if part_bytes:
        each = large_json.records(spark, path, "releases", part_bytes).where(covers(F.element_at(F.split("path", "/"), -1), start))
        release = each.select(F.from_json("value", outer).alias("r"))
    else:
        raw = spark.read.json(path, schema=f"releases array<struct<{inner}>>, {outer}", multiLine=True)
        raw = raw.where(covers(F.col("_metadata.file_name"), start))
        one = F.struct(*RELEASE)
        release = raw.select(F.explode(F.when(F.col("releases").isNotNull(), F.col("releases")).otherwise(F.array(one))).alias("r"))
    each = release.select("r", F.explode("r.awards").alias("a")).select("r", "a", F.explode("a.suppliers").alias("s"))
    party = F.try_element_at(F.filter("r.parties", lambda p: p["id"] == F.col("s.id")), F.lit(1))
    buyer = F.coalesce(F.try_element_at(F.filter("r.parties", lambda p: F.array_contains(p["roles"], "buyer")), F.lit(1))["name"], F.col("r.buyer.name"))
    each = each.withColumn("party", F.when(F.size("r.parties") > 0, party)).withColumn("buyer", F.when(F.size("r.parties") > 0, buyer).otherwise(F.col("r.buyer.name")))
    kinds = F.array_distinct(F.transform(F.filter("r.tender.items", lambda i: i["classification"].isNotNull()), lambda i: F.concat_ws(":", i["classification"]["scheme"], i["classification"]["id"])))
    needs = F.array_join(F.array_distinct(F.filter(F.transform("r.tender.items", lambda i: i["description"]), lambda d: d.isNotNull())), "; ")
    made = signals(
        each, "tenders", "tender",
        name=F.trim("s.name"), detected_at=F.coalesce(parse_date(F.left("a.date", F.lit(19))), parse_date(F.left("a.date", F.lit(10))), parse_date(F.left("r.date", F.lit(10)))),
        source_ref=reference("tenders", F.col("r.ocid"), F.col("a.id"), F.trim("s.name")), value=F.col("a.value.amount"), title=F.col("r.tender.title"),
        address=F.col("party.address.streetAddress"), city=F.col("party.address.locality"), region=F.col("party.address.region"),
        fields=fields(buyer=F.col("buyer"), status=F.col("a.status"), currency=F.col("a.value.currency"), classes=F.array_join(kinds, ","), needs=needs, postal_code=F.col("party.address.postalCode")),
    )
    return since(made, start)


def datastore(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a data store's records (``result.records``), one row each, as
    maps of strings turned to columns by the readers below."""
    raw = spark.read.json(path, schema="result struct<records array<map<string,string>>>, records array<map<string,string>>", multiLine=True)
    return raw.select(F.explode(F.coalesce("result.records", "records")).alias("record"))


def _columns(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[F.col("record")[n].alias(n) for n in names])


def federal_contracts(spark: SparkSession, path: str, as_of: datetime) -> DataFrame:
    rows = _columns(datastore(spark, path), ["vendor_name", "contract_date", "contract_value", "original_value", "reference_number", "description_fr", "description_en", "buyer_name", "owner_org_title", "commodity_code", "economic_object_code"])
    made = signals(rows, "federal_contracts", "tender", name=text(rows, "vendor_name"), detected_at=date(rows, "contract_date"), source_ref=reference("federal_contracts", text(rows, "reference_number")), value=number(rows, "contract_value", "original_value"), title=text(rows, "description_fr", "description_en"), fields=fields(buyer=text(rows, "buyer_name", "owner_org_title"), commodity=text(rows, "commodity_code"), economic_object=text(rows, "economic_object_code")))
    return not_in_the_future(made, as_of)


def federal_grants(spark: SparkSession, path: str, as_of: datetime, province: str = "QC") -> DataFrame:
    rows = _columns(datastore(spark, path), ["recipient_legal_name", "agreement_start_date", "agreement_value", "ref_number", "amendment_number", "recipient_city", "recipient_province", "agreement_title_fr", "agreement_title_en", "prog_name_fr", "prog_name_en", "owner_org_title", "agreement_type"])
    rows = rows.where(F.col("recipient_province") == province)
    program = text(rows, "prog_name_fr", "prog_name_en")
    made = signals(rows, "federal_grants", "financing", name=text(rows, "recipient_legal_name"), detected_at=date(rows, "agreement_start_date"), source_ref=reference("federal_grants", text(rows, "ref_number"), text(rows, "amendment_number")), city=text(rows, "recipient_city"), region=text(rows, "recipient_province"), value=number(rows, "agreement_value"), title=F.coalesce(text(rows, "agreement_title_fr", "agreement_title_en"), program), fields=fields(goods=program, program=program, kind=text(rows, "agreement_type")))
    return not_in_the_future(made, as_of)


def provincial_contracts(spark: SparkSession, path: str, start: datetime | None = None) -> DataFrame:
    """Awarded tenders as JSON rows; flags say what was bought, and an amount of
    zero or less is unknown."""
    rows = spark.read.json(path, schema="tender_id string, vendor string, awarded_date string, awarded_amount string, tender_description string, entity string, goods string, service string, construction string", multiLine=True)
    flag = lambda c: F.when(F.lower(F.col(c)).isin("true", "y", "yes", "1"), F.lit(c))
    value = number(rows, "awarded_amount")
    made = signals(rows, "provincial_contracts", "tender", name=text(rows, "vendor"), detected_at=date(rows, "awarded_date"), source_ref=reference("provincial_contracts", text(rows, "tender_id"), text(rows, "vendor")), value=F.when(value > 0, value), title=text(rows, "tender_description"), fields=fields(buyer=text(rows, "entity"), nature=F.nullif(F.concat_ws("/", flag("goods"), flag("service"), flag("construction")), F.lit(""))))
    return since(made.where(~F.col("source_ref").startswith("provincial_contracts::")), start)


def building_permits(spark: SparkSession, path: str, start: datetime | None = None) -> DataFrame:
    rows = csv(spark, path)
    made = signals(rows, "building_permits", "registry", name=text(rows, "ENTREPRENEUR"), detected_at=date(rows, "DATE_EMISSION"), source_ref=reference("building_permits", text(rows, "NO_PERMIS")), address=text(rows, "ADRESSE"), city=text(rows, "EXVILLE_DESCR"), title=text(rows, "TYPE_PERMIS_DESCR"), fields=fields(change=F.lit("permit"), nature=text(rows, "TYPE_PERMIS_DESCR"), permit_cost=number(rows, "COUT_PERMIS")))
    return since(made, start)


def toronto_licences(spark: SparkSession, path: str) -> DataFrame:
    """Licences in force, the last issued row of each number."""
    rows = csv(spark, path)
    rows = rows.where(text(rows, "Cancel Date").isNull())
    place = city_and_province(text(rows, "Licence Address Line 2"))
    made = signals(rows, "toronto_licences", "registry", name=text(rows, "Client Name"), detected_at=date(rows, "Issued"), source_ref=reference("toronto_licences", text(rows, "Licence No.")), address=F.nullif(F.concat_ws(", ", text(rows, "Licence Address Line 1"), text(rows, "Licence Address Line 2"), text(rows, "Licence Address Line 3")), F.lit("")), city=place["city"], region=place["province"], sector=text(rows, "Category"), fields=fields(change=F.lit("new_licence"), trade_name=text(rows, "Operating Name")))
    return latest(made, ["source_ref"], [F.col("detected_at").desc_nulls_last(), F.col("name")])


def vancouver_licences(spark: SparkSession, path: str) -> DataFrame:
    rows = csv(spark, path)
    parts = [text(rows, c) for c in ("unit", "house", "street", "city", "province")]
    made = signals(rows, "vancouver_licences", "registry", name=text(rows, "businessname"), detected_at=date(rows, "issueddate"), source_ref=reference("vancouver_licences", text(rows, "licencenumber", "licencersn")), address=F.nullif(F.concat_ws(" ", *parts), F.lit("")), city=parts[3], region=parts[4], sector=text(rows, "businesstype"), fields=fields(change=F.lit("new_licence"), status=text(rows, "status"), employees=text(rows, "numberofemployees"), trade_name=text(rows, "businesstradename")))
    return latest(made, ["source_ref"], [F.col("detected_at").desc_nulls_last(), F.col("name")])


def licence_key() -> Column:
    """By what a licence is known again: its holder and address, normalised."""
    return F.concat_ws("|", F.coalesce(normalise(F.col("name")), F.lit("")), F.coalesce(normalise(F.col("address")), F.lit("")))


def new_licences(licences: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Licences whose key isn't known, and the keys to know from now on. The
    first scan has nothing to compare with and gives none."""
    keyed = licences.withColumn("licence_key", licence_key())
    keys = keyed.select("licence_key").distinct()
    if known is None:
        return licences.limit(0), keys
    fresh = keyed.join(known.select("licence_key"), "licence_key", "left_anti").drop("licence_key")
    return fresh, known.select("licence_key").unionByName(keys).distinct()


def job_board(spark: SparkSession, path: str, province: str | None = None) -> DataFrame:
    """Job posts as UTF-16 text with tabs; the employer's name may be filled in
    from the posts' pages by a join afterwards."""
    rows = csv(spark, path, sep="\t", encoding="UTF-16")
    role = header_aliases(rows.columns, {"id": ["job posting id", "id offre"], "title": ["job title", "titre"], "date": ["first posting date", "date"], "city": ["city", "ville"], "province": ["province"], "posts": ["vacancy count", "nombre de postes"]})
    col = lambda r: text(rows, role[r])
    made = rows.select(col("id").alias("job_id"), col("title").alias("title"), parse_date(F.left(col("date"), F.lit(10))).alias("detected_at"), col("city").alias("city"), col("province").alias("region"), number(rows, role["posts"]).alias("value"))
    return made.where("job_id is not null and title is not null").where(F.lit(True) if province is None else F.lower("region") == province.lower())


def with_employers(posts: DataFrame, employers: DataFrame) -> DataFrame:
    """Signals of job posts and their employers (job_id, name)."""
    met = posts.join(employers.select("job_id", "name"), "job_id")
    return signals(met, "job_board", "hiring", name=F.col("name"), detected_at=F.col("detected_at"), source_ref=reference("job_board", F.col("job_id")), city=F.col("city"), region=F.col("region"), value=F.col("value"), title=F.col("title"), fields=fields(posts=F.col("value")))


def aggregated_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job posts of an aggregator, JSON lines of varying shape: the first field
    that has a value among several paths; posts without company, title or
    reference go."""
    rows = spark.read.text(path).withColumnRenamed("value", "_json")
    first = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object("_json", f"$.{p}"), F.lit("")) for p in paths])
    made = signals(rows, "aggregated_jobs", "hiring", name=first("company_name", "company.name", "company"), detected_at=parse_date(F.left(first("date_posted", "posted_at", "discovered_at"), F.lit(10))), source_ref=reference("aggregated_jobs", first("id", "url", "job_url")), city=first("location", "city"), region=first("region", "country"), website=first("url", "job_url"), title=first("job_title", "title"), fields=fields(description=first("description", "job_description")))
    return made.where("title is not null and source_ref <> 'aggregated_jobs:'")


def growth_ranking(spark: SparkSession, path: str) -> DataFrame:
    """A ranking as lines of text: rank, name, city, province, growth in per cent."""
    pattern = r"^\s*(\d{1,4})\s+(.+?)\s{2,}(.+?),\s*([A-Z]{2})\s+([\d,]+)\s*%\s*$"
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    part = lambda i: F.regexp_extract("value", pattern, i)
    name = F.trim(part(2))
    return signals(lines, "growth_ranking", "ranking", name=name, source_ref=reference("growth_ranking", part(1), normalise(name)), city=F.trim(part(3)), region=part(4), fields=fields(rank=part(1), growth=F.replace(part(5), F.lit(","), F.lit(""))))


def embedded_ranking(spark: SparkSession, path: str, variable: str = "data") -> DataFrame:
    """A ranking embedded in pages as a JSON list assigned to a script variable."""
    pages = spark.read.text(path, wholetext=True)
    block = F.regexp_extract("value", rf"(?s)\b{variable}\s*=\s*(\[.*?\])\s*;", 1)
    rows = pages.select(F.explode(F.from_json(block, "array<struct<rank:string,company:string,location:string,growth:string>>")).alias("r")).select("r.*")
    place = city_and_province(text(rows, "location"))
    return signals(rows, "embedded_ranking", "ranking", name=text(rows, "company"), source_ref=reference("embedded_ranking", text(rows, "rank"), normalise(text(rows, "company"))), city=place["city"], region=place["province"], fields=fields(rank=text(rows, "rank"), growth=F.regexp_replace(text(rows, "growth"), "[,%]", "")))


def funding_table(spark: SparkSession, path: str) -> DataFrame:
    """Funding announcements whose tables were extracted to CSV; rows without a
    name or amount go."""
    rows = csv(spark, path)
    role = header_aliases(rows.columns, {"name": ["entreprise", "company", "beneficiaire"], "value": ["montant", "amount"], "date": ["date"]})
    made = signals(rows, "funding_table", "financing", name=text(rows, role["name"]), detected_at=date(rows, role["date"]), value=number(rows, role["value"]), source_ref=reference("funding_table", normalise(text(rows, role["name"])), text(rows, role["date"]), text(rows, role["value"])), fields=fields(amount=text(rows, role["value"])))
    return made.where("value is not null")


def _sheet_rows(data: bytes, name: str) -> list[list[str]]:
    """Cells of a small sheet, CSV or the first sheet of an XLSX."""
    import csv as plain_csv
    from xml.etree import ElementTree as ET

    if not name.lower().endswith("xlsx"):
        return list(plain_csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"))))
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        sheet = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        rows = []
        for row in ET.fromstring(z.read(sheet)).iter(f"{{{ns['m']}}}row"):
            cells: list[str] = []
            for c in row.findall("m:c", ns):
                place = 0
                for letter in c.get("r", "").rstrip("0123456789"):
                    place = place * 26 + ord(letter) - 64
                cells += [""] * (place - 1 - len(cells))
                value = c.findtext("m:v", "", ns) or "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            rows.append(cells)
    return rows


def foreign_workers(spark: SparkSession, path: str) -> DataFrame:
    """Quarterly sheets of approved posts, a task for each sheet. The header is
    the first of five rows with a cell that is exactly the employer's title; the
    quarter of the file's name dates its rows; rows without a number of posts
    are notes."""
    titles = {"employer": ("employer", "employeur"), "address": ("address", "adresse"), "occupation": ("occupation", "profession"), "province": ("province", "province territory"), "posts": ("approved positions", "postes approuves"), "stream": ("program stream", "volet du programme")}

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = lambda s: " ".join("".join(c if c.isalnum() else " " for c in s.lower().replace("é", "e")).split())
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                sheet = _sheet_rows(data, name)
                at = next((i for i, r in enumerate(sheet[:5]) if any(plain(c) in titles["employer"] for c in r)), None)
                if at is None:
                    raise ValueError(f"{name}: no row of titles among the first five")
                place = {role: next((k for k, c in enumerate(sheet[at]) if plain(c).startswith(options)), None) for role, options in titles.items()}
                out = [[name.rsplit("/", 1)[-1], i, *(r[k] if (k := place[role]) is not None and k < len(r) else None for role in titles)] for i, r in enumerate(sheet[at + 1 :])]
                yield pd.DataFrame(out, columns=["file", "line", *titles])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(rows_of, f"file string, line int, {', '.join(f'{t} string' for t in titles)}")
    posts = number(rows, "posts")
    made = signals(rows, "foreign_workers", "hiring", name=text(rows, "employer"), detected_at=quarter_date(F.col("file")).cast("timestamp"), source_ref=reference("foreign_workers", F.col("file"), F.col("line").cast("string")), address=text(rows, "address"), region=text(rows, "province"), value=posts, title=text(rows, "occupation"), fields=fields(stream=text(rows, "stream"), posts=posts))
    return made.where("value is not null")


def flat_registry(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, status, address, city, postal_code, region, sector) of a flat registry file."""
    rows = csv(spark, path)
    role = header_aliases(rows.columns, {"id": ["neq"], "name": ["nom"], "status": ["statut"], "address": ["adresse"], "city": ["ville"], "postal_code": ["code_postal"], "region": ["region"], "sector": ["desc_cae", "cae"]})
    return rows.select(*[text(rows, c).alias(r) for r, c in role.items()]).where("id is not null")


# Headers of the federal register's French file, and its active states.
CORPORATION_HEADERS = {"id": ["numero_de_societe"], "name": ["denomination_sociale_version_1"], "status": ["statut"], "street": ["rue"], "city": ["municipalite_ville"], "province": ["province_territoire"], "postal_code": ["code_postal"]}
ACTIVE = ("active", "actif", "active corporation")


def french_active_resources(resources: DataFrame) -> DataFrame:
    """Files of a catalogue (name, language array) of active corporations in
    French: ``inactive`` holds ``active`` and is left out, and a file without a
    language stays."""
    name = F.lower(F.coalesce("name", F.lit("")))
    said = F.coalesce("language", F.array().cast("array<string>"))
    return resources.where(F.contains(name, F.lit("active")) & ~F.contains(name, F.lit("inactive")) & ((F.size(said) == 0) | F.array_contains(said, "fr")))


def federal_corporations(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, status, address, law) of federal corporations, a snapshot for
    :func:`signalmill.operators.diff.run`; rows without a number or name go, the
    law is null where the file has no such column."""
    rows = csv(spark, path)
    role = header_aliases(rows.columns, CORPORATION_HEADERS)
    try:
        law = text(rows, header_aliases(rows.columns, {"law": ["regime_legislatif"]})["law"])
    except ValueError:  # an optional column
        law = F.lit(None).cast("string")
    col = lambda r: text(rows, role[r])
    address = F.nullif(F.array_join(F.array_compact(F.array(col("street"), col("city"), col("province"), col("postal_code"))), ", "), F.lit(""))
    return rows.select(col("id").alias("id"), col("name").alias("name"), col("status").alias("status"), address.alias("address"), law.alias("law")).where("id is not null and name is not null")


def inspect_zip(spark: SparkSession, path: str) -> DataFrame:
    """(member, bytes, header, first): the CSV members of a zip with their sizes,
    titles and first rows, read in tasks."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    with system.open_input_file(place) as f, zipfile.ZipFile(f) as z:
        members = [(i.filename, i.file_size) for i in z.infolist() if i.filename.lower().endswith(".csv")]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv as plain_csv

        for batch in batches:
            shown = []
            for member in batch["member"]:
                source, inside = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
                with source.open_input_file(inside) as f, zipfile.ZipFile(f) as z, z.open(member) as data:
                    lines = plain_csv.reader(io.TextIOWrapper(data, "utf-8-sig", "replace"))
                    shown.append((next(lines, []), next(lines, [])))
            yield pd.DataFrame({"member": batch["member"], "bytes": batch["bytes"], "header": [h for h, _ in shown], "first": [r for _, r in shown]})

    rows = spark.createDataFrame(members, "member string, bytes long")
    return rows.repartition(max(1, len(members)), "member").mapInPandas(look, "member string, bytes long, header array<string>, first array<string>")


def unzip(spark: SparkSession, path: str, folder: str) -> list[str]:
    """Unpacks a zip into a shared folder, a task for each member, and returns the
    members' names. Their contents stream through tasks, never the driver."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    with system.open_input_file(place) as f, zipfile.ZipFile(f) as z:
        members = [i.filename for i in z.infolist() if not i.is_dir()]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from shutil import copyfileobj

        for batch in batches:
            for member in batch["member"]:
                source, inside = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
                target, at = fs.FileSystem.from_uri(f"{folder}/{member.rsplit('/', 1)[-1]}")
                target.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with source.open_input_file(inside) as f, zipfile.ZipFile(f) as z, z.open(member) as data, target.open_output_stream(at) as out:
                    copyfileobj(data, out, 1 << 20)
            yield batch

    spark.createDataFrame([(m,) for m in members], "member string").repartition(max(1, len(members)), "member").mapInPandas(unpack, "member string").count()
    return members


REGISTRY_COLUMNS = {
    "companies": ["NEQ", "COD_STAT_IMMAT", "ADR_DOMCL_LIGN1_ADR", "ADR_DOMCL_LIGN2_ADR", "ADR_DOMCL_LIGN4_ADR", "DESC_ACT_ECON_ASSUJ"],
    "names": ["NEQ", "NOM_ASSUJ", "STAT_NOM", "TYP_NOM_ASSUJ", "DAT_INIT_NOM_ASSUJ"],
    "sites": ["NEQ", "NO_SUF_ETAB", "IND_ETAB_PRINC", "LIGN1_ADR", "LIGN2_ADR", "LIGN4_ADR", "DESC_ACT_ECON_ETAB", "NOM_ETAB"],
}


def linked_registry(companies: DataFrame, names: DataFrame, sites: DataFrame) -> DataFrame:
    """A registry of three linked tables as (id, name, name_normalised, status,
    address, city, province, postal_code, sector): the elected name, the
    company's own address or that of its main site, or the first one. Companies
    without a name go; a third address line may be missing. Joins on the id, no
    table in memory."""
    from signalmill.operators.resolution import elect_name

    named = names.select(F.col("NEQ").alias("id"), F.trim("NOM_ASSUJ").alias("name"), F.col("STAT_NOM").alias("status"), F.col("TYP_NOM_ASSUJ").alias("kind"), F.col("DAT_INIT_NOM_ASSUJ").alias("since"), F.monotonically_increasing_id().alias("line")).where("name <> ''")
    main = F.struct(F.when(F.col("IND_ETAB_PRINC") == "O", 0).otherwise(1), F.col("NO_SUF_ETAB"))

    def place(rows: DataFrame, head: str) -> Column:
        return composed_address(*[text(rows, f"{head}LIGN{k}_ADR") for k in (1, 2, 3, 4)])

    sector = lambda c: F.nullif(F.trim(c), F.lit("-"))
    site = sites.groupBy(F.col("NEQ").alias("id")).agg(F.min_by(F.struct(place(sites, "").alias("p"), sector(F.col("DESC_ACT_ECON_ETAB")).alias("s")), main).alias("site"))
    status = decode_status(F.col("COD_STAT_IMMAT"))
    own = companies.select(F.col("NEQ").alias("id"), status.alias("status"), place(companies, "ADR_DOMCL_").alias("own"), sector(F.col("DESC_ACT_ECON_ASSUJ")).alias("s"))
    met = own.join(elect_name(named).select("id", "name"), "id").join(site, "id", "left")
    parts = [F.coalesce(F.col(f"own.{c}"), F.col(f"site.p.{c}")).alias(c) for c in ("address", "city", "province", "postal_code")]
    return met.select("id", "name", normalise(F.col("name")).alias("name_normalised"), "status", *parts, F.coalesce("s", "site.s").alias("sector"))


def decode_status(code: Column) -> Column:
    plain = F.upper(F.trim(code))
    return F.when(plain.isin("RD", "RO", "RX"), "struck_off").when(plain == "IM", "registered").when(F.coalesce(plain, F.lit("")) == "", "unknown").otherwise(F.lower(plain))


def registry_names(names: DataFrame, sites: DataFrame, mergers: DataFrame) -> DataFrame:
    """(id, name, retired) of all tables that name a company, the names' own
    first; the first writer of a name wins."""
    from signalmill.operators.resolution import all_names, retired

    part = lambda df, name, gone: df.select(F.col("NEQ").alias("id"), normalise(F.col(name)).alias("name"), gone.alias("retired")).where("name <> ''")
    own = part(names, "NOM_ASSUJ", retired(F.col("STAT_NOM")))
    foreign = [part(names, "NOM_ASSUJ_LANG_ETRNG", retired(F.col("STAT_NOM")))] if "NOM_ASSUJ_LANG_ETRNG" in names.columns else []
    return all_names([own, *foreign, part(sites, "NOM_ETAB", F.lit(False)), part(mergers, "DENOMN_SOC", F.lit(False))])


def fallback_journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a journal of JSON lines (id, format, at, event, detail, cause) and
    the counts of unreadable lines and of those of an unknown format. A line
    without an id gets one from its content."""
    raw = spark.read.text(path)
    parsed = raw.select(F.col("value").alias("line"), F.from_json("value", "id string, format int, at string, event string, detail string, cause string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j"))
    unreadable, unknown = F.col("j._bad").isNotNull(), F.col("j._bad").isNull() & ~F.coalesce(F.col("j.format").isin(1, 2), F.lit(False))
    counts = parsed.where("trim(line) <> ''").agg(F.count_if(unreadable).alias("unreadable"), F.count_if(unknown).alias("unknown_format"))
    made = F.substring(F.sha2(F.to_json(F.array("j.at", "j.event", "j.detail")), 256), 1, 32)
    rows = parsed.where("trim(line) <> ''").where(~unreadable & ~unknown).select(F.coalesce("j.id", made).alias("id"), "j.format", parse_date(F.left("j.at", F.lit(19))).alias("at"), "j.event", "j.detail", "j.cause")
    return rows, counts
