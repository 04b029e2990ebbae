"""Readers, sinks and streams: files are written from the driver's tables, read
back through the operator and compared with what SQL says of the tables."""

from __future__ import annotations

import io
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from signalmill.operators.diff import KINDS, Limits, read_journal, run
from signalmill.plans.dossiers import _folder
from signalmill.plans.views import AS_OF, SIGNALS, SNAPSHOTS, Query, orders_after, orders_before, signals, table
from signalmill.sources import readers, signals as schema, sinks, zips
from signalmill.streaming import signals as streams


def _customers(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(n, "c_nationkey")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(_customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))


def _day(column: str):
    return F.date_format(column, "yyyy-MM-dd")


PAGE_RECORDS = 5_000


def _pages(spark, rows, record, wrap):
    """JSON documents: the records of each nation, wrapped, about ``PAGE_RECORDS``
    at most to a document, so that none grows with the table."""
    path = _folder(spark, "pages")
    pages = F.pmod(F.xxhash64("record"), F.greatest(F.lit(1), F.ceil(F.col("n") / PAGE_RECORDS)))
    counts = rows.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    each = rows.select("c_nationkey", record.alias("record")).join(F.broadcast(counts), "c_nationkey").withColumn("page", pages)  # a row for each of 25 nations
    made = each.groupBy("c_nationkey", "page").agg(F.to_json(F.collect_list("record")).alias("all")).select("c_nationkey", "page", wrap(F.col("all")).alias("value"))
    made.write.partitionBy("c_nationkey", "page").text(path)
    return path


def _put(path: str, data: bytes) -> str:
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place) as out:
        out.write(data)
    return path


def _csv(spark, rows, kind: str, **options) -> str:
    path = _folder(spark, kind)
    rows.write.options(header=True, escape='"', **options).csv(path)
    return path


def _awards(spark, sf_dir, part_bytes=None):
    text = lambda x: F.lit(x)
    key, supplier = F.col("o_orderkey").cast("string"), F.concat(F.lit("s"), F.col("c_custkey").cast("string"))
    parties = F.array(
        F.struct(text("b").alias("id"), F.col("n_name").alias("name"), F.array(text("buyer")).alias("roles"), F.struct(F.lit(None).cast("string").alias("streetAddress"), F.lit(None).cast("string").alias("locality"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("postalCode")).alias("address")),
        F.struct(supplier.alias("id"), F.col("c_name").alias("name"), F.array(text("supplier")).alias("roles"), F.struct(F.concat(F.col("c_custkey").cast("string"), text(" rue A")).alias("streetAddress"), text("Laval").alias("locality"), text("QC").alias("region"), text("H1H1H1").alias("postalCode")).alias("address")),
    )
    items = F.array(*[F.struct(text("work").alias("description"), F.struct(text("X").alias("scheme"), c.alias("id"), text("d").alias("description")).alias("classification")) for c in (F.col("o_orderstatus"), F.col("o_orderstatus"), text("9"))])
    award = F.struct(text("a1").alias("id"), _day("o_orderdate").alias("date"), text("active").alias("status"), F.struct(F.col("o_totalprice").alias("amount"), text("CAD").alias("currency")).alias("value"), F.array(F.struct(supplier.alias("id"), F.concat(F.lit(" "), "c_name").alias("name"))).alias("suppliers"))
    release = F.struct(F.concat(text("o"), key).alias("ocid"), _day("o_orderdate").alias("date"), F.struct(text("b").alias("id"), text("nobody").alias("name")).alias("buyer"), parties.alias("parties"), F.struct(F.col("o_orderpriority").alias("title"), items.alias("items")).alias("tender"), F.array(award).alias("awards"))
    path = _pages(spark, _orders(spark, sf_dir), release, lambda x: F.concat(F.lit('{"releases":'), x, F.lit("}")))
    got = readers.contract_awards(spark, path, part_bytes=part_bytes)
    return got.select("source_ref", "name", "value", "title", "address", "city", "region", F.to_date("detected_at").alias("day"), F.col("fields")["buyer"].alias("buyer"), F.col("fields")["classes"].alias("classes"), F.col("fields")["needs"].alias("needs"))


def awarded_contracts(spark, sf_dir):
    """Open-contracting releases: a signal for each supplier of each award."""
    return _awards(spark, sf_dir)


def awards_in_ranges(spark, sf_dir):
    """The same with each file read by many tasks, in ranges of bytes."""
    return _awards(spark, sf_dir, part_bytes=1 << 18)


def covered_files(spark, sf_dir):
    """Files of releases that reach a date, by their names."""
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 7 == 0, "undated.json").otherwise(F.concat(F.lit("h_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.date_format(F.date_add("o_orderdate", 6), "yyyyMMdd"), F.lit(".json")))
    return o.where(readers.covers(name, datetime(2000, 6, 1))).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def read_federal_contracts(spark, sf_dir):
    """Federal contracts of a data store, without those of the future."""
    record = F.struct(F.col("c_name").alias("vendor_name"), _day("o_orderdate").alias("contract_date"), F.lit("0").alias("contract_value"), F.format_number("o_totalprice", 2).alias("original_value"), F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("reference_number"), F.lit("").alias("description_fr"), F.col("o_orderpriority").alias("description_en"), F.col("n_name").alias("buyer_name"))
    path = _pages(spark, _orders(spark, sf_dir), record, lambda x: F.concat(F.lit('{"result":{"records":'), x, F.lit("}}")))
    got = readers.federal_contracts(spark, path, datetime(2000, 6, 1))
    return got.select("source_ref", "name", F.round("value", 2).alias("value"), "title", F.col("fields")["buyer"].alias("buyer"))


def read_federal_grants(spark, sf_dir):
    """Federal grants of one province, without those of the future."""
    province = F.when(F.col("o_orderkey") % 3 == 0, "QC").otherwise("ON")
    record = F.struct(F.col("c_name").alias("recipient_legal_name"), _day("o_orderdate").alias("agreement_start_date"), F.col("o_totalprice").cast("string").alias("agreement_value"), F.col("o_orderkey").cast("string").alias("ref_number"), F.lit("0").alias("amendment_number"), F.col("n_name").alias("recipient_city"), province.alias("recipient_province"), F.col("o_orderpriority").alias("prog_name_en"))
    path = _pages(spark, _orders(spark, sf_dir), record, lambda x: F.concat(F.lit('{"records":'), x, F.lit("}")))
    got = readers.federal_grants(spark, path, datetime(2000, 6, 1))
    return got.select("source_ref", "name", F.round("value", 2).alias("value"), "title", "city", F.col("fields")["goods"].alias("goods"))


def read_provincial_contracts(spark, sf_dir):
    """Awarded tenders: amounts of zero are unknown, flags say what was bought."""
    record = F.struct(F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey").cast("string")).alias("tender_id"), F.col("c_name").alias("vendor"), _day("o_orderdate").alias("awarded_date"), F.when(F.col("o_orderkey") % 5 == 0, "0").otherwise(F.col("o_totalprice").cast("string")).alias("awarded_amount"), F.col("o_orderpriority").alias("tender_description"), F.col("n_name").alias("entity"), F.when(F.col("o_orderkey") % 2 == 0, "Y").alias("goods"), F.lit("false").alias("service"), F.when(F.col("o_orderkey") % 3 == 0, "1").alias("construction"))
    path = _pages(spark, _orders(spark, sf_dir), record, lambda x: x)
    got = readers.provincial_contracts(spark, path, datetime(1996, 1, 1))
    return got.select("source_ref", F.round("value", 2).alias("value"), F.col("fields")["nature"].alias("nature"), F.to_date("detected_at").alias("day"))


def read_building_permits(spark, sf_dir):
    """Building permits of a city's file."""
    o = _orders(spark, sf_dir).select(F.when(F.col("o_orderkey") % 4 != 0, F.col("c_name")).alias("ENTREPRENEUR"), F.date_format("o_orderdate", "yyyy/MM/dd").alias("DATE_EMISSION"), F.col("o_orderkey").alias("NO_PERMIS"), F.concat(F.col("c_custkey").cast("string"), F.lit(', "rue" A\nbureau 2')).alias("ADRESSE"), F.col("n_name").alias("EXVILLE_DESCR"), F.col("o_orderpriority").alias("TYPE_PERMIS_DESCR"), F.col("o_totalprice").alias("COUT_PERMIS"))
    got = readers.building_permits(spark, _csv(spark, o, "permits"))
    return got.select("source_ref", "name", "address", "city", F.to_date("detected_at").alias("day"), F.col("fields")["nature"].alias("nature"))


def _toronto(spark, sf_dir):
    o = _orders(spark, sf_dir)
    rows = o.select(F.col("o_custkey").alias("Licence No."), F.col("c_name").alias("Client Name"), _day("o_orderdate").alias("Issued"), F.when(F.col("o_orderstatus") == "P", "2020-01-01").alias("Cancel Date"), F.concat(F.col("c_custkey").cast("string"), F.lit(" King St")).alias("Licence Address Line 1"), F.lit("TORONTO, ON").alias("Licence Address Line 2"), F.col("o_orderpriority").alias("Category"), F.col("n_name").alias("Operating Name"))
    return readers.toronto_licences(spark, _csv(spark, rows, "licences"))


def read_toronto_licences(spark, sf_dir):
    """Licences in force, the last issued row of each number."""
    return _toronto(spark, sf_dir).select("source_ref", "name", "address", "city", "region", F.to_date("detected_at").alias("day"))


def read_vancouver_licences(spark, sf_dir):
    """Licences of another city, one row for each number."""
    c = _customers(spark, sf_dir)
    rows = c.select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).alias("licencenumber"), F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("licencersn"), F.col("c_name").alias("businessname"), F.lit("2024-01-01").alias("issueddate"), F.col("c_custkey").alias("house"), F.lit("Main St").alias("street"), F.lit("Vancouver").alias("city"), F.lit("BC").alias("province"), F.col("c_mktsegment").alias("businesstype"), F.lit("Issued").alias("status"))
    return readers.vancouver_licences(spark, _csv(spark, rows, "licences")).select("source_ref", "name", "address", "city", "sector")


def new_licences(spark, sf_dir):
    """Licences that a second scan finds and the first didn't."""
    found = _toronto(spark, sf_dir)
    first, known = readers.new_licences(found.where("name < 'Customer#000000500'"), None)
    assert first.isEmpty()
    fresh, keys = readers.new_licences(found, known)
    return fresh.select("source_ref", "name").withColumn("keys", F.lit(keys.count()))


def read_job_board(spark, sf_dir):
    """Job posts in UTF-16 with tabs, joined to their employers."""
    o = _orders(spark, sf_dir)
    rows = o.select(F.col("o_orderkey").alias("Job Posting ID"), F.col("o_orderpriority").alias("Job Title"), _day("o_orderdate").alias("First Posting Date"), F.col("n_name").alias("City"), F.when(F.col("o_orderkey") % 2 == 0, "Québec").otherwise("Ontario").alias("Province"), (F.col("o_orderkey") % 9).alias("Vacancy Count"))
    path = _csv(spark, rows, "jobs", sep="\t", encoding="UTF-16")
    posts = readers.job_board(spark, path, "québec")
    got = readers.with_employers(posts, o.select(F.col("o_orderkey").cast("string").alias("job_id"), F.col("c_name").alias("name")))
    return got.select("source_ref", "name", "title", "city", "region", "value", F.to_date("detected_at").alias("day"))


def read_aggregated_jobs(spark, sf_dir):
    """Job posts of varying shape: the first path that has a value."""
    o = _orders(spark, sf_dir)
    k = F.col("o_orderkey")
    line = F.when(k % 3 == 0, F.to_json(F.struct(k.alias("id"), F.col("c_name").alias("company_name"), F.col("o_orderpriority").alias("title"), _day("o_orderdate").alias("posted_at")))).when(k % 3 == 1, F.to_json(F.struct(F.concat(F.lit("http://j/"), k.cast("string")).alias("url"), F.struct(F.col("c_name").alias("name")).alias("company"), F.col("o_orderpriority").alias("job_title")))).otherwise(F.to_json(F.struct(k.alias("id"), F.col("c_name").alias("company_name"))))
    path = _folder(spark, "jobs")
    o.select(line.alias("value")).write.text(path)
    return readers.aggregated_jobs(spark, path).select("source_ref", "name", "title", "website", F.to_date("detected_at").alias("day"))


def read_growth_ranking(spark, sf_dir):
    """A ranking as lines of text; other lines are left out."""
    c = _customers(spark, sf_dir)
    line = F.when(F.col("c_custkey") % 5 == 0, F.lit("Rank  Company")).otherwise(F.concat(F.lit(" "), (F.col("c_custkey") % 9999 + 1).cast("string"), F.lit(" "), "c_name", F.lit("   "), "n_name", F.lit(", ON  1,"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit(" %")))
    path = _folder(spark, "ranking")
    c.select(line.alias("value")).write.text(path)
    return readers.growth_ranking(spark, path).select("source_ref", "name", "city", "region", F.col("fields")["growth"].alias("growth"))


def read_embedded_ranking(spark, sf_dir):
    """A ranking within the scripts of pages."""
    c = _customers(spark, sf_dir)
    record = F.struct(F.col("c_custkey").cast("string").alias("rank"), F.col("c_name").alias("company"), F.concat("n_name", F.lit(", QC")).alias("location"), F.concat(F.col("c_custkey").cast("string"), F.lit("%")).alias("growth"))
    path = _pages(spark, c, record, lambda x: F.concat(F.lit("<html><script>var more = [1]; var data = "), x, F.lit(";</script></html>")))
    return readers.embedded_ranking(spark, path).select("source_ref", "name", "city", "region", F.col("fields")["growth"].alias("growth"))


def read_funding_table(spark, sf_dir):
    """Announcements of funding; rows without an amount go."""
    o = _orders(spark, sf_dir).select(F.col("c_name").alias("Entreprise bénéficiaire"), F.when(F.col("o_orderkey") % 6 == 0, "n/d").otherwise(F.concat(F.format_number("o_totalprice", 2), F.lit(" $"))).alias("Montant autorisé"), _day("o_orderdate").alias("Date"))
    return readers.funding_table(spark, _csv(spark, o, "funding")).select("name", F.round("value", 2).alias("value"), F.to_date("detected_at").alias("day"))


def read_foreign_workers(spark, sf_dir):
    """Approved posts of a quarter, under a title row that isn't the first."""
    n = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    lines = ["Note,,,", "Employer,Address,Occupation,Approved Positions,Province/Territory", *(f'{r.n_name},"{r.n_nationkey} rue A, B",cook,{r.n_nationkey if r.n_nationkey % 5 else ""},QC' for r in n)]
    path = _put(f"{_folder(spark, 'workers')}/approved_2024q3.csv", "\n".join(lines).encode("utf-8-sig"))
    return readers.foreign_workers(spark, path).select("name", "address", "region", "value", F.to_date("detected_at").alias("day"))


def read_flat_registry(spark, sf_dir):
    """A flat registry under headers of its own."""
    c = _customers(spark, sf_dir).select(F.col("c_custkey").alias("NEQ"), F.col("c_name").alias("Nom de l'entreprise"), F.lit("IM").alias("Statut"), F.lit(" ").alias("Adresse"), F.col("n_name").alias("Ville"), F.lit("H1H").alias("Code_postal"), F.lit("QC").alias("Région"), F.col("c_mktsegment").alias("DESC_CAE"))
    return readers.flat_registry(spark, _csv(spark, c, "registry"))


def read_corporations(spark, sf_dir):
    """Federal corporations as a snapshot."""
    c = _customers(spark, sf_dir).select(F.col("c_custkey").alias("Numéro de société"), F.col("c_name").alias("Dénomination sociale version 1"), F.lit("Active").alias("Statut"), F.concat(F.col("c_custkey").cast("string"), F.lit(" rue A")).alias("Rue"), F.col("n_name").alias("Municipalité ville"), F.lit("QC").alias("Province territoire"), F.lit("").alias("Code postal"))
    return readers.federal_corporations(spark, _csv(spark, c, "corporations"))


def french_resources(spark, sf_dir):
    """Files of active corporations in French."""
    n = table(spark, sf_dir, "nation")
    name = F.when(F.col("n_nationkey") % 3 == 0, "Active business corporations").when(F.col("n_nationkey") % 3 == 1, "Other INACTIVE corporations").otherwise(F.concat(F.lit("active "), "n_name"))
    language = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("fr"))).when(F.col("n_nationkey") % 5 == 0, F.lit(None).cast("array<string>")).otherwise(F.array(F.lit("en")))
    return readers.french_active_resources(n.select("n_nationkey", name.alias("name"), language.alias("language"))).select("n_nationkey", "name")


def corporation_moves(spark, sf_dir):
    """A guarded run over two files of corporations, by kind of change."""
    c = _customers(spark, sf_dir)
    file = lambda street, rows: _csv(spark, rows.select(F.col("c_custkey").alias("Numéro de société"), F.col("c_name").alias("Dénomination sociale version 1"), F.lit("Active").alias("Statut"), street.alias("Rue"), F.col("n_name").alias("Municipalité ville"), F.lit("QC").alias("Province territoire"), F.lit("H1H").alias("Code postal")), "corporations")
    old = readers.federal_corporations(spark, file(F.lit("1 rue A"), c))
    new = readers.federal_corporations(spark, file(F.when(F.col("c_acctbal") > 5000, "2 rue B").otherwise("1 rue A"), c.where("c_acctbal > -900")))
    out = run(old, new, ["id"], ["name", "status", "address"], earlier_runs=9, limits=Limits.of({k: {"percent": 95.0} for k in KINDS}))
    return out.changes.groupBy("change").agg(F.count("*").alias("n"), F.lit(out.status).alias("status"))


def _registry_tables(spark, sf_dir):
    k = F.col("c_custkey")
    c = _customers(spark, sf_dir)
    own = k % 2 == 0
    companies = c.select(k.cast("string").alias("NEQ"), F.when(k % 4 == 0, "RD").otherwise("IM").alias("COD_STAT_IMMAT"), F.when(own, F.concat(k.cast("string"), F.lit(" rue A"))).alias("ADR_DOMCL_LIGN1_ADR"), F.when(own, F.concat("n_name", F.lit(" (Québec)"))).alias("ADR_DOMCL_LIGN2_ADR"), F.when(own & (k % 3 == 0), "bureau 3").alias("ADR_DOMCL_LIGN3_ADR"), F.when(own, "H1H1H1").alias("ADR_DOMCL_LIGN4_ADR"), F.when(k % 5 == 0, "-").otherwise(F.col("c_mktsegment")).alias("DESC_ACT_ECON_ASSUJ"))
    names = c.where(k % 7 != 0).select(k.cast("string").alias("NEQ"), F.concat(F.lit(" "), "c_name", F.lit(" Été ")).alias("NOM_ASSUJ"), F.lit("V").alias("STAT_NOM"), F.lit("M").alias("TYP_NOM_ASSUJ"), F.lit("2001-01-01").alias("DAT_INIT_NOM_ASSUJ"))
    names = names.unionByName(c.select(k.cast("string").alias("NEQ"), F.lit("Old").alias("NOM_ASSUJ"), F.lit("A").alias("STAT_NOM"), F.lit("M").alias("TYP_NOM_ASSUJ"), F.lit("1999-01-01").alias("DAT_INIT_NOM_ASSUJ")).where("NEQ % 7 <> 0"))
    sites = c.select(k.cast("string").alias("NEQ"), F.lit("1").alias("NO_SUF_ETAB"), F.lit("N").alias("IND_ETAB_PRINC"), F.lit("first").alias("LIGN1_ADR"), F.lit("Laval").alias("LIGN2_ADR"), F.lit("").alias("LIGN4_ADR"), F.lit("Pain").alias("DESC_ACT_ECON_ETAB"), F.lit("Site").alias("NOM_ETAB"))
    main = sites.where("NEQ % 3 = 0").select("NEQ", F.lit("2").alias("NO_SUF_ETAB"), F.lit("O").alias("IND_ETAB_PRINC"), F.lit("main").alias("LIGN1_ADR"), F.lit("Lévis (Québec)").alias("LIGN2_ADR"), F.lit("G1G").alias("LIGN4_ADR"), F.lit("Bois").alias("DESC_ACT_ECON_ETAB"), F.lit("Main site").alias("NOM_ETAB"))
    return companies, names, sites.unionByName(main)


def linked_registry(spark, sf_dir):
    """A registry of three linked tables with elected names and addresses."""
    return readers.linked_registry(*_registry_tables(spark, sf_dir))


def registry_name_list(spark, sf_dir):
    """All names of a registry's companies, in force or retired."""
    _, names, sites = _registry_tables(spark, sf_dir)
    mergers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("NEQ"), F.lit("Site").alias("DENOMN_SOC"))
    return readers.registry_names(names, sites, mergers).groupBy("name", "retired").agg(F.count("*").alias("n")).where("n > 1")


def inspected_zip(spark, sf_dir):
    """The tables of a zip: titles, first rows and what is unpacked."""
    n = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("in/a.csv", "﻿key,name\n" + "".join(f'{r.n_nationkey},"{r.n_name}, x"\n' for r in n))
        z.writestr("b.csv", "")
        z.writestr("readme.txt", "no table")
    path = _put(f"{_folder(spark, 'zip')}/r.zip", held.getvalue())
    folder = _folder(spark, "unpacked")
    members = readers.unzip(spark, path, folder)
    unpacked = readers.csv(spark, f"{folder}/a.csv").count()
    seen = readers.inspect_zip(spark, path)
    return seen.select("member", F.array_join("header", "|").alias("header"), F.array_join("first", "|").alias("first"), (F.col("bytes") > 0).alias("filled"), F.lit(len(members)).alias("members"), F.lit(unpacked).alias("unpacked"))


def _zips(spark, rows, member: str) -> str:
    """A zip for each partition, its rows streamed into one CSV member; an archive
    is named by its task's attempt and renamed when whole."""
    path, titles = _folder(spark, "zips"), rows.columns

    def pack(batches):
        import csv

        import pandas as pd
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        system, place = fs.FileSystem.from_uri(path)
        system.create_dir(place, recursive=True)
        part, whole = f"{place}/{task.taskAttemptId()}.part", f"{place}/{task.partitionId():05d}.zip"
        with system.open_output_stream(part) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("readme.txt", "no table")
            with z.open(member, "w") as data, io.TextIOWrapper(data, "utf-8", newline="") as text:
                lines = csv.writer(text)
                lines.writerow(titles)
                for batch in batches:
                    lines.writerows(batch.itertuples(index=False))
        system.move(part, whole)
        yield pd.DataFrame({"archive": [whole]})

    rows.mapInPandas(pack, "archive string").count()
    return path


def read_zips(spark, sf_dir):
    """Orders from members of many archives, which are not unpacked."""
    rows = _orders(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("key"), F.concat(F.lit('é "'), "c_name", F.lit('",\n'), "n_name").alias("holder"), F.col("o_totalprice").cast("string").alias("price"), _day("o_orderdate").alias("day"))
    got = zips.zip_members(spark, _zips(spark, rows, "in/orders.csv"), ["day", "key", "holder"], "in/*.csv")
    return got.select("key", "holder", F.to_date("day").alias("day"), "member")


HEADERS = (("Nom de l'Entreprise", "Code postal", "Région administrative"), ("ENTREPRISE", "code_postal", "VILLE region"), ("region", "Entreprise (nom)", "Mon Code-Postal"), ("Nom", "Code postal", "Pays"))
ROLES = {"name": ["entreprise", "nom"], "code": ["code_postal"], "region": ["region"]}


def resolved_headers(spark, sf_dir):
    """Customers in four files of different titles, read by the roles of their
    columns; the last file lacks one and is refused before any row is read."""
    c = _customers(spark, sf_dir)
    values = {"name": F.col("c_name"), "code": F.col("c_custkey").cast("string"), "region": F.col("n_name")}
    order = (("name", "code", "region"), ("name", "code", "region"), ("region", "name", "code"), ("name", "code", "region"))
    read, refused = None, []
    for k, (titles, roles) in enumerate(zip(HEADERS, order, strict=True)):
        path = _csv(spark, c.where(F.col("c_custkey") % 4 == k).select(*[values[r].alias(t) for t, r in zip(titles, roles, strict=True)]), "titles")
        file = readers.csv(spark, path)
        try:
            role = schema.header_aliases(file.columns, ROLES)
            schema.check_columns(file, list(role.values()))
        except ValueError as error:
            refused.append((k, str(error).split(";")[0]))
            continue
        one = file.select(F.lit(k).alias("file"), *[F.col(f"`{role[r]}`").alias(r) for r in ROLES])
        read = one if read is None else read.unionByName(one)
    told = read.groupBy("file").agg(F.count("*").alias("n"), F.min("name").alias("first"), F.sum(F.col("code").cast("long")).alias("codes"), F.countDistinct("region").alias("regions"))
    return told.join(spark.createDataFrame(refused, "file int, refused string"), "file", "full_outer")


def read_fallback_journal(spark, sf_dir):
    """Rows of a journal of JSON lines, with ids made where they lack one."""
    rows, _ = _journal(spark, sf_dir)
    return rows.select("id", F.to_date("at").alias("day"), "event", "detail")


def fallback_journal_counts(spark, sf_dir):
    """Lines of a journal that can't be read or are of an unknown format."""
    return _journal(spark, sf_dir)[1]


def _journal(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    line = F.to_json(F.struct(F.when(k % 2 == 0, k.cast("string")).alias("id"), F.when(k % 5 == 0, 9).otherwise(k % 2 + 1).alias("format"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.col("o_orderpriority").alias("event"), k.cast("string").alias("detail")))
    path = _folder(spark, "journal")
    o.select(F.when(k % 11 == 0, F.concat(F.lit("{broken "), k.cast("string"))).when(k % 13 == 0, "  ").otherwise(line).alias("value")).write.text(path)
    return readers.fallback_journal(spark, path)


# --- sinks ------------------------------------------------------------------


def archived_generations(spark, sf_dir):
    """What is left of six archived snapshots, and the newest read back."""
    n, folder = table(spark, sf_dir, "nation"), _folder(spark, "archive")
    for k in range(6):
        left = sinks.archive_snapshot(n.where(F.col("n_regionkey") != k % 5), folder, f"run-{k}")
    back = sinks.read_snapshot(spark, folder, left[-1], "n_nationkey int, n_name string, n_regionkey int")
    return back.select("n_nationkey", "n_name", F.lit(",".join(left)).alias("left"))


def finished_runs(spark, sf_dir):
    """Runs carried through: what was archived, journalled and passed on."""
    old, new = orders_before(spark, sf_dir), orders_after(spark, sf_dir)
    folder, journal, passed = _folder(spark, "archive"), _folder(spark, "journal"), {}
    keys, relevant = ["key"], ["holder", "priority", "status"]
    loose, tight = Limits.of({k: {"percent": 95.0} for k in KINDS}), Limits.of({"disappeared": {"percent": 0.1, "count": 1}})
    runs = {"first": run(None, old, keys, relevant), "second": run(old, new, keys, relevant, earlier_runs=9, limits=loose), "third": run(old, new, keys, relevant, earlier_runs=9, limits=tight)}
    for name, out in runs.items():
        sinks.finish_run(out, "orders", name, folder, journal, lambda found, name=name: passed.update({name: found.count()}))
    told = read_journal(spark, journal).select("run_id", "status", "rows")
    archived = {name: sinks.read_snapshot(spark, f"{folder}/orders", name, "key long").count() for name in ("first", "second")}
    more = spark.createDataFrame([(n, archived.get(n), passed.get(n)) for n in runs], "run_id string, archived long, passed long")
    return told.join(more, "run_id")


def notification_documents(spark, sf_dir):
    """Notifications with their signals as nested documents, parsed again."""
    o = _orders(spark, sf_dir)
    notes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("note_id"), "c_name")
    each = o.select(F.col("o_custkey").alias("note_id"), F.col("o_orderdate").alias("detected_at"), F.col("n_name").alias("source"), F.lit("tender").alias("signal_type"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("title"))
    told = F.from_json("document", "note_id long, c_name string, signals array<struct<title:string,value:double,source:string>>")
    got = sinks.notification_documents(notes, each).select("note_id", told.alias("d"))
    total = F.aggregate("d.signals", F.lit(0.0), lambda a, s: a + s["value"])
    return got.select("note_id", F.col("d.c_name").alias("c_name"), F.size("d.signals").alias("n"), F.round(total, 2).alias("total"))


def _tops(spark, sf_dir):
    c = table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)
    return c.select(F.row_number().over(_by_balance()).alias("place"), F.concat(F.lit("<"), "c_name", F.lit("> & co")).alias("name"), F.lit(88.25).alias("score"), F.col("c_acctbal").alias("value"))


def _by_balance():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("c_acctbal"), "c_custkey")  # of ten rows


def written_digest(spark, sf_dir):
    """The digest as a page and as text, read back."""
    folder = _folder(spark, "digest")
    sinks.write_digest(_tops(spark, sf_dir), f"{folder}/digest.html")
    sinks.write_digest_text(_tops(spark, sf_dir), f"{folder}/digest.txt")
    page = spark.read.text(f"{folder}/digest.html", wholetext=True)
    items = page.select(F.posexplode(F.regexp_extract_all("value", F.lit("<li>(.*?)</li>"), F.lit(1)))).select((F.col("pos") + 1).alias("place"), F.col("col").alias("item"))
    lines = spark.read.text(f"{folder}/digest.txt").select(F.regexp_extract("value", r"^(\d+)\. ", 1).cast("int").alias("place"), F.regexp_extract("value", r"^\d+\. (.*)$", 1).alias("line"))
    return items.join(lines, "place").select("place", F.replace("item", F.lit(" "), F.lit(" ")).alias("item"), F.replace("line", F.lit(" "), F.lit(" ")).alias("line"))


def digest_subjects(spark, sf_dir):
    """Subject lines, with one prospect or several."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", sinks.digest_subject((F.col("o_orderkey") % 3).cast("int"), F.col("o_orderdate")).alias("subject"))


def written_map(spark, sf_dir):
    """Points of a map, read back from its page."""
    s = table(spark, sf_dir, "supplier")
    places = s.select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 10 != 0, (F.col("s_suppkey") % 90).cast("double")).alias("lat"), (F.col("s_suppkey") % 180).cast("double").alias("lon"), F.col("s_acctbal").alias("score"))
    path = f"{_folder(spark, 'map')}/map.html"
    sinks.write_map(places, path)
    page = spark.read.text(path)  # a line for each point
    dots = page.select(F.explode(F.regexp_extract_all("value", F.lit("<circle cx='([0-9.]+)'"), F.lit(1))).alias("x"))
    return dots.groupBy(F.col("x").cast("double").alias("x")).agg(F.count("*").alias("n"))


def mapped_fields(spark, sf_dir):
    """Fields under another system's names; those without one go."""
    c = table(spark, sf_dir, "customer")
    fields = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.lit("secret"), F.lit("x"))
    got = c.select("c_custkey", sinks.mapped_properties(fields, {"name": "company", "segment": "industry"}).alias("m"))
    return got.select("c_custkey", F.col("m")["company"].alias("company"), F.col("m")["industry"].alias("industry"), F.size("m").alias("n"))


# --- streams ----------------------------------------------------------------


def _stream(spark, sf_dir):
    s = signals(spark, sf_dir).select("signal_id", "company_id", "signal_type", "value", "detected_at")
    path = _folder(spark, "stream-in")
    s.write.parquet(path)
    return streams.read(spark, path, "signal_id long, company_id long, signal_type string, value double, detected_at timestamp")


def _streamed(spark, stream):
    out = _folder(spark, "stream-out")
    streams.append_to(stream, out, _folder(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def streamed_signals(spark, sf_dir):
    """The first signal of each company and type on a stream, repeats dropped."""
    stream = streams.without_repeats(_stream(spark, sf_dir), ["company_id", "signal_type"], late="3650 days")
    return _streamed(spark, stream).groupBy("signal_type").agg(F.count("*").alias("n"))


def streamed_windows(spark, sf_dir):
    """Counts of a stream by day and type, as windows close."""
    got = _streamed(spark, streams.windowed(_stream(spark, sf_dir), "detected_at", "1 day", ["signal_type"], late="0 seconds"))
    return got.select(F.to_date("start").alias("day"), "signal_type", "n", F.round("total", 2).alias("total"))


def streamed_sessions(spark, sf_dir):
    """Sessions of companies' signals on a stream, as they close."""
    got = _streamed(spark, streams.sessions(_stream(spark, sf_dir), "detected_at", "12 hours", ["company_id"], late="0 seconds"))
    return got.groupBy("company_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("signals"))


def streamed_batches(spark, sf_dir):
    """A batch operator on every micro-batch: the new signals of each are added."""
    out = _folder(spark, "stream-out")
    empty = _stream(spark, sf_dir)

    def add(rows, number):
        fresh = rows.select(F.lit("s").alias("source"), F.concat_ws("-", "company_id", "signal_type").alias("source_ref"), F.col("signal_id").cast("string").alias("name"), "detected_at")
        schema.ingest(fresh.limit(0), fresh, AS_OF).write.mode("append").parquet(out)

    streams.each_batch(empty, add, _folder(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.parquet(out).groupBy("source").agg(F.count_distinct("source_ref").alias("refs"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (awarded_contracts, awards_in_ranges, covered_files, read_federal_contracts, read_federal_grants, read_provincial_contracts, read_building_permits, read_toronto_licences, read_vancouver_licences, new_licences, read_job_board, read_aggregated_jobs, read_growth_ranking, read_embedded_ranking, read_funding_table, read_foreign_workers, read_flat_registry, read_corporations, french_resources, corporation_moves, linked_registry, registry_name_list, inspected_zip, read_zips, resolved_headers, read_fallback_journal, fallback_journal_counts, archived_generations, finished_runs, notification_documents, written_digest, digest_subjects, written_map, mapped_fields, streamed_signals, streamed_windows, streamed_sessions, streamed_batches)}

_C = "customer JOIN nation ON n_nationkey = c_nationkey"
_O = "orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"
_D = "CAST(o_orderdate AS DATE)"
_N = "lower(replace(c_name, '#', ' '))"
_MONEY = "replace(replace(format('{:,.2f}', {x}), ',', '@'), '@', ' ')"
_LICENCES = f"licences AS (SELECT * FROM (SELECT concat('toronto_licences:', o_custkey) AS source_ref, c_name AS name, concat(c_custkey, ' King St, TORONTO, ON') AS address, 'TORONTO' AS city, 'ON' AS region, {_D} AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, c_name) AS r FROM {_O} WHERE o_orderstatus <> 'P') WHERE r = 1)"
_MONTHS = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"), 1))
_VALUES = "replace(CASE WHEN v = floor(v) THEN replace(format('{:,}', CAST(v AS BIGINT)), ',', ' ') ELSE replace(replace(format('{:,.2f}', v), ',', ' '), '.', ',') END, '-', '-')"
_LAST_DAY = "SELECT max(CAST(detected_at AS DATE)) FROM signals"

SQL = {
    "awarded_contracts": f"SELECT concat('tenders:o', o_orderkey, ':a1:', c_name) AS source_ref, c_name AS name, o_totalprice AS value, o_orderpriority AS title, concat(c_custkey, ' rue A') AS address, 'Laval' AS city, 'QC' AS region, {_D} AS day, n_name AS buyer, concat('X:', o_orderstatus, ',X:9') AS classes, 'work' AS needs FROM {_O}",
    "covered_files": f"SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 7 = 0 OR {_D} + 6 >= DATE '2000-06-01' GROUP BY o_orderstatus",
    "read_federal_contracts": f"SELECT concat('federal_contracts:R', o_orderkey) AS source_ref, c_name AS name, round(o_totalprice, 2) AS value, o_orderpriority AS title, n_name AS buyer FROM {_O} WHERE {_D} <= DATE '2000-06-01'",
    "read_federal_grants": f"SELECT concat('federal_grants:', o_orderkey, ':0') AS source_ref, c_name AS name, round(o_totalprice, 2) AS value, o_orderpriority AS title, n_name AS city, o_orderpriority AS goods FROM {_O} WHERE o_orderkey % 3 = 0 AND {_D} <= DATE '2000-06-01'",
    "read_provincial_contracts": f"SELECT concat('provincial_contracts:', o_orderkey, ':', c_name) AS source_ref, CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice, 2) END AS value, nullif(concat_ws('/', CASE WHEN o_orderkey % 2 = 0 THEN 'goods' END, CASE WHEN o_orderkey % 3 = 0 THEN 'construction' END), '') AS nature, {_D} AS day FROM {_O} WHERE o_orderkey % 11 <> 0 AND {_D} >= DATE '1996-01-01'",
    "read_building_permits": f"SELECT concat('building_permits:', o_orderkey) AS source_ref, c_name AS name, concat(c_custkey, ', \"rue\" A', chr(10), 'bureau 2') AS address, n_name AS city, {_D} AS day, o_orderpriority AS nature FROM {_O} WHERE o_orderkey % 4 <> 0",
    "read_toronto_licences": f"WITH {_LICENCES} SELECT source_ref, name, address, city, region, day FROM licences",
    "read_vancouver_licences": f"SELECT concat('vancouver_licences:', CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'r' END, c_custkey) AS source_ref, c_name AS name, concat(c_custkey, ' Main St Vancouver BC') AS address, 'Vancouver' AS city, c_mktsegment AS sector FROM {_C}",
    "new_licences": f"WITH {_LICENCES} SELECT source_ref, name, (SELECT count(*) FROM licences) AS keys FROM licences WHERE name >= 'Customer#000000500'",
    "read_job_board": f"SELECT concat('job_board:', o_orderkey) AS source_ref, c_name AS name, o_orderpriority AS title, n_name AS city, 'Québec' AS region, CAST(o_orderkey % 9 AS DOUBLE) AS value, {_D} AS day FROM {_O} WHERE o_orderkey % 2 = 0",
    "read_aggregated_jobs": f"SELECT concat('aggregated_jobs:', CASE WHEN o_orderkey % 3 = 1 THEN 'http://j/' ELSE '' END, o_orderkey) AS source_ref, c_name AS name, o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 1 THEN concat('http://j/', o_orderkey) END AS website, CASE WHEN o_orderkey % 3 = 0 THEN {_D} END AS day FROM {_O} WHERE o_orderkey % 3 < 2",
    "read_growth_ranking": f"SELECT concat('growth_ranking:', c_custkey % 9999 + 1, ':', {_N}) AS source_ref, c_name AS name, n_name AS city, 'ON' AS region, concat('1', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')) AS growth FROM {_C} WHERE c_custkey % 5 <> 0",
    "read_embedded_ranking": f"SELECT concat('embedded_ranking:', c_custkey, ':', {_N}) AS source_ref, c_name AS name, n_name AS city, 'QC' AS region, CAST(c_custkey AS VARCHAR) AS growth FROM {_C}",
    "read_funding_table": f"SELECT c_name AS name, round(o_totalprice, 2) AS value, {_D} AS day FROM {_O} WHERE o_orderkey % 6 <> 0",
    "read_foreign_workers": "SELECT n_name AS name, concat(n_nationkey, ' rue A, B') AS address, 'QC' AS region, CAST(n_nationkey AS DOUBLE) AS value, DATE '2024-07-01' AS day FROM nation WHERE n_nationkey % 5 <> 0",
    "read_flat_registry": f"SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, 'IM' AS status, CAST(NULL AS VARCHAR) AS address, n_name AS city, 'H1H' AS postal_code, 'QC' AS region, c_mktsegment AS sector FROM {_C}",
    "read_corporations": f"SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, 'Active' AS status, concat(c_custkey, ' rue A, ', n_name, ', QC') AS address, CAST(NULL AS VARCHAR) AS law FROM {_C}",
    "french_resources": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'Active business corporations' ELSE concat('active ', n_name) END AS name FROM nation WHERE n_nationkey % 3 <> 1 AND (n_nationkey % 2 = 0 OR n_nationkey % 5 = 0)",
    "corporation_moves": "SELECT CASE WHEN c_acctbal <= -900 THEN 'disappeared' ELSE 'modified' END AS change, count(*) AS n, 'accepted' AS status FROM customer WHERE c_acctbal <= -900 OR c_acctbal > 5000 GROUP BY 1",
    "linked_registry": f"""SELECT CAST(c_custkey AS VARCHAR) AS id, concat(c_name, ' Été') AS name, concat({_N}, ' ete') AS name_normalised, CASE WHEN c_custkey % 4 = 0 THEN 'struck_off' ELSE 'registered' END AS status,
CASE WHEN c_custkey % 2 = 0 THEN concat(c_custkey, ' rue A', CASE WHEN c_custkey % 3 = 0 THEN ', bureau 3' ELSE '' END) WHEN c_custkey % 3 = 0 THEN 'main' ELSE 'first' END AS address,
CASE WHEN c_custkey % 2 = 0 THEN n_name WHEN c_custkey % 3 = 0 THEN 'Lévis' ELSE 'Laval' END AS city, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN 'Québec' END AS province,
CASE WHEN c_custkey % 2 = 0 THEN 'H1H1H1' WHEN c_custkey % 3 = 0 THEN 'G1G' END AS postal_code, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN 'Bois' ELSE 'Pain' END AS sector FROM {_C} WHERE c_custkey % 7 <> 0""",
    "registry_name_list": "WITH n AS (SELECT c_custkey AS id, 'old' AS name, TRUE AS retired FROM customer WHERE c_custkey % 7 <> 0 UNION SELECT c_custkey, 'site', FALSE FROM customer UNION SELECT c_custkey, 'main site', FALSE FROM customer WHERE c_custkey % 3 = 0 UNION SELECT s_suppkey, 'site', FALSE FROM supplier) SELECT name, retired, count(*) AS n FROM n GROUP BY 1, 2 HAVING count(*) > 1",
    "inspected_zip": "SELECT 'in/a.csv' AS member, 'key|name' AS header, (SELECT concat(n_nationkey, '|', n_name, ', x') FROM nation ORDER BY n_nationkey LIMIT 1) AS first, TRUE AS filled, 3 AS members, (SELECT count(*) FROM nation) AS unpacked UNION ALL SELECT 'b.csv', '', '', FALSE, 3, (SELECT count(*) FROM nation)",
    "resolved_headers": f"SELECT CAST(c_custkey % 4 AS INTEGER) AS file, count(*) AS n, min(c_name) AS first, CAST(sum(c_custkey) AS BIGINT) AS codes, count(DISTINCT n_name) AS regions, CAST(NULL AS VARCHAR) AS refused FROM {_C} WHERE c_custkey % 4 < 3 GROUP BY 1 UNION ALL SELECT 3, NULL, NULL, NULL, NULL, 'no column for [''region'']'",
    "read_fallback_journal": f"SELECT CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE substr(sha256(concat('[\"', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), '\",\"', o_orderpriority, '\",\"', o_orderkey, '\"]')), 1, 32) END AS id, {_D} AS day, o_orderpriority AS event, CAST(o_orderkey AS VARCHAR) AS detail FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 5 <> 0",
    "fallback_journal_counts": "SELECT count(CASE WHEN o_orderkey % 11 = 0 THEN 1 END) AS unreadable, count(CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 5 = 0 THEN 1 END) AS unknown_format FROM orders",
    "archived_generations": "SELECT n_nationkey, n_name, 'run-1,run-2,run-3,run-4,run-5' AS left FROM nation WHERE n_regionkey <> 0",
    "finished_runs": f"WITH {SNAPSHOTS}, b AS (SELECT count(*) AS n FROM before_), a AS (SELECT count(*) AS n FROM after_), c AS (SELECT count(*) AS n FROM before_ b FULL OUTER JOIN after_ a ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.holder IS DISTINCT FROM b.holder OR a.priority IS DISTINCT FROM b.priority OR a.status IS DISTINCT FROM b.status) SELECT 'first' AS run_id, 'reference' AS status, b.n AS rows, b.n AS archived, CAST(NULL AS BIGINT) AS passed FROM b UNION ALL SELECT 'second', 'accepted', a.n, a.n, c.n FROM a, c UNION ALL SELECT 'third', 'quarantined', a.n, NULL, NULL FROM a",
    "notification_documents": "SELECT c_custkey AS note_id, c_name, CAST(count(o_orderkey) AS INTEGER) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2",
    "written_digest": f"WITH t AS (SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place, c_name, c_acctbal AS v FROM customer QUALIFY place <= 10) SELECT CAST(place AS INTEGER) AS place, concat('&lt;', c_name, '&gt; &amp; co – 88.3 – ', {_VALUES}, ' $') AS item, concat('<', c_name, '> & co – 88.3 – ', {_VALUES}, ' $') AS line FROM t",
    "digest_subjects": f"SELECT o_orderkey, concat(o_orderkey % 3, CASE WHEN o_orderkey % 3 > 1 THEN ' prospects' ELSE ' prospect' END, ' – ', CASE WHEN day(o_orderdate) = 1 THEN '1er' ELSE CAST(day(o_orderdate) AS VARCHAR) END, ' ', CASE month(o_orderdate) {_MONTHS} END, ' ', year(o_orderdate)) AS subject FROM orders",
    "written_map": "SELECT CAST((s_suppkey % 180 + 180) * 2 AS DOUBLE) AS x, count(*) AS n FROM supplier WHERE s_suppkey % 10 <> 0 GROUP BY 1",
    "mapped_fields": "SELECT c_custkey, c_name AS company, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS industry, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM customer",
    "streamed_signals": f"WITH {SIGNALS} SELECT signal_type, count(DISTINCT company_id) AS n FROM signals GROUP BY signal_type",
    "streamed_windows": f"WITH {SIGNALS} SELECT CAST(detected_at AS DATE) AS day, signal_type, count(*) AS n, round(sum(value), 2) AS total FROM signals WHERE CAST(detected_at AS DATE) < ({_LAST_DAY}) GROUP BY 1, 2",
    "streamed_sessions": f"WITH {SIGNALS}, g AS (SELECT company_id, detected_at, CASE WHEN detected_at < lag(detected_at) OVER (PARTITION BY company_id ORDER BY detected_at) + INTERVAL 12 HOURS THEN 0 ELSE 1 END AS first FROM signals), s AS (SELECT *, sum(first) OVER (PARTITION BY company_id ORDER BY detected_at, first) AS session FROM g), w AS (SELECT company_id, session, count(*) AS n, max(detected_at) + INTERVAL 12 HOURS AS stop FROM s GROUP BY 1, 2) SELECT company_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS signals FROM w WHERE stop <= (SELECT max(detected_at) FROM signals) GROUP BY company_id",
    "streamed_batches": f"WITH {SIGNALS} SELECT 's' AS source, count(DISTINCT concat(company_id, '-', signal_type)) AS refs FROM signals",
}
SQL["read_zips"] = f"SELECT CAST(o_orderkey AS VARCHAR) AS key, concat('é \"', c_name, '\",', chr(10), n_name) AS holder, {_D} AS day, 'in/orders.csv' AS member FROM {_O}"
SQL["awards_in_ranges"] = SQL["awarded_contracts"]
