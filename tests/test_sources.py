"""Readers, writers and streams on files that the tests write."""

from __future__ import annotations

import json
import zipfile
from datetime import datetime

from signalmill.sources import readers, signals, sinks
from signalmill.streaming import signals as streaming

NOW = datetime(2024, 6, 1)


def test_contract_awards_name_every_supplier(spark, tmp_path):
    award = {"id": "a1", "date": "2024-05-02T00:00:00Z", "value": {"amount": 5000.0, "currency": "CAD"}, "suppliers": [{"id": "s1", "name": " Ferme A "}, {"id": "s2", "name": "B inc"}, {"id": "s3", "name": " "}]}
    release = {"ocid": "o1", "date": "2024-05-01", "buyer": {"name": "Ville"}, "parties": [{"id": "s1", "roles": ["supplier"], "address": {"locality": "Laval"}}], "tender": {"title": "Bois", "items": [{"description": "planches", "classification": {"scheme": "UNSPSC", "id": "30"}}]}, "awards": [award]}
    (tmp_path / "hebdo_20240501_20240507.json").write_text(json.dumps({"releases": [release]}))
    (tmp_path / "hebdo_20200101_20200107.json").write_text(json.dumps([{**release, "ocid": "old"}]))
    got = readers.contract_awards(spark, str(tmp_path), datetime(2024, 1, 1)).collect()
    assert {(r.name, r.city, r.value) for r in got} == {("Ferme A", "Laval", 5000.0), ("B inc", None, 5000.0)}
    assert len({r.source_ref for r in got}) == 2 and got[0].fields["classes"] == "UNSPSC:30" and got[0].fields["buyer"] == "Ville"


def test_datastore_sources(spark, tmp_path):
    def page(name, records):
        (tmp_path / name).write_text(json.dumps({"result": {"records": records}}))
        return str(tmp_path / name)

    path = page("c.json", [{"vendor_name": "X", "contract_date": "2024-01-05", "contract_value": "0", "original_value": "1,500.00", "reference_number": "r1"}, {"vendor_name": "Y", "contract_date": "2031-01-05", "reference_number": "r2"}, {"vendor_name": " ", "reference_number": "r3"}])
    assert [(r.name, r.value) for r in readers.federal_contracts(spark, path, NOW).collect()] == [("X", 1500.0)]
    path = page("g.json", [{"recipient_legal_name": "Z", "agreement_start_date": "2024-02-01", "agreement_value": "9", "recipient_province": "QC", "ref_number": "g", "prog_name_fr": "Équipement"}, {"recipient_legal_name": "W", "recipient_province": "ON"}])
    got = readers.federal_grants(spark, path, NOW).collect()
    assert [(r.name, r.fields["goods"]) for r in got] == [("Z", "Équipement")]
    (tmp_path / "p.json").write_text(json.dumps([{"tender_id": "t", "vendor": "V", "awarded_date": "2024-03-01T00:00:00", "awarded_amount": "-5", "goods": "Y", "service": "Y"}, {"vendor": "no tender"}]))
    assert [(r.name, r.value, r.fields["nature"]) for r in readers.provincial_contracts(spark, str(tmp_path / "p.json")).collect()] == [("V", None, "goods/service")]


def test_csv_sources(spark, tmp_path):
    (tmp_path / "permits.csv").write_text("ENTREPRENEUR,DATE_EMISSION,NO_PERMIS,TYPE_PERMIS_DESCR,ADRESSE,EXVILLE_DESCR,COUT_PERMIS\nBâtir,2024-02-01,7,Nouvelle construction,1 rue A,Laval,\"1,000\"\n,2024-02-01,8,,,,\n")
    assert [(r.name, r.fields["permit_cost"]) for r in readers.building_permits(spark, str(tmp_path / "permits.csv")).collect()] == [("Bâtir", "1000.0")]
    (tmp_path / "toronto.csv").write_text("Client Name,Licence No.,Category,Issued,Cancel Date,Licence Address Line 1,Licence Address Line 2,Licence Address Line 3\nA,1,Shop,2024-01-01,,1 King,\"Toronto, ON\",M5V\nA new,1,Shop,2024-02-01,,1 King,\"Toronto, ON\",M5V\nB,2,Shop,2024-01-01,2024-02-02,x,y,z\n")
    licences = readers.toronto_licences(spark, str(tmp_path / "toronto.csv"))
    assert [(r.name, r.city, r.region) for r in licences.collect()] == [("A new", "Toronto", "ON")]
    first, known = readers.new_licences(licences, None)
    again, _ = readers.new_licences(licences, known)
    assert first.count() == again.count() == 0 and readers.new_licences(licences, known.limit(0))[0].count() == 1
    (tmp_path / "vancouver.csv").write_text("businessname,licencenumber,businesstype,issueddate,status,unit,house,street,city,province\nC,9,Cafe,2024-01-02,Issued,,12,Main,Vancouver,BC\n")
    assert readers.vancouver_licences(spark, str(tmp_path / "vancouver.csv")).first().address == "12 Main Vancouver BC"
    (tmp_path / "funds.csv").write_text("Entreprise,Montant,Date\nD,\"25,000 $\",2024-01-03\nE,,2024-01-03\n")
    assert [(r.name, r.value) for r in readers.funding_table(spark, str(tmp_path / "funds.csv")).collect()] == [("D", 25000.0)]
    (tmp_path / "jobs.tsv").write_bytes("Job Posting ID\tJob Title\tFirst Posting Date\tCity\tProvince\tVacancy Count\n5\tSoudeur\t2024-01-04\tLaval\tQuébec\t3\n".encode("utf-16"))
    posts = readers.job_board(spark, str(tmp_path / "jobs.tsv"), "québec")
    made = readers.with_employers(posts, spark.createDataFrame([("5", "F inc")], "job_id string, name string")).first()
    assert (made.name, made.value, made.title) == ("F inc", 3.0, "Soudeur")
    (tmp_path / "ranking.txt").write_text("Fast 50\n 1 Acme Logiciels  Montréal, QC  1,234 %\nnoise\n")
    assert [(r.name, r.city, r.fields["growth"]) for r in readers.growth_ranking(spark, str(tmp_path / "ranking.txt")).collect()] == [("Acme Logiciels", "Montréal", "1234")]
    (tmp_path / "page.html").write_text('<script>var data = [{"rank":"3","company":"G","location":"Ottawa, ON","growth":"150%"}];</script>')
    assert [(r.name, r.region, r.fields["rank"]) for r in readers.embedded_ranking(spark, str(tmp_path / "page.html")).collect()] == [("G", "ON", "3")]
    (tmp_path / "agg.jsonl").write_text('{"company":{"name":"H"},"title":"Chef","url":"u"}\n{"title":"no company","id":1}\n')
    assert [(r.name, r.title) for r in readers.aggregated_jobs(spark, str(tmp_path / "agg.jsonl")).collect()] == [("H", "Chef")]


def test_foreign_worker_sheets(spark, tmp_path):
    (tmp_path / "2026Q1-list.csv").write_text("A title that names employers\nProvince/Territory,Program Stream,Employer,Address,Occupation,Approved LMIAs,Approved Positions\nQC,High,I inc,\"Laval, QC J0L 2A\",Chef,1,4\nNotes,,,,,,\n")
    sheet = "<worksheet xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'><sheetData><row><c r='A1' t='inlineStr'><is><t>Employer</t></is></c><c r='C1' t='inlineStr'><is><t>Approved Positions</t></is></c></row><row><c r='A2' t='inlineStr'><is><t>J inc</t></is></c><c r='C2'><v>2</v></c></row></sheetData></worksheet>"
    with zipfile.ZipFile(tmp_path / "2025Q4-list.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    got = {r.name: (r.value, str(r.detected_at)[:10], r.region) for r in readers.foreign_workers(spark, str(tmp_path)).collect()}
    assert got == {"I inc": (4.0, "2026-01-01", "QC"), "J inc": (2.0, "2025-10-01", None)}


def test_registry_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("Entreprise.csv", "NEQ,COD_STAT_IMMAT,ADR_DOMCL_LIGN1_ADR,ADR_DOMCL_LIGN2_ADR,ADR_DOMCL_LIGN4_ADR,DESC_ACT_ECON_ASSUJ\n1,IM,1 rue A,Laval (Québec),H1H,Bois\n2,RD,,,,\n3,IM,x,y,z,\n")
        z.writestr("Nom.csv", "NEQ,NOM_ASSUJ,STAT_NOM,TYP_NOM_ASSUJ,DAT_INIT_NOM_ASSUJ\n1,Vieux nom,A,M,2001-01-01\n1,Été inc,V,M,1999-01-01\n2,B,A,X,2000-01-01\n2,C,A,X,2010-01-01\n")
        z.writestr("Etablissements.csv", "NEQ,NO_SUF_ETAB,IND_ETAB_PRINC,LIGN1_ADR,LIGN2_ADR,LIGN4_ADR,DESC_ACT_ECON_ETAB,NOM_ETAB\n2,1,N,1 rue B,Québec (Québec),G1G,Pain,Chez B\n2,2,O,2 rue B,Lévis (Québec),G1G,Pain,\n")
    folder = f"file://{tmp_path}/out"
    assert sorted(readers.unzip(spark, str(tmp_path / "r.zip"), folder)) == ["Entreprise.csv", "Etablissements.csv", "Nom.csv"]
    tables = [readers.csv(spark, f"{folder}/{n}.csv") for n in ("Entreprise", "Nom", "Etablissements")]
    signals.check_columns(tables[0], readers.REGISTRY_COLUMNS["companies"])
    got = {r.id: (r.name, r.name_normalised, r.status, r.address, r.city) for r in readers.linked_registry(*tables).collect()}
    assert got == {"1": ("Été inc", "ete inc", "registered", "1 rue A", "Laval"), "2": ("C", "c", "struck_off", "2 rue B", "Lévis")}
    mergers = spark.createDataFrame([("1", "Fusion X")], "NEQ string, DENOMN_SOC string")
    names = {(r.id, r.name, r.retired) for r in readers.registry_names(tables[1], tables[2], mergers).collect()}
    assert names == {("1", "vieux nom", True), ("1", "ete inc", False), ("2", "b", True), ("2", "c", True), ("2", "chez b", False), ("1", "fusion x", False)}


def test_ingestion_is_idempotent(spark):
    rows = spark.createDataFrame([("s", "A", "r1"), ("s", "B", "r1"), ("s", "C", "r2")], "source string, name string, source_ref string")
    made = signals.signals(rows, "s", "tender", name=rows["name"], source_ref=rows["source_ref"])
    fresh = signals.ingest(made.limit(0), made, NOW)
    assert sorted((r.name, r.source_ref, r.detected_at) for r in fresh.collect()) == [("A", "r1", NOW), ("C", "r2", NOW)]
    assert signals.ingest(fresh, made, NOW).count() == 0


def test_fallback_journal(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"id":"1","format":1,"at":"2024-01-01 00:00:00","event":"e"}\nnot json\n{"format":9}\n{"format":2,"event":"x"}\n\n')
    rows, counts = readers.fallback_journal(spark, str(tmp_path / "j.jsonl"))
    assert tuple(counts.first()) == (1, 1) and sorted(len(r.id) for r in rows.collect()) == [1, 32]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    for i in range(7):
        left = sinks.archive_snapshot(rows, f"file://{tmp_path}/gen", f"run{i}")
    assert left == [f"run{i}" for i in range(2, 7)] and sinks.read_snapshot(spark, f"file://{tmp_path}/gen", "run6", "k int, v string").count() == 1
    notes = spark.createDataFrame([(1, "A"), (2, "B")], "note_id int, name string")
    sig = spark.createDataFrame([(1, NOW, "s", "tender", 5.0, "t")], "note_id int, detected_at timestamp, source string, signal_type string, value double, title string")
    documents = {r.note_id: json.loads(r.document) for r in sinks.notification_documents(notes, sig).collect()}
    assert documents[1]["signals"][0]["title"] == "t" and documents[2]["signals"] == []
    tops = spark.createDataFrame([(1, "A & B", 88.0, 1000.0)], "place int, name string, score double, value double")
    sinks.write_digest(tops, f"file://{tmp_path}/digest.html")
    assert "A &amp; B" in (tmp_path / "digest.html").read_text()
    sinks.write_map(spark.createDataFrame([("A", 45.0, -73.0, 9.0)], "name string, lat double, lon double, score double"), f"file://{tmp_path}/map.html")
    assert "<circle" in (tmp_path / "map.html").read_text()


def test_streams(spark, tmp_path):
    rows = [("s", f"r{i % 6}", datetime(2024, 1, 1 + i % 6), float(i)) for i in range(12)]
    spark.createDataFrame(rows, "source string, source_ref string, detected_at timestamp, value double").write.parquet(f"{tmp_path}/in")
    schema = "source string, source_ref string, detected_at timestamp, value double"
    once = streaming.without_repeats(streaming.read(spark, f"{tmp_path}/in", schema), ["source", "source_ref"])
    for _ in range(2):
        streaming.append_to(once, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    seen = []
    streaming.each_batch(streaming.read(spark, f"{tmp_path}/in", schema), lambda df, n: seen.append(df.count()), f"{tmp_path}/check2").awaitTermination()
    assert sum(seen) == 12
    counts = streaming.windowed(streaming.read(spark, f"{tmp_path}/in", schema), "detected_at", "2 days", ["source"], "1 day")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("select sum(n) from counts").first()[0] == 12
