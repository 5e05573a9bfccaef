"""Readers, writers and jobs on files."""

import json

import pytest
from pyspark.sql import functions as F

from rollcall.jobs import health, intake, reconcile
from rollcall.operators import apply, order
from rollcall.operators.reconcile import candidates, proposed, recommend, score
from rollcall.sources import adapters, records, tables
from tests.test_reconcile import number


def read(spark, path):
    return tables.Table(spark, path).read()


def now():
    return F.lit("2024-06-30 00:00:00").cast("timestamp_ntz")


def registry(n, kind="NPI-1", city="Golden", phone="720-555-0187", **over):
    place = {"address_purpose": "LOCATION", "address_1": "9 Cedar Sq", "address_2": "Suite 4", "city": city, "state": "Colorado", "postal_code": "80401-11", "telephone_number": phone}
    return {"number": n, "enumeration_type": kind, "basic": {"first_name": "ADA", "last_name": "MOSS", "status": "A"},
            "taxonomies": [{"code": "x1", "desc": "Dermatology", "primary": False}, {"code": "y2", "desc": "Allergy", "primary": True}],
            "addresses": [{"address_purpose": "MAILING", "address_1": "PO Box", "city": "Pueblo", "state": "NM", "postal_code": "1"}, place]} | over


@pytest.fixture
def registry_file(tmp_path):
    rows = [registry(number("123450001")), registry(number("123450002"), kind="NPI-2"), registry(number("123450003"), city="Vail"), registry("1234500010"),
            registry(number("123450004"), basic={"first_name": "Bo", "last_name": "Li", "status": "d"}), registry(number("123450005"), addresses=[{"address_purpose": "LOCATION", "city": "Golden", "state": "Colorado", "postal_code": "804"}])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/r.json").write_text("\n".join(map(json.dumps, rows)))
    return str(tmp_path / "in")


def test_registry_reader(spark, registry_file):
    read = lambda **k: records.read_registry(spark, registry_file, **k)
    assert read().count() == 5 and read(cities=["vail"]).count() == 1 and read(taxonomy="allerg", state="colorado", cities=["Golden"]).count() == 4
    assert read(taxonomy="surgery").count() == 0 and read(target=2).count() == 2
    r = records.flatten_registry(read(cities=["Vail"])).first()
    assert (r["name"], r["taxonomy_code"], r["street"], r["city"], r["phone"], r["is_active"]) == ("ADA MOSS", "y2", "9 Cedar Sq Suite 4", "Vail", "720-555-0187", 1)


def test_intake_job(spark, registry_file, tmp_path):
    out = str(tmp_path / "out")
    intake.main(["--registry", registry_file, "--out", out, "--as-of", "2024-06-30 00:00:00"])
    rows = {r["npi"]: r for r in read(spark, f"{out}/providers").collect()}
    assert sorted(rows) == [number(f"12345000{i}") for i in (1, 3, 4)]
    one = rows[number("123450001")]
    assert (one["name"], one["street"], one["unit"], one["state"], one["zip"], one["phone"]) == ("Ada Moss", "9 Cedar Square", "4", "CO", "80401", "(720) 555-0187")
    assert rows[number("123450004")]["is_active"] == 0
    bad = {r["npi"]: r for r in read(spark, f"{out}/providers_quarantine").collect()}
    assert bad["1234500010"]["rejection_reason"] == "Invalid NPI"
    assert bad[number("123450005")]["rejection_reason"] == "Constraint failed: zip" and json.loads(bad[number("123450005")]["raw_record"])["zip"] == "804"
    assert read(spark, f"{out}/providers_audit_log").groupBy("action").count().orderBy("action").collect() == [("ACCEPTED", 3), ("QUARANTINED", 2)]
    mirror = spark.read.option("header", True).csv(f"{out}/providers_csv")
    assert mirror.count() == 3 and "80401" in {r["zip"] for r in mirror.collect()}


def test_csv_intake_keeps_zeros_and_fails_when_empty(spark, tmp_path):
    (tmp_path / "a.csv").write_text("npi,name,error_type,expected_valid\n0012345678,Noor Vance,x,False\n" + number("223450001") + ",Noor Vance,x,True\n")
    assert [r["npi"] for r in records.read_intake(spark, str(tmp_path / "a.csv")).collect()] == ["0012345678", number("223450001")]
    intake.main(["--csv", str(tmp_path / "a.csv"), "--out", str(tmp_path / "out")])
    assert read(spark, str(tmp_path / "out/providers")).count() == 1
    with pytest.raises(ValueError, match="no provider"):
        intake.main(["--csv", str(tmp_path / "a.csv"), "--out", str(tmp_path / "out2"), "--existing", str(tmp_path / "out/providers")])
    assert not tables.Table(spark, str(tmp_path / "out2/providers_audit_log")).exists()  # nothing was written


def test_first_storable_record_of_an_identifier(spark, tmp_path):
    """A record that breaks a constraint doesn't stand in for a later sound copy, and both leave their audit row."""
    a = number("123450001")
    raw = spark.createDataFrame([(0, a, "Ada Moss", "804"), (1, a, "Ada Moss", "80401"), (2, a, "Ada Lund", "80402"), (3, None, "No One", "80401")], "ordinal long, npi string, name string, zip string")
    done = intake.run(spark, raw, str(tmp_path / "out"), now())
    assert [(r["npi"], r["zip"]) for r in done["providers"].collect()] == [(a, "80401")]
    assert sorted((r["npi"] or "-", r["rejection_reason"]) for r in done["providers_quarantine"].collect()) == [("-", "Invalid NPI"), (a, "Constraint failed: zip")]
    assert done["providers_quarantine"].filter("npi is null").count() == 1
    assert done["counts"] == {"received": 4, "quarantined": 2, "accepted": 1, "duplicates": 1}


def held(spark):
    rows = [(number(f"12345000{i}"), "Ada Moss", "", "Allergy", 1, "(720) 555-0187", "9 Cedar Square", "", "Golden", "CO", "80401") for i in range(1, 5)]
    cols = "npi string, name string, taxonomy_code string, specialty string, is_active int, phone string, street string, unit string, city string, state string, zip string"
    return spark.createDataFrame(rows, cols).withColumns({"created_at": F.lit("2023-01-01 00:00:00").cast("timestamp_ntz"), "updated_at": F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")})


def said(spark, rows):
    return spark.createDataFrame(rows, "npi string, phone string, city string, state string")


def source(df, tmp_path, name):
    path = f"{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}"
    df.write.parquet(path)
    return adapters.Source(name, path)


def test_reconcile_and_health_jobs(spark, tmp_path):
    out, providers = str(tmp_path / "out"), held(spark)
    ids = [number(f"12345000{i}") for i in range(1, 5)]
    clinic = said(spark, [(ids[0], "7195550111", "Golden", "CO"), (ids[1], "720 555 0187", "Vail", "CO"), (ids[2], "", "Golden", "CO")])
    cms = said(spark, [(ids[1], "7205550187", "Golden", "CO"), (ids[3], "7205550187", "Golden", "CO")])
    for name, df in (("clinic_site", clinic), ("cms", cms), ("dir", providers)):
        df.write.parquet(str(tmp_path / name))
    reconcile.main(["--providers", str(tmp_path / "dir"), "--source", f"clinic_site={tmp_path}/clinic_site", "--source", f"cms=rows:{tmp_path}/cms", "--out", out, "--as-of", "2024-06-30 00:00:00"])
    changes = {r["id"]: r["status"] for r in read(spark, f"{out}/proposed_changes").collect()}
    assert changes == {f"{ids[0]}-phone": "applied", f"{ids[1]}-city": "pending_review"}
    new = {r["npi"]: r for r in read(spark, f"{out}/providers").collect()}
    assert len(new) == 4 and new[ids[0]]["phone"] == "(719) 555-0111" and str(new[ids[0]]["updated_at"])[:4] == "2024" and str(new[ids[1]]["updated_at"])[:4] == "2023"
    queue = spark.read.json(f"{out}/review_queue").collect()
    assert [(r["id"], r["name"], r["new_value"], r["source"]) for r in queue] == [(f"{ids[1]}-city", "Ada Moss", "Vail", "Practice Website")]
    # Another pull of one source replaces that source alone, and one without rows leaves it with none.
    one = source(said(spark, [(ids[0], "7205550187", "Golden", "CO")]), tmp_path, "cms")
    count = lambda: {(r["source_name"], r["count"]) for r in read(spark, f"{out}/external_data").groupBy("source_name").count().collect()}
    reconcile.run(spark, [one], out, now(), least_score=50)
    assert count() == {("clinic_site", 3), ("cms", 1)}
    # A pull that scores too low changes nothing at all.
    before = {t: tables.Table(spark, f"{out}/{t}").versions() for t in ("external_data", "proposed_changes", "providers", "providers_audit_log", "source_errors")}
    with pytest.raises(ValueError, match="below 101"):
        reconcile.run(spark, [source(cms, tmp_path, "cms")], out, now(), least_score=101)
    assert before == {t: tables.Table(spark, f"{out}/{t}").versions() for t in before}
    reconcile.run(spark, [source(said(spark, []), tmp_path, "cms")], out, now(), least_score=0)
    assert count() == {("clinic_site", 3)}
    with pytest.raises(ValueError, match="no provider"):
        reconcile.run(spark, [one], str(tmp_path / "none"), now(), providers=providers.limit(0))
    external = clinic.selectExpr("npi", "'clinic_site' AS source_name", "monotonically_increasing_id() AS ordinal", "phone", "'' AS street", "city", "state", "'' AS zip", "1 AS is_active").unionByName(
        one.load(spark).selectExpr("npi", "'cms' AS source_name", "9L AS ordinal", "phone", "'' AS street", "city", "state", "'' AS zip", "1 AS is_active"))
    got = {r["detector"]: r["n"] for r in health.run(spark, providers, external, f"{out}/health", now()).collect()}
    assert got == {"duplicates": 1, "shared_locations": 1, "moved": 4, "inactive": 0, "stale": 4}
    assert spark.read.parquet(f"{out}/health/stale").count() == 4


def test_runs_in_one_folder_lose_nothing(spark, registry_file, tmp_path):
    """Intake, reconcile twice and intake again below one folder: every record, change and audit row is there, once."""
    out = str(tmp_path / "out")
    ids = [number(f"12345000{i}") for i in (1, 3, 4)]
    intake.main(["--registry", registry_file, "--out", out, "--run", "first"])
    log = lambda: sorted((r["run_id"], r["action"], r["count"]) for r in read(spark, f"{out}/providers_audit_log").groupBy("run_id", "action").count().collect())
    taken = [("first", "ACCEPTED", 3), ("first", "QUARANTINED", 2)]
    assert log() == taken
    phone = source(said(spark, [(ids[0], "7195550111", "Golden", "CO"), (ids[1], "7205550187", "Aspen", "CO")]), tmp_path, "clinic_site")
    reconcile.run(spark, [phone], out, now(), "second", least_score=0)
    taken += [("second", "AUTO_UPDATED", 1), ("second", "FLAGGED_REVIEW", 1)]
    assert log() == taken
    # The same run once more does nothing; another finds the applied change done and the pending one still to decide.
    reconcile.run(spark, [phone], out, now(), "second", least_score=0)
    assert log() == taken
    reconcile.run(spark, [phone], out, now(), "third", least_score=0)
    assert log() == [*taken, ("third", "FLAGGED_REVIEW", 1)]
    held_ = {r["npi"]: r["phone"] for r in read(spark, f"{out}/providers").collect()}
    assert sorted(held_) == ids and held_[ids[0]] == "(719) 555-0111"
    assert sorted((r["run_id"], r["id"], r["status"]) for r in read(spark, f"{out}/proposed_changes").collect()) == [
        ("second", f"{ids[0]}-phone", "applied"), ("second", f"{ids[1]}-city", "pending_review"), ("third", f"{ids[1]}-city", "pending_review")]
    more = spark.createDataFrame([(0, number("223450001"), "Noor Vance"), (1, ids[0], "Ada Moss")], "ordinal long, npi string, name string")
    done = intake.run(spark, more, out, now(), "fourth")
    assert done["counts"] == {"received": 2, "quarantined": 0, "accepted": 1, "duplicates": 1}
    assert done["providers"].count() == 4 and done["providers"].filter(f"npi = '{ids[0]}'").first()["phone"] == "(719) 555-0111"
    assert log() == sorted([*taken, ("third", "FLAGGED_REVIEW", 1), ("fourth", "ACCEPTED", 1)])


def test_a_run_that_is_killed_can_be_repeated(spark, tmp_path, monkeypatch):
    out, ids = str(tmp_path / "out"), [number(f"12345000{i}") for i in range(1, 5)]
    clinic = source(said(spark, [(ids[0], "7195550111", "Golden", "CO")]), tmp_path, "clinic_site")
    go = lambda: reconcile.run(spark, [clinic], out, now(), "r", held(spark), 0)
    with monkeypatch.context() as m:
        m.setattr(tables.BucketedTable, "rewrite", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            go()
    assert {r["phone"] for r in read(spark, f"{out}/providers").collect()} == {"(720) 555-0187"}  # the old version
    done = go()
    assert done["proposed_changes"].count() == 1 and done["providers_audit_log"].count() == 1
    assert done["counts"] == {"applied": 1, "pending": 0, "skipped": 0, "conflicts": 0} and go()["counts"] == {}
    assert done["providers"].filter("phone = '(719) 555-0111'").count() == 1 and done["providers"].count() == 4
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_staging")]


# ---------------------------------------------------------------- sources that fail

BROKEN = ['{"npi": "%s", "phone": "7195550111"}', '{"npi": "%s", "phone": "719', 'not json', '{"npi": "%s", "phone": "7205550187"}']


def test_sources_are_isolated(spark, tmp_path):
    ids = [number(f"12345000{i}") for i in range(1, 5)]
    lines = [x % ids[i] if "%s" in x else x for i, x in enumerate(BROKEN)]
    (tmp_path / "half.json").write_text("\n".join(lines))
    (tmp_path / "torn").mkdir()
    (tmp_path / "torn/part-0.parquet").write_bytes(b"PAR1 this is no table")
    good = source(said(spark, [(ids[1], "7205550187", "Vail", "CO")]), tmp_path, "state_board")
    sources = [good, adapters.Source("clinic_site", str(tmp_path / "half.json"), "json", "npi string, phone string"), adapters.Source("cms", str(tmp_path / "nowhere")),
               adapters.Source("nppes", str(tmp_path / "torn")), adapters.Source("odd", good.path, shape=lambda df: df.select("no_such_column"))]
    pulled = adapters.pull(spark, sources, str(tmp_path / "staging"), now())
    assert [x.split("(")[0] for x in pulled.failed] == ["cms", "nppes", "odd"] and pulled.failed[0] == "cms(error: PATH_NOT_FOUND)"
    assert sorted((r["source_name"], r["npi"]) for r in pulled.rows.collect()) == [("clinic_site", ids[0]), ("clinic_site", ids[3]), ("state_board", ids[1])]
    errors = [(r["source_name"], r["error"], r["record"]) for r in pulled.errors.collect()]
    assert sorted(x for x in errors if x[1] == "BAD_RECORD") == sorted(("clinic_site", "BAD_RECORD", x) for x in lines[1:3])
    assert {x[0] for x in errors} == {"clinic_site", "cms", "nppes", "odd"}
    rec = {r["npi"]: r for r in recommend(held(spark), pulled.rows, failed=pulled.failed).collect()}
    assert rec[ids[0]]["sources_consulted"] == ["clinic_site", *pulled.failed] and rec[ids[0]]["recommended_action"] == "auto_update"
    assert rec[ids[2]]["sources_consulted"] == pulled.failed and rec[ids[2]]["reason"].startswith("No external source could be reached")
    # The job goes on with what there is, and keeps the failed source's earlier rows without using them.
    done = reconcile.run(spark, sources, str(tmp_path / "out"), now(), "r", held(spark), 0)
    assert done["source_errors"].count() == len(errors) and done["proposed_changes"].count() == 2


def test_nothing_could_be_read(spark, tmp_path):
    pulled = adapters.pull(spark, [adapters.Source("cms", str(tmp_path / "nowhere"))], str(tmp_path / "s"), now())
    assert pulled.rows.count() == 0 and pulled.read == [] and pulled.errors.count() == 1


def test_enrollment_file(spark, tmp_path):
    """A bulk file with more columns in another order; the first row of an identifier counts, wherever the file is split."""
    ids = [number(f"12345000{i}") for i in range(1, 4)]
    head = "Provider_Last_Name,NPI,extra,adr_ln_1,adr_ln_2,ln_2_sprs,citytown,state,zip_code,telephone_number,provider_first_name"
    rows = [f"Moss,{ids[0]},x,9 Cedar Sq,Wing B,,Golden,CO,804011234,7205550187,Ada", f"Lund,{ids[0]},x,1 Elm St,,,Vail,CO,81657,,Ada", f"Li,{ids[1]},x,2 Elm St,Room 9,Y,Vail,CO,81657,,Bo", f",{ids[2]},,,,,,,,,"]
    (tmp_path / "e.csv").write_text("\n".join([head, *rows]))
    pulled = adapters.pull(spark, [adapters.parse(f"cms=enrollment:{tmp_path}/e.csv")], str(tmp_path / "s"), now())
    got = {r["npi"]: r for r in pulled.rows.collect()}
    assert sorted(got) == ids[:2] and not pulled.failed
    assert [got[ids[0]][c] for c in ("name", "street", "city", "phone", "specialty", "source_name")] == ["Ada Moss", "9 Cedar Sq Wing B", "Golden", "7205550187", None, "cms"]
    assert (got[ids[1]]["street"], got[ids[1]]["phone"]) == ("2 Elm St", None)


def test_other_kinds_of_sources(spark, tmp_path, registry_file):
    row = {"npi": number("123450001"), "extraction": {"name": "Ada Moss", "phone": " ", "city": "Vail"}}
    (tmp_path / "x.json").write_text(json.dumps(row))
    pulled = adapters.pull(spark, [adapters.parse(f"practice_site=extraction:{tmp_path}/x.json"), adapters.parse(f"nppes=registry:{registry_file}")], str(tmp_path / "s"), now())
    got = {(r["source_name"], r["npi"]): r for r in pulled.rows.collect()}
    assert len(got) == 6 and not pulled.failed
    assert (got["practice_site", row["npi"]]["city"], got["practice_site", row["npi"]]["phone"]) == ("Vail", None)
    assert got["nppes", number("123450004")]["is_active"] == 0


# ---------------------------------------------------------------- one order over all rows

@pytest.mark.parametrize("partitions", [1, 7])
def test_ordinals_over_all_sources(spark, tmp_path, partitions):
    """Distinct, gapless, and the same however the rows are dealt out."""
    ids = [number(f"12345{i:04}") for i in range(40)]
    made = []
    for name, cities in (("cms", ["Vail", "Aspen"]), ("state_board", ["Aspen", "Vail"])):
        df = spark.createDataFrame([(i, npi, cities[i % 2]) for i, npi in enumerate(ids)], "ordinal long, npi string, city string").repartition(partitions)
        made.append(source(df, tmp_path, name))
    rows = adapters.pull(spark, made, str(tmp_path / "s"), now()).rows.collect()
    assert sorted(r["ordinal"] for r in rows) == list(range(80))
    assert {(r["ordinal"], r["source_name"], r["npi"]) for r in rows} == {(i + 40 * k, s, npi) for k, s in enumerate(("cms", "state_board")) for i, npi in enumerate(ids)}


@pytest.mark.parametrize("partitions", [1, 7])
def test_ties_go_to_the_value_seen_first(spark, tmp_path, partitions):
    """Two sources of equal weight disagree: the one that was given first wins, in whatever order their files are read."""
    a = number("123450001")
    say = lambda name, city: source(said(spark, [(a, "", city, "CO")]).repartition(partitions), tmp_path, name)
    for names in (("feed_a", "feed_b"), ("feed_b", "feed_a")):
        sources = [say(n, {"feed_a": "Vail", "feed_b": "Aspen"}[n]) for n in names]
        rows = adapters.pull(spark, sources, f"{tmp_path}/s-{names[0]}-{len(list(tmp_path.iterdir()))}", now()).rows
        got = score(candidates(held(spark), rows)).first()
        assert got["conflict"] and got["new_value"] == {"feed_a": "Vail", "feed_b": "Aspen"}[names[0]]


def test_numbering(spark, tmp_path):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "CASE WHEN id % 10 = 0 THEN NULL ELSE id % 3 END AS g").repartition(5)
    got, n = order.numbered(df, ["g", "k"], str(tmp_path / "a"), start=5)
    rows = got.orderBy("ordinal").collect()
    assert n == 1000 and [r["ordinal"] for r in rows] == list(range(5, 1005))
    assert [(r["g"], r["k"]) for r in rows] == sorted(((r["g"], r["k"]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    empty, n = order.numbered(df.filter("false"), ["k"], str(tmp_path / "b"))
    assert n == 0 and empty.count() == 0


# ---------------------------------------------------------------- tables of parts

def test_a_table_may_be_read_while_it_is_replaced(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no table"):
        t.read()
    t.replace({"a": spark.range(3), "b": spark.range(10, 12)}, "one")
    old = t.read()
    t.replace({"a": t.read().selectExpr("id + 100 AS id")})  # reads what it replaces
    assert sorted(r["id"] for r in t.read().collect()) == [10, 11, 100, 101, 102, 110, 111]
    assert sorted(r["id"] for r in old.collect()) == [0, 1, 2, 10, 11]  # the version before is still whole
    t.replace({"b": None, "c": spark.range(1).selectExpr("id", "'x' AS more")})
    assert sorted((r["id"], r["more"]) for r in t.read("c").collect()) == [(0, "x")] and t.read("b").count() == 0
    assert t.has_run("one") and not t.has_run("two") and len(t.versions()) == 2
    with pytest.raises(ValueError, match="column id"):
        t.replace({"a": spark.range(1).selectExpr("cast(id AS string) AS id")})


def test_two_writers_and_a_writer_that_dies(spark, tmp_path, monkeypatch):
    t = tables.Table(spark, str(tmp_path / "t"))
    t.replace({"a": spark.range(3)})
    stale = t.manifest()
    t.replace({"a": spark.range(4)})
    with pytest.raises(Exception, match="(?i)exist"):
        t._swap(stale, {}, stale["schema"], None)  # another writer was faster
    monkeypatch.setattr(t, "_swap", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        t.replace({"a": spark.range(9)})
    assert tables.Table(spark, str(tmp_path / "t")).read().count() == 4


def shuffled(df, mark):
    """For each leaf of the plan that has the mark: the exchanges above it."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().splitlines(), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    for i, line in enumerate(lines):
        if mark in line:
            at, above = depth(line), []
            for upper in reversed(lines[:i]):
                if depth(upper) < at:
                    at = depth(upper)
                    above += [upper.strip()] if "Exchange" in upper else []
            out.append(above)
    return out


def test_the_directory_stays_where_it_is(spark, tmp_path):
    """Finding, scoring and merging changes shuffles the sources' rows and the changes, never the directory's."""
    t = tables.BucketedTable(spark, str(tmp_path / "t"), "npi", buckets=8)
    t.add(held(spark))
    t.add(held(spark).withColumn("npi", F.translate("npi", "123", "321")))
    assert t.colocated().count() == 8
    external = said(spark, [(number("123450001"), "7195550111", "Golden", "CO")]).selectExpr("*", "'clinic_site' AS source_name", "1L AS ordinal", "'' AS street", "'' AS zip", "'' AS specialty", "1 AS is_active")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        changes = proposed(score(candidates(t.colocated(), external)))
        assert shuffled(changes, "FileScan parquet") == [[]]
        plan = changes._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # the sources' rows, once for the join, all groups and windows
        routed = apply.route(changes)
        merged = apply.merge(t.colocated(), routed, now())
        assert [] in shuffled(merged, "FileScan parquet") and {r["phone"] for r in merged.collect()} == {"(719) 555-0111", "(720) 555-0187"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    t = tables.BucketedTable(spark, str(tmp_path / "t"), "k", buckets=8)
    rows = spark.range(200).selectExpr("cast(id AS string) AS k", "0 AS v")
    t.add(rows.filter("cast(k AS int) < 100"))
    t.add(rows.filter("cast(k AS int) >= 100"))
    before = t.manifest()["parts"]
    assert len(before) == 8 and all(len(f) == 2 for f in before.values())
    keys = rows.filter("k IN ('7', '150')")
    n = t.rewrite(keys, lambda df: df.withColumn("v", F.when(F.col("k").isin("7", "150"), 1).otherwise(F.col("v"))))
    after = tables.BucketedTable(spark, str(tmp_path / "t"), "k").manifest()["parts"]
    assert 1 <= n <= 2 and sum(before[k] != after[k] for k in before) == n
    got = {r["k"]: r["v"] for r in t.read().collect()}
    assert len(got) == 200 and {k for k, v in got.items() if v} == {"7", "150"}


def test_review_and_misclassified_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, True, False), (2, True, True)], "ordinal int, predicted boolean, expected boolean")
    from rollcall.operators import evaluate

    records.write_csv(evaluate.misclassified(rows), str(tmp_path / "wrong"))
    assert [r["ordinal"] for r in spark.read.option("header", True).csv(str(tmp_path / "wrong")).collect()] == ["1"]


def test_extraction_plug_point(spark):
    df = spark.createDataFrame([(1, "Call 720-555-0187 at 9 Cedar Ave in Golden, CO 80401"), (2, None)], "doc_id long, text string")
    r = {x["doc_id"]: x for x in records.extract_fields(df).collect()}
    assert (r[1]["phone"], r[1]["city"], r[1]["state"], r[1]["zip"], r[1]["street"], r[2]["phone"]) == ("720-555-0187", "Golden", "CO", "80401", "9 Cedar Ave", "")

    def shout(batches):
        for b in batches:
            yield b[["doc_id"]].assign(phone=b["text"].fillna("").str.upper())

    assert {x["phone"] for x in records.extract_fields(df, batch_function=shout, schema="doc_id long, phone string").collect()} >= {""}
