import itertools

import pytest
from pyspark.sql import functions as F

from rollcall.functions import normalize
from rollcall.functions.policy import DEFAULT
from rollcall.operators import apply, detect, evaluate, intake, quality, reconcile

PROVIDER = "npi string, name string, specialty string, is_active int, phone string, street string, unit string, city string, state string, zip string, updated_at timestamp_ntz"
EXTERNAL = "ordinal long, npi string, source_name string, field string, value string"
NOW = "timestamp_ntz '2024-06-30 00:00:00'"

STORED = {"name": "Ines Okafor", "specialty": "Dermatology", "is_active": "1", "phone": "(303) 555-0142", "street": "77 Quarry Lane", "city": "Boulder", "state": "CO", "zip": "80301"}
OTHER = {"name": "Ines Lund", "specialty": "Allergy", "is_active": "0", "phone": "720.555.0187", "street": "9 Cedar Sq", "city": "Golden", "state": "Utah", "zip": "84101-22"}
THIRD = OTHER | {"name": "I Marsh", "specialty": "Urology", "phone": "7195550111", "street": "4 Elm Ct", "city": "Pueblo", "state": "nm", "zip": "87501"}


def expected(field, sources, rivals):
    """Confidence and decision of a change by the rules, worked out one source after the other."""
    def weigh(names):
        best = {}
        for s in names:
            rel, group, _ = DEFAULT.sources.get(s, (0.6, s, s))
            best[group] = max(rel, best.get(group, 0))
        doubt = 1.0
        for rel in best.values():
            doubt *= 1 - rel
        owner = DEFAULT.group_of(DEFAULT.owners[field]) in best
        sure = 1 - doubt
        return len(best), round(sum(best.values()), 6), sure + 0.15 * (1 - sure) if owner else sure, owner

    n, _, sure, owner = max((weigh(x) for x in (sources, rivals) if x), key=lambda w: w[:2])
    if rivals:
        return sure * 0.7, "human_review"
    fine = field not in ("name", "is_active") and (n > 1 or owner) and sure >= DEFAULT.bar_of(field)
    return sure, "auto_update" if fine else "human_review"


def cases():
    """Every field with single sources, pairs (also of one group), all together, and rivals that disagree."""
    names = [*DEFAULT.sources, "county_feed"]
    sets = [[s] for s in names] + [list(p) for p in itertools.combinations(names, 2)] + [names]
    out = [(f, s, []) for f in STORED for s in sets]
    return out + [(f, [a], [b]) for f in STORED if f != "is_active" for a, b in (("nppes", "practice_site"), ("state_board", "cms"), ("county_feed", "clinic_site"))]


def directory(spark, keys):
    rows = [(k, STORED["name"], STORED["specialty"], 1, STORED["phone"], STORED["street"], "", STORED["city"], STORED["state"], STORED["zip"], None) for k in keys]
    return spark.createDataFrame(rows, PROVIDER)


def reports(spark, said):
    """said: (npi, source, field, value)"""
    rows = [(i, k, s, f, v) for i, (k, s, f, v) in enumerate(said)]
    return spark.createDataFrame(rows, EXTERNAL).groupBy("ordinal", "npi", "source_name").pivot("field", reconcile.RECORD).agg(F.first("value"))


def test_decisions_by_the_rules(spark):
    every = cases()
    said = [(f"c{i}", s, f, v[f]) for i, (f, one, two) in enumerate(every) for v, names in ((OTHER, one), (THIRD, two)) for s in names]
    scored = reconcile.score(reconcile.candidates(directory(spark, [f"c{i}" for i in range(len(every))]), reports(spark, said), reconcile.RECORD))
    got = {r["npi"]: r for r in scored.collect()}
    assert len(got) == len(every)
    for i, (field, one, two) in enumerate(every):
        sure, decision = expected(field, one, two)
        r = got[f"c{i}"]
        assert (r["field"], r["decision"], r["conflict"]) == (field, decision, bool(two)), (every[i], r)
        assert abs(r["confidence"] - sure) <= 0.0011, (every[i], r)


def test_reasons_and_shown_values(spark):
    said = [("a", "clinic_site", "phone", "720.555.0187"), ("b", "cms", "zip", "84101-22"), ("b", "state_board", "zip", "84101"), ("c", "nppes", "is_active", "0"), ("d", "cms", "city", "Golden"), ("d", "state_board", "city", "Pueblo")]
    got = {r["npi"]: r for r in reconcile.score(reconcile.candidates(directory(spark, "abcd"), reports(spark, said), reconcile.RECORD)).collect()}
    assert got["a"]["new_value"] == "(720) 555-0187" and got["b"]["new_value"] == "84101-22"
    assert got["a"]["reason"] == "reported by Practice Website | authoritative source for 'phone' | confidence 83% vs bar 83% -> confidence >= bar -> auto-update"
    assert got["b"]["reason"].startswith("2 independent sources agree (CMS, State Medical Board) | confidence 98% vs bar 84%")
    assert "deactivation is high-stakes" in got["c"]["reason"] and "sources conflict on the new value" in got["d"]["reason"]


def test_what_is_no_change(spark):
    stored = directory(spark, ["same", "spelt", "blank", "bad", "fill"]).withColumn("phone", F.when(F.col("npi") == "fill", "").otherwise(F.col("phone")))
    said = [("same", "cms", "phone", STORED["phone"]), ("spelt", "cms", "phone", "1-303-555-0142"), ("spelt", "cms", "street", "77 QUARRY LN"), ("spelt", "cms", "state", "Colorado"),
            ("blank", "cms", "phone", "  "), ("bad", "cms", "phone", "555"), ("fill", "cms", "phone", "7205550187"), ("gone", "cms", "phone", "7205550187")]
    got = reconcile.candidates(stored, reports(spark, said), reconcile.RECORD).collect()
    assert [(r["npi"], r["value"], r["old_value"]) for r in got] == [("fill", "7205550187", "")]


def _shuffled_bytes(spark, make):
    """What an action writes to shuffles, and its rows."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = total()
    rows = make().collect()
    return total() - before, sorted(rows)


def test_rows_that_agree_leave_early(spark):
    """The same candidates, and the fewer rows differ, the fewer bytes are shuffled."""
    n, cut = 4000, {}
    keys = [f"k{i:05}" for i in range(n)]
    stored = reconcile.with_digests(directory(spark, keys)).persist()
    spell = [STORED["street"], "77 QUARRY LN", " 77 Quarry Ln. "]
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for every in (2, 200):
            said = [(i, k, "cms", STORED["name"], ["3035550142", "", "+1 (303) 555-0142"][i % 3], spell[i % 3], "Golden" if i % every == 0 else "boulder", "Colorado", "80301-77", "x" * 200 if i % every == 1 else None, "1")
                    for i, k in enumerate(keys)]
            ext = reconcile.with_digest(spark.createDataFrame(said, "ordinal long, npi string, source_name string, name string, phone string, street string, city string, state string, zip string, specialty string, is_active string")).persist()
            assert ext.count() == n and stored.count() == n
            whole, want = _shuffled_bytes(spark, lambda ext=ext: reconcile.candidates(stored, ext, reconcile.RECORD))
            early, got = _shuffled_bytes(spark, lambda ext=ext: reconcile.early_candidates(stored, ext, reconcile.RECORD, reconcile.differing(stored, ext, reconcile.RECORD)))
            narrow, found = _shuffled_bytes(spark, lambda ext=ext: reconcile.differing(stored, ext, reconcile.RECORD))
            assert got == want and {r["ordinal"] for r in found} == {r["ordinal"] for r in want} and len(found) == (n if every == 2 else n // 100)
            cut[every] = (narrow, whole)
            ext.unpersist()
        assert cut[200][0] < 0.75 * cut[200][1]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        stored.unpersist()


def test_digests_of_blank_unusable_and_missing_values(spark):
    stored = reconcile.with_digests(directory(spark, "abcdef").withColumn("phone", F.when(F.col("npi") == "e", "").otherwise(F.col("phone"))))
    said = [("a", "cms", "phone", "  "), ("b", "cms", "phone", "555"), ("c", "cms", "name", "INES OKAFOR, MD"), ("d", "cms", "name", "Ines Lund"), ("e", "cms", "phone", "7205550187"), ("f", "cms", "is_active", "0"), ("gone", "cms", "city", "Vail")]
    ext = reconcile.with_digest(reports(spark, said))
    ids = lambda fields: sorted(r["npi"] for r in reconcile.differing(stored, ext, fields).collect())
    assert ids(reconcile.RECORD) == ["d", "e", "f"] and ids(reconcile.COMPARE) == ["e", "f"]
    old = ext.withColumns({c: F.lit(None).cast("long") for c in ("reported", "digest", "name_digest")})
    assert reconcile.differing(stored, old).count() == 6  # nothing is known of any of them
    for fields in (reconcile.RECORD, reconcile.COMPARE):
        assert sorted(reconcile.early_candidates(stored, ext, fields).collect()) == sorted(reconcile.candidates(stored, ext, fields).collect())


def test_recommend_verify_and_apply(spark):
    providers = directory(spark, ["auto", "mixed", "same", "silent"])
    said = [("auto", "clinic_site", "phone", OTHER["phone"]), ("mixed", "clinic_site", "phone", OTHER["phone"]), ("mixed", "cms", "city", "Golden"), ("same", "cms", "city", "Boulder")]
    ext = reports(spark, said)
    rec = {r["npi"]: r for r in reconcile.recommend(providers, ext).collect()}
    assert {k: (r["recommended_action"], r["overall_confidence"]) for k, r in rec.items()} == {
        "auto": ("auto_update", 0.83), "mixed": ("human_review", 0.84), "same": ("no_change", 1.0), "silent": ("human_review", 0.0)}
    asked = spark.createDataFrame([("auto",), ("auto",), ("nobody",), (None,)], "npi string")
    got = {r["npi"]: (r["recommended_action"], r["error"]) for r in reconcile.verify(asked, providers, ext).collect()}
    assert got == {"auto": ("auto_update", None), "nobody": (None, "not in directory")}
    routed = apply.route(reconcile.proposed(reconcile.score(reconcile.candidates(providers, ext, reconcile.RECORD))))
    assert apply.counts(routed).first().asDict() == {"applied": 2, "pending": 1, "skipped": 0}
    out = {r["npi"]: r for r in apply.merge(providers, routed, F.expr(NOW)).collect()}
    assert out["auto"]["phone"] == "(720) 555-0187" and out["auto"]["updated_at"] is not None and out["same"]["updated_at"] is None
    assert [r["id"] for r in apply.review_queue(routed, providers).collect()] == ["mixed-city"]


def test_backstop_and_last_change_wins(spark):
    rows = [(1, "a", "phone", None, "1", 0.9), (2, "a", "phone", None, "2", 0.5), (3, "a", "name", "x", "y", 0.99), (4, "a", "is_active", "1", "0", 0.99),
            (5, "b", "is_active", "0", "0", 0.99), (6, "a", "taxonomy_code", "x", "y", 0.99), (7, "a", "zip", "x", "80302-1", 0.9)]
    changes = spark.createDataFrame(rows, "id long, npi string, field string, old_value string, new_value string, confidence double").withColumns(
        {"decision": F.lit("AUTO_UPDATE"), "status": F.lit("new"), "source": F.lit("CMS"), "reason": F.lit("")})
    routed = apply.route(changes)
    assert {r["id"]: r["status"] for r in routed.collect()} == {1: "applied", 2: "applied", 3: "pending_review", 4: "pending_review", 5: "applied", 6: "new", 7: "applied"}
    got = {r["npi"]: r for r in apply.merge(directory(spark, "ab"), routed, F.expr(NOW)).collect()}
    assert (got["a"]["phone"], got["a"]["zip"], got["a"]["is_active"], got["b"]["is_active"]) == ("2", "80302", 1, 0)
    assert sorted(r["detail"] for r in apply.audit(routed).filter("id = 4" if "id" in apply.audit(routed).columns else "detail like 'is_active%1%'").collect())[0].endswith("[blocked auto: high-stakes]")


def number(nine):
    total = 24 + sum(int(d) if i % 2 else int(d) * 2 // 10 + int(d) * 2 % 10 for i, d in enumerate(nine))
    return nine + str((10 - total % 10) % 10)


def test_intake_gate(spark):
    a, b = number("123450001"), number("223450001")
    rows = [(1, a, "Dr. Noor Vance"), (2, a, "Noor Vance"), (3, a[:9] + str((int(a[9]) + 1) % 10), "Noor Vance"), (4, f" {b} ", "Doc J"), (5, None, None), (6, None, "x y"), (0, b, "Ada Moss")]
    g = intake.gate(spark.createDataFrame(rows, "ordinal long, npi string, name string"))
    assert sorted(r["ordinal"] for r in intake.accepted(g).collect()) == [0, 1]
    assert intake.counters(g).first().asDict() == {"received": 7, "accepted": 2, "quarantined": 4, "duplicates": 1}
    assert [r["ordinal"] for r in intake.accepted(g, spark.createDataFrame([(b,)], "npi string")).collect()] == [1]


def test_empty_load_fails(spark):
    with pytest.raises(ValueError, match="no provider"):
        intake.require_rows(spark.createDataFrame([], "npi string"))
    assert intake.require_rows(spark.createDataFrame([("x",)], "npi string")).count() == 1


def test_empty_pull_scores_65(spark):
    df = spark.createDataFrame([], "npi string, phone string, city string, state string, fetched_at string")
    assert quality.verdict(quality.checks(df)).first()["score"] == 65


def test_sketches_of_pulls_are_merged(spark):
    df = spark.range(60000).selectExpr("cast(id AS string) AS npi", "id % 2 AS half").unionByName(spark.range(30000, 90000).selectExpr("cast(id AS string) AS npi", "2L AS half"))
    df = df.unionByName(spark.createDataFrame([(None, 5)], "npi string, half long"))
    kept = quality.sketches(df, "half")
    got = quality.distinct_identifiers(kept).first()
    assert got["n"] == 120001 and abs(got["identifiers"] - 90000) <= 450  # 0.5 %
    assert {r["half"]: r["identifiers"] for r in quality.distinct_identifiers(kept, "half").collect()}[5] == 0
    assert quality.distinct_identifiers(quality.sketches(df.filter("false"), "half"), "half").count() == 0
    exact = quality.checks(df.select("npi")).filter("check_name = 'duplicates'").first()["points"]
    assert quality.checks(df.select("npi"), approximate=True).filter("check_name = 'duplicates'").first()["points"] == exact


LABELLED = [  # (id, field, stored, reports, expected)
    ("same phone", "phone", "(303) 555-0142", [("cms", "1-303-555-0142"), ("nppes", "303.555.0142")], "no_change"),
    ("same street", "street", "77 Quarry Lane", [("practice_site", "77 quarry ln.")], "no_change"),
    ("blank report", "city", "Boulder", [("cms", "  ")], "no_change"),
    ("owner's phone", "phone", "(303) 555-0142", [("clinic_site", "7205550187")], "auto_update"),
    ("two for a zip", "zip", "80301", [("cms", "84101"), ("state_board", "84101-22")], "auto_update"),
    ("registry and board", "specialty", "Dermatology", [("nppes", "Allergy"), ("state_board", "allergy")], "auto_update"),
    ("city below the bar", "city", "Boulder", [("practice_site", "Golden")], "human_review"),
    ("lone stranger", "phone", "(303) 555-0142", [("county_feed", "7205550187")], "human_review"),
    ("two phones", "phone", "(303) 555-0142", [("practice_site", "7205550187"), ("cms", "7195550111")], "conflict"),
    ("two streets", "street", "77 Quarry Lane", [("state_board", "9 Cedar Sq"), ("clinic_site", "4 Elm Ct")], "conflict"),
    ("switched off", "is_active", "1", [("nppes", "0"), ("cms", "0"), ("state_board", "0")], "blocked_unsafe"),
    ("renamed", "name", "Ines Okafor", [("nppes", "Ines Lund"), ("state_board", "Ines Lund")], "blocked_unsafe"),
]


def _decided(spark, labelled):
    stored = directory(spark, [x[0] for x in labelled])
    said = [(k, s, f, v) for k, f, _, reps, _ in labelled for s, v in reps]
    cands = reconcile.candidates(stored, reports(spark, said), reconcile.RECORD).withColumnRenamed("npi", "id")
    fixtures = spark.createDataFrame([(x[0], x[1], x[4]) for x in labelled], "id string, field string, expected string")
    return evaluate.decisions(fixtures, cands)


def test_labelled_decisions_of_all_kinds(spark):
    decided = _decided(spark, LABELLED)
    assert [r["id"] for r in decided.filter("not correct").collect()] == []
    assert {r["metric"]: r["n"] for r in evaluate.metrics(decided).collect()} == {"correct_no_change": 3, "correct_auto_update": 3, "correct_human_review": 6}
    held = {r["id"]: r for r in decided.collect()}
    assert held["renamed"]["confidence"] >= DEFAULT.bar_of("name") and held["switched off"]["predicted"] == "human_review"


def test_labelled_decisions_that_are_wrong(spark):
    wrong = [(k, f, old, reps, {"no_change": "auto_update", "auto_update": "no_change", "human_review": "auto_update", "conflict": "no_change", "blocked_unsafe": "conflict"}[e]) for k, f, old, reps, e in LABELLED]
    decided = _decided(spark, wrong)
    assert decided.filter("correct").count() == 0
    assert {r["metric"]: r["n"] for r in evaluate.metrics(decided).collect()} == {"missed_change": 3, "false_auto_update": 3, "false_human_review": 4, "correct_human_review": 2}


def test_confusion_on_nothing(spark):
    r = evaluate.confusion(spark.createDataFrame([], "predicted boolean, expected boolean")).first()
    assert (r["tp"], r["precision"], r["f1"]) == (0, 0.0, 0.0)


@pytest.mark.parametrize("block", [10000, 2])
def test_clusters(spark, block, monkeypatch):
    monkeypatch.setattr(detect, "BLOCK", block)
    base = dict(zip(PROVIDER.replace(",", "").split()[::2], ("", "Noor Vance", "x", 1, "(303) 555-0142", "77 Quarry Lane", "", "Boulder", "CO", "80301", None), strict=True))
    given = [{}, {"unit": "5"}, {"unit": "9", "phone": ""}, {"name": "Ada Moss"}, {"name": "Ada Moss", "street": "9 Elm Road"}, {"name": "Ada Moss", "street": "9 Elm Road", "phone": ""}, {"name": "", "street": "", "city": "", "state": "", "zip": ""}]
    rows = [tuple((base | x | {"npi": f"n{i}"}).values()) for i, x in enumerate(given)]
    keys = detect.keyed(spark.createDataFrame(rows, PROVIDER))
    found = {}
    for r in detect.duplicates(keys).collect():
        found.setdefault((r["reason"], r["name"], r["n_records"]), set()).update(r["npis"])
    assert found == {("same name + same phone", "Noor Vance", 2): {"n0", "n1"}, ("same name + same phone", "Ada Moss", 2): {"n3", "n4"},
                     ("same name + same address", "Noor Vance", 3): {"n0", "n1", "n2"}, ("same name + same address", "Ada Moss", 2): {"n4", "n5"}}
    places = detect.shared_locations(keys).collect()
    assert [(r["location_label"], r["n_providers"]) for r in detect.shared_locations(keys, lists=False).collect()] == [("77 Quarry Lane, Boulder CO", 4), ("9 Elm Road, Boulder CO", 2)]
    assert {n for r in places for n in r["npis"]} == {f"n{i}" for i in range(6)} and all(len(r["npis"]) <= 4 for r in places)
    apart = detect.shared_locations(detect.keyed(spark.createDataFrame(rows, PROVIDER), with_unit=True), lists=False).collect()
    assert sorted(r["n_providers"] for r in apart) == [2, 2]


def test_forms_of_odd_spaces(spark):
    """The short way of squish() is taken by plain text only and gives what the long way gives."""
    given = ["", " ", "a b", " a b ", "a  b", "a\tb", "\ta", "a\n", "a\u00a0 b", "\u3000x", "caf\u00e9 x", "a\x1cb", "~ !"]
    want = ["", "", "a b", "a b", "a b", "a b", "a", "a", "a b", "x", "caf\u00e9 x", "a b", "~ !"]
    df = spark.createDataFrame(list(enumerate(given)), "i int, x string").orderBy("i")
    assert [r[0] for r in df.select(normalize.squish(F.col("x"))).collect()] == want


def test_rows_are_dealt_by_identifier_once(spark):
    """Early candidates are found in the join that they leave, so source rows are shuffled by npi alone, and by nothing else."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = spark.createDataFrame([("n1", "Ada Moss", "Surgery", "3035550142", "1 Elm Rd", "Boulder", "CO", "80301", 1)], "npi string, name string, specialty string, phone string, street string, city string, state string, zip string, is_active int")
        said = spark.createDataFrame([("n1", "cms", 1, "Ada Moss", "Surgery", "303 555 0142", "1 Elm Road", "Boulder", "CO", "80302", 1), ("n1", "nppes", 2, "Ada Moss", "Surgery", "303 555 0142", "1 Elm Road", "Boulder", "CO", "80301", 1),
                                      ("n2", "cms", 3, "Ada Moss", "Surgery", "303 555 0142", "1 Elm Road", "Boulder", "CO", "80301", 1)], "npi string, source_name string, ordinal long, name string, specialty string, phone string, street string, city string, state string, zip string, is_active int")
        p, x = reconcile.with_digests(stored), reconcile.with_digest(said)
        early = reconcile.early_candidates(p, x)
        assert [(r["npi"], r["field"], r["value"]) for r in early.collect()] == [("n1", "zip", "80302")]
        assert "ordinal" not in "".join(line for line in early._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line)
        assert sorted((r["ordinal"], r["differs"]) for r in reconcile.compared(p, x).collect()) == [(1, True), (2, False), (3, False)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reports_that_agree_leave_in_the_join(spark):
    """Only reports with a difference are dealt out by field, and what they say is told apart as before."""
    stored = directory(spark, ["a", "b"]).withColumn("phone", F.when(F.col("npi") == "b", "").otherwise(F.col("phone")))
    said = [("a", "cms", "phone", "303.555.0142"), ("a", "cms", "street", "77 QUARRY LN"), ("a", "cms", "phone", "555"), ("a", "cms", "city", " \u3000"),
            ("b", "cms", "phone", "555"), ("b", "cms", "phone", "7205550187"), ("a", "cms", "name", "'- Ines Okafor"), ("a", "cms", "zip", "80302"), ("gone", "cms", "city", "Vail")]
    found = reconcile.candidates(stored, reports(spark, said), reconcile.RECORD)
    assert sorted((r["npi"], r["field"], r["value"], r["old_value"]) for r in found.collect()) == [("a", "zip", "80302", "80301"), ("b", "phone", "7205550187", "")]
    joins = found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner,")[1:]
    assert len(joins) == 1 and all(f"_cmp_{f}#" in joins[0].split(":- ")[0] for f in reconcile.RECORD)
