"""Reconciliation: which values do the sources propose, how sure is each, and may it be applied without a human?

The join, the groups and the windows all hash by npi, so Spark shuffles each side once. Compare forms are made only of
values that are not word for word what the directory holds: in the join, which reports that agree don't leave, and once more
for the reports that differ; display forms only for what differs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.policy import DEFAULT, Policy

COMPARE = ["phone", "street", "city", "state", "zip", "specialty", "is_active"]
RECORD = ["name", "specialty", "phone", "street", "city", "state", "zip", "is_active"]  # fixed order of a record's changes

# What is said of a record.
UNREACHED = "No external source could be reached to verify this record."
SAME = "All checked fields match the trusted sources."
CONFIRMED = "Confirmed by trusted sources at or above the auto-update bar for every field."
DISAGREED = "Sources disagree on at least one field. Manual verification recommended."
BELOW = "At least one change did not clear the auto-update bar. Sent to human review."

# The rules of a decision in order, as (decision, what is noted, what is concluded).
RULES = {
    "conflict": ("human_review", "sources conflict on the new value", "conflict -> human review"),
    "deactivation": ("human_review", "deactivation is high-stakes", "provider deactivation always reviewed"),
    "name": ("human_review", "name changes can be identity/merge issues", "name change always reviewed"),
    "alone": ("human_review", "single uncorroborated source, not the field owner", "needs a 2nd independent source or the field owner -> human review"),
    "sure": ("auto_update", None, "confidence >= bar -> auto-update"),
    "unsure": ("human_review", None, "confidence < bar -> human review"),
}


def _plain(field: str, c: Column) -> Column:
    """What two values of a field agree by."""
    return _bare(field, N.compare_form(field, c.cast("string")))


def _bare(field: str, form: Column) -> Column:
    """A compare form in lower case and without white space at the ends, as all are but a name's, whose leading marks may have gone."""
    return F.lower(N.strip(form)) if field == "name" else form


def with_digests(providers: DataFrame) -> DataFrame:
    """Directory rows with digests: 64 bits of each field of RECORD as it is compared. To be kept with the directory."""
    return N.derive(providers, {"digests": F.array(*[F.xxhash64(F.lit(f), _plain(f, F.col(f))) for f in RECORD])})


def with_digest(external: DataFrame) -> DataFrame:
    """Source rows with reported (a bit a field of RECORD that says something), digest (of what they say but for the name,
    exclusive or) and name_digest. To be kept with the sources' rows, so that a run needn't read their values again."""
    said = {f: F.when(F.coalesce(N.strip(F.col(f)), F.lit("")) != "", _plain(f, F.col(f))) if f in external.columns else F.lit(None).cast("string") for f in RECORD}
    marks = F.array(*[F.when(F.col(f"_said.{f}") != "", F.xxhash64(F.lit(f), F.col(f"_said.{f}"))) for f in RECORD])
    out = N.derive(external, {"_said": F.struct(*[c.alias(f) for f, c in said.items()])}).withColumn("_marks", marks)
    bits = sum((F.when(F.get("_marks", F.lit(i)).isNotNull(), 1 << i).otherwise(0) for i in range(len(RECORD))), F.lit(0))
    both = reduce(lambda a, i: a.bitwiseXOR(F.coalesce(F.get("_marks", F.lit(i)), F.lit(0))), range(1, len(RECORD)), F.lit(0).cast("long"))
    return out.withColumns({"reported": bits, "digest": both, "name_digest": F.get("_marks", F.lit(0))}).drop("_said", "_marks")


def _differs(fields: list[str]) -> Column:
    """Whether a source row, with the directory's digests beside it, says anything else; null digests: no such identifier."""
    theirs = F.lit(0).cast("long")
    for i, f in enumerate(RECORD):
        if f != "name":
            theirs = theirs.bitwiseXOR(F.when(F.col("reported").bitwiseAND(F.lit(1 << i)) != 0, F.get("digests", F.lit(i))).otherwise(0))
    other = F.coalesce(F.col("digest") != theirs, F.lit(True))  # rows without digests are looked at whole
    if "name" in fields:
        other = other | F.coalesce(F.col("name_digest") != F.get("digests", F.lit(0)), F.lit(False))
    return F.col("digests").isNotNull() & other


def compared(providers: DataFrame, external: DataFrame, fields: list[str] = COMPARE) -> DataFrame:
    """npi, source_name, ordinal of all source rows, with differs: says anything else than the directory. As differing()."""
    told = external.select("npi", "source_name", "ordinal", "reported", "digest", "name_digest")
    return told.join(providers.select("npi", "digests"), "npi", "left").select("npi", "source_name", "ordinal", _differs(fields).alias("differs"))


def differing(providers: DataFrame, external: DataFrame, fields: list[str] = COMPARE) -> DataFrame:
    """npi, source_name, ordinal of the source rows that say anything else than the directory; rows of identifiers that the
    directory doesn't hold aren't among them.

    providers: with digests; external: with reported, digest and name_digest. Only these narrow columns are read and
    shuffled. A row agrees if its digest is that of the directory's digests of the fields it reports; a row that doesn't
    agree is taken for one that does with a probability of 2^-64.
    """
    told = external.select("npi", "source_name", "ordinal", "reported", "digest", "name_digest")
    return told.join(providers.select("npi", "digests"), "npi").filter(_differs(fields)).select("npi", "source_name", "ordinal")


def early_candidates(providers: DataFrame, external: DataFrame, fields: list[str] = COMPARE, found: DataFrame | None = None) -> DataFrame:
    """candidates(), of rows that differ alone. Pays where most rows agree.

    providers and external as in differing(); found: its rows, if they are at hand, so that those that agree leave before
    any value is shuffled. Without it rows are shuffled once, by npi, and those that agree leave before their forms are made.
    """
    if found is None:
        some = external.join(providers.select("npi", "digests"), "npi").filter(_differs(fields)).drop("digests")
    else:
        some = external.join(found, ["npi", "source_name", "ordinal"], "left_semi")
    return candidates(providers, some, fields)


def candidates(providers: DataFrame, external: DataFrame, fields: list[str] = COMPARE) -> DataFrame:
    """npi, field, source_name, ordinal, value (compare form), display, old_value: what differs from the directory.

    Blank reports, reports equal to the stored value, and unusable ones where a value is stored are left out.
    """
    text = lambda f: F.col(f).cast("string")
    forms = {f: N.compare_form(f, text(f)) for f in fields}  # by name, so the same for both sides
    stored = providers.select("npi", *[c for f in fields for c in (text(f).alias(f"_raw_{f}"), _bare(f, forms[f]).alias(f"_cmp_{f}"))])
    both = external.select("npi", "source_name", "ordinal", *fields).join(stored, "npi")
    other = {f: ~text(f).eqNullSafe(F.col(f"_raw_{f}")) for f in fields}
    # Reports that agree in all fields (blank ones have empty forms) leave in the join, before they are dealt out by field.
    some = both.filter(reduce(Column.__or__, [other[f] & ~_bare(f, forms[f]).isin(F.col(f"_cmp_{f}"), "") for f in fields]))

    def said(f):
        return F.struct(F.lit(f).alias("field"), text(f).alias("raw"), F.when(other[f], forms[f]).alias("value"), F.col(f"_raw_{f}").alias("old_value"), F.col(f"_cmp_{f}").alias("cmp"))

    rows = some.select("npi", "source_name", "ordinal", F.inline(F.array(*map(said, fields)))).filter("value is not null")
    rows = rows.filter(~F.when(F.col("field") == "name", _bare("name", F.col("value"))).otherwise(F.col("value")).isin(F.col("cmp"), ""))
    return rows.select("npi", "field", "source_name", "ordinal", "value", N.display_of(F.col("field"), fields, F.col("raw")).alias("display"), "old_value")


def support(cands: DataFrame, policy: Policy = DEFAULT, keys: tuple[str, ...] = ("npi", "field")) -> DataFrame:
    """One row a proposed value: its independent sources and the confidence they give it, before conflicts."""
    src = F.col("source_name")
    rated = cands.withColumns({"rel": policy.reliability(src), "grp": policy.group(src), "auth": policy.is_authority(F.col("field"), src)})
    shown = F.when(F.coalesce("display", F.lit("")) != "", F.struct("ordinal", "display"))
    one = rated.groupBy(*keys, "value", "grp").agg(
        F.max("rel").alias("rel"), F.min_by("source_name", F.struct(-F.col("rel"), "ordinal")).alias("source_name"), F.min("ordinal").alias("ordinal"),
        F.max("auth").alias("auth"), F.min(shown).alias("shown"), F.first("old_value").alias("old_value"))
    value = one.groupBy(*keys, "value").agg(
        F.count(F.lit(1)).alias("n_sources"), F.round(F.sum("rel"), 6).alias("weight"), (1 - F.product(1 - F.col("rel"))).alias("base"),
        F.max("auth").alias("authority"), F.min("ordinal").alias("ordinal"), F.min("shown")["display"].alias("display"),
        F.sort_array(F.collect_set(policy.pretty(F.col("source_name")))).alias("sources"), F.first("old_value").alias("old_value"))
    return value.withColumn("confidence", F.when(F.col("authority"), F.col("base") + policy.authority_bonus * (1 - F.col("base"))).otherwise(F.col("base")))


def _percent(c: Column) -> Column:
    """Rounded half to even, as text."""
    return F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def decide(valued: DataFrame, policy: Policy = DEFAULT, keys: tuple[str, ...] = ("npi", "field")) -> DataFrame:
    """The best value of each field with conflict, bar, decision and reason. Decides on the unrounded confidence."""
    per = Window.partitionBy(*keys)
    best = per.orderBy(F.desc("n_sources"), F.desc("weight"), "ordinal")
    rows = valued.withColumns({"conflict": F.count(F.lit(1)).over(per) > 1, "_r": F.row_number().over(best)}).filter("_r = 1")
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.col("conflict"), F.col("confidence") * policy.conflict_factor).otherwise(F.col("confidence"))))
    rows = rows.withColumns({"confidence": conf, "bar": policy.bar(F.col("field")), "new_value": F.coalesce("display", "value")})
    risky = (F.col("field") == "is_active") & (F.col("old_value") == "1") & (F.col("new_value") == "0")
    lone = (F.col("n_sources") < 2) & ~F.col("authority")
    holds = {"conflict": F.col("conflict"), "deactivation": F.coalesce(risky, F.lit(False)), "name": F.col("field") == "name", "alone": lone,
             "sure": F.col("confidence") >= F.col("bar"), "unsure": F.lit(True)}
    rules = [(holds[k], *said) for k, said in RULES.items()]  # the first that holds
    first = lambda i: F.coalesce(*[F.when(r[0], F.struct(F.lit(r[i]).cast("string").alias("x"))) for r in rules])["x"]
    said = F.when(F.size("sources") > 1, F.concat(F.size("sources").cast("string"), F.lit(" independent sources agree ("), F.array_join("sources", ", "), F.lit(")"))).otherwise(
        F.concat(F.lit("reported by "), F.get("sources", F.lit(0))))
    owner = F.when(F.col("authority"), F.concat(F.lit("authoritative source for '"), F.col("field"), F.lit("'")))
    final = F.concat(F.lit("confidence "), _percent(F.col("confidence")), F.lit(" vs bar "), _percent(F.col("bar")), F.lit(" -> "), first(3))
    rows = rows.withColumns({"decision": first(1), "reason": F.concat_ws(" | ", said, owner, first(2), final)})
    return rows.select(*keys, "old_value", "new_value", F.round("confidence", 3).alias("confidence"), "sources", "decision", "conflict", "reason", "bar")


def score(cands: DataFrame, policy: Policy = DEFAULT, keys: tuple[str, ...] = ("npi", "field")) -> DataFrame:
    return decide(support(cands, policy, keys), policy, keys)


def proposed(scored: DataFrame) -> DataFrame:
    """Scored fields as rows of the change table. A run proposes at most one change a field, so record and field name it."""
    return scored.select(F.concat_ws("-", "npi", "field").alias("id"), "npi", "field", "old_value", "new_value", F.array_join("sources", ", ").alias("source"), "confidence",
                         F.when(F.col("decision") == "auto_update", "AUTO_UPDATE").otherwise("NEEDS_REVIEW").alias("decision"), "reason", F.lit("new").alias("status"))


def recommend(providers: DataFrame, external: DataFrame, policy: Policy = DEFAULT, failed: list[str] | None = None) -> DataFrame:
    """One row a directory record: all its changes, an overall confidence and what to do; records no source knows go to
    review with confidence 0. failed: sources that couldn't be read, as adapters.Pull names them; every record was to be
    checked with them, so they are listed with the sources it was checked with."""
    scored = score(candidates(providers, external, RECORD), policy)
    rank = F.array_position(F.array(*[F.lit(f) for f in RECORD]), F.col("field"))
    change = F.struct(rank.alias("rank"), "field", "old_value", "new_value", F.col("confidence").alias("confidence_score"), F.col("sources").alias("supporting_sources"))
    changes = scored.groupBy("npi").agg(F.array_sort(F.collect_list(change)).alias("changes"), F.round(F.avg("confidence"), 3).alias("overall"),
                                        F.bool_and(F.col("decision") == "auto_update").alias("all_auto"), F.bool_or("conflict").alias("any_conflict"))
    seen = external.groupBy("npi").agg(F.sort_array(F.collect_set("source_name")).alias("sources_consulted"))
    rows = providers.select("npi").join(seen, "npi", "left").join(changes, "npi", "left")
    none, same = F.col("sources_consulted").isNull(), F.col("changes").isNull()
    consulted = F.col("sources_consulted")
    if failed:
        consulted = F.array_sort(F.array_distinct(F.concat(F.coalesce(consulted, F.array().cast("array<string>")), F.array(*map(F.lit, failed)))))
    return rows.select(
        F.col("npi").alias("provider_id"), "npi", (~none & ~same).alias("change_detected"),
        F.when(none, 0.0).when(same, 1.0).otherwise(F.col("overall")).alias("overall_confidence"),
        F.when(none, "human_review").when(same, "no_change").when(F.col("all_auto"), "auto_update").otherwise("human_review").alias("recommended_action"),
        F.when(none, UNREACHED).when(same, SAME)
        .when(F.col("all_auto"), CONFIRMED)
        .when(F.col("any_conflict"), DISAGREED)
        .otherwise(BELOW).alias("reason"),
        "changes", consulted.alias("sources_consulted"))


def verify(requested: DataFrame, providers: DataFrame, external: DataFrame, policy: Policy = DEFAULT, failed: list[str] | None = None) -> DataFrame:
    """On-demand check of some records (requested: npi): recommend() for those the directory holds, and a row with
    `error` for the others. Each requested identifier counts once."""
    wanted = requested.select("npi").filter("npi is not null").distinct()
    some = recommend(providers.join(wanted, "npi", "left_semi"), external.join(wanted, "npi", "left_semi"), policy, failed)
    return some.withColumn("error", F.lit(None).cast("string")).unionByName(missing(wanted, providers), allowMissingColumns=True)


def missing(requested: DataFrame, providers: DataFrame) -> DataFrame:
    """Requested identifiers that the directory doesn't hold."""
    return requested.select("npi").join(providers.select("npi"), "npi", "left_anti").withColumn("error", F.lit("not in directory"))
