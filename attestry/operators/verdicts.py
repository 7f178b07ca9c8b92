"""Verdicts: severity, guards, routing, significance, risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import lexical, text
from attestry.functions.text import plain_words
from attestry.operators import fidelity

# Fixed values of the contract.
CITING = ["covered", "partial", "contradicts", "not_assessable", "not_applicable"]
DECISIVE = ["covered", "contradicts", "not_applicable"]
KNOWN = [*CITING, "absent", "needs_review"]
WEAK_SCORE, ABSENT_CONFIDENCE, FIGURE_CONFIDENCE, FIGURE_WORDS, FIGURE_COUNT = 0.018, 0.55, 0.80, 2, 2
MAX_RATIONALE = 600
PROJECT_ORDER = ["contradicts", "covered", "partial", "needs_review", "absent"]


def severity(verdict: Column, obligation: Column) -> Column:
    """critical, moderate, check, or null where there is nothing to act on."""
    advisory = obligation.isin("should", "may")
    return (
        F.when(verdict.isin("covered", "not_applicable"), None)
        .when(verdict == "not_assessable", F.when(obligation == "must", "moderate").otherwise("check"))
        .when(verdict == "contradicts", F.when(advisory, "moderate").otherwise("critical"))
        .when(verdict == "absent", F.when(obligation == "must", "critical").when(advisory, "moderate").otherwise("check"))
        .when(verdict == "partial", F.when(obligation == "may", "check").otherwise("moderate")).otherwise("check")
    )


def brief_severity(verdict: Column, obligation: Column) -> Column:
    """(tier, settled) on four tiers, derived from severity()."""
    s = severity(verdict, obligation)
    make = lambda tier, settled: F.struct(F.lit(tier).alias("tier"), F.lit(settled).alias("settled"))
    return F.when(s == "critical", make("critical", True)).when(s == "check", make("low", False)).when(s == "moderate", F.when(verdict.isin("partial", "contradicts"), make("high", True)).otherwise(make("medium", True)))


def project_verdict(findings: DataFrame) -> DataFrame:
    """One verdict a clause from those of all designs: a breach anywhere, else covered anywhere, and so on."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PROJECT_ORDER)), F.col("verdict")), F.lit(0)), F.lit(len(PROJECT_ORDER)))
    worst = findings.groupBy("clause_id").agg(F.min(rank).cast("int").alias("r"))
    return worst.select("clause_id", F.element_at(F.array(*map(F.lit, PROJECT_ORDER)), F.col("r")).alias("verdict"))


def attention(rows: DataFrame) -> DataFrame:
    """What a report opens on."""
    return rows.filter(~F.col("verdict").isin("covered", "not_applicable"))


def cited_breaches(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("verdict") == "contradicts") & (F.size("evidence") > 0))


def figure_corroborates(clause: Column, figures: Column, count: Column) -> Column:
    return (count >= FIGURE_COUNT) | (F.size(F.array_intersect(lexical.keywords(clause), lexical.keywords(figures))) >= FIGURE_WORDS)


def guard(rows: DataFrame) -> DataFrame:
    """verdict_after and why: the first of the checks, in this order, that the evidence doesn't pass.

    Columns: verdict, confidence, evidence (array of excerpts), best_score, rationale, cited_total,
    cited_generated, fabricated (array), conflicted, clause_text, figure_text.
    """
    c = F.col
    said = F.array_join("evidence", " ")
    stands = (c("verdict") == "covered") & (c("confidence") >= FIGURE_CONFIDENCE) & figure_corroborates(c("clause_text"), c("figure_text"), c("cited_generated"))
    missing = fidelity.families_missing(c("clause_text"), said, c("rationale"))
    arms = [
        (c("verdict").isin(CITING) & (F.size("evidence") == 0), "needs_review", "cites nothing"),
        (c("verdict").isin(DECISIVE) & (c("cited_total") > 0) & (c("cited_generated") == c("cited_total")) & ~stands, "needs_review", "figures only"),
        (F.size("fabricated") > 0, "needs_review", "decision not on record"),
        (c("conflicted") & c("verdict").isin(DECISIVE), "needs_review", "decisions disagree"),
        ((c("verdict") == "contradicts") & fidelity.overreach(c("rationale"), c("clause_text")), "needs_review", "overreach"),
        ((c("verdict") == "contradicts") & fidelity.hedged_breach(c("rationale")), "not_assessable", "hedged breach"),
        ((c("verdict") == "covered") & fidelity.approval_missing(c("clause_text"), said, c("rationale")), "not_assessable", "approval missing"),
        ((c("verdict") == "covered") & (F.size(missing) > 0), "partial", "families missing"),
        (c("verdict").isin(CITING) & fidelity.subject_mismatch(c("clause_text"), said), "needs_review", "subject mismatch"),
        ((c("verdict") == "absent") & (c("best_score") < WEAK_SCORE), "needs_review", "weak retrieval"),
        ((c("verdict") == "absent") & (c("confidence") < ABSENT_CONFIDENCE), "needs_review", "low confidence"),
    ]
    pick = lambda k: reduce(lambda rest, arm: F.when(F.coalesce(arm[0], F.lit(False)), arm[k]).otherwise(rest), reversed(arms), c("verdict") if k == 1 else F.lit(None).cast("string"))
    return rows.withColumn("verdict_after", pick(1)).withColumn("why", pick(2))


def normalise_answer(rows: DataFrame) -> DataFrame:
    """verdict, confidence and rationale of raw answers (verdict, confidence, rationale, clause_text) put right.

    Unknown verdicts are for review; confidence lies within 0 and 1; a partial answer told in words of breach
    contradicts; one whose remedy argues compliance is covered; families that the clause doesn't name are
    marked in the rationale; a technical clause answered by missing paperwork is for review.
    """
    said, clause = F.coalesce("rationale", F.lit("")), F.coalesce("clause_text", F.lit(""))
    low = F.lower(F.trim("verdict"))
    rows = rows.withColumn("verdict", F.when(low.isin(KNOWN), low).otherwise("needs_review")).withColumn("rationale", text.first_sentences(said, MAX_RATIONALE))
    rows = rows.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))))
    v, r = F.col("verdict"), F.col("rationale")
    rows = rows.withColumn("verdict", F.when((v == "partial") & r.rlike(fidelity.BREACH), "contradicts").otherwise(v))
    rows = rows.withColumn("verdict", F.when(fidelity.remedy_claims_compliance(v, r), "covered").otherwise(v))
    stray = fidelity.invented_families(r, clause)
    note = F.concat(r, F.lit(" (This clause does not state a requirement for "), F.array_join(stray, ", "), F.lit("; that part of the assessment is not traceable to it.)"))
    rows = rows.withColumn("rationale", F.when(F.size(stray) > 0, F.substring(note, 1, MAX_RATIONALE)).otherwise(r))
    return rows.withColumn("verdict", F.when(fidelity.paperwork_for_architecture(v, r, clause), "needs_review").otherwise(v))


def breach_mark(quote: Column, extract: Column) -> Column:
    """The quote if the cited extract holds it (spaces and case aside), at most 240 characters."""
    flat = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    return F.when(F.contains(flat(extract), flat(quote)) & (F.length(F.trim(quote)) > 0), F.substring(F.trim(quote), 1, 240))


def absent_after_failure(verdict: Column, confidence: Column) -> Column:
    """When the second reading failed: absents that weren't sure are for review."""
    return F.when((verdict == "absent") & (confidence < 0.85), "needs_review").otherwise(verdict)


def next_step(critical: Column, high: Column, significance: Column, unsettled: Column) -> Column:
    """board, architect or auto_approve; no significance given is a reason to look."""
    significant = F.coalesce(significance == "significant", F.lit(False))
    return (
        F.when(significant & (critical > 0), "board").when(critical + high > 0, "architect").when(significant, "architect")
        .when(unsettled > 0, "architect").when(significance.isNull(), "architect").otherwise("auto_approve")
    )


def significance(answers: DataFrame, rules: DataFrame) -> DataFrame:
    """(request_id, category, triggered, text) for every active category; see classify().

    answers: request_id, as_of, field, value (text), items (list or null): one row a field. rules:
    category, active, field, operator, value, items, text: one row a condition, a configuration of a
    page or two. A field without an answer never meets a condition; nor does an operator not known here.
    A request's answers are gathered once; its rules are looked at in its row.
    """
    number = lambda x: F.try_to_number(x, F.lit("999999999999.999999"))
    conditions = rules.filter("active").groupBy("category").agg(F.collect_list(F.struct("field", "operator", "value", "items", "text")).alias("conditions"))
    asked = answers.groupBy("request_id").agg(F.max("as_of").alias("as_of"), F.collect_list(F.struct("field", "value", "items")).alias("answers"))

    def met(rule, answer):
        value, want, op = answer["value"], rule["value"], rule["operator"]
        holds = (
            F.when(op == "is_true", value == "true").when(op == "at_least", number(value) >= number(want))
            .when(op == "count_at_least", F.size(F.filter(answer["items"], lambda x: F.trim(x) != "")) >= want.cast("int"))
            .when(op == "one_of", F.array_contains(rule["items"], F.coalesce(value, F.lit(""))))
            .when(op == "further_out_than_months", value.cast("date") > F.add_months(F.col("as_of").cast("date"), want.cast("int")))
        )
        return (answer["field"] == rule["field"]) & F.coalesce(holds, F.lit(False))

    both = asked.crossJoin(F.broadcast(conditions))
    triggered = F.exists("conditions", lambda r: F.exists("answers", lambda a: met(r, a)))
    return both.select("request_id", "category", triggered.alias("triggered"), F.array_join(F.array_sort(F.transform("conditions", lambda r: r["text"])), " ").alias("text"))


def classify(results: DataFrame) -> DataFrame:
    """significant if any category is triggered."""
    return results.groupBy("request_id").agg(F.when(F.bool_or("triggered"), "significant").otherwise("not_significant").alias("significance"))


def risk(suggestions: DataFrame, findings: DataFrame, dimensions: list[str]) -> DataFrame:
    """Worst severity of each dimension through suggestion -> clause links; a dimension nothing speaks to is not assessed."""
    order = F.array(*map(F.lit, ["critical", "moderate", "check"]))
    links = suggestions.select("dimension", F.explode("clauses").alias("clause_id"))
    rank = links.join(findings, "clause_id").withColumn("r", F.array_position(order, severity(F.col("verdict"), F.col("obligation")))).filter("r > 0")
    worst = rank.groupBy("dimension").agg(F.min("r").cast("int").alias("r"))
    names = suggestions.sparkSession.createDataFrame([(d,) for d in dimensions], "dimension string")
    return F.broadcast(names).join(worst, "dimension", "left").select("dimension", F.when(F.col("r").isNull(), "not assessed").otherwise(F.get(order, F.col("r") - 1)).alias("risk"))


def may_reject(role: Column, own: Column, state: Column, note: Column, breaches: Column) -> Column:
    """Why an outcome can't be recorded, or null."""
    return (
        F.when(~role.isin("architect", "admin"), "role").when(own, "own submission").when(state != "complete", "run not complete")
        .when(F.length(F.trim(F.coalesce(note, F.lit("")))) == 0, "note needed").when(breaches < 1, "no cited breach")
    )


def promote(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings without an active decision, with the effect that one would have."""
    effect = F.when(F.col("verdict") == "covered", "accepts").when(F.col("verdict") == "contradicts", "rejects").otherwise("context")
    return findings.join(decisions.filter("status = 'active'").select("finding_id"), "finding_id", "left_anti").withColumn("effect", effect)


def sharpening(lines: DataFrame) -> DataFrame:
    """Proposed lines with the reason each is refused, or null.

    lines: line, basis (ids of what it was read from), existing (lines of the standard), design_name. A line
    is refused if it is too long or short, rests on nothing, states no duty, is vague, stands in the standard,
    or names the design.
    """
    c = F.col("line")
    # The first part of a heading path is the document's title; capitalised runs of two words and more in it are its name.
    names = F.regexp_extract_all(F.split(F.coalesce("design_name", F.lit("")), " › ")[0], F.lit(r"\b([A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+)+)\b"), 1)
    reason = (
        F.when(F.length(c) > 240, "too long").when(F.size(F.split(F.trim(c), r"\s+")) < 6, "too short").when(F.size(F.coalesce("basis", F.array().cast("array<string>"))) == 0, "rests on nothing")
        .when(~c.rlike(text.BINDING), "states no duty").when(c.rlike(text.VAGUE), "vague").when(F.exists("existing", lambda e: plain_words(e) == plain_words(c)), "exists already")
        .when(F.exists(names, lambda n: F.contains(F.lower(c), F.lower(n))), "names the design")
    )
    return lines.withColumn("reason", reason)
