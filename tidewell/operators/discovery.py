"""Reviewed observations held against the documents that they speak of, and candidates ranked by what stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Dispositions, the grounded fields of an observed one, statuses, the form of an author's hash.
DISPOSITIONS = ("observed", "wish", "promotion", "ambiguous", "satisfied", "off_topic")
FIELDS = ("context", "requirement", "behavior", "burden", "trade_off")
TECHNICAL = ("unassessed", "available", "contradictory")
FEASIBILITY = ("unassessed", "existing_process_hypothesis", "incompatible")
AUTHOR_HASH = r"^(?:[a-f0-9]{16}|[a-f0-9]{24}|[a-f0-9]{64})$"


def _blank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit("")) == ""


def _told(rows: DataFrame, subject: str, key: Column, rules: list[tuple[Column, str]]) -> DataFrame:
    """(subject, key, violation) for every rule that a row breaks, not the first alone."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(what)) for when, what in rules]))
    return rows.select(F.lit(subject).alias("subject"), key.cast("string").alias("key"), F.explode(found).alias("violation"))


def grounded(span: Column, text: Column) -> Column:
    """Whether a span is given and stands in the text, to the letter."""
    return F.coalesce((span != "") & text.contains(span), F.lit(False))


def violations(documents: DataFrame, observations: DataFrame, candidates: DataFrame) -> DataFrame:
    """(subject, key, violation): all that is wrong with a review, each once for each row that has it.

    ``documents`` are (doc_id, text, author_hash), ``observations`` (doc_id, disposition, reason, candidate, recurring,
    recurrence_span, span, and a struct (summary, span) for each of FIELDS), ``candidates`` (candidate, need, limitations,
    technical, technical_reason, references, feasibility, feasibility_reason). A null counts as missing.
    """
    docs = documents.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("text").alias("text"), F.max(F.when(~_blank("author_hash") & ~F.col("author_hash").rlike(AUTHOR_HASH), 1)).alias("odd"))
    asked = observations.groupBy("doc_id").agg(F.count("*").alias("times"))
    both = docs.alias("d").join(asked.alias("a"), F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")), "full_outer").select(F.col("d.doc_id").alias("doc"), F.col("a.doc_id").alias("asked"), "n", "odd", "times")
    of_document = _told(both, "document", F.coalesce("doc", "asked"), [
        (F.col("n") > 1, "duplicate document"), (F.col("odd") == 1, "author is no stored hash"), (F.col("n").isNotNull() & F.col("times").isNull(), "not reviewed"),
        (F.col("times") > 1, "reviewed twice"), (F.col("n").isNull(), "review of an unknown document"),
    ])
    known = candidates.select(F.col("candidate").alias("declared")).distinct()
    o = observations.join(docs.select("doc_id", "text"), "doc_id").join(F.broadcast(known), F.col("candidate") == F.col("declared"), "left")
    seen, text = F.col("disposition").eqNullSafe(F.lit("observed")), F.col("text")
    of_field = [(seen & (_blank(F.col(f)["summary"]) | ~grounded(F.col(f)["span"], text)), f"ungrounded {f}") for f in FIELDS]
    of_observation = _told(o, "observation", F.col("doc_id"), [
        (~F.coalesce(F.col("disposition").isin(*DISPOSITIONS), F.lit(False)), "unknown disposition"), (_blank("reason"), "no reason"), (F.col("candidate").isNotNull() & F.col("declared").isNull(), "undeclared candidate"), *of_field,
        (seen & F.col("candidate").isNull(), "no candidate"), (seen & F.col("recurring").isNull(), "recurrence not said"),
        (seen & F.col("recurring") & ~grounded(F.col("recurrence_span"), text), "recurrence without its span"), (~seen & ~grounded(F.col("span"), text), "no supporting span"),
    ])
    of_candidate = _told(candidates, "candidate", F.col("candidate"), [
        (_blank("need"), "no need"), (_blank("limitations"), "no limitations"), (~F.coalesce(F.col("technical").isin(*TECHNICAL), F.lit(False)), "unknown technical status"),
        ((F.col("technical") == "available") & _blank("references"), "available without references"), (~F.coalesce(F.col("feasibility").isin(*FEASIBILITY), F.lit(False)), "unknown feasibility status"),
        (_blank("technical_reason"), "no technical reason"), (_blank("feasibility_reason"), "no feasibility reason"),
    ])
    return of_document.unionByName(of_observation).unionByName(of_candidate)


def sorted_out(documents: DataFrame, observations: DataFrame) -> DataFrame:
    """(doc_id, candidate, rejected, disposition, recurring, source, author_hash, published_at): why an observation supports nothing, null where it does.

    A text (after its normalisation) that an earlier document has gives no support of its own, whatever the other one was
    used for; an observed one without an author's hash gives none either.
    """
    same = F.row_number().over(Window.partitionBy(F.sha2(F.col("text"), 256)).orderBy("doc_id")) > 1
    d = documents.select("doc_id", "source", "author_hash", "published_at", same.alias("__copy"))
    why = (
        F.when(F.col("__copy"), "duplicate").when(~F.col("disposition").eqNullSafe(F.lit("observed")), F.concat_ws(": ", "disposition", "reason")).when(_blank("author_hash"), "no author")
    )
    return observations.join(d, "doc_id").select("doc_id", "candidate", why.alias("rejected"), "disposition", "recurring", "source", "author_hash", "published_at")


def ranked_candidates(sorted_observations: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidate, users, dates, recurring, score (five parts), reasons (why it does not qualify) and place (of those that do).

    Users are distinct (source, author_hash): identities of two sites are not reconciled. Score: any recurring, users up
    to 3, more dates than one, available technical evidence, an existing process; greater ones first, then by name.
    """
    s = sorted_observations.where(F.col("rejected").isNull())
    g = s.groupBy("candidate").agg(
        F.count_distinct("source", "author_hash").alias("users"), F.count_distinct(F.to_date("published_at")).alias("dates"), F.coalesce(F.bool_or("recurring"), F.lit(False)).alias("recurring"),
    )
    c = candidates.select("candidate", "technical", "feasibility").join(g, "candidate", "left").withColumns({"users": F.coalesce("users", F.lit(0)), "dates": F.coalesce("dates", F.lit(0)), "recurring": F.coalesce("recurring", F.lit(False))})
    conflict = (F.col("technical") == "contradictory") | (F.col("feasibility") == "incompatible")
    reasons = F.array_compact(F.array(
        F.when(F.col("users") < 2, "too few users"), F.when(~F.col("recurring") & (F.col("dates") < 2), "repeatability unestablished"), F.when(conflict, "technical or feasibility conflict"),
    ))
    score = F.array(F.col("recurring").cast("int"), F.least(F.col("users"), F.lit(3)).cast("int"), (F.col("dates") > 1).cast("int"), (F.col("technical") == "available").cast("int"), (F.col("feasibility") == "existing_process_hypothesis").cast("int"))
    told = c.select("candidate", "users", "dates", "recurring", score.alias("score"), reasons.alias("reasons"))
    best = told.where(F.size("reasons") == 0).select("candidate", F.row_number().over(Window.orderBy(F.desc("score"), "candidate")).alias("place"))
    return told.join(best, "candidate", "left")
