"""Knowledge facts: entities and subject-predicate-object facts, their merging, conflicts, review and reports.

facts(fact_id, project_id, subject_id, predicate, object_text, confidence, status, created_at, deleted_at),
entities(entity_id, project_id, name, entity_type, description, created_at), evidence(fact_id, chunk_id, verbatim).
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.functions import keyed, snippet
from foliate.sources import cut

#: Words that do not count in a value, and what counts as no value.
UNITS = ["mg", "mcg", "g", "tab", "tabs", "caps", "capsule", "capsules", "daily", "qd", "bid", "tid", "qid", "once"]
MISSING = ["", "n/a", "unknown", "none", "nil", "null", "undefined"]
LOW_CONFIDENCE = 0.75
ACTIVE = ["pending", "verified", "unverified", "conflicted"]
_EDGE = (r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])")


def live(df: DataFrame) -> DataFrame:
    return df.filter("deleted_at is null")


# ---- what a model returned

OUTPUT = "entities array<struct<name:string,type:string>>, facts array<struct<subject:string,predicate:string,object:string,confidence:double>>"


def parsed(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """outputs(chunk_id, raw) as valid fact rows and as rejected rows with a reason."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("raw", r"^\s*```(?:json)?", ""), r"```\s*$", ""))
    rows = outputs.withColumn("plain", plain).withColumn("v", F.from_json("plain", OUTPUT + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    broken = F.col("v").isNull() | F.col("v._bad").isNotNull() | F.col("v.facts").isNull()
    facts = rows.filter(~broken).select("chunk_id", F.posexplode("v.facts").alias("pos", "f")).select("chunk_id", "pos", "f.*").withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    lacks = F.col("subject").isNull() | F.col("predicate").isNull() | F.col("object").isNull()
    reason = F.when(lacks, "a field is missing").when(~F.col("confidence").between(0.0, 1.0), "confidence is out of range")
    judged = facts.withColumn("reason", reason)
    rejected = rows.filter(broken).select("chunk_id", F.lit(-1).alias("pos"), F.lit("not the JSON asked for").alias("reason"))
    return judged.filter("reason is null").drop("reason"), rejected.unionByName(judged.filter("reason is not null").select("chunk_id", "pos", "reason"))


# ---- entities

def resolved(entities: DataFrame) -> DataFrame:
    """One row per project, name and type (in any case): the first id, and the first description that there is."""
    at = F.struct("created_at", "entity_id")
    rows = entities.withColumn("key_name", keyed(F.col("name"))).withColumn("key_type", keyed(F.coalesce("entity_type", F.lit("unknown"))))
    return rows.groupBy("project_id", "key_name", "key_type").agg(F.min_by("entity_id", at).alias("entity_id"), F.min_by("description", F.when(F.col("description").isNotNull(), at)).alias("description"), F.count(F.lit(1)).alias("n"))


def merge_map(entities: DataFrame) -> DataFrame:
    """entity_id, canonical_id of all entities: the first of those with the same project, name and type."""
    w = W.partitionBy("project_id", keyed(F.col("name")), keyed(F.coalesce("entity_type", F.lit("unknown")))).orderBy("created_at", "entity_id")
    return entities.select("entity_id", F.first("entity_id").over(w).alias("canonical_id"))


def redirected(facts: DataFrame, merges: DataFrame) -> DataFrame:
    moved = merges.filter("entity_id <> canonical_id").select(F.col("entity_id").alias("subject_id"), "canonical_id")
    return facts.join(moved, "subject_id", "left").withColumn("subject_id", F.coalesce("canonical_id", "subject_id")).drop("canonical_id").select(facts.columns)


def ingested(claims: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """claims(chunk_id, project_id, subject, predicate, object, confidence) as unverified facts with evidence; and orphans by chunk."""
    known = resolved(entities).groupBy("project_id", "key_name").agg(F.min("entity_id").alias("subject_id"))
    rows = claims.withColumn("key_name", keyed(F.col("subject")))
    found = rows.join(known, ["project_id", "key_name"]).select("chunk_id", "project_id", "subject_id", F.trim("predicate").alias("predicate"), F.trim("object").alias("object_text"), "confidence", F.lit("unverified").alias("status"), F.concat_ws(" ", "subject", "predicate", "object").alias("verbatim"))
    return found, rows.join(known, ["project_id", "key_name"], "left_anti").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("orphans"))


# ---- duplicates among facts

def merged_facts(facts: DataFrame) -> DataFrame:
    """canonical_id, fact_ids, confidence of facts with the same subject, predicate and object.

    Confidences are folded in order: each next one takes its share of what is still in doubt, to four places and 0.9999 at most.
    """
    rows = live(facts).withColumn("p", keyed(F.col("predicate"))).withColumn("o", keyed(F.col("object_text")))
    got = rows.groupBy("project_id", "subject_id", "p", "o").agg(F.array_sort(F.collect_list(F.struct("created_at", "fact_id", "confidence"))).alias("x"))
    fold = lambda a, y: F.least(F.round(1 - (1 - a) * (1 - y["confidence"]), 4), F.lit(0.9999))
    folded = F.aggregate(F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0))), F.col("x")[0]["confidence"], fold)
    return got.select(F.col("x")[0]["fact_id"].alias("canonical_id"), F.col("x.fact_id").alias("fact_ids"), F.when(F.size("x") == 1, F.col("x")[0]["confidence"]).otherwise(folded).alias("confidence"))


#: Facts of one key that are folded in one row; keys with more go by parts.
FEW = 10_000
#: Confidences after a step, in ten-thousandths.
STATES = 10_000


def by_content(facts: DataFrame) -> DataFrame:
    """key, created_at, fact_id, confidence as a written table; facts with the same project, subject, predicate and object share a key."""
    rows = live(facts).select("project_id", "subject_id", keyed(F.col("predicate")).alias("p"), keyed(F.col("object_text")).alias("o"), "created_at", "fact_id", "confidence")
    return cut(rows.select(F.sha2(F.to_json(F.struct("project_id", "subject_id", "p", "o"), {"ignoreNullFields": "false"}), 256).alias("key"), "created_at", "fact_id", "confidence"))


def fact_map(facts: DataFrame) -> DataFrame:
    """fact_id, canonical_id: the first fact with the same content. No array of a key's facts is made, and a key that many have can be split."""
    rows = by_content(facts)
    first = cut(rows.groupBy("key").agg(F.min(F.struct("created_at", "fact_id")).alias("first")))
    return rows.join(first, "key").select("fact_id", F.col("first.fact_id").alias("canonical_id"))


def four_places(x: np.ndarray) -> np.ndarray:
    """Rounded half up by their shortest decimals, as Spark does; in ten-thousandths."""
    y = x * 10_000
    out = np.floor(y + 0.5).astype(np.int64)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6).tolist():
        out[i] = int(Decimal(repr(float(x[i]))).quantize(Decimal("0.0001"), ROUND_HALF_UP).scaleb(4))
    return out


def step(states: np.ndarray, confidence: float) -> np.ndarray:
    """The states, in ten-thousandths, after one more fact."""
    if np.isnan(confidence):  # as `least` has it
        return np.full_like(states, STATES - 1)
    return np.minimum(four_places(1 - (1 - states / 10_000) * (1 - confidence)), STATES - 1)


def part_map(confidences: np.ndarray) -> np.ndarray:
    """What a part's facts make of each state that it may begin with. Soon few different states are left, and only those are carried on."""
    ends, of = np.arange(STATES), np.arange(STATES)
    for c in confidences.tolist():
        made = step(ends, c)
        if len(made) > 1:
            ends, again = np.unique(made, return_inverse=True)
            of = again[of]
        else:
            ends = made
        if len(ends) == 1 and ends[0] == STATES - 1 and confidences.min() >= 0 and confidences.max() <= 1:
            break
    return ends[of].astype(np.int16)


def folded_confidence(facts: DataFrame, few: int = FEW) -> DataFrame:
    """canonical_id, n_facts, confidence of facts with the same project, subject, predicate and object (see merged_facts), however many a key has.

    Keys with many facts are dealt by ranges of key and order. A part of a key becomes a map from the state before it to the state after it (a state has four
    places and 0.9999 at most, so there are ten thousand), and the maps of a key's parts, one for each task at most, are applied in order.
    """
    rows = by_content(facts)
    counts = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    many = counts.filter(F.col("n") > few)
    got = rows.join(many, "key", "left_anti").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("created_at", "fact_id", "confidence"))).alias("x"))
    fold = lambda a, y: F.least(F.round(1 - (1 - a) * (1 - y["confidence"]), 4), F.lit(0.9999))
    folded = F.aggregate(F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0))), F.col("x")[0]["confidence"], fold)
    small = got.select(F.col("x")[0]["fact_id"].alias("canonical_id"), F.size("x").cast("long").alias("n_facts"), folded.alias("confidence"))
    if many.isEmpty():
        return small
    first = cut(rows.groupBy("key").agg(F.min(F.struct("created_at", "fact_id", "confidence")).alias("first")).join(many, "key"))

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            for name, own in batch.groupby("key", sort=False)["confidence"]:
                made = part_map(own.to_numpy(float))
                held[name] = made[held[name]] if name in held else made
            for name in [x for x in held if x != batch["key"].iloc[-1]]:
                yield pd.DataFrame({"key": [name], "part": [part], "states": [held.pop(name).tobytes()]})
        for name, made in held.items():
            yield pd.DataFrame({"key": [name], "part": [part], "states": [made.tobytes()]})

    def applied(parts: pd.DataFrame) -> pd.DataFrame:
        x = parts["second"].iloc[0]
        for states in parts.dropna(subset="states").sort_values("part")["states"]:
            x = int(np.frombuffer(states, np.int16)[x])
        return pd.DataFrame({"canonical_id": parts["canonical_id"].iloc[:1], "n_facts": parts["n"].iloc[:1], "confidence": [x / 10_000]})

    # the first fact's confidence is taken as it is, so the second one's step is made before the maps
    rest = rows.join(first.select("key", F.col("first.fact_id").alias("of")), "key").filter(F.col("fact_id") != F.col("of")).drop("of")
    second = cut(rest.groupBy("key").agg(F.min(F.struct("created_at", "fact_id", "confidence")).alias("second")))
    begin = F.least(F.round(1 - (1 - F.col("first.confidence")) * (1 - F.col("second.confidence")), 4), F.lit(0.9999))
    start = first.join(second, "key").select("key", "n", F.col("first.fact_id").alias("canonical_id"), F.col("second.fact_id").alias("of"), F.round(begin * 10_000).cast("int").alias("second"))
    order = ["key", "created_at", "fact_id"]
    third = rest.join(start.select("key", "of"), "key").filter(F.col("fact_id") != F.col("of")).select(*order, "confidence").repartitionByRange(*order).sortWithinPartitions(*order)
    made = third.select("key", "confidence").mapInPandas(maps, "key string, part int, states binary")
    large = start.select("key", "n", "canonical_id", "second").join(made, "key", "left").groupBy("key").applyInPandas(applied, "canonical_id long, n_facts long, confidence double")
    return small.unionByName(large)


def relinked(evidence: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence of the canonical facts, and an audit row for each fact that was merged away."""
    to = merged.select("canonical_id", F.explode("fact_ids").alias("fact_id"))
    moved = evidence.join(to, "fact_id", "left").select(F.coalesce("canonical_id", "fact_id").alias("fact_id"), "chunk_id", "verbatim").distinct()
    return moved, to.filter("fact_id <> canonical_id").select(F.lit("FACT_MERGED").alias("action"), "fact_id", "canonical_id")


# ---- conflicts

def normal_value(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_\s.]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, f"{_EDGE[0]}(?:{'|'.join(UNITS)}){_EDGE[1]}", ""), r"\s+", " "))


def _first(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, f"{_EDGE[0]}({pattern}){_EDGE[1]}", 1)
    return F.when(found != "", found)


def number_in(text: Column) -> Column:
    return _first(text, r"\d+(?:\.\d+)?").cast("double")


def traits(value: Column) -> Column:
    """What decides a pair's kind: made once for a value that meets many."""
    return F.struct(normal_value(value).alias("normal"), number_in(value).alias("number"), _first(value, r"(?:19|20)\d{2}").alias("year"))


def kind_of(a: Column, b: Column) -> Column:
    """duplicate, numeric, temporal or needs_llm, in this order, by the traits of two values."""
    kind = F.when(a["normal"] == b["normal"], "duplicate").when(a["number"] != b["number"], "numeric")
    return kind.when(a["year"] != b["year"], "temporal").otherwise("needs_llm")


def pair_kind(a: Column, b: Column) -> Column:
    """The kind of a pair of values."""
    return kind_of(traits(a), traits(b))


def unordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("first_fact_id"), F.greatest(a, b).alias("second_fact_id"))


def with_kind(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("kind", pair_kind(F.col("first_object"), F.col("second_object")))


def candidates(facts: DataFrame, reports: DataFrame) -> DataFrame:
    """Pairs of facts of one subject and predicate whose objects differ, without an open report. first_fact_id < second_fact_id.

    The distinct objects of a subject and predicate are paired, then their facts are put in their place: facts of one value never meet, and there are no
    more rows on the way than there are pairs in the end.
    """
    key = ["project_id", "subject_id", "p"]
    rows = live(facts).select("fact_id", "project_id", "subject_id", keyed(F.col("predicate")).alias("p"), F.lower("object_text").alias("low"), "object_text", "confidence")
    objects = rows.select(*key, "low").distinct()
    pairs = objects.join(objects.select(*key, F.col("low").alias("high")), key).filter("low < high")
    side = lambda name: rows.select(*key, F.col("low").alias(name), F.struct("fact_id", "object_text", "confidence").alias(f"of_{name}"))
    both = pairs.join(side("low"), [*key, "low"]).join(side("high"), [*key, "high"])
    turned = F.col("of_low.fact_id") > F.col("of_high.fact_id")
    first, second = F.when(turned, F.col("of_high")).otherwise(F.col("of_low")), F.when(turned, F.col("of_low")).otherwise(F.col("of_high"))
    met = both.select(*key, first.alias("a"), second.alias("b")).select(
        "project_id", "subject_id", "p", F.col("a.fact_id").alias("first_fact_id"), F.col("b.fact_id").alias("second_fact_id"), F.col("a.object_text").alias("first_object"),
        F.col("b.object_text").alias("second_object"), F.col("a.confidence").alias("first_confidence"), F.col("b.confidence").alias("second_confidence"),
    )
    return met.join(unordered(reports.filter("status = 'open'"), "first_fact_id", "second_fact_id"), ["first_fact_id", "second_fact_id"], "left_anti")


def incremental(new: DataFrame, facts: DataFrame, reports: DataFrame, strict: bool = False) -> DataFrame:
    """Pairs of each new fact with its subject's active facts, of any predicate, without an open report.

    strict: siblings are only verified or unverified ones, and equal predicate and object are a duplicate at once.
    """
    allowed = ["verified", "unverified"] if strict else ACTIVE
    n = new.select(F.col("fact_id").alias("new_id"), "project_id", "subject_id", F.col("predicate").alias("new_predicate"), F.col("object_text").alias("new_object"), F.col("confidence").alias("new_confidence"))
    s = live(facts).filter(F.col("status").isin(allowed)).select(F.col("fact_id").alias("sibling_id"), "project_id", "subject_id", F.col("predicate").alias("sibling_predicate"), F.col("object_text").alias("sibling_object"), F.col("confidence").alias("sibling_confidence"))
    met = n.join(s, ["project_id", "subject_id"]).filter("new_id <> sibling_id")
    met = met.withColumn("first_fact_id", F.least("new_id", "sibling_id")).withColumn("second_fact_id", F.greatest("new_id", "sibling_id"))
    met = met.join(unordered(reports.filter("status = 'open'"), "first_fact_id", "second_fact_id"), ["first_fact_id", "second_fact_id"], "left_anti").dropDuplicates(["first_fact_id", "second_fact_id"])
    kind = pair_kind(F.col("new_object"), F.col("sibling_object"))
    if strict:
        same = (keyed(F.col("new_predicate")) == keyed(F.col("sibling_predicate"))) & (keyed(F.col("new_object")) == keyed(F.col("sibling_object")))
        kind = F.when(same, "duplicate").otherwise(kind)
    return met.withColumn("kind", kind)


def reports_of(pairs: DataFrame, predicate: str = "p") -> DataFrame:
    """Reports of decided pairs with reason, advice and score."""
    values = F.concat(F.lit("values differ between '"), "first_object", F.lit("' and '"), "second_object", F.lit("'."))
    reason = F.when(F.col("kind") == "duplicate", F.concat(F.lit("Deterministic duplicate fact: '"), predicate, F.lit(": "), "first_object", F.lit("'.")))
    reason = reason.when(F.col("kind") == "numeric", F.concat(F.lit("Numeric mismatch: '"), F.col(predicate), F.lit("' "), values)).otherwise(F.concat(F.lit("Temporal mismatch: "), values))
    advice = F.when(F.col("kind") == "duplicate", "Merge duplicate assertions.").when(F.col("kind") == "numeric", "Verify dosage/measurement units and values.").otherwise("Check temporal timeline records.")
    score = F.when(F.col("kind") == "duplicate", F.lit(0.95)).otherwise(F.round((F.col("first_confidence") + F.col("second_confidence")) / 2, 6))
    return pairs.filter("kind <> 'needs_llm'").select("first_fact_id", "second_fact_id", "kind", reason.alias("reasoning"), advice.alias("recommendation"), score.alias("score"))


def marked(facts: DataFrame, reports: DataFrame) -> DataFrame:
    """facts with status conflicted for those in a report."""
    ids = reports.select(F.explode(F.array("first_fact_id", "second_fact_id")).alias("fact_id")).distinct().withColumn("hit", F.lit(True))
    return facts.join(ids, "fact_id", "left").withColumn("status", F.when(F.col("hit"), "conflicted").otherwise(F.col("status"))).drop("hit")


def decided(reports: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes(fact_id, new_status, removed, conflict_id) that decisions make, and rejected decisions with a reason.

    resolve: the winner is verified, the other removed. ignore: both are verified. merge: both are superseded and removed.
    """
    rows = decisions.join(reports, "conflict_id", "left")
    reason = F.when(F.col("first_fact_id").isNull(), "no such conflict").when(F.col("status") == "resolved", "already resolved")
    reason = reason.when((F.col("action") == "resolve") & ~F.col("winner_id").isin(F.col("first_fact_id"), F.col("second_fact_id")), "winner is not in the pair")
    judged = rows.withColumn("reason", reason)
    each = judged.filter("reason is null").select("conflict_id", "action", "winner_id", F.explode(F.array("first_fact_id", "second_fact_id")).alias("fact_id"))
    loses = (F.col("action") == "resolve") & (F.col("fact_id") != F.col("winner_id"))
    status = F.when(F.col("action") == "merge", "superseded").when(loses, "rejected").otherwise("verified")
    changes = each.select("conflict_id", "fact_id", status.alias("new_status"), (loses | (F.col("action") == "merge")).alias("removed"))
    return changes, judged.filter("reason is not null").select("conflict_id", "action", "reason")


def merged_by_decision(reports: DataFrame, decisions: DataFrame, facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """The new verified facts of merge decisions, with the evidence of both: conflict_id, subject_id, predicate, object_text, chunk_ids."""
    rows = decisions.filter("action = 'merge'").join(reports.filter("status <> 'resolved'"), "conflict_id")
    chunks = rows.select("conflict_id", F.explode(F.array("first_fact_id", "second_fact_id")).alias("fact_id")).join(evidence, "fact_id").groupBy("conflict_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    first = facts.select(F.col("fact_id").alias("first_fact_id"), "subject_id", "predicate")
    return rows.join(first, "first_fact_id").join(chunks, "conflict_id", "left").select("conflict_id", "subject_id", "predicate", F.col("merged_text").alias("object_text"), F.lit(1.0).alias("confidence"), F.lit("verified").alias("status"), "chunk_ids")


# ---- clarification

def triggers(entities: DataFrame, facts: DataFrame, reports: DataFrame, questions: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """trigger_type, entity_id, fact_id, conflict_id, priority of what should be asked and is not yet. scope(fact_id) restricts it."""
    none = F.lit(None).cast("bigint")
    rows = live(facts)
    if scope is not None:
        rows = rows.join(scope.select("fact_id").distinct(), "fact_id", "left_semi")
        entities = entities.join(rows.select(F.col("subject_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    kind = F.col("entity_type")
    who = entities.filter(kind.isNull() | (kind == "unknown") | F.lower("name").contains("unknown")).select(F.lit("missing_entity").alias("trigger_type"), "entity_id", none.alias("fact_id"), none.alias("conflict_id"), F.lit("medium").alias("priority"))
    low = rows.filter(F.col("confidence") < LOW_CONFIDENCE).select(F.lit("low_confidence").alias("trigger_type"), none.alias("entity_id"), "fact_id", none.alias("conflict_id"), F.lit("low").alias("priority"))
    gap = rows.filter(keyed(F.coalesce("object_text", F.lit(""))).isin(MISSING)).select(F.lit("missing_value").alias("trigger_type"), none.alias("entity_id"), "fact_id", none.alias("conflict_id"), F.lit("medium").alias("priority"))
    open_ = reports.filter("status = 'open'").select(F.lit("conflict").alias("trigger_type"), none.alias("entity_id"), none.alias("fact_id"), "conflict_id", F.lit("high").alias("priority"))
    asked = questions.filter("status = 'open'").select("trigger_type", "fact_id").distinct()
    return reduce(DataFrame.unionByName, (who, low, gap, open_)).join(asked, ["trigger_type", "fact_id"], "left_anti")


def answered(questions: DataFrame, answers: DataFrame, facts: DataFrame) -> DataFrame:
    """answers(question_id, action, answer): the question's new status, and for approved ones the fact's new value and status."""
    rows = answers.join(questions, "question_id").join(facts.select("fact_id", "object_text", F.col("status").alias("fact_status")), "fact_id", "left")
    status = F.when(F.col("action") == "approve", "resolved").when(F.col("action") == "dismiss", "dismissed").otherwise("answered")
    yes = F.col("action") == "approve"
    return rows.select("question_id", status.alias("new_status"), "fact_id", F.when(yes, F.coalesce("answer", "object_text")).otherwise(F.col("object_text")).alias("object_text"), F.when(yes, "verified").otherwise(F.col("fact_status")).alias("fact_status"))


def question_list(questions: DataFrame, facts: DataFrame, entities: DataFrame) -> DataFrame:
    v = F.from_json("question", "question string, priority string")
    rows = questions.withColumn("v", v).join(facts.select("fact_id", "subject_id", "predicate", "object_text"), "fact_id", "left").join(entities.select(F.col("entity_id").alias("subject_id"), "name"), "subject_id", "left")
    return rows.select("question_id", F.coalesce("v.question", "question").alias("text"), F.coalesce("v.priority", F.lit("medium")).alias("priority"), "trigger_type", "status", "fact_id", "predicate", "object_text", "name")


# ---- review

def reviewed(facts: DataFrame, log: DataFrame) -> DataFrame:
    """Each fact after its latest action of log(event_id, fact_id, action, created_at, new_object), and how it was before."""
    acts = log.filter("action in ('approve', 'reject', 'modify')").groupBy("fact_id").agg(F.max(F.struct("created_at", "event_id", "action", "new_object")).alias("a"))
    rows = facts.join(acts, "fact_id")
    a = F.col("a.action")
    return rows.select("fact_id", a.alias("action"), F.col("status").alias("prior_status"), F.when(a == "reject", "rejected").otherwise("verified").alias("status"), F.when(a == "reject", F.col("confidence")).otherwise(F.lit(1.0)).alias("confidence"), F.when(a == "modify", F.col("a.new_object")).otherwise(F.col("object_text")).alias("object_text"), ((a == "reject") | F.col("deleted_at").isNotNull()).alias("removed"))


def undone(log: DataFrame) -> DataFrame:
    """fact_id, event_id, depth: the action that still stands after all undos, the log being a stack for each fact."""
    acts = log.filter("action in ('approve', 'reject', 'modify', 'undo')")
    got = acts.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "event_id", "action"))).alias("x"))
    step = lambda s, e: F.when(e["action"] == "undo", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(e["event_id"])))
    stack = F.aggregate("x", F.array().cast("array<bigint>"), step)
    return got.withColumn("stack", stack).select("fact_id", F.try_element_at("stack", F.lit(-1)).alias("event_id"), F.size("stack").alias("depth"))


def history(log: DataFrame, fact_id: int) -> DataFrame:
    """A fact's actions, newest first."""
    return log.filter((F.col("fact_id") == fact_id) & F.col("action").isin("approve", "reject", "modify", "undo")).orderBy(F.desc("created_at"), F.desc("event_id"))


def index_rows(facts: DataFrame, entities: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """A pseudo-chunk for each verified fact on the page of its first evidence, after that page's chunks."""
    page = evidence.groupBy("fact_id").agg(F.min("chunk_id").alias("chunk_id")).join(chunks.select("chunk_id", "document_id", "page_number"), "chunk_id")
    last = chunks.groupBy("document_id", "page_number").agg(F.max("chunk_index").alias("last"))
    rows = live(facts).filter("status = 'verified'").join(entities.select(F.col("entity_id").alias("subject_id"), "name"), "subject_id").join(page, "fact_id").join(last, ["document_id", "page_number"])
    nth = F.row_number().over(W.partitionBy("document_id", "page_number").orderBy("fact_id"))
    text = F.concat(F.lit("Fact ID: "), "fact_id", F.lit(" - "), F.trim("name"), F.lit(" "), F.trim("predicate"), F.lit(" is "), "object_text")
    return rows.select("fact_id", "document_id", "page_number", (F.col("last") + nth).alias("chunk_index"), text.alias("content"))


# ---- views

def graph(entities: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their degree, and edges."""
    rows = live(facts)
    edges = rows.select("fact_id", F.col("subject_id").alias("source"), F.col("object_text").alias("target"), F.trim("predicate").alias("label"), "status", "confidence")
    degree = rows.groupBy(F.col("subject_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("degree"))
    nodes = entities.select("entity_id", F.trim("name").alias("label"), "entity_type").join(degree, "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))
    return nodes, edges


def provenance(facts: DataFrame, entities: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Facts with subject, first evidence and its document; defaults where there is none."""
    first = evidence.groupBy("fact_id").agg(F.min(F.struct("chunk_id", "verbatim")).alias("e")).select("fact_id", "e.chunk_id", "e.verbatim")
    rows = facts.join(entities.select(F.col("entity_id").alias("subject_id"), "name"), "subject_id", "left").join(first, "fact_id", "left").join(chunks.select("chunk_id", "file_name", "page_number"), "chunk_id", "left")
    return rows.select("fact_id", F.coalesce(F.trim("name"), F.lit("Unknown")).alias("subject"), F.trim("predicate").alias("predicate"), "object_text", "verbatim", F.coalesce("file_name", F.lit("Unknown")).alias("file_name"), F.coalesce("page_number", F.lit(1)).alias("page_number"))


def review_list(facts: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Facts, newest first by position, with their evidence as parallel arrays of file, page and snippet."""
    e = evidence.join(chunks.select("chunk_id", "file_name", "page_number", snippet(F.col("content")).alias("snippet")), "chunk_id").groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "file_name", "page_number", "snippet"))).alias("e"))
    position = F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("fact_id")))
    return live(facts).select("fact_id", "project_id", position.alias("position")).join(e, "fact_id", "left").select("fact_id", "project_id", "position", F.col("e.file_name").alias("files"), F.col("e.page_number").alias("pages"), F.col("e.snippet").alias("snippets"))


def conflict_list(reports: DataFrame, sources: DataFrame) -> DataFrame:
    side = lambda n: sources.select(F.col("fact_id").alias(f"{n}_fact_id"), F.col("subject").alias(f"{n}_subject"), F.col("object_text").alias(f"{n}_object"), F.col("file_name").alias(f"{n}_file"))
    return reports.join(side("first"), "first_fact_id", "left").join(side("second"), "second_fact_id", "left").select("conflict_id", "status", "first_fact_id", "first_subject", "first_object", "first_file", "second_fact_id", "second_subject", "second_object", "second_file")


def dashboard(projects: DataFrame, entities: DataFrame, facts: DataFrame, reports: DataFrame, questions: DataFrame) -> DataFrame:
    """Counts by project: each table is grouped once."""
    e = entities.groupBy("project_id").agg(F.count(F.lit(1)).alias("entities"))
    f = live(facts).groupBy("project_id").agg(F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(F.col("status") == "unverified").alias("unverified"))
    c = reports.groupBy("project_id").agg(F.count_if(F.col("status") == "open").alias("open_conflicts"))
    q = questions.groupBy("project_id").agg(F.count_if(F.col("status") == "open").alias("open_questions"))
    joined = reduce(lambda a, b: a.join(b, "project_id", "left"), (e, f, c, q), projects)
    return joined.na.fill(0)


def monitor(evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """Of each chunk its distinct subjects and facts."""
    rows = evidence.select("fact_id", "chunk_id").distinct().join(live(facts).select("fact_id", "subject_id"), "fact_id")
    return rows.groupBy("chunk_id").agg(F.count_distinct("subject_id").alias("n_entities"), F.count(F.lit(1)).alias("n_facts"), F.array_sort(F.collect_set("subject_id")).alias("subjects"))


def report_values(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """project_id, predicate, object_text of the profile (the latest verified fact of each predicate)."""
    rows = live(facts).filter("status = 'verified'").join(entities.select(F.col("entity_id").alias("subject_id"), "entity_type"), "subject_id")
    profile = rows.filter(F.lower("entity_type").rlike("patient|profile|standard"))
    return profile.groupBy("project_id", keyed(F.col("predicate")).alias("predicate")).agg(F.max_by("object_text", F.struct("created_at", "fact_id")).alias("object_text"))


def rendered(facts: DataFrame, entities: DataFrame, html: bool = False) -> DataFrame:
    """project_id, subject_id, body: the verified findings of each subject as a list in Markdown or HTML."""
    rows = live(facts).filter("status = 'verified'").join(entities.select(F.col("entity_id").alias("subject_id"), F.trim("name").alias("name")), "subject_id")
    line = F.concat(F.lit("<li>" if html else "- "), F.trim("predicate"), F.lit(": "), "object_text", F.lit("</li>" if html else ""))
    got = rows.groupBy("project_id", "subject_id", "name").agg(F.array_sort(F.collect_list(F.struct("created_at", "fact_id", line.alias("line")))).alias("x"))
    head = F.concat(F.lit("<h2>" if html else "## "), "name", F.lit("</h2>" if html else ""))
    return got.select("project_id", "subject_id", F.concat(head, F.lit("\n"), F.array_join(F.col("x.line"), "\n")).alias("body"))
