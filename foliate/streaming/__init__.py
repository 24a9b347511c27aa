"""Structured Streaming twins of the event folds: each drained stream gives the rows of its batch operator.

Output goes through foreachBatch into a folder per batch id, so a batch that is run again replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliate.operators import facts, quality, vectors
from foliate.operators.events import MAX_RETRIES, delivery_status
from foliate.sources import cut, shared_folder

#: Where a null time stands.
FIRST = -(1 << 63)


def drained(stream: DataFrame, each: Callable[[DataFrame, int], DataFrame], mode: str = "append") -> DataFrame:
    """All that is there now, batch by batch through `each`, which gets the batch and its number; the rows written."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        each(batch, number).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


#: What each kind of change does to the set of facts. An update brings its fact's image before and after.
SIGNS = {"insert": 1, "update_postimage": 1, "update_preimage": -1, "delete": -1}


#: Kinds of a pair; of several the first counts.
KINDS = ["duplicate", "needs_llm", "numeric", "temporal"]


def watch_conflicts(changes: DataFrame, known: DataFrame, reports: DataFrame, many: int = 10_000) -> DataFrame:
    """changes(facts' columns, change, version) as a stream: the pairs of a fact that came or changed with its subject's active facts, after all changes.

    Each change is a signed row, which its batch writes; no state is held and no batch reads what earlier ones brought. A pair's sign is the product of its rows' signs, and
    what is left of a pair is the sum over its rows, which is the product of sums: so the rows of a fact and value are summed first, in whatever order the files came, what
    was taken back goes, and only what is left is paired, once. A subject of more new facts than `many` is dealt over tasks by a hash of them, its other side being held as often.

    version: 0 for the image of a fact that was known before the stream, 1 and up for images that came with it. Known facts do not pair with each other,
    so images of version 0 are siblings only. Rows with a null fact, project or subject pair with nothing, as in the batch twin; an unknown change ends the job.
    A pair with an open report is left out. The log must be whole: an image that is taken back has to have come, be it later.
    """
    columns = ["fact_id", "project_id", "subject_id", "object_text", "new_sign", "sign"]
    sign = F.raise_error(F.concat(F.lit("no change is called "), F.coalesce("change", F.lit("null"))))
    for change, value in SIGNS.items():
        sign = F.when(F.col("change") == change, value).otherwise(sign)
    came = F.when(F.col("version") > 0, F.col("sign")).otherwise(0)
    counts = lambda rows: rows.withColumn("new_sign", came).withColumn("sign", F.when(F.col("deleted_at").isNull() & F.col("status").isin(facts.ACTIVE), F.col("sign")).otherwise(0)).select(columns)
    signed = drained(counts(changes.withColumn("sign", sign.cast("int"))), lambda batch, _: batch).select(columns)
    before = counts(known.withColumn("sign", F.lit(1)).withColumn("version", F.lit(0)))
    rows = signed.unionByName(before).filter("fact_id is not null and project_id is not null and subject_id is not null")
    summed = rows.groupBy(columns[:4]).agg(F.sum("new_sign").alias("n_new"), F.sum("sign").alias("n")).filter("n_new <> 0 or n <> 0")
    left_over = cut(summed.withColumn("traits", facts.traits(F.col("object_text"))).drop("object_text"))
    key = ["project_id", "subject_id"]
    parts = left_over.filter("n_new <> 0").groupBy(key).agg(F.ceil(F.count(F.lit(1)) / many).cast("int").alias("parts")).filter("parts > 1")
    dealt = left_over.join(cut(parts), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = dealt.filter("n_new <> 0").select(*key, F.pmod(F.xxhash64("fact_id"), "parts").cast("int").alias("part"), F.struct("fact_id", "n_new", "n", "traits").alias("a"))
    right = dealt.select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.struct("fact_id", "n_new", "n", "traits").alias("b"))
    # two new facts meet once, and count both ways
    met = left.join(right, [*key, "part"]).filter("a.fact_id <> b.fact_id and (b.n_new = 0 or a.fact_id < b.fact_id)")
    n = F.col("a.n_new") * F.col("b.n") + F.col("b.n_new") * F.col("a.n")
    kind = F.array_position(F.array(*map(F.lit, KINDS)), facts.kind_of(F.col("a.traits"), F.col("b.traits"))).cast("int")
    pair = ["first_fact_id", "second_fact_id"]
    pairs = met.select(F.least("a.fact_id", "b.fact_id").alias(pair[0]), F.greatest("a.fact_id", "b.fact_id").alias(pair[1]), kind.alias("kind"), n.alias("n")).filter("n <> 0")
    some = pairs.repartition(*pair).groupBy(*pair, "kind").agg(F.sum("n").alias("n")).filter("n > 0").groupBy(pair).agg(F.min("kind").alias("kind"))
    found = some.select(*pair, F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("kind"))
    return found.join(facts.unordered(reports.filter("status = 'open'"), *pair), pair, "left_anti")


def detect_conflicts(new: DataFrame, known: DataFrame, reports: DataFrame) -> DataFrame:
    """Each new fact against the facts of its subject that are known or have arrived, in its own batch or before; a pair found twice is one by its key.

    A fact that is known and arrives counts with both images; `watch_conflicts` replaces the one by the other.
    """
    return watch_conflicts(new.withColumn("change", F.lit("insert")).withColumn("version", F.lit(1)), known, reports)


def fold_deliveries(log: DataFrame) -> DataFrame:
    """log(message_id, attempt_ts, event_id, ok): status and retry_count of each message.

    Attempts may come in any order and as late as they like: of each batch a message's attempts are written up to the one that closes it, three at most, as what
    follows that one counts for nothing whatever else comes. The batch twin folds what was written; no state is held.
    """
    w = W.partitionBy("message_id").orderBy("attempt_ts", "event_id", F.desc("ok"))
    closed = F.coalesce(F.max("ok").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))

    def first(batch: DataFrame, _: int) -> DataFrame:
        return batch.withColumn("nth", F.row_number().over(w)).withColumn("closed", closed).filter((F.col("nth") <= MAX_RETRIES) & ~F.col("closed")).drop("nth", "closed")

    return delivery_status(drained(log.select("message_id", "attempt_ts", "event_id", F.coalesce("ok", F.lit(False)).alias("ok")), first).drop("batch"))


def fold_lifecycle(log: DataFrame, keep: int | None = None) -> DataFrame:
    """log(document_id, ts, event_id, is_valid): the status after each event in order of ts (null first), failures in a row being counted by document.

    Events may come in any order. The state has a document's events from the last `keep` microseconds of event time (all, where that is null) with the
    failures counted after each, and the count before them. A late event changes what follows it up to where the counts agree again; those rows are written once
    more, and the last one written counts. An event from before the state's bound comes back with a null status and count, so none goes missing.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base, bound, *held = state.get if state.exists else (0, FIRST, [], [], [], [])
        rows = pd.concat(list(batches))
        new = [(at, event, ok, None) for at, event, ok in zip(rows["at"].tolist(), rows["event_id"].tolist(), rows["is_valid"].tolist())]
        out = [(event, None, None) for at, event, _, _ in new if at < bound]
        count, kept = base, []
        for at, event, ok, known in sorted([*zip(*held), *(x for x in new if x[0] >= bound)], key=lambda x: x[:2]):
            count = 0 if ok else (count + 1) % MAX_RETRIES
            kept.append((at, event, ok, count))
            if known != count:
                out.append((event, "ready_for_chat" if ok else "failed" if count == 0 else "ready_for_reindex", count))
        if keep is not None and kept:
            bound = max(bound, kept[-1][0] - keep)
            base = next((c for at, _, _, c in reversed(kept) if at < bound), base)
            kept = [x for x in kept if x[0] >= bound]
        state.update((base, bound, *(list(x) for x in zip(*kept))) if kept else (base, bound, [], [], [], []))
        if out:
            yield pd.DataFrame({"document_id": key[0], "event_id": [x[0] for x in out], "status": [x[1] for x in out], "retry_count": pd.array([x[2] for x in out], "Int32")})

    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(FIRST))
    rows = log.select("document_id", "event_id", at.alias("at"), "is_valid")
    state = "base int, bound long, at array<long>, event_id array<long>, ok array<boolean>, count array<int>"
    out = rows.groupBy("document_id").applyInPandasWithState(step, "document_id long, event_id long, status string, retry_count int", state, "append", GroupStateTimeout.NoTimeout)
    last = drained(out, lambda batch, _: batch).groupBy("document_id", "event_id").agg(F.max_by(F.struct("status", "retry_count"), "batch").alias("s"))
    return last.select("document_id", "event_id", "s.status", "s.retry_count")


def ingest(chunks: DataFrame, model: str, dimension: int) -> DataFrame:
    """New chunks(document_id, chunk_id, content): embedded (unless they bring an embedding), checked, and the document's verdict for the batch."""

    def each(batch: DataFrame, _: int) -> DataFrame:
        vector = F.col("embedding") if "embedding" in batch.columns else vectors.embed(F.col("content"), model, dimension)
        made = batch.select("document_id", "chunk_id", vector.alias("embedding"))
        return quality.verdicts(batch.select("document_id").distinct(), quality.embedding_issues(made, dimension))

    return drained(chunks, each).groupBy("document_id").agg(F.bool_and("is_valid").alias("is_valid"))


def window_counts(events: DataFrame, size: str = "1 day") -> DataFrame:
    """events(ts, event_type) counted by windows of event time: each batch writes its own counts, which are added up afterwards.

    No row is too late and no window stays open; no state is held. A null ts is in no window.
    """
    windows = lambda batch: batch.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
    found = drained(events.withColumn("ts", F.col("ts").cast("timestamp")), lambda batch, _: windows(batch).select(F.col("window.start").alias("begin"), "event_type", "n"))
    return found.groupBy("begin", "event_type").agg(F.sum("n").alias("n"))
