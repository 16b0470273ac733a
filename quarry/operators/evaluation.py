"""Evaluation sets: order-independent samples, pairs and their review."""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import aliases, usable_pair


def sample_priority(uuid_hex: Column, seed: int | None) -> Column:
    """The hash that ranks an id under a seed; without one, under 32 fresh random bytes."""
    told = b"nonce\0" + secrets.token_bytes(32) if seed is None else b"seed\0" + str(seed).encode()
    head = b"rag-evaluation-sample-v1\0" + told + b"\0"
    return F.sha2(F.concat(F.unhex(F.lit(head.hex())), F.unhex(uuid_hex)), 256)


def sample_chunks(chunks: DataFrame, n: int, seed: int | None, uuid_hex: str = "uuid_hex") -> DataFrame:
    """The n distinct ids of smallest hash: the same for any order and partitioning, and for a seed each time."""
    return chunks.select(uuid_hex).distinct().withColumn("priority", sample_priority(F.col(uuid_hex), seed)).orderBy("priority", uuid_hex).limit(n)


def generate_pairs(sample: DataFrame, fn: Callable[[str], str], retries: int = 1) -> DataFrame:
    """id, question, answer, ground_truth, error: one pair per sampled chunk from a user function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            replies, errors = [], []
            for text in g["content"]:
                reply = error = None
                for _ in range(retries + 1):
                    try:
                        reply, error = fn(text), None
                        break
                    except Exception as e:  # a failing call is counted, never fatal
                        error = type(e).__name__
                replies.append(reply)
                errors.append(error)
            yield pd.DataFrame({"id": g["id"], "reply": replies, "error": errors})

    raw = sample.select("id", "content").mapInPandas(run, "id long, reply string, error string")
    pair = usable_pair(F.col("reply"))
    out = raw.withColumn("_p", pair).select("id", "_p.question", "_p.answer", "_p.ground_truth", "error")
    return out.withColumn("error", F.coalesce("error", F.when(F.col("question").isNull(), "unusable reply")))


def regenerate_pairs(pairs: DataFrame, fresh: DataFrame, seen: DataFrame) -> DataFrame:
    """Pairs replaced whole by fresh ones of the same pair_id; one that changed in any way since ``seen`` stays.

    ``seen`` holds the pairs as they were when regeneration began. A fresh pair has question and
    answer; a column of pairs that it doesn't have starts anew where it tells of the old pair
    (ground_truth: the answer, status: pending) and stays where it tells of its chunk. A fresh pair
    without question leaves the old one.
    """
    told = [c for c in pairs.columns if c != "pair_id" and c in seen.columns]
    s = seen.select("pair_id", F.struct(*told).alias("_seen"))
    new = [c for c in fresh.columns if c != "pair_id" and c in pairs.columns]
    f = fresh.select("pair_id", F.struct(*new).alias("_new"))
    out = pairs.join(s, "pair_id", "left").join(f, "pair_id", "left")
    ok = F.col("_new.question").isNotNull() & F.struct(*told).eqNullSafe(F.col("_seen"))
    begun = {"ground_truth": F.col("_new.answer"), "status": F.lit("pending")}
    values = {c: F.col(f"_new.{c}") if c in new else begun.get(c, F.col(c)) for c in pairs.columns if c != "pair_id"}
    return out.select(*["pair_id" if c == "pair_id" else F.when(ok, values[c]).otherwise(F.col(c)).alias(c) for c in pairs.columns])


EDITABLE = ("question", "answer", "ground_truth")
STATUSES = ("approved", "edited", "rejected", "pending")


def edit_problem(edits: DataFrame) -> Column:
    """Why an edit is refused: blank content, unknown status, or content without the status ``edited``; else null."""
    content = [F.col(f) for f in EDITABLE if f in edits.columns]
    changed, blank = F.lit(False), F.lit(False)
    for c in content:
        changed = changed | c.isNotNull()
        blank = blank | F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")) == "", F.lit(False))
    unknown = F.col("status").isNotNull() & ~F.col("status").isin(*STATUSES)
    return F.when(blank, "blank content").when(unknown, "unknown status").when(changed & ~F.col("status").eqNullSafe("edited"), "content needs the status edited")


def rejected_edits(edits: DataFrame) -> DataFrame:
    """pair_id, reason of the edits that are refused."""
    return edits.select("pair_id", edit_problem(edits).alias("reason")).where("reason is not null")


def apply_pair_edits(pairs: DataFrame, edits: DataFrame) -> DataFrame:
    """``pairs`` with refused: non-null edit fields win unless the edit is refused (``rejected_edits`` says why).

    ``edits``: pair_id, status and any of question, answer and ground_truth; one row a pair.
    """
    fields = [f for f in (*EDITABLE, "status") if f in edits.columns and f in pairs.columns]
    e = edits.select("pair_id", edit_problem(edits).isNotNull().alias("_bad"), *[F.col(f).alias(f"_{f}") for f in fields])
    out = pairs.join(e, "pair_id", "left").withColumn("refused", F.coalesce("_bad", F.lit(False)))
    for f in fields:
        out = out.withColumn(f, F.when(~F.col("refused"), F.coalesce(f"_{f}", f)).otherwise(F.col(f)))
    return out.drop("_bad", *[f"_{f}" for f in fields])


def session_progress(pairs: DataFrame) -> DataFrame:
    """session, total, completed, failed, status; with a column ``cancelled``, also attempted and that status."""
    done, failed = F.count("question"), F.count("error")
    status = F.when((done == 0) & (failed > 0), "failed").otherwise("completed")
    if "cancelled" not in pairs.columns:
        return pairs.groupBy("session").agg(F.count("*").alias("total"), done.alias("completed"), failed.alias("failed"), status.alias("status"))
    status = F.when(F.max(F.col("cancelled").cast("int")) == 1, "cancelled").otherwise(status)
    return pairs.groupBy("session").agg(F.count("*").alias("total"), (done + failed).alias("attempted"), done.alias("completed"), failed.alias("failed"), status.alias("status"))


def eval_export_counts(pairs: DataFrame) -> DataFrame:
    saved = F.col("status").isin("approved", "edited")
    return pairs.groupBy("session").agg(F.sum(saved.cast("long")).alias("saved"), F.sum((~saved).cast("long")).alias("excluded"))


def eval_export(pairs: DataFrame, sessions: DataFrame, allow_historical: bool = False) -> DataFrame:
    """Counts per session with refused: a stale or orphaned session is no current baseline unless allowed."""
    old = F.coalesce("stale", F.lit(False)) | F.coalesce("orphaned", F.lit(False))
    state = sessions.select("session", old.alias("historical"))
    out = eval_export_counts(pairs).join(state, "session", "left").withColumn("historical", F.coalesce("historical", F.lit(False)))
    return out.withColumn("refused", F.col("historical") & F.lit(not allow_historical))


def eval_set(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("status").isin("approved", "edited")).select("question", "answer", "contexts", "ground_truth")


def flag_sessions(sessions: DataFrame, collections: DataFrame, flag: str, reason: str) -> DataFrame:
    """Sessions with ``flag`` and ``<flag>_reason`` set where their collection, in either spelling, is named.

    No session is deleted, and what earlier flaggings set stays where this one doesn't hit.
    """
    named = collections.select(F.explode(aliases(F.col("collection"))).alias("collection")).distinct().withColumn("_hit", F.lit(True))
    out = sessions.join(named, "collection", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    why = f"{flag}_reason"
    had = F.coalesce(F.col(flag), F.lit(False)) if flag in sessions.columns else F.lit(False)
    old = F.col(why) if why in sessions.columns else F.lit(None).cast("string")
    return out.withColumn(flag, had | F.col("_hit")).withColumn(why, F.when(F.col("_hit"), reason).otherwise(old)).drop("_hit")


#: Fields that belong to the installation a session comes from.
LOCAL_FIELDS = ("owner", "created_at", "finished_at")


def import_sessions(sessions: DataFrame, existing: DataFrame, collection: Column | str | None = None) -> DataFrame:
    """Sessions under their id if it is free, else under a new one, with where they come from; local fields go.

    New ids are numbered on from those that exist, so a session may be imported any number of times,
    and given twice at once: its first copy then takes the id if that is free.
    """
    own = F.col("session").cast("string")
    origin = [own.alias("session")] if collection is None else [own.alias("session"), (F.lit(collection) if isinstance(collection, str) else collection).alias("collection")]
    here = existing.select(own.alias("session")).distinct()
    rows = sessions.drop(*LOCAL_FIELDS).withColumn("imported_from", F.struct(*origin)).withColumn("session", own)
    rows = rows.join(here.withColumn("_taken", F.lit(True)), "session", "left")
    base = F.concat(F.lit("imported-"), F.substring(F.sha2(F.col("session"), 256), 1, 32))
    pattern = r"^(imported-[0-9a-f]{32})-(\d{1,9})$"
    # Ids of this form that exist, or that come in under their own name, are numbered on from.
    used = here.union(rows.select("session")).where(F.col("session").rlike(pattern))
    most = used.groupBy(F.regexp_extract("session", pattern, 1).alias("_base")).agg(F.max(F.regexp_extract("session", pattern, 2).cast("long")).alias("_most"))
    copy = F.row_number().over(W.partitionBy("session").orderBy(F.lit(1)))
    rows = rows.withColumn("_copy", copy).withColumn("_base", base).join(most, "_base", "left")
    free = F.col("_taken").isNull() & (F.col("_copy") == 1)
    fresh = F.concat("_base", F.lit("-"), (F.coalesce("_most", F.lit(0)) + F.col("_copy")).cast("string"))
    return rows.withColumn("session", F.when(free, F.col("session")).otherwise(fresh)).drop("_taken", "_copy", "_base", "_most")
