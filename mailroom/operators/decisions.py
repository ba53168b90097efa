"""Human decisions folded into message state (D3) and their activity rows
(part of K2).

decisions(email_id, seq, at, action, reply_body, new_draft,
custom_instructions), applied in ``seq`` order per message:

* approve -- status 'sent'; final_reply = the given body, or the draft
  current at that moment; human_edited when a non-empty body differs from
  that draft; replied_at = at; auto_sent = 0. Unknown message: no effect.
* reject -- status 'rejected'; logged even for an unknown message.
* regenerate -- the draft becomes new_draft. Unknown message: no effect.

Scale: every per-message result is an aggregate (``max_by``), combined
map-side, so one message holding a third of all decisions never lands in
one task. The only order-dependent value -- the draft each approval saw --
is an as-of lookup computed on ``seq`` buckets: a window per
(message, bucket) holds at most one bucket of rows, and the carry-in from
earlier buckets is a window over one row per (message, bucket).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Decisions of one message that meet in a window: those of this many numbers.
SEQ_WIDTH = 4096


def draft_as_of(approvals: DataFrame, regens: DataFrame, width: int) -> DataFrame:
    """For each approval (email_id, seq): the new_draft of the latest
    regenerate of the same message with a smaller seq, or NULL."""
    bucket = F.floor(F.col("seq") / F.lit(width))
    a = approvals.select("email_id", "seq").withColumn("_b", bucket)
    r = regens.select("email_id", "seq", "new_draft").withColumn("_b", bucket)
    # latest regenerate inside the same bucket, before the approval
    both = (a.select("email_id", "_b", "seq", F.lit(None).cast("string").alias("new_draft"),
                     F.lit(False).alias("_reg"))
            .unionByName(r.withColumn("_reg", F.lit(True))))
    w = (Window.partitionBy("email_id", "_b").orderBy("seq")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = (both.withColumn("_loc", F.last(F.when(F.col("_reg"), F.struct("seq", "new_draft")), True).over(w))
             .filter(~F.col("_reg")).select("email_id", "_b", "seq", "_loc"))
    # carry-in: latest regenerate in any earlier bucket
    seg = r.groupBy("email_id", "_b").agg(F.max_by(F.struct("seq", "new_draft"), F.col("seq")).alias("_last"))
    keys = a.select("email_id", "_b").distinct().join(seg, ["email_id", "_b"], "full")
    wb = (Window.partitionBy("email_id").orderBy("_b")
          .rowsBetween(Window.unboundedPreceding, -1))
    carry = keys.withColumn("_carry", F.last("_last", True).over(wb)).select("email_id", "_b", "_carry")
    out = local.join(carry, ["email_id", "_b"], "left")
    pick = F.coalesce(F.col("_loc"), F.col("_carry"))
    return out.select("email_id", "seq", pick["new_draft"].alias("draft_asof"),
                      pick.isNotNull().alias("_has_regen"))


def apply_decisions(emails: DataFrame, decisions: DataFrame, seq_width: int = SEQ_WIDTH) -> tuple[DataFrame, DataFrame]:
    """-> (new message state, activity rows).

    When ``emails`` already carries ``final_reply``, ``replied_at`` and
    ``human_edited`` (a state folded earlier, e.g. by the stream), messages
    without a new approval keep those values."""
    carried = [c for c in ("final_reply", "replied_at", "human_edited") if c in emails.columns]
    prior = [F.col(c).alias(f"_prev_{c}") for c in carried]
    e = emails.select("id", "status", "ai_draft", "auto_sent", *prior)
    known = decisions.join(e.select(F.col("id").alias("email_id")), "email_id", "left_semi")
    approvals = known.filter(F.col("action") == "approve")
    regens = known.filter(F.col("action") == "regenerate")
    asof = draft_as_of(approvals, regens, seq_width)
    orig = e.select(F.col("id").alias("email_id"), F.col("ai_draft").alias("_orig"))
    ap = (approvals.join(asof, ["email_id", "seq"], "left").join(orig, "email_id", "left")
          .withColumn("_draft", F.when(F.col("_has_regen"), F.col("draft_asof")).otherwise(F.col("_orig"))))
    given = F.coalesce(F.col("reply_body"), F.lit("")) != ""
    ap = (ap.withColumn("final_reply", F.when(given, F.col("reply_body")).otherwise(F.col("_draft")))
          .withColumn("human_edited", F.when(given & (F.col("reply_body") != F.coalesce(F.col("_draft"), F.lit(""))), 1)
                      .when(given & F.col("_draft").isNull(), 1).otherwise(0)))

    # final state: aggregates combined map-side
    st = (known.filter(F.col("action").isin("approve", "reject"))
          .groupBy("email_id").agg(F.max_by(F.when(F.col("action") == "approve", F.lit("sent"))
                                            .otherwise(F.lit("rejected")), F.col("seq")).alias("_status")))
    rg = regens.groupBy("email_id").agg(F.max_by("new_draft", F.col("seq")).alias("_draft_new"))
    la = ap.groupBy("email_id").agg(F.max_by(F.struct("final_reply", "human_edited", F.col("at").alias("replied_at")),
                                             F.col("seq")).alias("_ap"))
    s = (e.join(st.withColumnRenamed("email_id", "id"), "id", "left")
         .join(rg.withColumnRenamed("email_id", "id"), "id", "left")
         .join(la.withColumnRenamed("email_id", "id"), "id", "left"))
    def prev(c, default):
        return F.col(f"_prev_{c}").cast("timestamp_ntz") if c == "replied_at" and c in carried else (
            F.col(f"_prev_{c}") if c in carried else default)

    state = s.select(
        "id",
        F.coalesce("_status", "status").alias("status"),
        F.when(F.col("_draft_new").isNotNull(), F.col("_draft_new")).otherwise(F.col("ai_draft")).alias("ai_draft"),
        F.when(F.col("_ap").isNotNull(), F.col("_ap.final_reply"))
        .otherwise(prev("final_reply", F.lit(None).cast("string"))).alias("final_reply"),
        F.when(F.col("_ap").isNotNull(), F.col("_ap.replied_at").cast("timestamp_ntz"))
        .otherwise(prev("replied_at", F.lit(None).cast("timestamp_ntz"))).alias("replied_at"),
        F.when(F.col("_ap").isNotNull(), F.col("_ap.human_edited"))
        .otherwise(F.coalesce(prev("human_edited", F.lit(0)), F.lit(0))).alias("human_edited"),
        F.when(F.col("_ap").isNotNull(), F.lit(0)).otherwise(F.col("auto_sent")).alias("auto_sent"))

    def act(df, action, details):
        return df.select(F.concat(F.lit("dec-"), F.col("seq").cast("string")).alias("id"), "email_id",
                         F.lit(action).alias("action"), F.lit("human").alias("actor"),
                         details.alias("details"), F.col("at").cast("timestamp_ntz").alias("created_at"))

    ci = F.col("custom_instructions")
    acts = (act(ap, "approved_sent", F.when(F.col("human_edited") == 1, F.lit("Edited and sent"))
                .otherwise(F.lit("Approved AI draft")))
            .unionByName(act(regens, "draft_regenerated",
                             F.when(F.coalesce(ci, F.lit("")) != "", F.concat(F.lit("Custom: "), ci))
                             .otherwise(F.lit("Regenerated"))))
            .unionByName(act(decisions.filter(F.col("action") == "reject"), "rejected",
                             F.lit(None).cast("string"))))
    return state, acts
