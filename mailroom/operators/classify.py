"""Model request/response tables, department resolution, scoring, routing
(M1-M8, M10, M11).

The language model itself is outside the engine: requests are written as a
table, responses come back as a table ``(email_id, response_text)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import DEFAULT_THRESHOLD, confidence
from ..functions import prompts as P
from ..functions.text import prefix, py_strip

# Fixed fallback classification for a response that is not valid JSON.
FALLBACK = {"intent": "general_inquiry", "department": "General", "sentiment": "neutral",
            "urgency": "normal"}
# Fixed defaults when no department exists at all.
NO_DEPT_TONE = "professional"
NO_DEPT_SIGNATURE = "Best regards,\nSupport Team"
# Fixed output texts (stored with the message and in its log).
NO_KB_HIT = "No specific KB match found."
KB_HIT = "Used knowledge base."
NO_KNOWLEDGE = "Nothing in the knowledge base fits this message; answer politely and ask what is needed."
CLASSIFY_BODY_CHARS = 1500
REPLY_BODY_CHARS = 2000
REGEN_CONTEXT_CHARS = 2000

OUTCOME_PARSED, OUTCOME_FALLBACK, OUTCOME_FAILED = "parsed", "fallback", "failed"


# ------------------------------------------------------------ M2 responses

def _vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def _field(j: Column, key: str) -> Column:
    return F.try_variant_get(j, f"$.{key}", "variant")


def _shown(j: Column, key: str) -> Column:
    """A scalar field as text: booleans ``True``/``False``, and fractions with
    their point (``1.0``); other values as they are."""
    text, kind = F.try_variant_get(j, f"$.{key}", "string"), _vtype(_field(j, key))
    return (F.when(kind == "BOOLEAN", F.initcap(text))
            .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.try_variant_get(j, f"$.{key}", "double").cast("string"))
            .otherwise(text))


def finite_numbers(t: Column) -> Column:
    """JSON text with the number words NaN, Infinity and -Infinity, outside of
    strings, read as null. Escapes are masked first, so each remaining quote
    opens or closes a string, and every other piece lies outside."""
    masked = F.replace(F.replace(t, F.lit("\\\\"), F.lit("\ue000")), F.lit('\\"'), F.lit("\ue001"))
    pieces = F.transform(F.split(masked, '"', -1), lambda p, i: F.when(
        i % 2 == 0, F.regexp_replace(p, r"(?<![\w-])(NaN|-?Infinity)(?!\w)", "null")).otherwise(p))
    back = F.replace(F.replace(F.array_join(pieces, '"'), F.lit("\ue001"), F.lit('\\"')), F.lit("\ue000"), F.lit("\\\\"))
    return F.when(t.rlike("NaN|Infinity") & ~t.rlike("[\ue000\ue001]"), back).otherwise(t)


_REQUIRED = ("intent", "department", "sentiment", "urgency")


def parse_response_frame(df: DataFrame, response_text: str = "response_text",
                         subject: str = "subject") -> DataFrame:
    """Append the parsed classification columns (outcome, intent,
    department, sentiment, urgency, summary, topics) to ``df``.

    Whitespace is stripped, every ```json and ``` fence removed, then the
    text is parsed as JSON. Not JSON -> the fixed fallback classification.
    JSON that cannot drive the pipeline (not an object; a required key
    missing; department not a string; intent/sentiment/urgency a list or
    object; key_topics null, a number, a boolean, an object, or a list with a
    non-string) -> ``failed``. A string key_topics counts its characters as
    topics.

    Built in stages (one projection each) so the text is cleaned once, the
    JSON parsed once and every field's type read once per row; Catalyst does
    not merge projections that would repeat these expressions.
    """
    keep = [c for c in df.columns]
    t = py_strip(F.regexp_replace(py_strip(F.coalesce(F.col(response_text), F.lit(""))), "```json|```", ""))
    s1 = df.withColumn("_t", finite_numbers(t))
    # The parser stops at the end of the first value. Inside an array that a
    # mark closes, which the text cannot know, anything after the value shows:
    # the array has to hold the value and the mark, and no more.
    mark = F.md5(F.col("_t").cast("binary"))
    framed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), "_t", F.lit(',"'), mark, F.lit('"]'))),
                               "$", "array<variant>")
    s2 = s1.withColumn("_framed", framed).withColumn("_mark", mark)
    s2 = s2.withColumn("_j", F.when(
        (F.size("_framed") == 2) & F.try_variant_get(F.get("_framed", F.lit(1)), "$", "string").eqNullSafe(F.col("_mark")),
        F.get("_framed", F.lit(0))))
    j = F.col("_j")
    s3 = s2.select(*keep, j.isNotNull().alias("_valid"),
                   _vtype(j).alias("_root"),
                   F.map_keys(F.try_variant_get(j, "$", "map<string,variant>")).alias("_keys"),
                   *[_vtype(_field(j, k)).alias(f"_ty_{k}") for k in (*_REQUIRED, "key_topics")],
                   *[_shown(j, k).alias(f"_s_{k}") for k in (*_REQUIRED, "summary", "key_topics")],
                   F.try_variant_get(j, "$.key_topics", "array<string>").alias("_topics_arr"))

    def has(k):
        return F.coalesce(F.array_contains(F.col("_keys"), k), F.lit(False))

    def scalar(k):
        ty = F.col(f"_ty_{k}")
        return has(k) & ~ty.startswith("OBJECT") & ~ty.startswith("ARRAY")

    valid = F.col("_valid")
    topics_t = F.col("_ty_key_topics")
    topics_arr = F.col("_topics_arr")
    topics_ok = (~has("key_topics")
                 | (topics_t == "STRING")
                 | ((topics_t == "ARRAY<STRING>") & ~F.exists(topics_arr, lambda x: x.isNull()))
                 | (topics_t == "ARRAY<VOID>") & (F.size(topics_arr) == 0))
    ok = (valid & F.col("_root").startswith("OBJECT") & has("department")
          & (F.col("_ty_department") == "STRING")
          & scalar("intent") & scalar("sentiment") & scalar("urgency") & topics_ok)
    s4 = s3.withColumn("_ok", ok)
    ok = F.col("_ok")
    topics = (F.when(~has("key_topics"), F.array().cast("array<string>"))
              .when(topics_t == "STRING", F.split(F.col("_s_key_topics"), ""))
              .otherwise(topics_arr))
    summary = F.when(has("summary"), F.col("_s_summary")).otherwise(F.col(subject))
    empty = F.array().cast("array<string>")
    outcome = (F.when(~valid, F.lit(OUTCOME_FALLBACK))
               .when(ok, F.lit(OUTCOME_PARSED)).otherwise(F.lit(OUTCOME_FAILED)))

    def pick(k):
        return (F.when(~valid, F.lit(FALLBACK[k])).when(ok, F.col(f"_s_{k}"))
                .otherwise(F.lit(None).cast("string")))

    return s4.select(
        *keep, outcome.alias("outcome"),
        *[pick(k).alias(k) for k in _REQUIRED],
        F.when(~valid, F.col(subject)).when(ok, summary).otherwise(F.lit(None).cast("string")).alias("summary"),
        F.when(~valid, empty).when(ok, topics).otherwise(F.lit(None).cast("array<string>")).alias("topics"))


def parse_responses(responses: DataFrame, emails: DataFrame) -> DataFrame:
    """responses(email_id, response_text) joined to the message subject
    (used by the fallback) -> one parsed row per response."""
    e = emails.select(F.col("id").alias("email_id"), "subject")
    p = responses.select("email_id", "response_text").join(e, "email_id", "left")
    return parse_response_frame(p).select(
        "email_id", "outcome", *_REQUIRED, "summary", "topics")


# ------------------------------------------------------------ M3 departments

def resolve_department(df: DataFrame, departments: DataFrame, predicted: str = "department") -> DataFrame:
    """Attach the department used for tone, signature and threshold: the
    case-insensitive name match, else the last department (highest ord),
    else fixed defaults. The predicted string itself is kept unchanged.

    Both joins are left to the planner, which broadcasts a table of departments
    if its size is below the threshold."""
    # first department (table order) per case-folded name
    d = departments.groupBy(F.lower("name").alias("_lname")).agg(F.min("ord").alias("_ord"))
    last_ord = departments.agg(F.max("ord")).scalar()
    m = df.join(d, F.lower(F.col(predicted)) == F.col("_lname"), "left")
    m = m.withColumn("_rord", F.coalesce(F.col("_ord"), last_ord)).drop("_lname", "_ord")
    dd = departments.select(F.col("ord").alias("_rord"), F.col("name").alias("dept_name"),
                            F.col("tone").alias("_tone"), F.col("signature").alias("_sig"),
                            F.col("auto_send_threshold").alias("_thr"))
    m = m.join(dd, "_rord", "left")
    return (m.withColumn("tone", F.coalesce("_tone", F.lit(NO_DEPT_TONE)))
            .withColumn("signature", F.coalesce("_sig", F.lit(NO_DEPT_SIGNATURE)))
            .withColumn("auto_send_threshold", F.coalesce("_thr", F.lit(DEFAULT_THRESHOLD)))
            .drop("_rord", "_tone", "_sig", "_thr"))


# ------------------------------------------------------------ M4-M6

def route(conf: Column, threshold: Column, auto_send_enabled: bool) -> Column:
    if not auto_send_enabled:
        return F.lit("pending_approval")
    return F.when(conf >= threshold, F.lit("auto_sent")).otherwise(F.lit("pending_approval"))


def reasoning(intent: Column, department: Column, sentiment: Column, has_kb: Column) -> Column:
    return F.concat(F.lit("Classified as "), F.coalesce(intent, F.lit("None")), F.lit(" for "),
                    F.coalesce(department, F.lit("None")), F.lit(". Sentiment: "),
                    F.coalesce(sentiment, F.lit("None")), F.lit(". "),
                    F.when(has_kb, F.lit(KB_HIT)).otherwise(F.lit(NO_KB_HIT)))


def log_detail(intent: Column, conf: Column) -> Column:
    """``Intent: X, Confidence: NN%`` (percent with no decimals)."""
    return F.concat(F.lit("Intent: "), F.coalesce(intent, F.lit("None")), F.lit(", Confidence: "),
                    F.format_string("%.0f%%", conf * 100.0))


def score(df: DataFrame, has_kb: str, body_chars: str) -> DataFrame:
    return df.withColumn("confidence_score", confidence("intent", "sentiment", "urgency",
                                                        F.col(has_kb), F.col(body_chars)))


# ------------------------------------------------------------ prompts

def dept_list(departments: DataFrame) -> Column:
    """``Name (description)`` of every department in table order, as a
    scalar subquery (evaluated once, then a constant)."""
    agg = departments.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", F.concat("name", F.lit(" ("), "description", F.lit(")")).alias("t")))),
        lambda x: x["t"]), ", ").alias("dl"))
    return agg.scalar()


def _s(c) -> Column:
    return F.coalesce(c, F.lit(""))


def _none(c) -> Column:
    return F.coalesce(c, F.lit("None"))


def classify_prompt(sender_name, sender_email, subject, body, depts: Column) -> Column:
    return P.render_spark(P.CLASSIFY, sender_name=_s(sender_name), sender_email=_s(sender_email),
                          subject=_s(subject), body=prefix(_s(body), CLASSIFY_BODY_CHARS),
                          departments=_s(depts))


def reply_prompt(ctx, sender_name, sender_email, subject, body, intent, department, sentiment, urgency,
                 tone, signature) -> Column:
    return P.render_spark(
        P.REPLY, context=F.coalesce(F.nullif(ctx, F.lit("")), F.lit(NO_KNOWLEDGE)),
        sender_name=F.coalesce(F.nullif(sender_name, F.lit("")), F.lit("Customer")),
        sender_email=_s(sender_email), subject=_s(subject), body=prefix(_s(body), REPLY_BODY_CHARS),
        intent=_none(intent), department=_none(department), sentiment=_none(sentiment),
        urgency=_none(urgency), tone=_s(tone), signature=_s(signature))


def regenerate_prompt(kb_ctx, sender_name, sender_email, subject, body, intent, sentiment, department,
                      instructions) -> Column:
    extra = F.when(_s(instructions) != "", F.concat(F.lit("\nExtra instructions: "), instructions)
                   ).otherwise(F.lit(""))
    return P.render_spark(
        P.REGENERATE, context=prefix(_s(kb_ctx), REGEN_CONTEXT_CHARS), sender_name=_none(sender_name),
        sender_email=_none(sender_email), subject=_none(subject), body=prefix(_s(body), REPLY_BODY_CHARS),
        intent=_none(intent), sentiment=_none(sentiment), department=_none(department), extra=extra)


# ------------------------------------------------------------ drafts

def apply_drafts(state: DataFrame, drafts: DataFrame) -> DataFrame:
    """drafts(email_id, draft_text) for triaged messages -> the state with
    ``ai_draft``, white space stripped at both ends. A message that was routed
    but whose draft is null (the call failed) is marked 'failed' and keeps no
    classification; one without a draft row waits: status and draft stay.
    Failed messages take no draft."""
    d = drafts.groupBy(F.col("email_id").alias("id")).agg(
        F.max(py_strip(F.col("draft_text"))).alias("_draft"), F.lit(True).alias("_came"))
    m = state.join(d, "id", "left")
    live = F.col("status") != "failed"
    broken = live & F.coalesce(F.col("_came"), F.lit(False)) & F.col("_draft").isNull()
    held = F.col("ai_draft") if "ai_draft" in state.columns else F.lit(None).cast("string")
    blank = {c: F.when(~broken, F.col(c)) for c in ("department", "intent", "sentiment", "ai_reasoning")}
    return m.select(*[blank.get(c, F.col(c)).alias(c) for c in state.columns if c not in (
                        "status", "ai_draft", "confidence_score", "urgency", "has_kb")],
                    F.when(broken, F.lit("failed")).otherwise(F.col("status")).alias("status"),
                    F.when(broken, F.lit(0.0)).otherwise(F.col("confidence_score")).alias("confidence_score"),
                    F.when(broken, F.lit("normal")).otherwise(F.col("urgency")).alias("urgency"),
                    (F.col("has_kb") & ~broken).alias("has_kb"),
                    F.when(live & F.col("_draft").isNotNull(), F.col("_draft")).when(~broken, held).alias("ai_draft"))


# ------------------------------------------------------------ M11 send results

def apply_send_results(triaged: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results(email_id, ok, sent_at) for auto-sent messages -> (new state,
    'auto_sent' activity rows). A failed send marks the message 'failed'."""
    r = results.select(F.col("email_id").alias("id"), F.col("ok").alias("_ok"), F.col("sent_at").alias("_at"))
    m = triaged.join(r, "id", "left")
    sent = (F.col("status") == "auto_sent") & F.coalesce(F.col("_ok"), F.lit(False))
    failed = (F.col("status") == "auto_sent") & (F.col("_ok") == F.lit(False))
    state = (m.withColumn("status", F.when(failed, F.lit("failed")).otherwise(F.col("status")))
             .withColumn("auto_sent", F.when(sent, F.lit(1)).otherwise(F.lit(0)))
             .withColumn("replied_at", F.when(sent, F.col("_at")).otherwise(F.lit(None).cast("timestamp_ntz")))
             .drop("_ok", "_at"))
    acts = m.filter(sent).select(
        F.concat(F.lit("send-"), F.col("id")).alias("id"), F.col("id").alias("email_id"),
        F.lit("auto_sent").alias("action"), F.lit("ai").alias("actor"),
        F.lit("Auto-sent based on confidence score").alias("details"), F.col("_at").alias("created_at"))
    return state, acts
