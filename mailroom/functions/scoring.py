"""Confidence score and routing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Fixed values of the scoring rule.
BASE_SCORE = 0.7
HIGH_CONFIDENCE_INTENTS = ["general_inquiry", "order_status", "billing_question"]
LOW_CONFIDENCE_INTENTS = ["complaint", "urgent_issue", "refund_request"]
NEGATIVE_SENTIMENTS = ["angry", "frustrated"]
SHORT_BODY_CHARS = 50
SCORE_FLOOR = 0.1
SCORE_CEIL = 0.99
DEFAULT_THRESHOLD = 0.95


def _d(x: float) -> Column:
    return F.lit(float(x)).cast("double")


def confidence(intent, sentiment, urgency, has_knowledge, body_length) -> Column:
    """Score in [0.1, 0.99]. Terms are added in a fixed order on doubles so
    the result is bit-equal to the sequential rule."""
    i, s, u = col(intent), col(sentiment), col(urgency)
    score = _d(BASE_SCORE)
    score = (score
             + F.when(i.isin(HIGH_CONFIDENCE_INTENTS), _d(0.15)).otherwise(_d(0.0))
             - F.when(i.isin(HIGH_CONFIDENCE_INTENTS), _d(0.0))
               .when(i.isin(LOW_CONFIDENCE_INTENTS), _d(0.2)).otherwise(_d(0.0)))
    score = (score
             - F.when(s.isin(NEGATIVE_SENTIMENTS), _d(0.15)).otherwise(_d(0.0))
             + F.when(s.isin(NEGATIVE_SENTIMENTS), _d(0.0))
               .when(s == "positive", _d(0.05)).otherwise(_d(0.0)))
    score = (score
             - F.when(u == "critical", _d(0.3))
               .when(u == "high", _d(0.1)).otherwise(_d(0.0)))
    score = score + F.when(col(has_knowledge), _d(0.1)).otherwise(_d(0.0))
    score = score - F.when(col(body_length) < SHORT_BODY_CHARS, _d(0.1)).otherwise(_d(0.0))
    return F.greatest(_d(SCORE_FLOOR), F.least(_d(SCORE_CEIL), score))
