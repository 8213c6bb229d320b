"""Declared schemas of the datasets; optional fields are nullable."""

from __future__ import annotations

from pyspark.sql import types as T

_LONG, _INT, _STR, _DBL, _BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


MESSAGE = _struct(role=_STR, content=_STR)
PAIRS = _struct(premise=_STR, hypothesis=_STR, label=_INT, id=_LONG)
THOUGHTS = _struct(id=_LONG, premise=_STR, hypothesis=_STR, thought_process=_STR, predicted_label=_INT, true_label=_INT, correct=_BOOL, chat_history=T.ArrayType(MESSAGE), reprompt_counts=_INT)
REFLECTIONS = _struct(id=_LONG, premise=_STR, hypothesis=_STR, predicted_label=_INT, true_label=_INT, thought_process=_STR, error_analysis=_STR, improved_thought_process=_STR)
VERDICT = _struct(score=_INT, predicted_label=_INT, improved_thought_process=_STR)
SCORES = _struct(id=_LONG, premise=_STR, hypothesis=_STR, thought_process=_STR, predicted_label=_INT, true_label=_INT, score_json=VERDICT, reprompt_counts=_INT)
SFT = _struct(text=_STR, id=_LONG)
RESULT = _struct(premise=_STR, hypothesis=_STR, predicted_label=_INT, output=_STR, true_label=_INT, correct=_BOOL, extraction_method=_STR)
METRICS = _struct(accuracy=_DBL, precision=_DBL, recall=_DBL, f1_score=_DBL)
COUNTS = _struct(output_count=_LONG, correct_count=_LONG, true_positives=_LONG, false_positives=_LONG, false_negatives=_LONG)
RESULT_FILE = _struct(
    model=_STR, inference_time_seconds=_DBL, samples_per_second=_DBL, use_cot=_BOOL, accuracy=_DBL, precision=_DBL, recall=_DBL, f1_score=_DBL,
    stats=METRICS, summary=_struct(stats=METRICS), counts=COUNTS, results=T.ArrayType(RESULT),
)
RUN_HISTORY = _struct(run=_STR, global_step=_LONG, train_loss=_DBL, eval_loss=_DBL, accuracy=_DBL)
RUN_LIST = _struct(id=_STR, name=_STR, state=_STR, created_at=_STR)
DEAD_LETTERS = _struct(id=_LONG, premise=_STR, hypothesis=_STR, true_label=_INT, error_info=_STR)
