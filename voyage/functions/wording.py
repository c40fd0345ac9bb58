"""The fixed texts and formats of samples, and small text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voyage.functions.numbers import value_text

# Wording of samples, as the models that read them expect it.
PREAMBLE = (
    "The following is a patient, starting with the demographic data, following visit by visit everything that the patient experienced. "
    "All lab codes refer to LOINC codes."
)
CONSTANT = "\n\nStarting with demographic data:\n"
FIRST_DAY = "\nOn the first visit, the patient experienced the following: \n"
DAY = "\n"
DAY_TEXT = " weeks later, the patient visited and experienced the following: \n"
DAY_END = ".\n"
GENETIC_OPEN, GENETIC_CLOSE, GENETIC_SKIP, GENETIC_NONE = "<genetic>", "</genetic>", "present", "No genetic data available."
CATEGORY_PREFIX = {"drug": "drug"}
REPLACED = {("death", "death"): "death"}
FORECAST_START = "\nYour task is to predict the future values of the following variables for each cumulative week starting from the last visit:\n"
FORECAST_TIME = " the future weeks "
SUMMARY_GENETIC = "\n\n\n\nHere we repeat the last observed values of each genetic event in the input data:\n"
SUMMARY_LOT = "\nThe most recent line of therapy:\n"
SUMMARY_NO_LOT = "\tNo line of therapy start information available.\n"
SUMMARY_LAST = "\nThe last values of the variables in the input data are:\n"
EVENT_START = "\nYour task is to predict whether the following event was censored "
EVENT_MID = " weeks from the last clinical visit and whether the event occured or not: "
EVENT_END = (
    ".\nPlease provide your prediction in the following format: 'Here is the prediction: the event (<name of event>) was [not] censored and [did not occur]/[occured].'"
)
ANSWER_START, ANSWER_WAS = "\nHere is the prediction: the event (", ") was "
CENSORED, NOT_CENSORED, AND, OCCURRED, NOT_OCCURRED = "censored ", "not censored ", "and ", "occurred.", "did not occur."
BINS_START = "\nYour task is to predict the appropriate bins for the future values of the following variables for each cumulative week starting from the date of the last visit:"
BINS_LIST = "\tThe possible bins are: "
TASKS_START = (
    "\nYou will now have multiple tasks to complete. Please answer for each task in the same order as they are presented. "
    "Before every response state the task nr, e.g. 'Task 2:'.\n\n"
)
TASK_KINDS = {"forecasting": "forecasting:", "forecasting_qa": "forecasting QA:", "events": "time to event prediction:", "custom": " a custom task:"}


def weeks_text(days: Column) -> Column:
    """Days as weeks of two decimals at most."""
    return value_text((days / 7).cast("string"))


def single_dash(text: Column) -> Column:
    """Runs of " - -" as one " - "."""
    return F.regexp_replace(text, r"(\s-\s-)+", " - ")


def words_and_signs(text: Column) -> Column:
    """A stand-in for a tokenizer's count: words, and single characters that are neither word nor space."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\w+|[^\w\s]"), F.lit(0)))
