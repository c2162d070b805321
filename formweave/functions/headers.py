"""Column headers: which priority class a header belongs to, and the class's threshold and weight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical headers by priority class, and headers of yes/no columns.
CRITICAL = ("questiontype", "questiontext", "englishquestionindextext", "sequence")
HIGH = ("branchinglogic", "section", "englishsection", "required", "requiredyesno", "autopopulated", "autopopulatedyesno", "answervalidation", "answertext", "englishanswertext")
MEDIUM = ("autopopulatewith", "autopopulatefield", "alert", "alertyesno", "alternatetext", "alternatetextyesno", "history", "historyyesno", "prepopulate", "prepopulateyesno", "speechtotext", "speechtotextyesno", "submissionhistory", "submissionhistoryyesno")
LOW = ("conceptcode", "conceptcodeformigrationuseonly", "tokenid", "tokenidpdfgeneration", "itnotes", "talkingpoints", "alerttype", "alerttext", "alternatequestiontext", "alternateanswertext")
YES_NO = ("alert", "alertyesno", "alternatetext", "alternatetextyesno", "autopopulated", "autopopulatedyesno", "history", "historyyesno", "prepopulate", "prepopulateyesno", "required", "requiredyesno", "speechtotext", "speechtotextyesno", "submissionhistory", "submissionhistoryyesno")
CLASSES = {"critical": CRITICAL, "high": HIGH, "medium": MEDIUM, "low": LOW}
THRESHOLDS = {"critical": 0.97, "high": 0.92, "medium": 0.85, "low": 0.99}
WEIGHTS = {"critical": 5.0, "high": 3.0, "medium": 1.0}


def _lookup(key: Column, table: dict[str, float]) -> Column:
    found = F.when(F.lit(False), F.lit(0.0))
    for name, value in table.items():
        found = found.when(key == name, F.lit(value))
    return found.otherwise(0.0)


def column_priority(canonical: Column) -> Column:
    found = F.when(F.lit(False), F.lit(""))
    for name, headers in CLASSES.items():
        found = found.when(canonical.isin(*headers), F.lit(name))
    return found.otherwise("unclassified")


def priority_threshold(priority: Column) -> Column:
    return _lookup(priority, THRESHOLDS)


def priority_weight(priority: Column) -> Column:
    return _lookup(priority, WEIGHTS)
