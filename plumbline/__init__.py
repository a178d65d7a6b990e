"""Profiling, cleaning and modelling-readiness of tables on Spark."""

from plumbline.operators.cleaning import CleaningError, CleanResult, clean
from plumbline.operators.facts import column_facts
from plumbline.plans.analyze import Analysis, analyze
from plumbline.plans.cleaning_plan import propose_plan
from plumbline.plans.profile import Profile, profile, profile_record
from plumbline.sources.csv_files import ScanError, read_csv
from plumbline.streaming.admission import admission_audit, admission_stream

__all__ = [
    "Analysis", "CleanResult", "CleaningError", "Profile", "ScanError", "admission_audit", "admission_stream",
    "analyze", "clean", "column_facts", "profile", "profile_record", "propose_plan", "read_csv",
]
