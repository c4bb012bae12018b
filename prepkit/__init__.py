"""prepkit: profile, clean, sample and split tables on Spark."""

from prepkit.plans.clean import CleanPlan, CleanResult, clean_to_parquet, run_clean
from prepkit.plans.prepare import Prepared, prepare, prepare_to_parquet
from prepkit.plans.profile import Profile, profile_table
from prepkit.sources.io import convert_to_parquet, read_table, write_table

__all__ = [
    "CleanPlan",
    "CleanResult",
    "Prepared",
    "Profile",
    "clean_to_parquet",
    "convert_to_parquet",
    "prepare",
    "prepare_to_parquet",
    "profile_table",
    "read_table",
    "run_clean",
    "write_table",
]
