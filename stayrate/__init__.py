"""Activity, attrition and cohort analytics on Spark DataFrames."""

from stayrate.params import Params

__all__ = ["Params"]
