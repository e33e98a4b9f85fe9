"""strandlake: genomic-interval analytics as plain Spark DataFrames."""

from strandlake.session import get_spark, materialize, scratch_path

__all__ = ["get_spark", "materialize", "scratch_path"]
