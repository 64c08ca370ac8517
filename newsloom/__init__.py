"""newsloom: article discovery, scoring and reporting as Spark DataFrame jobs."""

from newsloom.profile import Profile

__all__ = ["Profile"]
