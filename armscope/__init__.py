"""armscope: curation and paired evaluation of natural-language-to-query data on Spark.

Every operator takes DataFrames and returns a lazy DataFrame built from
built-in Spark functions, so Catalyst plans the whole job.
"""

from armscope.session import build_session, work_dir

__all__ = ["build_session", "work_dir"]
