"""lurescan — phishing / smishing message analytics as Spark DataFrame jobs.

Layout:
  sources/    readers, sinks, the stand-in message tables built from the test data
  functions/  Column -> Column expressions (cleaning, label rules, features)
  operators/  DataFrame -> DataFrame operators (tokens, vectors, splits,
              resampling, neighbours, models, evaluation, scoring)
  plans/      the registered queries and their DuckDB oracle SQL
  streaming/  the stateless scoring plan applied to a readStream
"""

from lurescan.session import get_session, scratch_dir  # noqa: F401
