"""loanlens: loan scorecard features, default flags and user targets on Spark.

Every operator is a function from DataFrames to a DataFrame built from
built-in Spark expressions. Clocks are explicit (`as_of`, `current_date`),
ties are broken on explicit keys, and money stays decimal until the output
edge, so results do not depend on row order or partitioning.

Layout:
    sources/    source mapping, soft-delete filters, schemas, readers/writers,
                and the adapter that derives lending tables from the test data
    functions/  pure Column expressions (banding, loose dates, regex cleaning)
    operators/  DataFrame -> DataFrame operators (delinquency, scoring, ...)
    plans/      composed tables (loan feature table) and the query registry
    streaming/  nothing: the reference has no streams (see README)
"""

from loanlens.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
