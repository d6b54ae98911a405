"""Table replication and parity as Spark jobs.

Every operator is a function of DataFrames plus explicit ``batch_ts``,
``batch_id`` and ``as_of`` values, so a run can be repeated and compared.
"""

__version__ = "0.1.0"
