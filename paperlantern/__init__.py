"""Full-text document search expressed as Spark DataFrame plans.

Everything takes DataFrames and returns DataFrames.  Many collections
(``index_id``) and many queries (``query_id``) run in one plan.
"""

__version__ = "0.1.0"
