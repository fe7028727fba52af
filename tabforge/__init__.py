"""tabforge: tabular learning on Spark DataFrames.

Takes a table and a target column and carries it from profiling to scored
predictions; every data-sized step is a DataFrame / MLlib job.
"""

__version__ = "0.1.0"
