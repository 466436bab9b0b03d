"""gaugeworks: Spark-native analytics for evaluating document pipelines.

Every operator takes and returns DataFrames (or Columns); nothing here collects
data to the driver unless a size bound is checked first.
"""

__version__ = "0.1.0"
