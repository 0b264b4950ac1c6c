"""tamarack: a Spark-native analytics engine for folders of mixed data.

Data-plane functions take and return DataFrames; planning functions work on
metadata-sized inputs on the driver.
"""

__version__ = "0.1.0"
