"""plateflow: table work behind yard-camera plate recognition, as PySpark jobs.

Every operator takes DataFrames and returns a DataFrame; nothing is collected to the driver.
"""

__version__ = "0.1.0"
