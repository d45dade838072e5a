"""leadloom: business-lead analytics on Spark.

Captured directory pages, company websites and CSV files become DataFrames;
phone and name columns are cleaned with built-in column expressions; listings
of one company are resolved into one record; the leads table is searched,
filtered, tagged, edited, de-duplicated, imported into and exported as plain
DataFrame -> DataFrame transforms.
"""

__version__ = "0.1.0"
