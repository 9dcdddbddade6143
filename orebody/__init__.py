"""orebody: a data-mining analytics engine on PySpark DataFrames."""
