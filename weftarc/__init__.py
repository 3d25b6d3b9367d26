"""Web-archive and table analytics on Spark DataFrames."""
