"""factloom: document-to-facts analytics as Spark DataFrames."""
