"""Training-data operators: text statistics, classifiers, joins, search and mixing on Spark DataFrames."""
