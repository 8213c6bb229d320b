"""sievewright: curation and evaluation of language-model datasets on Spark DataFrames."""
