"""vocabra: cataloguing and comparing data vocabularies on Spark DataFrames."""
