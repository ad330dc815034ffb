"""inkprint: stylometry and open-set authorship attribution on Spark DataFrames."""
