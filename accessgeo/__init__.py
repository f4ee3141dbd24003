"""accessgeo: gridded observations, mapped assets and road graphs as Spark DataFrames."""
