"""weekgrid: entity-week panel analytics expressed as Spark DataFrames."""
