"""Operations of a training-data pipeline on Spark DataFrames."""
