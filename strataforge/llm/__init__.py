"""Operations of a training-data pipeline, each a job over DataFrames."""
