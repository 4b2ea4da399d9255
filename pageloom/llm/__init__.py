"""Operations of a training-data pipeline, each on whole tables and each judged by its own contract."""
