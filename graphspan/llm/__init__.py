"""Operations of a training-data pipeline over document, page, vector and benchmark tables."""
