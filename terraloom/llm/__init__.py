"""Operations of training-data pipelines over text and vectors."""
