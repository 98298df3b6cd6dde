"""lodeworks: DataFrame operators for preparing training corpora on Spark."""
