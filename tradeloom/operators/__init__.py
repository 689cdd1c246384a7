"""Trade and tariff operators: DataFrame in, DataFrame out."""
