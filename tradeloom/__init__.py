"""Trade and tariff analytics as Spark DataFrame operators."""
