"""themelens: market and theme trend analytics expressed as Spark DataFrame operators."""
