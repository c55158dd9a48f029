"""weftline: record linking and training-data operators expressed as Spark DataFrame plans."""
