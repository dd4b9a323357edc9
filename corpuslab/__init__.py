"""corpuslab: corpus analytics for multilingual text on Apache Spark."""
