"""corvane: a Spark-first analytics engine for multilingual document corpora and their processing ledgers."""
