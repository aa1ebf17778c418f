"""rxloom: Spark-first operators for product catalogues, registers and sales extracts."""
