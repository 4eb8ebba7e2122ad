"""voltmap: power-outage intelligence as Spark DataFrame operators."""
