"""leafmill: document preparation and evidence analytics as Spark DataFrame operators."""
