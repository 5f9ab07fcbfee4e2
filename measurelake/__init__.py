"""Statistical queries over long measurement tables, as Spark plans."""
