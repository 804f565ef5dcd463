"""Knowledge-graph analytics on Spark: tables in, tables out."""
