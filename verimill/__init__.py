"""Knowledge-reliability analytics over whole document collections, on the public Spark API."""
