"""Web pages to structured articles, as Spark DataFrame transformations."""
