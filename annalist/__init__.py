"""annalist: timelines from large document collections, as Spark DataFrame operators."""
