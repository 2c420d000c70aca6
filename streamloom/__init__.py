"""streamloom: keyed, event-time record streams as Spark plans."""
