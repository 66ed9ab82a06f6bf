"""Tables, calendars and partitioned writes."""
