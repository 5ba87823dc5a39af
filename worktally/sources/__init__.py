"""Reading and checking feeds, and the sample feeds built from the test tables."""
