"""DataFrame operators: joins, cleaning, filling, reshaping, tabulation, tests."""
