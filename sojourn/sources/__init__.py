"""Reading claims and person tables, writing results, and the test-data binding."""
