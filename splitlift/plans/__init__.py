"""End-to-end plans, the query catalog and its SQL oracle."""
