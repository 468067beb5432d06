"""Generic table operators that the cohort and statistics modules compose."""
