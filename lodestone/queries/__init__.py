"""The engine's operators applied to the tables, each with SQL for the same result where SQL can say it."""
