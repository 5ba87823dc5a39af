"""Work-time pipelines: charges to weekly, week_table, monthly and yearly tables."""
