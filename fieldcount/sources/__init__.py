"""Reading raw deliveries and stored tables, and writing stage results."""
