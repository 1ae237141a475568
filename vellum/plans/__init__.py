"""Plans: every operator as a query over the driver's tables, with the same in SQL."""
